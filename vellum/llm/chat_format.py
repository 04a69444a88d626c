"""Chat formatting of typed content parts: one marked, reversible text with a loss mask.

A turn's content is a list of parts. A visitor flattens them in order: neighbouring texts
are joined and escaped together, so that no control string forms where they meet; each
image, audio or document part becomes a numbered placeholder, its reference and the
number of tokens it expands to are recorded. The loss mask covers texts only. The output has a row per turn; the rows of a
conversation in order of ``place`` are its formatted text, so a conversation of any length
passes as a stream through one task.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm._shared import small_batches

OPEN, COLON, CLOSE, MARK = "### ", ": ", "</turn>\n", "<|"
#: Control strings and what stands for them inside a text.
ESCAPES = {"\\": "\\\\", "###": "\\h", "</turn>": "\\t", "<|": "\\p"}
_ROLE = ESCAPES | {":": "\\c", "\n": "\\n"}
_BACK = {v: k for k, v in _ROLE.items()}
_text_find = re.compile("|".join(map(re.escape, ESCAPES)))
_role_find = re.compile("|".join(map(re.escape, _ROLE)))
_back_find = re.compile(r"\\[\\htpcn]")

PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
ATTACHED = "array<struct<index:int,type:string,ref:string,at:long,tokens:long>>"
SCHEMA = f"conv_id long, place long, turn long, role string, segment string, start long, loss array<struct<start:int,end:int>>, attachments {ATTACHED}, expanded_tokens long"
_LOSS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_ATTACHED = pa.list_(pa.struct([("index", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())]))


def escape(text: str) -> str:
    return _text_find.sub(lambda m: ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return _back_find.sub(lambda m: _BACK[m[0]], text)


class Visitor:
    """Flattens the parts of one conversation's turns; placeholders are numbered through it."""

    patch, tokens_a_second, tokens_a_page = 28, 25, 1024

    def __init__(self):
        self.index = 0

    def visit(self, part: dict) -> tuple[str, int | None]:
        """(text as it is, None) or (placeholder, expanded tokens)."""
        return getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_unknown)(part)

    def visit_text(self, part: dict) -> tuple[str, None]:
        return part.get("text") or "", None

    def visit_unknown(self, part: dict) -> tuple[str, int]:
        return self._placed("unknown", 1)

    def _placed(self, kind: str, tokens: float) -> tuple[str, int]:
        self.index += 1
        return f"{MARK}{kind}:{self.index - 1}|>", max(1, math.ceil(tokens))

    def visit_image(self, part: dict) -> tuple[str, int]:
        return self._placed("image", math.ceil((part.get("width") or 0) / self.patch) * math.ceil((part.get("height") or 0) / self.patch))

    def visit_audio(self, part: dict) -> tuple[str, int]:
        return self._placed("audio", (part.get("seconds") or 0) * self.tokens_a_second)

    def visit_document(self, part: dict) -> tuple[str, int]:
        return self._placed("document", (part.get("pages") or 0) * self.tokens_a_page)


def _formatted(batches):
    conv, visitor, place, start = object(), Visitor(), 0, 0
    for b in batches:
        out: list[list] = [[] for _ in range(9)]
        for cid, turn, role, text, parts in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if cid != conv:
                conv, visitor, place, start = cid, Visitor(), 0, 0
            head = OPEN + _role_find.sub(lambda m: _ROLE[m[0]], role or "") + COLON
            body, attached, loss, at, texts = [], [], [], len(head), []

            def put(flat: str) -> None:
                nonlocal at
                body.append(flat)
                at += len(flat)

            def end_text() -> None:
                if text := escape("".join(texts)):
                    loss.append({"start": at, "end": at + len(text)})
                    put(text)
                texts.clear()

            for part in parts if parts is not None else [{"type": "text", "text": text}]:
                index = visitor.index
                flat, tokens = visitor.visit(part or {})
                if tokens is None:
                    texts.append(flat)
                    continue
                end_text()
                attached.append({"index": index, "type": part["type"], "ref": part.get("ref"), "at": start + at, "tokens": tokens})
                put(flat)
            end_text()
            segment = f"{head}{''.join(body)}{CLOSE}"
            loss = loss if role == "assistant" else []
            for c, v in zip(out, (cid, place, turn, role, segment, start, loss, attached, sum(a["tokens"] for a in attached)), strict=True):
                c.append(v)
            place += 1
            start += len(segment)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), _LOSS, _ATTACHED, pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["conv_id", "place", "turn", "role", "segment", "start", "loss", "attachments", "expanded_tokens"])


def format_chats(turns: DataFrame) -> DataFrame:
    """A row per turn of ``turns(conv_id, turn, role, text[, parts])``, see SCHEMA; offsets count code points.

    A turn's content is its ``parts`` (see PARTS) if the column is there and not null, else
    its text. Turns are ordered by turn (null first), equal ones by role and text, so ties
    and repeated rows have one order. Null texts and roles count as empty; rows without
    conv_id form one conversation. A part of an unknown type gets a placeholder that says so,
    and one token. ``loss`` has the spans of an assistant turn's texts in its segment,
    without placeholders; it is empty for other roles. An empty table gives no rows;
    further columns are ignored.
    """
    small_batches(turns.sparkSession)
    parts = F.col("parts").cast(PARTS) if "parts" in turns.columns else F.lit(None).cast(PARTS)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), parts.alias("parts"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_formatted, SCHEMA)


def parse(segment: str) -> tuple[str, str]:
    """(role, escaped content) of a formatted turn."""
    colon = segment.index(COLON, len(OPEN))
    if not segment.startswith(OPEN) or not segment.endswith(CLOSE):
        raise ValueError("not a formatted turn")
    return unescape(segment[len(OPEN) : colon]), segment[colon + len(COLON) : -len(CLOSE)]


def _digested(batches):
    conv, state = object(), None

    def row():
        return conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

    for b in batches:
        done = []
        for cid, segment, loss in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if cid != conv or state is None:
                if state is not None:
                    done.append(row())
                conv, state = cid, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, body = parse(segment)
            state[0] += 1
            state[1].update(f"{role}\n{unescape(body)}\n".encode())
            state[4] += len(segment)
            for span in loss:
                text = unescape(segment[span["start"] : span["end"]])
                state[2] += len(text)
                state[3].update(text.encode())
        yield _digests(done)
    if state is not None:
        yield _digests([row()])


_NAMES = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=_NAMES)


def chat_digest(formatted: DataFrame) -> DataFrame:
    """Per conversation what its formatted rows hold when they are parsed back."""
    rows = formatted.select("conv_id", "place", "segment", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return rows.select("conv_id", "segment", "loss").mapInArrow(_digested, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
