"""Quality rules under weak supervision: rules vote or abstain, a latent quality explains the votes.

Each rule says good, bad or nothing about a text. Expectation-maximisation over the counts
of all vote patterns estimates how often each rule is right about good and about bad texts
and what share of texts is good; the posterior probability of a text's own pattern
replaces a conjunction of all rules. Patterns are counted in Spark over all documents.
Their number is bounded by 3 to the number of rules whatever the input, so the counts can
go to the driver and the posteriors back into the plan as a literal map.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm._shared import frugal, settle, small_batches, text_key
from vellum.llm._text import _SPACE, Prefixes, U, Words, mix, slices

SYMBOLS = b"#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_alpha_words", "n_ended_lines", "n_digits"]


def _is(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _DIGIT, _END = _is(SYMBOLS), _is(b"0123456789"), _is(b".!?:;\"')]")
_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _per(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    c = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=c[1:])
    return c[offs[1:]] - c[offs[:-1]]


def _again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which keys occur twice or more, which have an equal one before them)."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    both, later = np.zeros(len(k), bool), np.zeros(len(k), bool)
    both[order] = same[:-1] | same[1:]
    later[order] = same[:-1]
    return both, later


def stats(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The figures that rules look at, of each text of a slice."""
    docs = len(offs) - 1
    w = Words(buf, offs)
    out = {"n_words": np.diff(w.first)}
    points = (buf & 0xC0) != 0x80
    out["word_chars"] = _per(points & ~_SPACE[buf], offs)
    out["n_symbols"] = _per(_SYMBOL[buf], offs)
    out["n_digits"] = _per(_DIGIT[buf], offs)
    alpha = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(_ALPHA[buf], out=alpha[1:])
    out["n_alpha_words"] = np.bincount(w.doc[2 * (alpha[w.end] - alpha[w.start]) > w.end - w.start], minlength=docs)

    # lines that have a word; a text's last line ends where it ends
    cut = np.flatnonzero(buf == 10)
    start = np.unique(np.concatenate([offs[:-1][np.diff(offs) > 0], cut + 1]))
    start = start[start < len(buf)]
    start = start[buf[start] != 10]
    stop = np.unique(np.concatenate([cut, offs[1:]]))
    end = stop[np.searchsorted(stop, start, side="right")]
    words_to = np.searchsorted(w.start, np.stack([start, end]))
    full = words_to[1] > words_to[0]
    start, end, last = start[full], end[full], words_to[1][full] - 1
    line_doc = np.searchsorted(offs, start, side="right") - 1
    p = Prefixes(buf)
    key = mix(mix(p.spans(start, end) + (end - start).astype(U)) + line_doc.astype(U) * U(0x9E3779B97F4A7C15))
    out["n_lines"] = np.bincount(line_doc, minlength=docs)
    out["n_dup_lines"] = np.bincount(line_doc[_again(key)[1]], minlength=docs)
    out["n_ended_lines"] = np.bincount(line_doc[_END[buf[w.end[last] - 1]]], minlength=docs)

    covered = np.zeros(len(w.start), bool)
    if len(w.start) > 2:
        h = mix(p.spans(w.start, w.end) + (w.end - w.start).astype(U) * U(0xA0761D6478BD642F))
        at = np.flatnonzero(w.doc[2:] == w.doc[:-2])
        tri = mix(h[at] * U(3) + mix(h[at + 1] * U(5) + mix(h[at + 2] + w.doc[at].astype(U) * U(0x9E3779B97F4A7C15))))
        twice = at[_again(tri)[0]]
        for i in range(3):
            covered[twice + i] = True
    out["n_repeat_words"] = np.bincount(w.doc[covered], minlength=docs)
    return out


@frugal
def _measured(batches):
    for b in batches:
        parts = [stats(buf, offs) for _, _, buf, offs in slices(b.column(1))]
        cols = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in STATS]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(c.astype(np.int64)) for c in cols)], names=["doc_id", "text_key", *STATS])


@dataclass(frozen=True)
class Rule:
    """Votes good or bad where the conditions hold (good first), and abstains elsewhere."""

    name: str
    good: Callable[[], Column]
    bad: Callable[[], Column]


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


RULES = [
    Rule("long_enough", lambda: F.col("n_words") >= 60, lambda: F.col("n_words") < 50),
    Rule("word_length", lambda: (F.col("n_words") > 0) & _ratio("word_chars", "n_words").between(3, 10), lambda: (F.col("n_words") > 0) & ~_ratio("word_chars", "n_words").between(2.2, 14)),
    Rule("few_symbols", lambda: _ratio("n_symbols", "n_words") <= 0.1, lambda: _ratio("n_symbols", "n_words") > 0.3),
    Rule("fresh_lines", lambda: (F.col("n_lines") > 1) & (_ratio("n_dup_lines", "n_lines") <= 0.2), lambda: (F.col("n_lines") > 2) & (_ratio("n_dup_lines", "n_lines") > 0.4)),
    Rule("fresh_words", lambda: (F.col("n_words") > 0) & (_ratio("n_repeat_words", "n_words") <= 0.25), lambda: _ratio("n_repeat_words", "n_words") > 0.5),
    Rule("letters", lambda: (F.col("n_words") > 0) & (_ratio("n_alpha_words", "n_words") >= 0.8), lambda: (F.col("n_words") > 0) & (_ratio("n_alpha_words", "n_words") < 0.6)),
    Rule("ended_lines", lambda: (F.col("n_lines") > 0) & (_ratio("n_ended_lines", "n_lines") >= 0.3), lambda: (F.col("n_lines") > 4) & (_ratio("n_ended_lines", "n_lines") < 0.05)),
    Rule("few_digits", lambda: _ratio("n_digits", "word_chars") <= 0.1, lambda: _ratio("n_digits", "word_chars") > 0.3),
]


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 200, strength: float = 20.0) -> dict:
    """EM for vote patterns (1 good, 0 bad, -1 none) with their counts.

    Returns the share of good texts, each rule's accuracy about good and about bad ones,
    and each pattern's posterior. A rule's two accuracies start from, and are held by a
    Beta prior of ``strength`` votes at, 0.95 and 0.7, which keeps the two classes named
    as intended where votes are few; only votes that were given count.
    """
    share, good, bad = 0.9, np.full(votes.shape[1], 0.95), np.full(votes.shape[1], 0.7)
    says, none = votes == 1, votes < 0
    post = np.zeros(len(votes))
    for _ in range(rounds):
        lg = np.where(none, 0, np.where(says, np.log(good), np.log1p(-good))).sum(axis=1) + np.log(share)
        lb = np.where(none, 0, np.where(says, np.log1p(-bad), np.log(bad))).sum(axis=1) + np.log1p(-share)
        new = 1 / (1 + np.exp(np.clip(lb - lg, -700, 700)))
        done = np.abs(new - post).max(initial=0) < 1e-10
        post = new
        if done:
            break
        w, v = (counts * post)[:, None], (counts * (1 - post))[:, None]
        share = (w.sum() + 0.9 * strength) / (counts.sum() + strength)
        good = ((w * says).sum(axis=0) + 0.95 * strength) / ((w * ~none).sum(axis=0) + strength)
        bad = ((v * (~says & ~none)).sum(axis=0) + 0.7 * strength) / ((v * ~none).sum(axis=0) + strength)
        good, bad = np.clip(good, 0.5, 1 - 1e-6), np.clip(bad, 0.05, 1 - 1e-6)
    return {"share": share, "good": good, "bad": bad, "posterior": post}


def quality_rules(docs: DataFrame, rules: list[Rule] | None = None, keep_from: float = 0.5, keyed: bool = False) -> DataFrame:
    """(doc_id, the figures, base_failed, pattern, quality, kept) of ``docs(doc_id, text)``.

    ``quality`` is the posterior probability of a good text, ``pattern`` its votes, one
    letter a rule (g, b or -). A text fails the base rule with under 50 words or if more
    than half of its words lie in repeated windows of three; it is kept if it doesn't and
    its quality is at least ``keep_from``. Null and empty texts have zero figures and fail.
    Repeated rows are judged each by itself, ties follow from the pattern; doc_id may be
    null; further columns are ignored; an empty table gives an empty result. ``keyed``
    adds text_key, the text's hash, which tells rows of one doc_id apart.
    """
    rules = RULES if rules is None else rules
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key())
    found = settle(docs.mapInArrow(_measured, ", ".join(["doc_id long", "text_key long", *(f"{c} long" for c in STATS)])), "quality-stats")
    found = found if keyed else found.drop("text_key")
    vote = [F.when(r.good(), "g").when(r.bad(), "b").otherwise("-") for r in rules]
    found = found.withColumn("pattern", F.concat(*vote)).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    counted = sorted((r["pattern"], r["n"]) for r in found.groupBy("pattern").agg(F.count("*").alias("n")).collect())
    if not counted:
        return found.withColumn("quality", F.lit(0.0)).withColumn("kept", F.lit(False))
    votes = np.array([["b-g".index(c) for c in p] for p, _ in counted])
    votes = np.select([votes == 2, votes == 0], [1, 0], -1)
    fit = estimate(votes, np.array([n for _, n in counted], float))
    given = F.create_map(*[F.lit(x) for (p, _), q in zip(counted, fit["posterior"].tolist(), strict=True) for x in (p, q)])
    return found.withColumn("quality", given[F.col("pattern")]).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep_from))
