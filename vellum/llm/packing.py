"""Packing by lexical retrieval: windows filled with the BM25 neighbours of a seed document.

Documents are tokenized once and written. A document's locality is one of its rarer token
ids, the smallest under a fixed permutation, so similar documents tend to share it. The
number of localities is that of the vocabulary; from the token total of each the shards
are laid out, several small localities in one shard, a large one over several. Each shard
has an inverted index of its own over what is left of its documents after whole windows
have been cut off. The next unused document is a seed; its heaviest terms retrieve unused
neighbours, which fill the seed's window best first; the last one is cut at the window's
end and its rest goes back to the pool. What no longer fills a window is cut into
sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm._bpe import SLICE, encoder
from vellum.llm._shared import frugal, groups, settle, small_batches
from vellum.llm._text import U, mix, slices

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Token ids below this are common ones; a document's locality is taken from the others if it has any.
COMMON = 2000
#: Shards are dealt to as many partitions as there are shards, up to this number.
MOST_PARTITIONS = 50_000


def _tokenized(path: str, end_id: int):
    def run(batches):
        e = encoder(path)
        size = max(e.library.get_vocab_size(), end_id + 1)
        rank = np.empty(size, np.int64)
        rank[np.argsort(mix(np.arange(size, dtype=U) + U(77)), kind="stable")] = np.arange(size)
        back = np.argsort(rank)
        rank[:COMMON] += size  # common ids come after all others
        for b in batches:
            for i, j, buf, offs in slices(b.column(1), SLICE):
                ids, to = e.encode(buf, offs)
                ends = to + np.arange(len(to))
                out = np.empty(ends[-1], "<u4")
                stop = np.zeros(len(out), bool)
                stop[ends[1:] - 1] = True
                out[stop], out[~stop] = end_id, ids
                low = np.minimum.reduceat(rank[out], ends[:-1])
                raw = out.astype("<u2").tobytes() if size <= 1 << 16 else out.tobytes()
                width = 2 if size <= 1 << 16 else 4
                body = [raw[x * width : y * width] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(back[low % size].astype(np.int32)), pa.array(np.diff(ends)), pa.array(np.full(j - i, width, np.int32)), pa.array(body, pa.binary())],
                    names=["doc_id", "locality", "n", "width", "ids"],
                )

    return frugal(run, keeps="vellum.llm._bpe")


class Index:
    """BM25 over bags of token ids."""

    def __init__(self, ids: list[np.ndarray], k1: float = 1.2, b: float = 0.75):
        n = len(ids)
        size = np.array([len(x) for x in ids])
        doc = np.repeat(np.arange(n), size)
        pair, tf = np.unique((np.concatenate(ids).astype(np.int64) << 32) | doc, return_counts=True)
        term, self.doc = pair >> 32, (pair & 0xFFFFFFFF).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        df = np.diff(np.append(first, len(term)))
        self.begin, self.end = first, first + df
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        of = np.repeat(np.arange(len(first)), df)
        self.weight = idf[of] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[self.doc] / size.mean()))
        order = np.lexsort((-self.weight, self.doc))
        self.terms = of[order]
        self.own = np.searchsorted(self.doc[order], np.arange(n + 1))

    def scores(self, seed: int, query_terms: int) -> np.ndarray:
        """Scores of all documents for the heaviest terms of a seed."""
        out = np.zeros(len(self.own) - 1)
        for t in self.terms[self.own[seed] : min(self.own[seed + 1], self.own[seed] + query_terms)].tolist():
            at = slice(self.begin[t], self.end[t])
            out[self.doc[at]] += self.weight[at]
        return out


def pack(ids: list[np.ndarray], window: int, query_terms: int = 16):
    """(document, start, length, sequence, offset) of all pieces of a shard."""
    out, seq = [], 0
    start = np.zeros(len(ids), np.int64)
    for d, x in enumerate(ids):
        for s in range(0, len(x) - window + 1, window):
            out.append((d, s, window, seq, 0))
            seq += 1
            start[d] = s + window
    pool = [d for d in range(len(ids)) if start[d] < len(ids[d])]
    if not pool:
        return out
    index = Index([ids[d][start[d] :] for d in pool])
    left = np.array([len(ids[d]) - start[d] for d in pool])
    total, seed = int(left.sum()), 0

    def take(k: int, length: int, offset: int) -> None:
        d = pool[k]
        out.append((d, int(start[d]), length, seq, offset))
        start[d] += length
        left[k] -= length

    while total >= window:
        while not left[seed]:
            seed += 1
        fill = 0
        todo = [seed]
        score = index.scores(seed, query_terms)
        score[left == 0] = -1
        score[seed] = -1
        known = int((score > 0).sum())
        best = 64
        while fill < window:
            if not todo:  # more of the ranking, or any unused documents after it
                if best:
                    k = min(best, known)
                    at = np.argpartition(-score, k - 1)[:k] if 0 < k < len(score) else np.flatnonzero(score > 0)
                    at = at[np.lexsort((at, -score[at]))]
                    todo = [x for x in at.tolist() if left[x]]
                    best = 0 if k >= known else best * 8
                else:
                    todo = np.flatnonzero(left > 0).tolist()
                continue
            k = todo.pop(0)
            if not left[k]:
                continue
            length = min(int(left[k]), window - fill)
            take(k, length, fill)
            fill += length
        total -= window
        seq += 1
    size = 1 << max(0, total.bit_length() - 1)
    fill = 0
    for k in np.flatnonzero(left > 0).tolist():
        while left[k]:
            length = min(int(left[k]), size - fill)
            take(k, length, fill)
            fill += length
            if fill == size:
                total -= size
                size, fill, seq = 1 << max(0, total.bit_length() - 1), 0, seq + 1
    return out


def _packed(window: int, query_terms: int):
    def run(batches):
        for g in groups(batches, ["shard"]):
            g = g.combine_chunks()
            shard = g.column("shard")[0].as_py()
            ids = [np.frombuffer(x, "<u2" if w == 2 else "<u4") for x, w in zip(g.column("ids").to_pylist(), g.column("width").to_pylist(), strict=True)]
            pieces = pack(ids, window, query_terms)
            names = g.column("doc_id").combine_chunks() if isinstance(g.column("doc_id"), pa.ChunkedArray) else g.column("doc_id")
            for i in range(0, len(pieces), 1000):
                part = pieces[i : i + 1000]
                d, s, n, q, o = (np.array(c, np.int64) for c in zip(*part, strict=True))
                body = [ids[k][x : x + y].astype("<u4").tobytes() for k, x, y, _, _ in part]
                total = np.array([len(ids[k]) for k in d.tolist()])
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(d)), pa.array(s), pa.array(n), pa.array(body, pa.binary()), pa.array(total), pa.array((np.int64(shard) << 32) | q), pa.array(o)],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

    return frugal(run)


def layout(tokens: dict[int, int], shard_tokens: int) -> dict[int, tuple[int, int]]:
    """(first shard, number of shards) of each locality: in order of locality, filled to shard_tokens."""
    out, before = {}, 0
    for k, n in sorted(tokens.items()):
        out[k] = (before // shard_tokens, max(1, round(n / shard_tokens)))
        before += n
    return out


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = 2048, shard_tokens: int = 1 << 20, query_terms: int = 16) -> DataFrame:
    """Pieces of all ``docs(doc_id, text)`` in sequences of at most ``window`` (a power of two) tokens, see PIECES.

    A document's ids are its whole text's with ``end_id`` after them; each lies in exactly
    one piece. ``ids`` are a piece's as little-endian unsigned 32-bit integers, ``start``
    the number of its document's ids before it, ``offset`` its place in the sequence.
    Every sequence has ``window`` tokens or another power of two. A null or empty text is
    its end id alone. Repeated rows are packed each; equal scores go by doc_id (null
    first), which also decides within a shard who seeds first. No rows give no pieces;
    further columns are ignored.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = settle(rows.mapInArrow(_tokenized(tokenizer, end_id), "doc_id long, locality int, n long, width int, ids binary"), "packing-ids")
    # at most one row a token id of the vocabulary
    tokens = {r["locality"]: r["n"] for r in ids.groupBy("locality").agg(F.sum("n").alias("n")).collect()}
    places = layout(tokens, shard_tokens)
    if not places:
        return spark.createDataFrame([], PIECES)
    first = spark.createDataFrame([(k, *v) for k, v in places.items()], "locality int, first long, shards long")
    placed = ids.join(F.broadcast(first), "locality")  # bounded by the vocabulary
    shard = F.col("first") + F.pmod(F.xxhash64("doc_id", "n"), "shards")
    placed = placed.select("doc_id", shard.alias("shard"), "width", "ids")
    n = min(MOST_PARTITIONS, max(a + b for a, b in places.values()))
    return placed.repartition(n, "shard").sortWithinPartitions("shard", "doc_id", "ids").mapInArrow(_packed(window, query_terms), PIECES)
