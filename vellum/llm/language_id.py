"""Language identification by inference of a mixture of languages.

Learning counts hashed byte trigrams of each language over all labelled training texts.
A text is explained word by word: a word's likelihood under a language is the product of
its trigrams'. Expectation-maximisation finds the proportions of languages in the text;
sets of the leading languages are compared by likelihood less half the logarithm of the
word count for each further language, and the leading one of the best set is returned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm._shared import small_batches
from vellum.llm._text import _LOWER, _SPACE, SLICE_BYTES, Words, slices

#: Trigram buckets; with L languages the model holds L * BUCKETS numbers, whatever the corpus.
BUCKETS = 1 << 14
ROUNDS = 12
#: Bytes times languages whose likelihoods are held at a time.
HELD = 1 << 20
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def trigrams(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Bucket of the trigram around each byte; white space and the ends of a text count as one space."""
    x = np.where(_SPACE[buf], 32, _LOWER[buf]).astype(np.uint32)
    before, after = np.empty_like(x), np.empty_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    begin, end = offs[:-1][np.diff(offs) > 0], offs[1:][np.diff(offs) > 0]
    before[begin], after[end - 1] = 32, 32
    h = (before << np.uint32(16)) | (x << np.uint32(8)) | after
    h *= np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    return h >> np.uint32(18)


def _counted(batches):
    """Counts of trigrams by language: (lang, bucket, n), summed over the task."""
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        langs = b.column(1).to_pylist()
        for i, _, buf, offs in slices(b.column(0)):
            if not len(buf):
                continue
            t = trigrams(buf, offs)
            inside = ~_SPACE[buf]
            for d, (x, y) in enumerate(pairwise(offs.tolist())):
                s = sums.setdefault(langs[i + d], np.zeros(BUCKETS, np.int64))
                s += np.bincount(t[x:y][inside[x:y]], minlength=BUCKETS)
    for lang, s in sums.items():
        at = np.flatnonzero(s)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(s[at])], names=["lang", "bucket", "n"])


def learn(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log probabilities [bucket, language] with add-a-half smoothing, of ``labelled(text, lang)``.

    Rows with a null text or lang are left out. All texts are counted; only the summed
    table, of BUCKETS rows a language, reaches the driver.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    found = rows.mapInArrow(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique().tolist())
    counts = np.zeros((BUCKETS, len(langs)))
    counts[found["bucket"].to_numpy(), found["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=int)] = found["n"].to_numpy()
    return langs, np.log((counts + 0.5) / (counts + 0.5).sum(axis=0)).astype(np.float32)


def mixture(ll: np.ndarray, first: np.ndarray, allowed: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """EM for the proportions of each text: word log likelihoods [word, language], words of text d at first[d]:first[d + 1], allowed [text, language].

    Returns proportions and the log likelihood of each text; every text must have a word.
    """
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    top = ll.max(axis=1)
    like = np.exp(np.maximum(ll - top[:, None], -60))
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        w = like * share[doc]
        w /= w.sum(axis=1, keepdims=True)
        share = np.add.reduceat(w, first[:-1], axis=0) / n[:, None]
    total = np.log((like * share[doc]).sum(axis=1)) + top
    return share, np.add.reduceat(total, first[:-1])


def infer(ll: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(leading language, its proportion, number of languages in the chosen set) of each text; every text must have a word."""
    n, k = np.diff(first), ll.shape[1]
    penalty = 0.5 * np.log(n + 1)
    single = np.add.reduceat(ll, first[:-1], axis=0)
    best = single.argmax(axis=1)
    share, full = mixture(ll, first, np.ones((len(n), k)))
    score, size = single.max(axis=1), np.ones(len(n), int)
    lead, part = best.copy(), share[np.arange(len(n)), best]
    order = np.argsort(-share, axis=1, kind="stable")
    # no set can gain more than all languages together
    open_ = np.flatnonzero(full - score > penalty)
    for m in range(2, k + 1):
        if not len(open_):
            break
        words = np.concatenate([np.arange(first[d], first[d + 1]) for d in open_])
        own = np.concatenate([[0], np.cumsum(n[open_])])
        allowed = np.zeros((len(open_), k))
        np.put_along_axis(allowed, order[open_, :m], 1, axis=1)
        s, got = mixture(ll[words], own, allowed)
        got -= (m - 1) * penalty[open_]
        better = np.flatnonzero(got > score[open_])
        d = open_[better]
        score[d], size[d] = got[better], m
        lead[d], part[d] = s[better].argmax(axis=1), s[better].max(axis=1)
    return lead, np.clip(part, 0.0, 1.0), size


def word_likelihoods(buf: np.ndarray, table: np.ndarray, piece: int) -> Iterator[np.ndarray]:
    """Log likelihoods [word, language] of the words of one text, read in pieces of bounded size; a word may span pieces."""
    n, carry = len(buf), None
    for a in range(0, n, piece):
        b = min(a + piece, n)
        lo, hi = max(a - 1, 0), min(b + 1, n)
        t = trigrams(buf[lo:hi], np.array([0, hi - lo]))[a - lo : b - lo]
        inside = ~_SPACE[buf[a:b]]
        sums = np.zeros((b - a + 1, table.shape[1]))
        np.cumsum(np.where(inside[:, None], table[t], 0), axis=0, dtype=np.float64, out=sums[1:])
        edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        ll = sums[end] - sums[start]
        if carry is not None:
            if len(start) and start[0] == 0:
                ll[0] += carry
            else:
                ll = np.concatenate([carry[None], ll])
            carry = None
        if len(end) and end[-1] == b - a and b < n:
            carry, ll = ll[-1], ll[:-1]
        if len(ll):
            yield ll
    if carry is not None:
        yield carry[None]


def infer_long(pieces: Callable[[], Iterator[np.ndarray]]) -> tuple[int, float, int]:
    """What ``infer`` finds for one text whose words come in pieces, again for each round."""

    def fit(allowed: np.ndarray) -> tuple[np.ndarray, float]:
        share = allowed / allowed.sum()
        for k in range(ROUNDS + 1):
            gained, n, total = np.zeros(len(share)), 0, 0.0
            for ll in pieces():
                top = ll.max(axis=1)
                w = np.exp(np.maximum(ll - top[:, None], -60)) * share
                s = w.sum(axis=1)
                if k == ROUNDS:
                    total += float((np.log(s) + top).sum())
                else:
                    gained += (w / s[:, None]).sum(axis=0)
                    n += len(ll)
            if k < ROUNDS:
                share = gained / n
        return share, total

    single, n = 0.0, 0
    for ll in pieces():
        single, n = single + ll.sum(axis=0), n + len(ll)
    k = len(single)
    share, full = fit(np.ones(k))
    lead, score, size, penalty = int(single.argmax()), float(single.max()), 1, 0.5 * np.log(n + 1)
    part = float(share[lead])
    if full - score > penalty:
        order = np.argsort(-share, kind="stable")
        for m in range(2, k + 1):
            allowed = np.zeros(k)
            allowed[order[:m]] = 1
            s, got = fit(allowed)
            if got - (m - 1) * penalty > score:
                score, size, lead, part = got - (m - 1) * penalty, m, int(s.argmax()), float(s.max())
    return lead, min(max(part, 0.0), 1.0), size


def _has_letter(body: bytes) -> bool:
    return any(c.isalpha() for c in body.decode("utf-8", "ignore"))


def _predicted(langs: list[str], table: np.ndarray):
    limit = max(1 << 10, min(SLICE_BYTES, HELD // max(1, len(langs))))

    def run(batches):
        for b in batches:
            pred, score, size = [], [], []
            for _, _, buf, offs in slices(b.column(1), limit):
                docs = len(offs) - 1
                p, s, z = np.full(docs, -1), np.zeros(docs), np.zeros(docs, int)
                w = Words(buf, offs)
                letters = np.concatenate([[0], np.cumsum(_ASCII_LETTER[buf])])
                known = letters[offs[1:]] > letters[offs[:-1]]
                for d in np.flatnonzero(~known & (np.diff(offs) > 0)):
                    known[d] = _has_letter(buf[offs[d] : offs[d + 1]].tobytes())
                has = np.flatnonzero((np.diff(w.first) > 0) & known)
                if len(has) and langs and len(buf) > 2 * limit:  # one long text
                    p[0], s[0], z[0] = infer_long(lambda buf=buf: word_likelihoods(buf, table, limit))
                elif len(has) and langs:
                    g = np.zeros((len(buf) + 1, len(langs)))
                    np.cumsum(table[trigrams(buf, offs)], axis=0, dtype=np.float64, out=g[1:])
                    of = known[w.doc]
                    ll = g[w.end[of]] - g[w.start[of]]
                    p[has], s[has], z[has] = infer(ll, np.concatenate([[0], np.cumsum(np.diff(w.first)[has])]))
                pred += [langs[i] if i >= 0 else "und" for i in p]
                score.append(s)
                size.append(z)
            cat = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0), t)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in (0,)), pa.array(pred, pa.string()), cat(score, pa.float64()), cat(size, pa.int32())], names=["doc_id", "lang_pred", "score", "n_langs"])

    return run


def identify(docs: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """(doc_id, lang_pred, score, n_langs) of ``docs(doc_id, text)`` under a learned model.

    ``und`` with score 0 for a null text, one without a letter, and for all texts if no
    language was learned; ties go to the first language in order. Texts are read whole,
    long ones in pieces for each round of inference, so memory is bounded; repeated rows are judged each by itself; doc_id may be null; no rows give none.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predicted(langs, table), "doc_id long, lang_pred string, score double, n_langs int")
