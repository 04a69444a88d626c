"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells by source, language and topic. Topics are a column of their own
or are fitted: long words are hashed to BUCKETS buckets, how many documents have each two
of them is counted over all texts, the buckets are clustered by the leading eigenvectors
of these counts, and a document's topic is the cluster that most of its long words are in.
Raking multiplies the token
weight of the cells by a factor per source, per language and per topic in turn until all
three marginals hold. The factors, scaled so that the wanted share of tokens is expected
and none exceeds 1, are the probabilities by which documents are sampled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm._shared import frugal, settle, small_batches, text_key, unsettle
from vellum.llm._text import U, Words, slices

DIMS = ["source", "lang", "topic"]
#: Up to so many cells are raked on the driver; beyond, as tables.
DRIVER_CELLS = 100_000
#: Buckets of words that topics are fitted on: one task gets at most BUCKETS ** 2 / 2 counts, whatever the corpus.
BUCKETS = 512


def _long_words(texts, least: int):
    """(words of each text, text and bucket of each word of at least ``least`` bytes) of each slice."""
    for _, _, buf, offs in slices(texts):
        w = Words(buf, offs, lower=True)
        long_ = w.end - w.start >= least
        yield np.diff(w.first), w.doc[long_], (w.hashes()[long_] % U(BUCKETS)).astype(np.int64)


def _counted(least: int):
    """(cell, n): in how many texts both buckets of a cell are, summed over the task."""

    def run(batches):
        sums = np.zeros((BUCKETS, BUCKETS))
        for b in batches:
            for n, doc, bucket in _long_words(b.column(0), least):
                for i in range(0, len(n), 512):
                    has = np.zeros((min(512, len(n) - i), BUCKETS), np.float32)
                    at = (doc >= i) & (doc < i + 512)
                    has[doc[at] - i, bucket[at]] = 1
                    sums += has.T @ has
        cell = np.flatnonzero(np.triu(sums).ravel())
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(sums.ravel()[cell].astype(np.int64))], names=["cell", "n"])

    return frugal(run)


def clustered(together: np.ndarray, topics: int) -> np.ndarray:
    """Topic of each bucket from a symmetric matrix of counts; buckets that no text has are in topic 0."""
    out, docs = np.zeros(len(together), np.int64), together.diagonal()
    has = np.flatnonzero(docs > 0)
    if len(has) <= topics:
        out[has] = np.arange(len(has))
        return out
    x = together[np.ix_(has, has)]
    # more often together than by chance
    x = np.log1p(x * docs.max() / np.outer(docs[has], docs[has]))
    x -= x.mean(axis=0)
    value, vector = np.linalg.eigh((x - x.mean(axis=1, keepdims=True)))
    e = vector[:, np.argsort(-np.abs(value), kind="stable")[:topics]]
    e /= np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-12)
    # k-means from the most frequent bucket and then the farthest ones
    centre = e[[int(docs[has].argmax())]]
    for _ in range(topics - 1):
        centre = np.vstack([centre, e[((e[:, None] - centre) ** 2).sum(axis=2).min(axis=1).argmax()]])
    for _ in range(50):
        at = ((e[:, None] - centre) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([e[at == k].mean(axis=0) if (at == k).any() else centre[k] for k in range(topics)])
        if np.allclose(new, centre):
            break
        centre = new
    out[has] = at
    return out


def _fitted(topics: int):
    def run(batches):
        together = np.zeros(BUCKETS * BUCKETS)
        for b in batches:
            together[b.column(0).to_numpy()] = b.column(1).to_numpy()
        together = together.reshape(BUCKETS, BUCKETS)
        found = clustered(together + np.triu(together, 1).T, topics)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS, dtype=np.int32)), pa.array(found)], names=["bucket", "topic"])

    return frugal(run)


def fit_topics(texts: DataFrame, topics: int, least: int = 5) -> np.ndarray:
    """Topic of each bucket, from all ``texts(text)``; one task clusters the counts, and BUCKETS rows reach the driver."""
    found = texts.mapInArrow(_counted(least), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for bucket, topic in found.repartition(1).mapInArrow(_fitted(topics), "bucket int, topic long").collect():
        out[bucket] = topic
    return out


def _topical(topic_of: np.ndarray, least: int):
    """n_tokens (words) and the topic that most long words are in: the first on ties, 0 without a long word."""
    topics = int(topic_of.max(initial=0)) + 1

    def run(batches):
        for b in batches:
            n, topic = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for words, doc, bucket in _long_words(b.column(1), least):
                n.append(words)
                topic.append(np.bincount(doc * topics + topic_of[bucket], minlength=len(words) * topics).reshape(-1, topics).argmax(axis=1))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in (0, 2, 3, 4, 5)), pa.array(np.concatenate(n)), pa.array(np.concatenate(topic).astype(str).tolist(), pa.string())], names=["doc_id", "source", "lang", "text_key", "given", "n_tokens", "topic"])

    return frugal(run)


def flattened(tokens: dict, power: float) -> dict:
    """Target shares in proportion to a power of what there is: 1 as it is, 0 all equal."""
    raised = {k: max(v, 0) ** power if v else 0.0 for k, v in tokens.items()}
    total = sum(raised.values()) or 1.0
    return {k: v / total for k, v in raised.items()}


def rake(weight: np.ndarray, index: list[np.ndarray], targets: list[np.ndarray], rounds: int = 200, close: float = 1e-9) -> np.ndarray:
    """Factor of each cell that brings the marginals of weight * factor to the targets (shares)."""
    factor, total = np.ones(len(weight)), weight.sum()
    for _ in range(rounds):
        worst = 0.0
        for at, target in zip(index, targets, strict=True):
            have = np.bincount(at, weight * factor, minlength=len(target))
            ratio = np.divide(target * total, have, out=np.ones(len(target)), where=have > 0)
            worst = max(worst, np.abs(ratio[have > 0] - 1).max(initial=0))
            factor *= ratio[at]
        if worst < close:
            break
    return factor


def calibrate(weight: np.ndarray, factor: np.ndarray, share: float) -> np.ndarray:
    """Probabilities in proportion to the factors, at most 1, that keep ``share`` of the weight in expectation if that can be."""
    want, p, capped = share * weight.sum(), np.zeros(len(weight)), np.zeros(len(weight), bool)
    while not capped.all():
        rest = (weight * factor)[~capped].sum()
        scale = (want - weight[capped].sum()) / rest if rest > 0 else 0.0
        p = np.where(capped, 1.0, factor * max(scale, 0.0))
        over = (p > 1) & ~capped
        if not over.any():
            break
        capped |= over
    return np.minimum(np.where(capped, 1.0, p), 1.0)


def _uniform(seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.coalesce("doc_id", "text_key"), F.lit(seed)), 11) / F.lit(float(1 << 53))


def mix_sources(docs: DataFrame, targets: dict[str, dict] | None = None, powers: dict[str, float] | None = None, share: float = 0.5, topics: int = 8, topic: str | None = None, seed: int = 1, keyed: bool = False) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, probability, kept) of ``docs(doc_id, text, source, lang)``.

    ``targets`` gives shares of tokens by value for source, lang or topic; a marginal
    without them is flattened by its power in ``powers`` (source 0.7, lang 0.8, topic 0.9).
    ``topic`` names a column of docs; without it topics "0", "1", ... are fitted (see above).
    Values that a given target leaves out get nothing. Targets that contradict each other
    or want more than there is are met as far as probabilities up to 1 allow. Tokens are
    words of the whole text. Null sources, languages and topics count as values of their own;
    null and empty texts have no tokens, topic "0" and the probability of their cell. Every
    row is sampled by a hash of doc_id alone, so repeated rows of an id in one cell stay
    or go together; a row without doc_id is sampled by its text. ``keyed`` adds text_key,
    the text's hash. No rows give none.
    """
    small_batches(docs.sparkSession)
    powers = {"source": 0.7, "lang": 0.8, "topic": 0.9} | (powers or {})
    text, given = F.col("text").cast("string").alias("text"), F.lit(None) if topic is None else F.col(f"`{topic}`")
    topic_of = fit_topics(docs.select(text), topics) if topic is None else np.zeros(BUCKETS, np.int64)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), text_key(), given.cast("string").alias("given"))
    rows = rows.mapInArrow(_topical(topic_of, 5), "doc_id long, source string, lang string, text_key long, given string, n_tokens long, topic string")
    rows = settle((rows if topic is None else rows.withColumn("topic", F.col("given"))).drop("given"), "mixing-rows")
    cells = settle(rows.groupBy(*DIMS).agg(F.sum("n_tokens").cast("double").alias("weight")), "mixing-cells")
    if cells.limit(DRIVER_CELLS + 1).count() <= DRIVER_CELLS:
        found = _on_driver(cells, targets or {}, powers, share)
    else:
        found = _as_tables(cells, targets or {}, powers, share)
    same = F.lit(True)
    for d in DIMS:
        same &= rows[d].eqNullSafe(found[d])
    out = rows.join(found, same, "left").select("doc_id", *(rows[d] for d in DIMS), "n_tokens", "probability", "text_key")
    out = out.withColumn("kept", _uniform(seed) < F.col("probability"))
    return out if keyed else out.drop("text_key")


def _on_driver(cells: DataFrame, targets: dict, powers: dict, share: float) -> DataFrame:
    """(dims, probability), raked in numpy: at most DRIVER_CELLS rows."""
    spark = cells.sparkSession
    table = sorted(cells.collect(), key=lambda r: tuple((r[d] is not None, r[d]) if r[d] is not None else (False, "") for d in DIMS))
    schema = cells.select(*DIMS).schema.add("probability", "double")
    if not table:
        return spark.createDataFrame([], schema)
    weight = np.array([r["weight"] or 0.0 for r in table])
    index, wanted = [], []
    for d in DIMS:
        values = list(dict.fromkeys(r[d] for r in table))
        at = np.array([values.index(r[d]) for r in table]) if len(values) < 64 else np.array([{v: i for i, v in enumerate(values)}[r[d]] for r in table])
        tokens = dict(zip(values, np.bincount(at, weight).tolist(), strict=True))
        target = targets.get(d) or flattened(tokens, powers[d])
        sure = sum(target.get(v, 0.0) for v in values if tokens[v]) or 1.0
        index.append(at)
        wanted.append(np.array([target.get(v, 0.0) / sure if tokens[v] else 0.0 for v in values]))
    p = calibrate(weight, rake(weight, index, wanted), share)
    return spark.createDataFrame([(*(r[d] for d in DIMS), float(x)) for r, x in zip(table, p, strict=True)], schema)


def _as_tables(cells: DataFrame, targets: dict, powers: dict, share: float, rounds: int = 200, close: float = 1e-9) -> DataFrame:
    """The same on DataFrames: rake's stop rule and calibrate's capping, with one scalar a round to the driver."""
    spark = cells.sparkSession
    total = cells.agg(F.sum("weight")).first()[0] or 0.0
    wanted = {}
    for d in DIMS:
        w = cells.groupBy(F.col(d).cast("string").alias("v")).agg(F.sum("weight").alias("t"))
        if targets.get(d):
            given = spark.createDataFrame([(str(k) if k is not None else None, float(v)) for k, v in targets[d].items()], "g string, share double")
            w = w.join(given, F.col("v").eqNullSafe(F.col("g")), "left").select("v", F.when(F.col("t") > 0, F.coalesce("share", F.lit(0.0))).otherwise(0.0).alias("share"))
        else:
            w = w.select("v", F.when(F.col("t") > 0, F.pow("t", F.lit(powers[d]))).otherwise(0.0).alias("share"))
        w = settle(w, f"mixing-{d}")
        sure = w.agg(F.sum("share")).first()[0] or 1.0  # of the values that have tokens
        wanted[d] = w.select("v", (F.col("share") / sure).alias("target"))
    raked = cells.withColumn("factor", F.lit(1.0))
    for i in range(rounds):
        now = raked.withColumn("off", F.lit(0.0))
        for d in DIMS:
            have = now.groupBy(F.col(d).cast("string").alias("h")).agg(F.sum(F.col("weight") * F.col("factor")).alias("have"))
            ratio = have.join(wanted[d], F.col("h").eqNullSafe(F.col("v")), "left").select("h", F.when(F.col("have") > 0, F.coalesce("target", F.lit(0.0)) * total / F.col("have")).otherwise(1.0).alias("ratio"))
            now = now.join(ratio, F.col(d).cast("string").eqNullSafe(F.col("h"))).select(*DIMS, "weight", (F.col("factor") * F.col("ratio")).alias("factor"), F.greatest("off", F.abs(F.col("ratio") - 1)).alias("off"))
        before, raked = raked, settle(now, "mixing-raked")
        if i:
            unsettle(before)
        if (raked.agg(F.max("off")).first()[0] or 0.0) < close:
            break
    scale, capped = 0.0, 0
    while True:  # the scale only grows, so what it has capped stays capped
        over = F.col("factor") * scale > 1
        n, sure, rest = raked.agg(F.count_if(over), F.sum(F.when(over, F.col("weight")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight") * F.col("factor")))).first()
        if scale and n <= capped:
            p = F.least(F.lit(1.0), F.col("factor") * scale)
            break
        if not rest or share * total <= sure:
            p = F.when(over, 1.0).otherwise(0.0)
            break
        scale, capped = (share * total - sure) / rest, n
    return raked.select(*DIMS, p.alias("probability"))
