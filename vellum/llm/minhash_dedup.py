"""Near duplicates by MinHash: universal hash minima, banding, verification on full sets.

1. Every text becomes its set of word shingles, 64-bit hashes of k words. Equal sets
   are one class from here on, with a number of its own: ids may be used again for other
   texts. The row of its smallest id (and text hash) stands for it.
2. Minima of the set under ``bands * rows`` universal hashes are cut into bands. What
   shares a bucket is compared by signatures before anything is closed transitively: a
   bucket is covered by leaders, each tied to all that may be linked with what it covers
   (Jaccard distance is a metric, so a link of a covered class ends within the radius and
   the wanted distance of the leader). A bucket above ``most`` classes is dealt over
   several tasks, whose leaders meet afterwards in tiles.
3. Components of these ties (large-star and small-star) hold every candidate pair inside.
   The full sets go once to the task of their component. There a pair is looked at only
   while its two ends are not connected: signatures first, and what they don't rule out on
   the full sets. A component above ``chunk`` classes is dealt over several tasks, each
   with some common pivots; the classes that then lie outside the largest verified part
   are compared with all chunks in a second pass, so that no link between parts is missed.
4. Components of the verified links name the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm._shared import frugal, groups, long_lists, settle, signed, small_batches, text_key
from vellum.llm._text import U, Words, constants, mix, shingles, slices
from vellum.llm.components import connected_components

#: Signatures are compared to this many standard deviations below the wanted similarity.
SLACK = 8
#: The same for ties, where a pair is estimated against the leaders of several buckets.
TIE_SLACK = 5
#: Minima that a signature keeps, a byte of each.
SIGNATURE = 128


def _sets(texts, words: int, lower: bool) -> Iterator[np.ndarray]:
    for _, _, buf, offs in slices(texts):
        w = Words(buf, offs, lower)
        h = w.hashes()
        for d in range(len(offs) - 1):
            yield np.unique(shingles(h[w.first[d] : w.first[d + 1]], words))


def minima(s: np.ndarray, n: int) -> np.ndarray:
    """Minima of a non-empty set under n multiply-add hashes of 32 bits."""
    x = s.astype(np.uint32)
    a, b = constants(n, 101).astype(np.uint32), constants(n, 202).astype(np.uint32)
    low = None
    for i in range(0, len(x), 512):
        part = (x[i : i + 512, None] * a + b).min(axis=0)
        low = part if low is None else np.minimum(low, part)
    return low


def _signed_rows(words: int, lower: bool, bands: int, rows: int):
    def run(batches):
        salt = constants(bands * rows, 303)
        if bands * rows < SIGNATURE:
            raise ValueError(f"at least {SIGNATURE} minima are needed")
        for b in batches:
            n, h1, h2, keys, signature = [], [], [], [], []
            for s in _sets(b.column(1), words, lower):
                n.append(len(s))
                m = mix(s ^ U(0x5851F42D4C957F2D))
                h1.append(m.sum(dtype=U))
                h2.append((m * (m >> U(7) | U(1))).sum(dtype=U))
                if len(s):
                    x = mix(minima(s, bands * rows).astype(U) + U(1))
                    signature.append(x[:SIGNATURE].astype(np.uint8).tobytes())
                    keys.append(signed(mix((x * salt).reshape(bands, rows).sum(axis=1, dtype=U) + constants(bands, 404))))
                else:
                    signature.append(b"")
                    keys.append(np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(signed(np.array(h1, U))), pa.array(signed(np.array(h2, U))), long_lists(keys), pa.array(signature, pa.binary())],
                names=["doc_id", "text_key", "n_shingles", "h1", "h2", "bands", "signature"],
            )

    return frugal(run)


def spanning(sig: np.ndarray, near: float, far: float) -> tuple[list[np.ndarray], np.ndarray]:
    """([members, leader] pairs that connect all within ``far`` of a leader, leaders) of signatures; leaders cover what is ``near``."""
    n = len(sig)
    label, covered, ties, leaders = np.arange(n), np.zeros(n, bool), [], []
    for i in range(n):
        if covered[i]:
            continue
        leaders.append(i)
        equal = (sig == sig[i]).sum(axis=1)
        covered |= equal >= near
        at = np.flatnonzero((equal >= far) & (label != label[i]))
        if len(at):  # one of each component is enough
            other, first = np.unique(label[at], return_index=True)
            ties.append(np.stack([at[first], np.full(len(first), i)]))
            label[np.isin(label, other)] = label[i]
    return ties, np.array(leaders, np.int64)


def _whole_groups(batches, keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, first row of each group) of sorted batches; the last group of a batch waits for the next batch."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([held, t]) if held is not None else t
        first = np.flatnonzero(np.concatenate([[True], *[_changes(t, keys)]]))
        if len(first) > 1:
            yield t.slice(0, int(first[-1])), first[:-1]
        held = t.slice(int(first[-1]))
    if held is not None and held.num_rows:
        yield held, np.zeros(1, np.int64)


def _changes(t: pa.Table, keys: list[str]) -> np.ndarray:
    out = np.zeros(t.num_rows - 1, bool)
    for k in keys:
        c = t.column(k).to_numpy()
        out |= c[1:] != c[:-1]
    return out


_TIES = "a long, b long, key long, signature binary"


def _tied(near: float, far: float):
    """Ties (a, b) of classes that share a bucket; of buckets in several parts also the leaders (a, key, signature)."""

    def run(batches):
        for t, first in _whole_groups(batches, ["key", "part"]):
            ids, several = t.column("node").to_numpy(), t.column("parts").to_numpy() > 1
            raw = t.column("signature").combine_chunks()
            sig = np.frombuffer(b"".join(raw.to_pylist()), np.uint8).reshape(-1, SIGNATURE)
            sizes = np.diff(np.append(first, len(ids)))
            lead = np.repeat(first, sizes)
            equal = (sig == sig[lead]).sum(axis=1)
            # with two in it, or all near the first, that one is the only leader needed
            simple = ((sizes == 2) | np.logical_and.reduceat(equal >= near, first)) & ~several[first]
            at = np.flatnonzero(np.repeat(simple, sizes) & (equal >= far) & (lead != np.arange(len(ids))))
            a, b, hot = [ids[at]], [ids[lead[at]]], []
            for g in np.flatnonzero(~simple & ((sizes > 1) | several[first])).tolist():
                rows = slice(int(first[g]), int(first[g] + sizes[g]))
                ties, leaders = spanning(sig[rows], near, far)
                for x, y in ties:
                    a.append(ids[rows][x])
                    b.append(ids[rows][y])
                if several[first[g]]:
                    hot.append(first[g] + leaders)
            hot = np.concatenate(hot) if hot else np.zeros(0, np.int64)
            a, b = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([a, ids[hot]])), pa.array([*b.tolist(), *[None] * len(hot)], pa.int64()), pa.array([*[None] * len(a), *t.column("key").to_numpy()[hot].tolist()], pa.int64()), pa.array([*[None] * len(a), *raw.take(pa.array(hot)).to_pylist()], pa.binary())],
                names=["a", "b", "key", "signature"],
            )

    return frugal(run)


def _bucket_ties(firsts: DataFrame, percent: int, most: int) -> DataFrame:
    """(a, b): ties of firsts(node, bands, signature) such that every pair of a bucket that may be linked is connected."""
    keys = firsts.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / most).alias("parts"))
    placed = keys.join(shared, "key").withColumn("part", F.pmod(F.xxhash64("node", "key"), "parts"))
    rows = settle(placed.join(firsts.select("node", "signature"), "node"), "minhash-buckets")
    noise = lambda j: TIE_SLACK * (max(j, 0.1) * (1 - max(j, 0.1)) / SIGNATURE) ** 0.5
    j = percent / 100
    near, far, apart = j, 2 * j - 1, 3 * j - 2
    found = rows.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(_tied(near * SIGNATURE, (far - noise(far)) * SIGNATURE), _TIES)
    found = settle(found.distinct(), "minhash-ties")
    ties = found.where("key IS NULL").select("a", "b")
    hot = found.where("key IS NOT NULL").select("key", F.col("a").alias("node"), "signature")
    if not hot.limit(1).count():
        return ties
    # leaders of one bucket's parts meet: all of them in one task if they are few, else each pair of chunks in a task
    chunks = hot.groupBy("key").agg(F.ceil(F.count("*") / most).alias("chunks"))
    dealt = hot.join(chunks, "key").withColumn("own", F.pmod(F.xxhash64("node", "key", F.lit(1)), "chunks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    part = F.least("own", "other") * F.lit(1_000_003) + F.greatest("own", "other")
    tiles = dealt.select("node", "key", "signature", part.alias("part"), F.lit(1).alias("parts"))
    more = tiles.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(_tied(SIGNATURE + 1, (apart - noise(apart)) * SIGNATURE), _TIES)
    return ties.unionByName(settle(more.select("a", "b").distinct(), "minhash-ties"))


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * |x and y| >= percent * |x or y|, of sorted distinct hashes."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def least_equal(j: float, hashes: int) -> float:
    """How many of the minima of a pair must be equal for its full sets to be compared."""
    return (j - SLACK * (j * (1 - j) / hashes) ** 0.5) * hashes


def _links(ids: np.ndarray, sets: list[np.ndarray], sides: np.ndarray, had: np.ndarray, percent: int):
    """Links that connect what is not connected yet; a pair is tried if one end is on side 0 and the other's side is >= its own."""
    n = len(ids)
    size = np.array([len(s) for s in sets])
    sig = np.stack([minima(s, SIGNATURE) for s in sets])
    cut = least_equal(percent / 100, SIGNATURE)
    label = np.arange(n)
    known = had >= 0  # parts that an earlier pass has verified
    label[known] = n + np.unique(had[known], return_inverse=True)[1]
    out = []
    for i in range(n - 1):
        rest = np.arange(i + 1, n)
        rest = rest[((sides[i] == 0) | (sides[rest] == 0)) & (label[rest] != label[i])]
        rest = rest[100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i])]
        if not len(rest):
            continue
        rest = rest[(sig[rest] == sig[i]).sum(axis=1) >= cut]
        for k in rest.tolist():
            if label[i] != label[k] and similar(sets[i], sets[k], percent):
                label[label == label[k]] = label[i]
                out.append((int(ids[i]), int(ids[k])))
    return out


def _verify(percent: int):
    def run(batches):
        for g in groups(batches, ["part", "chunk"]):
            g = g.combine_chunks()
            if g.num_rows < 2:
                continue
            ids = g.column("node").to_numpy()
            order = np.argsort(ids, kind="stable")
            raw = g.column("shingles").to_pylist()
            sets = [np.frombuffer(raw[i], U) for i in order]
            found = _links(ids[order], sets, g.column("side").to_numpy()[order], g.column("had").to_numpy()[order], percent)
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return frugal(run)


def _full(words: int, lower: bool):
    def run(batches):
        for b in batches:
            sets = [s.tobytes() for s in _sets(b.column("text"), words, lower)]
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("places"), pa.array(sets, pa.binary())], names=["node", "places", "shingles"])

    return frugal(run)


def _placed(dealt: DataFrame) -> DataFrame:
    return dealt.groupBy("node").agg(F.collect_set(F.struct("part", "chunk", "side", "had")).alias("places"))


def _sets_of(docs: DataFrame, classes: DataFrame, dealt: DataFrame, words: int, lower: bool) -> DataFrame:
    """(node, places, shingles): full sets of the nodes of ``dealt``, made from the texts of docs once."""
    first = _placed(dealt).join(classes.select("node", F.col("first.doc_id").alias("doc_id"), F.col("first.text_key").alias("text_key")), "node")
    # the same join at every size: a broadcast that only fits small inputs is no plan for large ones
    texts = docs.select("doc_id", "text_key", "text").join(first.hint("merge"), ["doc_id", "text_key"])
    sets = texts.select("node", "text", "places").mapInArrow(_full(words, lower), "node long, places array<struct<part:long,chunk:long,side:int,had:long>>, shingles binary")
    return settle(sets, "minhash-sets")


def _tried(sets: DataFrame, percent: int) -> DataFrame:
    """Links among sets(node, places, shingles) that share a place; places are rows (part, chunk, side, had)."""
    rows = sets.select("node", "shingles", F.explode("places").alias("p")).select("node", "p.*", "shingles")
    return rows.repartition("part", "chunk").sortWithinPartitions("part", "chunk").mapInArrow(_verify(percent), "a long, b long")


def minhash_dedup(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 48, rows: int = 6, lower: bool = True, chunk: int = 2000, pivots: int = 8, most: int = 4096, keyed: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of ``docs(doc_id, text)``.

    Two documents are linked if 100 * intersection >= percent * union of their sets of
    word shingles. With the default 32 bands of 4 a pair at 0.8 is missed with a
    probability of 5e-8, at 0.85 of 6e-11 (the cut of equal minima before full sets are
    compared adds less than 3e-12 to either); nothing below the threshold is ever linked.

    A text of fewer words than a shingle is one shingle. A null text and one without words
    have an empty set and are linked with nothing, not even with each other. Repeated rows
    are copies. Rows of one doc_id with different texts are judged each by its own text;
    where they fall into one component the smallest text hash of the smallest id is kept.
    A row without doc_id is returned with a null component and kept. An empty table gives
    an empty result; further columns are ignored. ``keyed`` adds text_key, the text's hash.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key())
    signed_rows = docs.mapInArrow(_signed_rows(words, lower, bands, rows), "doc_id long, text_key long, n_shingles long, h1 long, h2 long, bands array<long>, signature binary")
    signs = settle(signed_rows, "minhash-signs")

    usable = signs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = usable.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    classes = settle(classes.withColumn("node", F.monotonically_increasing_id()), "minhash-classes")
    firsts = usable.join(classes.select("h1", "h2", "first.*", "node"), ["h1", "h2", "doc_id", "text_key"])
    ties = _bucket_ties(firsts, percent, most)
    parts = settle(connected_components(ties, "minhash-ties").select("node", F.col("component").alias("part")), "minhash-parts")

    sizes = parts.groupBy("part").agg(F.count("*").alias("n"), F.min("node").alias("low")).select("part", F.ceil(F.col("n") / chunk).alias("chunks"))
    placed = parts.join(sizes, "part").select("node", "part", "chunks", F.pmod(F.xxhash64("node"), "chunks").alias("chunk"))
    common = _pivots(placed, pivots)
    dealt = placed.select("node", "part", "chunk", F.lit(0).alias("side"), F.lit(-1).cast("long").alias("had"))
    sets = _sets_of(docs, classes, dealt.unionByName(common), words, lower)
    links = settle(_tried(sets, percent), "minhash-links")

    large = placed.where("chunks > 1")
    if large.limit(1).count():
        links = settle(links.unionByName(_between(sets, large, links, percent, chunk)), "minhash-links")
    found = connected_components(links, "minhash-found")

    member = classes.join(found, "node", "left")
    lowest = member.where("component IS NOT NULL").groupBy("component").agg(F.min("first").alias("lowest"))
    named = member.join(lowest, "component", "left").select("h1", "h2", F.coalesce("lowest", "first").alias("first"))
    out = signs.select("doc_id", "text_key", "n_shingles", "h1", "h2").join(named, ["h1", "h2"], "left")
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id"))
    kept = alone | ((F.col("doc_id") == F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key")))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), "text_key")
    return out if keyed else out.drop("text_key")


def _pivots(placed: DataFrame, pivots: int) -> DataFrame:
    """For components of several chunks: a few classes that go to each of their chunks."""
    large = placed.where("chunks > 1")
    picked = large.groupBy("part").agg(F.max("chunks").alias("chunks"), *[F.min_by("node", F.xxhash64("node", F.lit(i))).alias(f"p{i}") for i in range(pivots)])
    ids = F.array_distinct(F.array(*[f"p{i}" for i in range(pivots)]))
    rows = picked.select("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), ids.alias("ids")).select("part", "chunk", F.explode("ids").alias("node"))
    # a pivot is in its own chunk already
    own = F.pmod(F.xxhash64("node"), F.col("chunks")) != F.col("chunk")
    rows = rows.join(picked.select("part", "chunks"), "part").where(own)
    return rows.select("node", "part", "chunk", F.lit(0).alias("side"), F.lit(-1).cast("long").alias("had"))


def _between(sets, large, links, percent, chunk) -> DataFrame:
    """Links between verified parts of large candidate components: what is outside the largest part meets every chunk."""
    inside = connected_components(links, "minhash-inside")
    have = settle(large.join(inside, "node", "left").withColumn("had", F.coalesce("component", "node")).drop("component"), "minhash-have")
    per = have.groupBy("part", "had").agg(F.count("*").alias("n"))
    top = per.groupBy("part").agg(F.max_by("had", F.struct("n", "had")).alias("top"))
    marked = have.join(top, "part")
    minor = marked.where("had <> top").select("node", "part", "had", "chunks")
    tiles = minor.groupBy("part").agg(F.ceil(F.count("*") / chunk).alias("tiles"))
    at = lambda c, t: (F.col(c) * 1_000_003 + F.col(t))
    stay = marked.join(tiles, "part").select("node", "part", "had", "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("tile"))
    stay = stay.select("node", "part", at("chunk", "tile").alias("chunk"), F.lit(1).alias("side"), "had")
    move = minor.join(tiles, "part").select("node", "part", "had", F.pmod(F.xxhash64("node"), "tiles").alias("tile"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    move = move.select("node", "part", at("chunk", "tile").alias("chunk"), F.lit(0).alias("side"), "had")
    again = sets.select("node", "shingles").join(_placed(stay.unionByName(move)), "node")
    return _tried(again, percent)
