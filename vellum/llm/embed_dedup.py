"""Near duplicates among embeddings by a subspace pigeonhole join.

Unit vectors whose cosine is c lie at squared distance 2 - 2c. A rotation spreads that
distance over all coordinates. If the coordinates are cut into blocks, then in at least
one block the squared distance is no more than the block's share of it, in proportion to
its coordinates. So pairs within the wanted distance are among those within the block's
budget in some block.

Each block is a range join of its own: vectors are dealt to cells of a grid over the
first coordinates of the block, and sent as guests to the cells that their ball of the
block's radius touches as well. Cells with more than ``cell_rows`` homes are cut again
along the block's next coordinates until they hold fewer or no coordinate is left, so
their number grows with the vectors; what is still larger is dealt over several tasks,
each with all the cell's guests. In a cell the points are split at medians, coordinate by
coordinate, with guests within the radius on both sides, until few pairs are left, which
are tested on the block and then exactly on whole vectors in double precision. A pair is
given by the first block in which it is within the budget, so the union over the blocks
holds it once. Equal vectors are one class throughout and are never paired with each other.
A task doesn't emit its pairs but the number of links that each vector gets from them and
a spanning forest of them, so what leaves it grows with its rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from vellum.llm._shared import settle, small_batches
from vellum.llm.components import connected_components

#: Added to squared distances before they are compared in candidate search, for rounding.
EPSILON = 1e-9
PAIRS = 1 << 18
CELLS = "cell long, home boolean, block int, label long, id long, n long, vector binary"
_CELLS = ["cell", "home", "block", "label", "id", "n", "vector"]


@lru_cache(maxsize=16)
def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """An orthogonal matrix that depends on the dimension only."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(seed + dim)).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def blocks(dim: int, size: int) -> list[slice]:
    return [slice(i, min(i + size, dim)) for i in range(0, dim, size)]


def _radius(limit: float, cut: slice, dim: int) -> float:
    return math.sqrt(limit * (cut.stop - cut.start) / dim + EPSILON)


def _vectors(raw: pa.Array, dtype) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors in double precision) of a binary column, for each dimension in it."""
    body = raw.to_pylist()
    dims = np.array([len(r) for r in body], np.int64) // dtype().itemsize
    for dim in np.unique(dims).tolist():
        of = np.flatnonzero(dims == dim)
        yield of, np.frombuffer(b"".join(body[i] for i in of), dtype).reshape(len(of), dim).astype(np.float64)


def _dealt(y: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, grid cell, whether it is the row's own) of all cells that the balls around the rows of y touch."""
    width = 4 * radius
    low, own, high = (np.floor((y + d) / width).astype(np.int64) for d in (-radius, 0, radius))
    rows, cells = np.arange(len(y)), np.zeros((len(y), 0), np.int64)
    for g in range(y.shape[1]):
        step = [(np.ones(len(rows), bool), own)] + [(c[rows, g] != own[rows, g], c) for c in (low, high)]
        cells = np.concatenate([np.column_stack([cells[new], c[rows[new], g]]) for new, c in step])
        rows = np.concatenate([rows[new] for new, _ in step])
    return rows, cells, (cells == own[rows]).all(axis=1)


def _keyed(key: np.ndarray, cells: np.ndarray) -> np.ndarray:
    for g in range(cells.shape[1]):
        key = (key * 1_000_003) ^ cells[:, g]
    return key


def _cells(limit: float, size: int, grid: int, dtype):
    """A vector's own cell in each block, and those it is a guest in."""

    def run(batches):
        for b in batches:
            ids, labels = b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64)
            for of, x in _vectors(b.column(3), dtype):
                dim = x.shape[1]
                u = x / np.linalg.norm(x, axis=1)[:, None] @ rotation(dim)
                raw, n = b.column(3).take(pa.array(of)), b.column(2).take(pa.array(of))
                for k, cut in enumerate(blocks(dim, size)):
                    rows, cells, home = _dealt(u[:, cut][:, :grid], _radius(limit, cut, dim))
                    key = _keyed((labels[of[rows]] * 1_000_003 + dim) * 1_000_003 + k, cells)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(home), pa.array(np.full(len(rows), k, np.int32)), pa.array(labels[of[rows]]), pa.array(ids[of[rows]]), n.take(pa.array(rows)), raw.take(pa.array(rows))], names=_CELLS)

    return run


def _finer(limit: float, size: int, begin: int, end: int, dtype):
    """Rows of crowded cells dealt to cells that are cut along the block's coordinates begin:end as well."""

    def run(batches):
        for b in batches:
            key, was, block = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy()
            for of, x in _vectors(b.column(6), dtype):
                dim = x.shape[1]
                u = x / np.linalg.norm(x, axis=1)[:, None] @ rotation(dim)
                for k, cut in enumerate(blocks(dim, size)):
                    mine = np.flatnonzero(block[of] == k)
                    if not len(mine):
                        continue
                    rows, cells, own = _dealt(u[mine, cut][:, begin:end], _radius(limit, cut, dim))
                    at = of[mine[rows]]
                    yield pa.RecordBatch.from_arrays([pa.array(_keyed(key[at], cells)), pa.array(was[at] & own), *(b.column(i).take(pa.array(at)) for i in (2, 3, 4, 5, 6))], names=_CELLS)

    return run


def _near(y: np.ndarray, homes: np.ndarray, guests: np.ndarray, radius: float, axis: int = 0):
    """Index pairs (home, guest) that may be within the radius in the block's coordinates y."""
    while True:
        if len(homes) * len(guests) <= PAIRS or axis >= y.shape[1]:
            for i in range(0, len(homes), max(1, PAIRS // max(1, len(guests)))):
                h = homes[i : i + max(1, PAIRS // max(1, len(guests)))]
                d = np.zeros((len(h), len(guests)))
                for a in range(y.shape[1]):
                    d += (y[h, a][:, None] - y[guests, a]) ** 2
                p, q = np.nonzero(d <= radius * radius)
                yield h[p], guests[q]
            return
        v = y[homes, axis]
        m = np.median(v)
        left = v <= m
        if left.all():
            axis += 1
            continue
        w = y[guests, axis]
        yield from _near(y, homes[left], guests[w <= m + radius], radius, axis + 1)
        homes, guests, axis = homes[~left], guests[w >= m - radius], axis + 1


class _Points:
    """Vectors of one label, block and dimension, and the number of rows that have each."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, x: np.ndarray):
        self.ids, self.n, self.x = ids, n, x
        self.norm = np.linalg.norm(x, axis=1)
        self.u = x / self.norm[:, None] @ rotation(x.shape[1])
        self.links, self.label = np.zeros(len(ids)), np.arange(len(ids))


def _points(t: pa.Table, dtype) -> dict[tuple, _Points]:
    """Rows of a cell by what must be equal, as cells are keyed by a hash; each id once, should two cells have one key."""
    ids, label, block, n = (t.column(c).to_numpy() for c in ("id", "label", "block", "n"))
    raw, out = t.column("vector").combine_chunks(), {}
    for of, x in _vectors(raw if isinstance(raw, pa.Array) else pa.concat_arrays(raw.chunks), dtype):
        for kind in {*zip(label[of].tolist(), block[of].tolist(), strict=True)}:
            mine = np.flatnonzero((label[of] == kind[0]) & (block[of] == kind[1]))
            mine = mine[np.unique(ids[of[mine]], return_index=True)[1]]
            out[(*kind, x.shape[1])] = _Points(ids[of[mine]], n[of[mine]], x[mine])
    return out


def _pairs(h: _Points, g: _Points, block: int, cosine: float, limit: float, size: int):
    """Index pairs of linked homes and points whose id is larger; a pair belongs to the home cell of its smaller id."""
    dim = h.x.shape[1]
    cuts = blocks(dim, size)
    budget = [limit * (c.stop - c.start) / dim + EPSILON for c in cuts]
    n = len(h.ids)
    y = np.concatenate([h.u[:, cuts[block]], g.u[:, cuts[block]]])
    for p, q in _near(y, np.arange(n), np.arange(n, n + len(g.ids)), math.sqrt(budget[block])):
        q = q - n
        ask = h.ids[p] < g.ids[q]
        p, q = p[ask], q[ask]
        for i in range(0, len(p), 1 << 14):
            a, b = p[i : i + (1 << 14)], q[i : i + (1 << 14)]
            same = np.einsum("ij,ij->i", h.x[a], g.x[b]) / (h.norm[a] * g.norm[b]) >= cosine
            a, b = a[same], b[same]
            d = (h.u[a] - g.u[b]) ** 2
            new = np.ones(len(a), bool)
            for k in range(block):
                new &= d[:, cuts[k]].sum(axis=1) > budget[k] - 1e-12  # rounding must not lose it between blocks
            if new.any():
                yield a[new], b[new]


def forest(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which of the pairs connect what was apart, one by one; labels of what they connect become equal."""
    x, y = label[p], label[q]
    apart = np.flatnonzero(x != y)
    if not len(apart):
        return apart
    _, first = np.unique(np.minimum(x[apart], y[apart]) * len(label) + np.maximum(x[apart], y[apart]), return_index=True)
    up, out = {}, []

    def root(i: int) -> int:
        while up.get(i, i) != i:
            up[i] = up.get(up[i], up[i])
            i = up[i]
        return i

    for k in apart[first].tolist():
        i, j = root(int(x[k])), root(int(y[k]))
        if i != j:
            up[max(i, j)] = min(i, j)
            out.append(k)
    to = np.arange(len(label))
    for i in up:
        to[i] = root(i)
    label[:] = to[label]
    return np.array(out, np.int64)


_LINKS = "a long, b long, n long"


def _linked(a: np.ndarray, b: np.ndarray | None, n: np.ndarray | None) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(a), none if b is None else pa.array(b), none if n is None else pa.array(n.astype(np.int64))], names=["a", "b", "n"])


def _joined(cosine: float, limit: float, size: int, dtype):
    """Of rows sorted by cell and part, homes first: links that connect (a, b), and how many rows each vector is linked with (a, n).

    Homes are held, the others pass by in batches.
    """

    def among(homes):
        for kind, h in homes.items():
            for p, q in _pairs(h, h, kind[1], cosine, limit, size):
                h.links += np.bincount(p, h.n[q], len(h.ids)) + np.bincount(q, h.n[p], len(h.ids))
                k = forest(h.label, p, q)
                if len(k):
                    yield _linked(h.ids[p[k]], h.ids[q[k]], None)

    def passing(homes, others):
        for kind, g in others.items():
            h = homes.get(kind)
            if h is None:
                continue
            if (both := np.isin(g.ids, h.ids)).any():
                g = _Points(g.ids[~both], g.n[~both], g.x[~both])
            n = len(h.ids)
            label = np.concatenate([h.label, n + np.arange(len(g.ids))])
            for p, q in _pairs(h, g, kind[1], cosine, limit, size):
                h.links += np.bincount(p, g.n[q], n)
                g.links += np.bincount(q, h.n[p], len(g.ids))
                k = forest(label, p, q + n)
                if len(k):
                    yield _linked(h.ids[p[k]], g.ids[q[k]], None)
            h.label = label[:n]
            yield from counted(g)

    def counted(points):
        has = np.flatnonzero(points.links)
        if len(has):
            yield _linked(points.ids[has], None, points.links[has])

    def end(homes, waiting):
        if waiting:
            homes = _points(pa.concat_tables(waiting), dtype)
            yield from among(homes)
        for h in (homes or {}).values():
            yield from counted(h)

    def run(batches):
        last, waiting, homes = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            cell, part, home = b.column("cell").to_numpy(), b.column("part").to_numpy(), b.column("home").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (part[1:] != part[:-1]) | (home[1:] != home[:-1])) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                key, rows = (cell[i], part[i]), pa.Table.from_batches([b.slice(i, j - i)])
                if key != last:
                    yield from end(homes, waiting)
                    last, waiting, homes = key, [], None
                if home[i]:
                    waiting.append(rows)
                    continue
                if homes is None:
                    homes = _points(pa.concat_tables(waiting), dtype) if waiting else {}
                    waiting = []
                    yield from among(homes)
                if homes:
                    yield from passing(homes, _points(rows, dtype))
        yield from end(homes, waiting)

    return run


def _crowded(cells: DataFrame, cell_rows: int) -> DataFrame:
    return cells.where("home").groupBy("cell").agg(F.count("*").alias("homes")).where(F.col("homes") > cell_rows)


def embedding_dedup(vectors: DataFrame, cosine: float = 0.98, block: int = 8, grid: int = 2, cell_rows: int = 4096) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of ``vectors(vec_id, embedding, label)``.

    Vectors with equal non-null labels and dimensions are linked if their cosine is at
    least ``cosine`` (in double precision; components keep the width of the column). Null,
    empty and zero vectors, and those with null or non-finite components, are linked with
    nothing, nor is a row without vec_id. Every row of a repeated vector counts as a
    vector. No rows give none; further columns are ignored.
    """
    spark = vectors.sparkSession
    small_batches(spark, 4096)
    limit = 2 - 2 * cosine
    kind = vectors.schema["embedding"].dataType
    double = isinstance(kind, ArrayType) and isinstance(kind.elementType, DoubleType)
    dtype, element = (np.float64, "double") if double else (np.float32, "float")
    e = F.col("embedding").cast(f"array<{element}>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), e.alias("embedding"))
    sound = F.size("embedding") > 0
    sound &= F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    sound &= F.exists("embedding", lambda v: v != 0)
    usable = rows.where(F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound, F.lit(False)))
    # -0.0 and 0.0 are one value
    usable = usable.withColumn("embedding", F.transform("embedding", lambda v: v + F.lit(0.0).cast(element)))
    classes = settle(usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")), "embed-classes")
    members = usable.join(classes, ["label", "embedding"]).select("vec_id", "id", "n")

    packed = classes.select("id", "label", "n", "embedding").mapInArrow(_packed(dtype), "id long, label long, n long, vector binary")
    cells = settle(packed.mapInArrow(_cells(limit, block, grid, dtype), CELLS), "embed-cells")
    begin, ready, crowded = grid, None, settle(_crowded(cells, cell_rows), "embed-crowded")
    while (some := crowded.limit(1).count()) and begin < block:
        calm = cells.join(crowded.select("cell"), "cell", "left_anti").select(*_CELLS)
        ready = calm if ready is None else ready.unionByName(calm)
        cut = cells.join(crowded.select("cell"), "cell", "left_semi").select(*_CELLS)
        cells = settle(cut.mapInArrow(_finer(limit, block, begin, begin + 2, dtype), CELLS), "embed-cells")
        begin, crowded = begin + 2, settle(_crowded(cells, cell_rows), "embed-crowded")
    dealt = cells.withColumn("part", F.lit(0).cast("long"))
    if some:  # no coordinate left: each part has its own homes, and everyone of the cell to compare them with
        dealt = cells.join(crowded.select("cell", F.ceil(F.col("homes") / cell_rows).alias("parts")), "cell", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
        dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        dealt = dealt.withColumn("home", F.col("home") & (F.pmod(F.xxhash64("id"), "parts") == F.col("part"))).drop("parts")
    if ready is not None:
        dealt = dealt.unionByName(ready.withColumn("part", F.lit(0).cast("long")))
    found = dealt.repartition("cell", "part").sortWithinPartitions("cell", "part", F.desc("home")).mapInArrow(_joined(cosine, limit, block, dtype), _LINKS)
    found = settle(found, "embed-links")

    others = found.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    parts = connected_components(found.where("b IS NOT NULL").select("a", "b"), "embed-parts").withColumnRenamed("node", "id")
    per = members.join(others, "id", "left").join(parts, "id", "left")
    per = per.select("vec_id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    alone = rows.where(~F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return per.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _packed(dtype):
    """Vectors as bytes, which cost less than lists to deal out."""

    def run(batches):
        for b in batches:
            lists = b.column(3)
            raw = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), dtype=dtype).tobytes()
            end = np.cumsum(np.asarray(lists.value_lengths())).astype(np.int64) * dtype().itemsize
            body = [raw[s:t] for s, t in zip([0, *end[:-1].tolist()], end.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(body, pa.binary())], names=["id", "label", "n", "vector"])

    return run
