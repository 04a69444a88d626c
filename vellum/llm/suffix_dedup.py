"""Removal of repeated passages: a sparse suffix sort with hash comparisons.

A byte goes if it lies in a string of ``length`` bytes that also starts somewhere else.
Sorting every suffix of the corpus would shuffle many times the input, so suffixes are
first gathered where they can meet:

1. Each window of ``length`` bytes names an anchor, the leftmost smallest polynomial hash
   of the ``gram``-byte strings inside it. Equal windows name equal anchors at the same
   offset. Neighbouring windows with one anchor form a run. Only a few numbers a run are
   shuffled, dealt by anchor and sorted by anchor and the run's own hash, and read as a
   stream: a run that is equal to its neighbour is repeated as a whole; a run that shares
   its anchor only is undecided; all others are unique.
   Equal runs go on as whole strings, keyed by anchor and run hash. An anchor that a task
   meets often is dealt over PARTS parts; there a run without an equal one is undecided,
   and the task tells part 0 that the anchor is dealt, so that nothing counts as unique
   for having been dealt elsewhere.
2. Undecided runs are cut into blocks of 32 windows aligned to the anchor and keyed by
   what all these windows have in common, dealt in the same way where a key is frequent.
   Within a key the suffixes (the windows of its blocks, or equal runs as a whole) are
   merge-sorted. Two suffixes are compared by the first eight bytes and else by binary
   search for their longest common extension on prefix polynomial hashes, so a comparison
   takes a logarithmic number of steps. Neighbours in that order which agree by hash are
   compared byte by byte before they count.
3. What a frequent key's parts leave open is counted by its hash with partial aggregation;
   what occurs twice is read from the texts again and sorted and compared in the same way
   under a key of its own.
4. The spans of each document are merged and cut out of the text as given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm._shared import frugal, groups, settle, signed, small_batches
from vellum.llm._text import Prefixes, U, mix, slices

BLOCK = 32
PIECE = 1 << 20
#: A key that a task meets more than OFTEN times, and in more than SHARE of its rows, is dealt over PARTS parts from then on.
OFTEN, SHARE, PARTS = 64, 0.01, 64
#: Keys whose frequency a task keeps in mind at a time.
WATCHED = 4096
#: Equal runs are verified in groups of so many.
VERIFIED = 1024
_OFFSET = U((1 << 21) - 1)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    k = 1
    while 2 * k <= w:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (w - k)], x[w - k :]) if w > k else x


def _pieces(buf: np.ndarray, offs: np.ndarray, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """The slice, or overlapping pieces of it if it is one long document."""
    if len(buf) <= PIECE:
        yield buf, offs, 0
        return
    for at in range(0, len(buf) - overlap, PIECE):
        part = buf[at : at + PIECE + overlap]
        yield part, np.array([0, len(part)]), at


def runs(buf: np.ndarray, offs: np.ndarray, length: int, gram: int):
    """(document, first window, last window, anchor position, anchor hash, run hash) of the runs in a slice."""
    n = len(buf)
    if n < length:
        return None
    p = Prefixes(buf)
    h = (p.h[gram:] - p.h[:-gram]) * p.inverse[: n - gram + 1]
    low = _sliding_min((h & ~_OFFSET) | np.arange(len(h), dtype=U), length - gram + 1)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(low)]
    at = np.flatnonzero(np.arange(len(low)) + length <= offs[doc + 1])
    if not len(at):
        return None
    anchor = (low[at] & _OFFSET).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    start, end, anchor = at[first], at[last], anchor[first]
    whole = mix(p.spans(start, end + length) + (end - start).astype(U) * U(0x9E3779B97F4A7C15) + (anchor - start).astype(U) * U(0xC2B2AE3D27D4EB4F))
    return doc[start], start, end, anchor, h[anchor], whole


class Frequent:
    """Deals the rows of keys that come often: part 0 for others, and 1 to PARTS for them. Space-saving counts, bounded by WATCHED."""

    def __init__(self, often: int):
        self.often, self.rows, self.count, self.hot = often, 0, {}, np.zeros(0, np.int64)

    def parts(self, key: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(part of each row, keys that became frequent with this call)."""
        self.rows += len(key)
        values, n = np.unique(key, return_counts=True)
        several = n > 1
        for k, c in zip(values[several].tolist(), n[several].tolist(), strict=True):
            self.count[k] = self.count.get(k, 0) + c
        new = [k for k, c in self.count.items() if c > max(self.often, SHARE * self.rows)]
        for k in new:
            del self.count[k]
        if len(self.count) > WATCHED:  # the rarer half is forgotten
            least = sorted(self.count.values())[len(self.count) // 2]
            self.count = {k: c - least for k, c in self.count.items() if c > least}
        new = np.setdiff1d(np.array(new, np.int64), self.hot)
        self.hot = np.union1d(self.hot, new)
        return np.where(np.isin(key, self.hot), (mix(by.view(U)) % U(PARTS)).astype(np.int64) + 1, 0), new


def _anchored(length: int, gram: int, often: int):
    """(anchor, part, whole, key, more, span) of all runs; a row without key says that its anchor is dealt over parts."""

    def run(batches):
        watch = Frequent(often)
        for b in batches:
            keys, more = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            for i, _, buf, offs in slices(b.column(1)):
                for part, po, at in _pieces(buf, offs, length - 1):
                    r = runs(part, po, length, gram)
                    if r is None:
                        continue
                    doc, start, end, anchor, ah, wh = r
                    begin = start - po[doc] + at
                    span = (begin << 20) | ((end - start) << 10) | (anchor - start)
                    key = keys[i + doc]
                    part, new = watch.parts(signed(ah), np.ascontiguousarray(key + span))
                    told = np.zeros(len(new), np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(c)) for c in ((signed(ah), new), (part, told), (signed(wh), told), (key, told), (more[i + doc], told.astype(np.int32)), (span, told - 1))],
                        names=["anchor", "part", "whole", "key", "more", "span"],
                    )

    return frugal(run)


@frugal
def _decided(batches):
    """Of a stream sorted by anchor, part and run hash: (key, more, anchor, span, whole, kind); 0 to be verified as a whole, 1 undecided, 2 both.

    One row is held back, so no group is ever gathered. Equal runs are verified in groups
    of VERIFIED, never of one; ``whole`` becomes the key of such a group.
    """

    def judge(cols, before, after):
        """Rows whose neighbours are known: before and after are the columns next to them, or None."""
        nonlocal count
        anchor, part, whole, key, more, span = cols
        n = len(anchor)
        same_a, same_w = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        same_a[1:-1] = (anchor[1:] == anchor[:-1]) & (part[1:] == part[:-1])
        same_w[1:-1] = same_a[1:-1] & (whole[1:] == whole[:-1]) & (span[1:] >= 0) & (span[:-1] >= 0)
        for at, end, row in ((0, before, 0), (n, after, -1)):
            if end is not None:
                same_a[at] = end[0] == anchor[row] and end[1] == part[row]
                same_w[at] = same_a[at] and end[2] == whole[row] and end[5] >= 0 and span[row] >= 0
        full = same_w[:-1] | same_w[1:]
        hot = part > 0
        shared = same_a[:-1] | same_a[1:] | hot
        # the first or last of equal runs stands for them if a different run of its anchor is next to it, or may be elsewhere
        ends = (~same_w[:-1] & (same_a[:-1] | hot)) | (~same_w[1:] & (same_a[1:] | hot))
        kind = np.where(full, np.where(ends, 2, 0), 1)
        # the place of a row among its equals, which may have begun in an earlier batch
        first = np.flatnonzero(~same_w[:-1])
        base = np.repeat(np.concatenate([[0], first]), np.diff(np.concatenate([[0], first, [n]])))
        place = np.arange(n) - base
        if not len(first) or first[0] > 0:
            place[: first[0] if len(first) else n] += count
        count = int(place[-1]) + 1 if n else count
        group = place // VERIFIED
        group[(place % VERIFIED == 0) & (place > 0) & ~same_w[1:]] -= 1  # none is verified alone
        keyed = signed(mix(whole.view(U) ^ mix(anchor.view(U) + mix(group.astype(U) * U(PARTS + 1) + part.astype(U)))) | U(1))
        keep = (shared | full) & (span >= 0)
        return _kinds([x[keep] for x in (key, more, anchor, span, keyed)] + [kind[keep].astype(np.int32)])

    count, before, held = 0, None, None
    for b in batches:
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
        if not len(cols[0]):
            continue
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
        if len(cols[0]) > 1:
            yield judge([c[:-1] for c in cols], before, [c[-1] for c in cols])
            before = [c[-2] for c in cols]
        held = [c[-1:] for c in cols]
    if held is not None:
        yield judge(held, before, None)


def _kinds(x) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in x], names=["key", "more", "anchor", "span", "whole", "kind"])


_BLOCK = "bkey long, part long, key long, more int, at long, whole boolean, body binary"


def _blocks(length: int, often: int):
    """Strings to be sorted: blocks of windows of the undecided runs and, whole, runs to be verified; body is their bytes.

    A row without body says that its key is dealt over parts.
    """
    core = length - BLOCK + 1

    def run(batches):
        watch = Frequent(often)
        for b in batches:
            keys, more, todo = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False), b.column(3)
            for i, j, buf, offs in slices(b.column(1)):
                rows = todo.slice(i, j - i)
                flat = rows.flatten()
                count = np.asarray(rows.value_lengths())
                if not len(flat):
                    continue
                doc = np.repeat(np.arange(j - i), count)
                anchor, span, kind = flat.field(0).to_numpy().view(U), flat.field(1).to_numpy(), flat.field(3).to_numpy()
                lo = (span >> 20) + offs[doc]
                hi = lo + (span >> 10 & 1023)
                a = lo + (span & 1023)
                p = Prefixes(buf)
                raw = buf.tobytes()
                sure, open_ = np.flatnonzero(kind != 1), np.flatnonzero(kind > 0)
                out = [[flat.field(2).to_numpy()[sure]], [doc[sure]], [lo[sure]], [hi[sure]], [np.ones(len(sure), bool)]]
                for q in range(-(-length // BLOCK)):
                    first, last = np.maximum(lo[open_], a[open_] - BLOCK * q - BLOCK + 1), np.minimum(hi[open_], a[open_] - BLOCK * q)
                    has = np.flatnonzero(first <= last)
                    s = a[open_[has]] - BLOCK * q
                    key = signed(mix(p.spans(s, s + core) + anchor[open_[has]] * U(5) + U(q)) & ~U(1))
                    for c, x in zip(out, (key, doc[open_[has]], first[has], last[has], np.zeros(len(has), bool)), strict=True):
                        c.append(x)
                bkey, d, first, last, whole = (np.concatenate(c) for c in out)
                part, new = watch.parts(np.where(whole, 0, bkey), keys[i + d] + first)
                part[whole] = 0
                new = new[new != 0]
                told = np.zeros(len(new), np.int64)
                body = [raw[x : y + length] for x, y in zip(first.tolist(), last.tolist(), strict=True)]
                cols = ((bkey, new), (part, told), (keys[i + d], told), (more[i + d], told.astype(np.int32)), (first - offs[d], told), (whole, told.astype(bool)))
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c)) for c in cols), pa.array([*body, *[None] * len(new)], pa.binary())], names=["bkey", "part", "key", "more", "at", "whole", "body"])

    return frugal(run)


class Suffixes:
    """Suffixes of a buffer, each cut to ``length`` bytes, compared by prefix hashes."""

    def __init__(self, buf: np.ndarray, start: np.ndarray, length: int):
        self.buf, self.start, self.length = buf, start, length
        self.p = Prefixes(buf)
        eight = np.zeros(len(start), U)
        for i in range(min(8, length)):
            eight = (eight << U(8)) | buf[start + i].astype(U)
        self.eight = eight
        self.whole = self.p.spans(start, start + length)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common extension by binary search, at most length."""
        x, y = self.start[i], self.start[j]
        lo, hi = np.zeros(len(x), np.int64), np.full(len(x), self.length)
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = self.p.spans(x, x + mid) == self.p.spans(y, y + mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def less(self, i: np.ndarray, j: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        out = self.eight[i] < self.eight[j]
        tied = np.flatnonzero(self.eight[i] == self.eight[j])
        if len(tied):
            ti, tj = i[tied], j[tied]
            equal = self.whole[ti] == self.whole[tj]
            got = or_equal[tied] & equal
            differ = np.flatnonzero(~equal)
            if len(differ):
                di, dj = ti[differ], tj[differ]
                c = np.minimum(self.common(di, dj), self.length - 1)
                got[differ] = self.buf[self.start[di] + c] < self.buf[self.start[dj] + c]
            out[tied] = got
        return out

    def sorted(self, sizes: np.ndarray) -> np.ndarray:
        """Order of the suffixes within consecutive groups of these sizes, by bottom-up mergesort over all groups at once."""
        order = np.arange(len(self.start))
        begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
        end = begin + np.repeat(sizes, sizes)
        rel = order - begin
        w = 1
        while w < sizes.max(initial=0):
            at = np.flatnonzero(end - begin > w)
            run = rel[at] // w
            other = run ^ 1
            lo = np.minimum(begin[at] + other * w, end[at])
            hi = np.minimum(lo + w, end[at])
            base, right = lo.copy(), (run & 1).astype(bool)
            mine = order[at]
            open_ = np.flatnonzero(lo < hi)
            while len(open_):
                mid = (lo[open_] + hi[open_]) >> 1
                below = self.less(order[mid], mine[open_], right[open_])
                lo[open_] = np.where(below, mid + 1, lo[open_])
                hi[open_] = np.where(below, hi[open_], mid)
                open_ = open_[lo[open_] < hi[open_]]
            to = begin[at] + np.minimum(run, other) * w + (rel[at] - run * w) + (lo - base)
            moved = order.copy()
            moved[to] = mine
            order = moved
            w *= 2
        return order

    def repeated(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which suffixes are equal to another one of their group, and which to one before them in order."""
        order = self.sorted(sizes)
        group = np.repeat(np.arange(len(sizes)), sizes)
        near = np.flatnonzero((self.whole[order[1:]] == self.whole[order[:-1]]) & (group[1:] == group[:-1]))
        out, later = np.zeros(len(order), bool), np.zeros(len(order), bool)
        reach = np.arange(self.length)
        for i in range(0, len(near), 4096):
            k = near[i : i + 4096]
            x, y = order[k], order[k + 1]
            sure = (self.buf[self.start[x][:, None] + reach] == self.buf[self.start[y][:, None] + reach]).all(axis=1)
            out[x[sure]] = True
            out[y[sure]] = later[y[sure]] = True
        return out, later


_FOUND = "key long, more int, s long, e long, window long"


def _spans(key: np.ndarray, more: np.ndarray, at: np.ndarray, length: int) -> pa.RecordBatch:
    """Windows as spans, neighbours of one block joined."""
    new = np.ones(len(at), bool)
    new[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return _found(key[first], more[first], at[first], at[last] + length, None)


def _found(key, more, s, e, window) -> pa.RecordBatch:
    none = pa.nulls(len(key), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(more), pa.array(s), none if e is None else pa.array(e), none if window is None else pa.array(window)], names=["key", "more", "s", "e", "window"])


def _sorted_blocks(length: int, gather: int = 2000, most: int = 4096):
    """Spans of repeated windows and runs of rows sorted by key and part; of dealt keys also each window left open, with its hash (e is null).

    A part above ``most`` rows is sorted in pieces: what no piece repeats is left open.
    """

    def flush(tables, size, dealt):
        """Of groups of strings of at least ``size`` bytes each: every window of that size, sorted within its group."""
        rows = pa.concat_tables(tables)
        body = rows.column("body").combine_chunks()
        _, _, buf, offs = next(slices(body, 1 << 60))
        n = np.diff(offs) - size + 1
        row = np.repeat(np.arange(len(n)), n)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        start = offs[row] + inner
        key, more, at = rows.column("key").to_numpy()[row], rows.column("more").to_numpy()[row], rows.column("at").to_numpy()[row] + inner
        sizes = np.add.reduceat(n, np.cumsum([0, *[t.num_rows for t in tables[:-1]]]))
        sort = Suffixes(buf, start, size)
        twice, later = sort.repeated(sizes)
        again = np.flatnonzero(twice)
        if len(again):
            yield _spans(key[again], more[again], at[again], size)
        # the first of equal ones as well, for one that is alone elsewhere
        left = np.flatnonzero(~later & np.repeat(np.array(dealt), sizes))
        if len(left):
            yield _found(key[left], more[left], at[left], None, signed(mix(sort.whole[left])))

    def run(batches):
        waiting, held = {}, 0
        for g, dealt in _pieces_of(batches, most):
            if g.num_rows < 2 and not dealt:
                continue
            size = len(g.column("body")[0].as_py()) if g.column("whole")[0].as_py() else length
            t = waiting.setdefault(size, [[], [], 0])
            t[0].append(g)
            t[1].append(dealt)
            t[2] += g.num_rows
            held += g.num_rows
            if t[2] >= gather or held >= 10 * gather:
                for k in [size] if t[2] >= gather else list(waiting):
                    tables, flags, n = waiting.pop(k)
                    held -= n
                    yield from flush(tables, k, flags)
        for size, (tables, flags, _) in waiting.items():
            yield from flush(tables, size, flags)

    return frugal(run)


def _pieces_of(batches, most: int):
    """(rows, whether others of the key may be elsewhere) of each key and part, in pieces of at most ``most`` rows; markers come first."""
    held, n, last, dealt = [], 0, None, False
    for t in (t for b in batches for t in groups([b], ["bkey", "part"])):
        key = (t.column("bkey")[0].as_py(), t.column("part")[0].as_py())
        if key != last:
            if n:
                yield pa.concat_tables(held), dealt
            held, n, last, dealt = [], 0, key, key[1] > 0
            limit = VERIFIED + 1 if t.column("whole")[0].as_py() else most  # groups of runs are bounded already
        marked = t.column("body").null_count
        dealt |= marked > 0
        t = t.slice(marked)
        while t.num_rows:
            part = t.slice(0, limit - n)
            held.append(part)
            n += part.num_rows
            t = t.slice(part.num_rows)
            if n == limit:
                dealt = True
                yield pa.concat_tables(held), True
                held, n = [], 0
    if n:
        yield pa.concat_tables(held), dealt


def _again(length: int):
    """Windows (window, at) of texts as strings to be sorted under their own hash."""

    def run(batches):
        for b in batches:
            keys, more, todo = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False), b.column(3)
            for i, j, buf, offs in slices(b.column(1)):
                rows = todo.slice(i, j - i)
                flat, doc = rows.flatten(), np.repeat(np.arange(j - i), np.asarray(rows.value_lengths()))
                at = flat.field(1).to_numpy()
                raw = buf.tobytes()
                for x in range(0, len(doc), 10_000):
                    d, s = doc[x : x + 10_000], at[x : x + 10_000]
                    body = [raw[p : p + length] for p in (s + offs[d]).tolist()]
                    yield pa.RecordBatch.from_arrays([flat.field(0).slice(x, len(d)), pa.array(np.zeros(len(d), np.int64)), pa.array(keys[i + d]), pa.array(more[i + d]), pa.array(s), pa.array(np.zeros(len(d), bool)), pa.array(body, pa.binary())], names=["bkey", "part", "key", "more", "at", "whole", "body"])

    return frugal(run)


_CUT = "n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"


@frugal
def _cut(batches):
    """Texts without their merged spans, and what is carried along."""
    for b in batches:
        n_bytes, removed, spans, kept = [], [], [], []
        marks = b.column(2)
        for i, _, buf, offs in slices(b.column(1)):
            for d in range(len(offs) - 1):
                body = buf[offs[d] : offs[d + 1]]
                m = marks[i + d]
                own = []
                if m.is_valid and len(m):
                    x = np.array([(v["s"], v["e"]) for v in m.as_py()], np.int64)
                    x = x[np.argsort(x[:, 0], kind="stable")]
                    reach = np.maximum.accumulate(x[:, 1])
                    new = np.ones(len(x), bool)
                    new[1:] = x[1:, 0] > reach[:-1]
                    first = np.flatnonzero(new)
                    own = list(zip(x[first, 0].tolist(), reach[np.append(first[1:], len(x)) - 1].tolist(), strict=True))
                stay = np.ones(len(body), bool)
                for s, e in own:
                    stay[s:e] = False
                n_bytes.append(len(body))
                removed.append(len(body) - int(stay.sum()))
                spans.append([{"start": s, "end": e} for s, e in own])
                kept.append(body[stay].tobytes() if own else body.tobytes())
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
            names=["row", "n_bytes", "n_removed", "spans", "kept"],
        )


def _sort(blocks: DataFrame, length: int, most: int) -> DataFrame:
    """Spans, and windows left open, of strings (see _BLOCK)."""
    # a marker of a dealt key comes before the key's rows
    rows = blocks.repartition("bkey", "part").sortWithinPartitions("bkey", "part", F.col("body").isNotNull())
    return settle(rows.mapInArrow(_sorted_blocks(length, most=most), _FOUND), "suffix-sorted")


def suffix_dedup(docs: DataFrame, length: int = 200, gram: int = 32, most: int = 4096, often: int = OFTEN) -> DataFrame:
    """(row, n_bytes, n_removed, spans, kept) of ``docs(doc_id, text)``: texts without bytes inside repeated strings.

    ``row`` is a struct of all columns of docs but the text. ``kept`` is the remaining
    UTF-8 bytes as they are (a cut may fall inside a character), ``spans`` the maximal
    removed runs.
    Strings are judged on the input, never across documents; a string may repeat within
    its own document. Texts below ``length`` bytes, empty and null texts (empty) stay
    whole. Repeated rows are copies of each other. doc_id may be null. No rows give none.
    Nothing is removed on a hash alone: every string that counts as repeated was equal byte
    by byte to its neighbour in the order of suffixes. Documents are told apart by 96 bits
    of hashes of doc_id and text.
    """
    if not BLOCK < length <= 1000 or not 8 <= gram <= length - BLOCK:
        raise ValueError("length must be in 33..1000 and gram in 8..length - 32")
    spark = docs.sparkSession
    small_batches(spark)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    named = [F.col("doc_id").cast("long"), F.col("text").cast("string")]
    docs = docs.select(row, F.xxhash64(*named).alias("key"), F.col("text").cast("string").alias("text"), F.hash(*named).alias("more"))
    doc = ["key", "more"]
    read = docs.select("key", "text", "more")
    found = read.mapInArrow(_anchored(length, gram, often), "anchor long, part long, whole long, key long, more int, span long")
    kinds = found.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "whole").mapInArrow(_decided, "key long, more int, anchor long, span long, whole long, kind int")
    kinds = settle(kinds, "suffix-kinds")

    # sets, as each copy of a repeated row gives the same
    todo = kinds.groupBy(*doc).agg(F.collect_set(F.struct("anchor", "span", "whole", "kind")).alias("todo"))
    blocks = read.join(todo, doc).select("key", "text", "more", "todo").mapInArrow(_blocks(length, often), _BLOCK)
    spans = _sort(blocks, length, most)
    open_ = spans.where("e IS NULL")
    twice = open_.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
    left = settle(open_.join(twice, "window").groupBy(*doc).agg(F.collect_set(F.struct("window", F.col("s").alias("at"))).alias("todo")), "suffix-open")
    if left.limit(1).count():
        last = read.join(left, doc).select("key", "text", "more", "todo").mapInArrow(_again(length), _BLOCK)
        spans = spans.unionByName(_sort(last, length, 1 << 40))

    marks = spans.where("e IS NOT NULL").groupBy(*doc).agg(F.collect_set(F.struct("s", "e")).alias("marks"))
    cut = docs.join(marks, doc, "left").select("row", "text", "marks")
    return cut.mapInArrow(_cut, f"row {cut.schema['row'].dataType.simpleString()}, {_CUT}")
