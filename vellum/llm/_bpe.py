"""Whole-text encoding by the tokenizers library, with distinct pieces of text encoded once.

A byte-level tokenizer with the usual word pattern never lets a token cross from a
character that is not white space into white space. A text is therefore cut before each
run of ASCII white space; the ids of the text are the ids of these units in order. Units
repeat, so each worker keeps a bounded table from a unit's hash to its ids and asks the
library only for units it does not know, JOINED at a time with a mark between them. Texts with white space outside ASCII, where a
run may lie across such a cut, and long units go to the library as they are.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np

from vellum.llm._text import _SPACE, Prefixes, U, mix

#: Units above this length are not looked up.
LONG = 64
#: Entries of the table after which it is started anew.
MOST = 1_000_000
SLICE = 1 << 20
#: Stands between units that are asked for together: a blank and a control character, whose id no other unit has.
MARK, JOINED = b" \x07", 256

_BLANK = b" \t\n\x0b\x0c\r"
_LEAD = np.zeros(256, bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_open: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _open:
        _open[path] = Encoder(path)
    return _open[path]


class _Table:
    def __init__(self):
        self.keys, self.start, self.count = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, -1 where it is not known."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, at, -1)

    def add(self, keys, start, count) -> None:
        to = np.searchsorted(self.keys, keys)
        self.keys, self.start, self.count = (np.insert(a, to, b) for a, b in ((self.keys, keys), (self.start, start), (self.count, count)))


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.dtype = np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32
        # the mark's ids, if units around it keep theirs
        one, two, mark = (self._ask([t])[0].tolist() for t in (" a", " b", MARK.decode()))
        sure = self._ask([f" a{MARK.decode()} b"])[0].tolist() == one + mark + two and mark.count(mark[-1]) == 1
        self.mark = mark if sure else None
        self._clear()

    def _clear(self) -> None:
        self.old, self.new = _Table(), _Table()
        self.pool, self.used = np.zeros(1 << 16, self.dtype), 0

    def _keep(self, ids: np.ndarray) -> int:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), self.dtype)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def _ask(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and the number of each."""
        found = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        count = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), self.dtype, int(count.sum())), count

    def _ask_units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for units, which begin with white space unless their text does not, and are joined where they do."""
        plain = np.array([self.mark is not None and u[0] in _BLANK and u[-1] not in _BLANK and MARK[-1] not in u for u in units], bool)
        at, other = np.flatnonzero(plain), np.flatnonzero(~plain)
        texts = [MARK.join([*(units[i] for i in at[k : k + JOINED].tolist()), b""]).decode("utf-8", "replace") for k in range(0, len(at), JOINED)]
        ids, _ = self._ask(texts) if texts else (np.zeros(0, self.dtype), None)
        alone, alone_n = self._ask([units[i].decode("utf-8", "replace") for i in other.tolist()]) if len(other) else (np.zeros(0, self.dtype), np.zeros(0, np.int64))
        n = np.zeros(len(units), np.int64)
        if len(at):
            size = len(self.mark)
            end = np.flatnonzero(ids == self.mark[-1]) + 1
            n[at] = np.diff(np.concatenate([[0], end])) - size
            stay = np.ones(len(ids), bool)
            for k in range(1, size + 1):
                stay[end - k] = False
            ids = ids[stay]
        n[other] = alone_n
        # units in their own order again
        source = np.zeros(len(units), np.int64)
        source[at], source[other] = np.cumsum(n[at]) - n[at], len(ids) + np.cumsum(alone_n) - alone_n
        before = np.cumsum(n) - n
        return np.concatenate([ids, alone])[np.repeat(source - before, n) + np.arange(int(n.sum()))], n

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice in a row, and the offsets of each text in them."""
        docs = len(offs) - 1
        if not len(buf):
            return np.zeros(0, self.dtype), np.zeros(docs + 1, np.int64)
        if len(self.old.keys) + len(self.new.keys) > MOST:
            self._clear()
        space = _SPACE[buf]
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[offs[:-1][offs[:-1] < len(buf)]] = True
        odd = _odd(buf, offs)
        for d in odd:  # such a text is one unit
            begins[offs[d] : offs[d + 1]] = False
            begins[offs[d]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(buf))
        doc = np.searchsorted(offs, start, side="right") - 1
        direct = end - start > LONG
        if odd:
            direct |= np.isin(doc, odd)

        at, count = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        raw = buf.tobytes()
        text = lambda i: raw[start[i] : end[i]].decode("utf-8", "replace")
        short = np.flatnonzero(~direct)
        hashes = mix(Prefixes(buf).spans(start[short], end[short]) + (end[short] - start[short]).astype(U) * U(0xA0761D6478BD642F))
        keys, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        key_at, key_count = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        unknown = np.ones(len(keys), bool)
        for t in (self.old, self.new):
            f = t.find(keys)
            has = f >= 0
            key_at[has], key_count[has] = t.start[f[has]], t.count[f[has]]
            unknown &= ~has
        ask = np.flatnonzero(unknown)
        if len(ask):
            u = short[first[ask]]
            ids, n = self._ask_units([raw[x:y] for x, y in zip(start[u].tolist(), end[u].tolist(), strict=True)])
            key_at[ask], key_count[ask] = self._keep(ids) + np.cumsum(n) - n, n
            self.new.add(keys[ask], key_at[ask], n)
            if len(self.new.keys) > 20_000 + len(self.old.keys) // 8:
                self.old.add(self.new.keys, self.new.start, self.new.count)
                self.new = _Table()
        at[short], count[short] = key_at[back], key_count[back]

        pool, long_ = self.pool, np.flatnonzero(direct)
        if len(long_):
            ids, n = self._ask([text(i) for i in long_])
            pool = np.concatenate([self.pool[: self.used], ids])
            at[long_], count[long_] = self.used + np.cumsum(n) - n, n
        before = np.cumsum(count) - count
        total = int(count.sum())
        out = pool[np.repeat(at - before, count) + np.arange(total)]
        to = np.append(before, total)
        return out, to[np.searchsorted(start, offs)]


def _odd(buf: np.ndarray, offs: np.ndarray) -> list[int]:
    """Texts that hold white space outside ASCII."""
    at = np.flatnonzero(_LEAD[buf])
    if not len(at):
        return []
    after = np.concatenate([buf, np.zeros(2, np.uint8)])
    a, b, c = buf[at], after[at + 1], after[at + 2]
    is_space = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    is_space |= (a == 0xE1) & (b == 0x9A) & (c == 0x80)
    is_space |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) & (c >= 0x80) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    is_space |= (a == 0xE2) & (b == 0x81) & (c == 0x9F)
    is_space |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
    return np.unique(np.searchsorted(offs, at[is_space], side="right") - 1).tolist()
