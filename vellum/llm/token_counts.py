"""Token counts under a unigram vocabulary by dynamic programming over a trie of pre-tokens.

Each distinct pre-token (a word with its leading space mark) is inserted in a trie. The
best segmentation score of a prefix depends on the prefix alone, so a node's forward score
and token count are computed once, when the node is made, whatever number of words pass
through it; a word's count is read at its terminal node. The pieces that end at a new
node come from an automaton over the vocabulary. Each worker keeps the trie and a table
from a pre-token's hash to its terminal for all its texts, both bounded; what a word has
beyond DEPTH characters is scored in a window of the longest piece, outside the trie.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm._bpe import _Table
from vellum.llm._shared import small_batches
from vellum.llm._text import Words, slices

SPACE = "▁"
#: Nodes of a worker's trie, and words of its table, after which they are started anew.
MOST_NODES, MOST_WORDS = 300_000, 1_000_000
#: Characters of a word that become nodes.
DEPTH = 256
_open: dict = {}


def vocabulary(model: str) -> dict[str, float]:
    """Pieces of a sentencepiece model with log probabilities that fall with their rank as Zipf's law says."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    keep = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    ranked = sorted(keep, key=lambda i: (-sp.get_score(i), i))
    weight = 1 / (np.arange(len(ranked)) + 10.0)
    return dict(zip(map(sp.id_to_piece, ranked), np.log(weight / weight.sum()).tolist(), strict=True))


class Trie:
    """Forward scores of all prefixes of the words inserted so far. A character outside the vocabulary is its UTF-8 bytes."""

    def __init__(self, scores: dict[str, float]):
        import ahocorasick

        self.scores, self.most = scores, max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - 10.0
        self.automaton = ahocorasick.Automaton()
        for piece, score in (scores or {"": 0.0}).items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.score, self.count = [0.0], [0]

    def insert(self, word: str) -> tuple[float, int]:
        """(score, tokens) of a word: of its terminal node, or beyond DEPTH of its end."""
        node, path, child = 0, [0], self.child
        score, count = self.score, self.count
        depth = min(len(word), DEPTH)
        known = 0
        while known < depth and (nxt := child.get((node, word[known]))) is not None:
            node = nxt
            path.append(node)
            known += 1
        if known == len(word):
            return score[node], count[node]
        # (score, tokens) of the prefixes that a piece may follow: prefix i is at i - base
        base = max(0, known + 1 - self.most)
        last = [(score[p], count[p]) for p in path[base:]]
        ends = self.automaton.iter(word, base) if self.scores else iter(())
        end, piece = next(ends, (len(word), None))
        while end < known:
            end, piece = next(ends, (len(word), None))
        for i in range(known, len(word)):
            s, n = last[i - base]
            best, tokens = s + self.unknown, n + len(word[i].encode("utf-8", "replace"))
            while end == i:  # longer pieces come first
                length, value = piece
                s, n = last[i + 1 - length - base]
                if s + value > best:
                    best, tokens = s + value, n + 1
                end, piece = next(ends, (len(word), None))
            last.append((best, tokens))
            if i < depth:
                child[node, word[i]] = len(score)
                node = len(score)
                score.append(best)
                count.append(tokens)
            if len(last) > 2 * self.most + 64:
                cut = len(last) - self.most - 1
                del last[:cut]
                base += cut
        return last[-1]


def _counter(model: str):
    def run(batches):
        if model not in _open:
            _open[model] = (Trie(vocabulary(model)), _Table(), _Table())
        trie, old, new = _open[model]
        for b in batches:
            words, tokens, score = [], [], []
            for _, _, buf, offs in slices(b.column(1)):
                if len(trie.score) > MOST_NODES:
                    trie.clear()
                w = Words(buf, offs)
                keys, first, back = np.unique(w.hashes(), return_index=True, return_inverse=True)
                n, s = np.zeros(len(keys), np.int64), np.zeros(len(keys))
                unknown = np.ones(len(keys), bool)
                for t in (old, new):
                    f = t.find(keys)
                    has = f >= 0
                    n[has], s[has] = t.count[f[has]], t.start[f[has]].view(np.float64)
                    unknown &= ~has
                ask = np.flatnonzero(unknown)
                if len(ask):
                    raw = buf.tobytes()
                    # in order, so that words with a common prefix follow each other
                    text = sorted((raw[w.start[first[i]] : w.end[first[i]]], i) for i in ask.tolist())
                    for body, i in text:
                        s[i], n[i] = trie.insert(SPACE + body.decode("utf-8", "replace"))
                        if len(trie.score) > 2 * MOST_NODES:
                            trie.clear()
                    if len(old.keys) + len(new.keys) > MOST_WORDS:
                        old, new = _Table(), _Table()
                    new.add(keys[ask], s[ask].view(np.int64), n[ask])
                    if len(new.keys) > 20_000 + len(old.keys) // 8:
                        old.add(new.keys, new.start, new.count)
                        new = _Table()
                    _open[model] = (trie, old, new)
                per = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[w.first])
                words.append(np.diff(w.first))
                tokens.append(per(n[back]))
                score.append(per(s[back]))
            cat = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0), t)
            yield pa.RecordBatch.from_arrays([b.column(0), cat(words, pa.int64()), cat(tokens, pa.int64()), cat(score, pa.float64())], names=["doc_id", "n_words", "n_tokens", "score"])

    return run


def count_tokens(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_words, n_tokens, score) of ``docs(doc_id, text)``: tokens of the best unigram segmentation of every word.

    Texts are read whole and split at ASCII white space. Null and empty texts have none.
    Of equally good segmentations the one whose last piece is longest counts. Repeated
    rows are counted each; doc_id may be null; further columns are ignored; no rows give none.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_counter(model), "doc_id long, n_words long, n_tokens long, score double")
