"""Registered queries on small tables against plain versions of what they are to return; texts above a megabyte among them."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.test_operators import awkward, base_figures, crc, cut_repeats, library_ids, prose
from vellum.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(31)
    docs = [(*d, len(d[1] or "")) for d in awkward()]
    long = prose(rng, 300_000, "abcdefghij")  # above the slices and pieces that operators work on
    return [*docs, (500, long, "en", "s1", len(long)), (501, prose(rng, 60) + " " + long[600_000:601_500], "fr", "s2", 0)]


@pytest.fixture(scope="module")
def at(spark, rows, tmp_path_factory):
    to = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{to}/documents.parquet")
    turns = [(c, k, role, text) for c in (1, 2) for k, role, text in ((0, "user", "hi"), (1, "assistant", f"<|{c}"), (2, "assistant", None))]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{to}/conversations.parquet")
    return str(to)


def test_op2(spark, at, rows):
    got = QUERIES["op2_quality_rules"](spark, at).collect()
    assert len(got) == len(rows)
    want = {r[0]: base_figures(r[1]) for r in rows}
    votes = Counter(r["pattern"] for r in got)
    for r in got:
        f = want[r["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == f
        assert r["base_failed"] == (f[0] < 50 or 100 * f[4] > 50 * f[0])
        assert r["kept"] == (not r["base_failed"] and r["quality"] >= 0.5)
    # the posterior of each pattern by loops over the patterns, with the priors that estimate states
    k = len(next(iter(votes)))
    share, good, bad, post = 0.9, [0.95] * k, [0.7] * k, {}
    for _ in range(200):
        for p in votes:
            a, b = share, 1 - share
            for i, v in enumerate(p):
                a *= 1 if v == "-" else good[i] if v == "g" else 1 - good[i]
                b *= 1 if v == "-" else bad[i] if v == "b" else 1 - bad[i]
            post[p] = a / (a + b)
        share = (sum(n * post[p] for p, n in votes.items()) + 18) / (sum(votes.values()) + 20)
        for i in range(k):
            said = {p: n for p, n in votes.items() if p[i] != "-"}
            good[i] = min(max((sum(n * post[p] for p, n in said.items() if p[i] == "g") + 19) / (sum(n * post[p] for p, n in said.items()) + 20), 0.5), 1 - 1e-6)
            bad[i] = min(max((sum(n * (1 - post[p]) for p, n in said.items() if p[i] == "b") + 14) / (sum(n * (1 - post[p]) for p, n in said.items()) + 20), 0.05), 1 - 1e-6)
    assert all(abs(r["quality"] - post[r["pattern"]]) < 1e-6 for r in got)


def test_op3(spark, at, rows):
    got = QUERIES["op3_token_orc"](spark, at).orderBy("start").collect()
    text, start = {r[0]: r[1] for r in rows}, 0
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    for r in got:
        ids = library_ids(text[r["doc_id"]], 0)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)


def test_op4(spark, at):
    got = {r["conv_id"]: r for r in QUERIES["op4_chat_format"](spark, at).collect()}
    said = r"\### Assistant: </turn> ok"
    want = {-7: [("user", said), ("assistant", said)], 1: [("user", "hi"), ("assistant", "<|1"), ("assistant", "")], 2: [("user", "hi"), ("assistant", "<|2"), ("assistant", "")]}
    assert got.keys() == want.keys()
    for c, turns in want.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (got[c]["n_turns"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_op5(spark, at, rows):
    texts = [(r[1] or "").encode() for r in rows]
    want = Counter()
    for r, t, gone in zip(rows, texts, cut_repeats(texts, 200), strict=True):
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[r[0], len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    got = QUERIES["op5_suffix_dedup"](spark, at).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want
    assert want.keys() and max(k[2] for k in want if k[0] == 500) >= 1500


def test_op6(spark, at, rows):
    got = QUERIES["op6_language_id"](spark, at).collect()
    assert len(got) == len(rows)
    letters = {r[0]: any(c.isalpha() for c in r[1] or "") for r in rows}
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert r["lang_pred"] in (("en", "fr") if letters[r["doc_id"]] else ("und",)) and 0 <= r["score"] <= 1


def test_op9_and_op10(spark, at, rows):
    words = {r["doc_id"]: r["n_words"] for r in QUERIES["op9_token_counts"](spark, at).collect()}
    assert words == {r[0]: base_figures(r[1])[0] for r in rows}
    text, pieces, sequences = {r[0]: r[1] for r in rows}, defaultdict(list), defaultdict(list)
    for r in QUERIES["op10_lexical_packing"](spark, at).collect():
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    copies = Counter(r[0] for r in rows)
    for i, own in pieces.items():
        ids = library_ids(text[i], 1)
        assert sum(p[1] for p in own) == copies[i] * len(ids) and {p[3] for p in own} == {len(ids)}
        assert all(crc(ids[s : s + n]) == c for s, n, c, _ in own)
    assert pieces.keys() == copies.keys()
    for s in sequences.values():
        s.sort()
        n = sum(x for _, x in s)
        assert [o for o, _ in s] == np.cumsum([0, *(x for _, x in s[:-1])]).tolist() and n <= 2048 and n & (n - 1) == 0


@pytest.mark.parametrize("name", ["op2_quality_rules", "op5_suffix_dedup"])
def test_sql_says_the_same(spark, at, name):
    import duckdb

    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet/*.parquet'")
    want = duck.execute(SQL[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, at)
    assert sorted(got.columns) == sorted(columns)
    assert Counter(tuple(r) for r in got.select(columns).collect()) == Counter(want.fetchall())
