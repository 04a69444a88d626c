"""Every operator against a plain re-computation on small tables with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, n string"


def prose(rng, n, kind="abcdefgh"):
    return " ".join("".join(rng.choice(kind) for _ in range(rng.randint(2, 7))) for _ in range(n))


def awkward():
    """Documents with nulls, empty and long texts, exact, near and partial copies, ties and repeated rows."""
    rng = random.Random(5)
    docs = [(i, prose(rng, rng.randint(20, 160)), rng.choice(["en", "fr"]), f"s{i % 3}") for i in range(40)]
    base = docs[3][1]
    docs += [(100 + i, base, "en", "s0") for i in range(6)]
    words = docs[5][1].split()
    for i in range(12):
        w = list(words)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = prose(rng, 1)
        docs.append((200 + i, " ".join(w), "fr", "s1"))
    passage = prose(rng, 60)
    for i in range(8):
        docs.append((300 + i, f"{prose(rng, 20)} {passage[i:]} {prose(rng, 15)}", "en", "s0"))
    docs += [(400, None, "en", "s0"), (401, "", None, None), (402, "  \n\t ", "fr", "s2"), (403, "one", "en", "s1"), (404, "one two", "en", "s1"), (405, "one two", "en", "s1")]
    docs += [(406, "a" * 700, "en", "s2"), (407, "ab " * 400, "en", "s2"), (408, prose(rng, 9000), "fr", "s0"), (409, "é\u00a0 \u2003x " * 90 + "naïve «été» 12:34", "fr", "s1")]
    docs += [(410, "<|endoftext|> it's  we'll\n\n\nthey've   \\ end ", "en", "s1"), (411, "line one here\nline one here\nother\n\n  \nline one here", "en", "s1")]
    docs += [docs[7], (None, "no id " * 80, "en", "s1"), (412, "12345 67890 .,;", "en", "s0")]
    return docs


@pytest.fixture(scope="module")
def docs():
    return awkward()


@pytest.fixture(scope="module")
def frame(spark, docs):
    return spark.createDataFrame([(*d, 0, 1, "x") for d in docs], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text, lower=False):
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


def components(ids, edges):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_components(spark):
    from vellum.llm.components import connected_components

    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5), (None, 3), (2000, 2001), (2000, 2001)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == components({x for e in real for x in e}, real)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    stars = [(c, 10_000 * c + i) for c in (1, 2, 3) for i in range(1500)] + [(20_001, 30_001)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert got == components({x for e in stars for x in e}, stars) and set(got.values()) == {1, 2}


@pytest.mark.parametrize("chunk, most", [(2000, 4096), (3, 4096), (2000, 2)])
def test_minhash(frame, docs, empty, chunk, most):
    from vellum.llm.minhash_dedup import minhash_dedup

    sets = {}
    for i, t, *_ in docs:
        w = words_of(t, True)
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()
    ids = sorted(i for i in sets if i is not None)
    edges = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = components(ids, edges)
    got = minhash_dedup(frame, words=3, percent=85, chunk=chunk, most=most).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r["n_shingles"] == len(sets[r["doc_id"]])
        assert r["component_id"] == want.get(r["doc_id"])
        assert r["kept"] == (r["doc_id"] is None or r["doc_id"] == want[r["doc_id"]])
    assert len({c for c in want.values()}) < len(want) - 10
    assert minhash_dedup(empty).count() == 0


def test_minhash_miss_rate():
    """Pairs at the threshold that the signature cut alone rules out are few beside those that banding misses."""
    from math import comb

    from vellum.llm.minhash_dedup import least_equal

    for j, banding in ((0.8, 5e-7), (0.85, 2e-10)):
        cut = least_equal(j, 128)
        ruled_out = sum(comb(128, k) * j**k * (1 - j) ** (128 - k) for k in range(129) if k < cut)
        assert ruled_out < 3e-12 and (1 - j**6) ** 48 + ruled_out < banding


def test_embeddings(spark):
    from pyspark.sql import functions as F

    from vellum.llm.embed_dedup import embedding_dedup

    rng = np.random.default_rng(3)
    rows, x = [], rng.standard_normal((120, 24))
    for i in range(120):
        rows.append((i, x[i].tolist(), int(i % 3)))
    for i in range(120, 300):
        rows.append((i, (x[i % 7] + rng.standard_normal(24) * rng.choice([0.02, 0.1, 0.15, 0.3])).tolist(), int(i % 7) % 3))
    rows += [(300 + i, x[1].tolist(), 1) for i in range(5)] + [(310, (2 * x[1]).tolist(), 1), (311, x[1].tolist(), None), (312, None, 1), (313, [], 1), (314, [0.0] * 24, 1), (315, [float("nan")] * 24, 1)]
    rows += [(316, [float("inf")] + [1.0] * 23, 1), (317, [None] + [1.0] * 23, 1), (318, x[1][:12].tolist(), 1), (319, x[1][:12].tolist(), 1), (None, x[1].tolist(), 1), (320, [1.0], 2), (321, [2.0], 2)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    good = {}
    for i, v, label in rows:
        if i is None or label is None or not v or None in v:
            continue
        v = np.array(v, np.float32).astype(float)
        if np.isfinite(v).all() and v.any():
            good[i] = (label, v)
    links = defaultdict(set)
    for a, (la, va) in good.items():
        for b, (lb, vb) in good.items():
            if a < b and la == lb and len(va) == len(vb) and va @ vb / (np.linalg.norm(va) * np.linalg.norm(vb)) >= 0.98:
                links[a].add(b)
                links[b].add(a)
    want = components({r[0] for r in rows if r[0] is not None}, [(a, b) for a in links for b in links[a]])
    for cell_rows in (4096, 20, 2):
        got = embedding_dedup(frame.withColumn("id", F.lit(1)).withColumn("cell", F.lit("x")), 0.98, cell_rows=cell_rows).collect()
        assert len(got) == len(rows)
        for r in got:
            if r["vec_id"] is not None:
                assert (r["n_links"], r["component_id"]) == (len(links[r["vec_id"]]), want[r["vec_id"]]), r
    again = embedding_dedup(frame.unionByName(frame.where("vec_id = 3"))).where("vec_id = 3").collect()
    assert [r["n_links"] for r in again] == [len(links[3]) + 1] * 2  # every row of a repeated vector counts
    # a double column keeps its width: one step of a double away from the threshold decides
    x, c = [1.0, 0.0], 0.98
    inside, outside = [c, float(np.sqrt(1 - c * c)) * (1 - 1e-12)], [c, float(np.sqrt(1 - c * c)) * (1 + 1e-9)]
    wide = spark.createDataFrame([(1, x, 0), (2, inside, 0), (3, x, 1), (4, outside, 1)], "vec_id long, embedding array<double>, label int")
    assert {r["vec_id"]: r["n_links"] for r in embedding_dedup(wide).collect()} == {1: 1, 2: 1, 3: 0, 4: 0}
    assert sum(map(len, links.values())) > 300
    assert embedding_dedup(frame.limit(0)).count() == 0


def base_figures(text):
    w = words_of(text)
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality(frame, docs, empty):
    from vellum.llm.quality_rules import quality_rules

    texts = defaultdict(set)
    for i, t, *_ in docs:
        texts[i].add(t)
    got = quality_rules(frame).collect()
    assert len(got) == len(docs)
    for r in got:
        (text,) = texts[r["doc_id"]]
        want = base_figures(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, r
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    assert quality_rules(empty).count() == 0


def test_quality_estimate():
    from vellum.llm.quality_rules import estimate

    rng = np.random.default_rng(0)
    truth = rng.random(20000) < 0.8
    right = np.array([0.95, 0.9, 0.85, 0.6])
    votes = np.where(rng.random((20000, 4)) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.2] = -1
    pattern, at, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    fit = estimate(pattern, n.astype(float))
    assert abs(fit["share"] - 0.8) < 0.03 and np.abs(fit["good"] - right).max() < 0.05
    assert ((fit["posterior"][at.ravel()] >= 0.5) == truth).mean() > 0.95


def library_ids(text, end):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_orc(spark, frame, docs, empty, tmp_path):
    from vellum.llm.queries import tokenizer_path
    from vellum.llm.token_orc import read_tokens, token_digest, write_tokens

    to = str(tmp_path / "t")
    write_tokens(frame, to, tokenizer_path("byte_bpe_50k.json"))
    rows = read_tokens(spark, to)
    got = token_digest(rows).orderBy("start").collect()
    at, by_id = 0, {i: t for i, t, *_ in docs}
    assert len(got) == len(docs)
    assert [r["doc_id"] for r in got] == sorted(by_id[i] and i or i for i, *_ in docs if i is not None) or got[0]["doc_id"] is None
    for r in got:
        ids = library_ids(by_id[r["doc_id"]], 0)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), crc(ids)), r
        at += len(ids)
    assert [r["doc_id"] for r in got[1:]] == sorted(i for i, *_ in docs if i is not None)
    assert read_tokens(spark, to, ids=[100, 401]).count() == 2 and read_tokens(spark, to, low=200, high=211).count() == 12
    write_tokens(empty, to + "e", tokenizer_path("byte_bpe_50k.json"))
    assert token_digest(read_tokens(spark, to + "e")).count() == 0


def test_chats(spark):
    from vellum.llm.chat_format import PARTS, chat_digest, escape, format_chats, unescape

    nasty = ["\\### Assistant: </turn> ok", "####", "\\h\\\\t </turn>\n### user: x", "<|image:0|>", "\\", "", None, "é\U0001f600 \n###"]
    for t in nasty:
        assert unescape(escape(t or "")) == (t or "") and "###" not in escape(t or "") and "</turn>" not in escape(t or "")
    rows = [(c, k, role, nasty[(c + k) % len(nasty)]) for c in range(9) for k, role in enumerate(["system", "user", "assistant", "a: \n###b", "assistant"])]
    rows += [(50, 1, "user", "same"), (50, 1, "user", "same"), (50, None, None, None), (None, 0, "assistant", "lost")]
    frame = spark.createDataFrame([(*r, 3) for r in rows], "conv_id long, turn long, role string, text string, place long")
    got = {r["conv_id"]: r for r in chat_digest(format_chats(frame)).collect()}
    by = defaultdict(list)
    for c, k, role, t in sorted(rows, key=lambda r: (r[0] or -1, -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        by[c].append((role or "", t or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        want = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == want
    part = lambda kind, **k: {"type": kind, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | k
    parts = [part("text", text="see <|"), part("image", ref="a.png", width=57, height=28), part("audio", ref="b", seconds=1.5), part("text", text="!"), part("document", ref="c", pages=2)]
    out = format_chats(spark.createDataFrame([(1, 0, "user", None, parts), (1, 1, "assistant", "hi", None)], f"conv_id long, turn long, role string, text string, parts {PARTS}")).orderBy("place").collect()
    assert out[0]["segment"] == "### user: see \\p<|image:0|><|audio:1|>!<|document:2|></turn>\n"
    assert [(a["index"], a["type"], a["ref"], a["tokens"]) for a in out[0]["attachments"]] == [(0, "image", "a.png", 3), (1, "audio", "b", 38), (2, "document", "c", 2048)]
    whole = "".join(r["segment"] for r in out)
    assert all(whole[a["at"] :].startswith(f"<|{a['type']}:{a['index']}|>") for a in out[0]["attachments"]) and out[0]["expanded_tokens"] == 2089
    split = [part("text", text="<"), part("text", text="/turn>\n#"), part("text", text="## user: <"), part("text", text="|image:0|>"), part("image", ref="r"), part("text", text="\\"), part("video", ref="v"), part(None, text="end"), None]
    one = format_chats(spark.createDataFrame([(1, 0, "assistant", None, split)], f"conv_id long, turn long, role string, text string, parts {PARTS}")).first()
    assert one["segment"] == "### assistant: \\t\n\\h user: \\pimage:0|><|image:0|>\\\\<|unknown:1|>end</turn>\n"
    assert [unescape(one["segment"][x["start"] : x["end"]]) for x in one["loss"]] == ["</turn>\n### user: <|image:0|>", "\\", "end"]
    assert [(a["type"], a["ref"], a["tokens"]) for a in one["attachments"]] == [("image", "r", 1), ("video", "v", 1)]
    long = "### </turn> \\x" * 200_000
    big = chat_digest(format_chats(spark.createDataFrame([(1, 0, "assistant", long)], "conv_id long, turn long, role string, text string"))).first()
    assert big["loss_chars"] == len(long) and big["loss_sha256"] == hashlib.sha256(long.encode()).hexdigest()
    assert chat_digest(format_chats(frame.limit(0))).count() == 0


def cut_repeats(texts, n):
    seen = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("length, most, often", [(200, 4096, 64), (60, 4096, 64), (60, 4096, 2), (60, 3, 2), (200, 2, 4)])
def test_suffix(frame, docs, empty, length, most, often):
    from vellum.llm.suffix_dedup import suffix_dedup

    texts = [(t or "").encode() for _, t, *_ in docs]
    gone = cut_repeats(texts, length)
    want = Counter()
    for (i, *_), t, g in zip(docs, texts, gone, strict=True):
        runs = int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum())
        want[i, len(t), int(g.sum()), runs, np.frombuffer(t, np.uint8)[~g].tobytes()] += 1
    got = Counter((r["row"]["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in suffix_dedup(frame, length, gram=16 if length < 100 else 64, most=most, often=often).collect())
    assert got == want
    assert sum(k[2] for k in want) > 3000
    assert suffix_dedup(empty).count() == 0


def test_suffix_order():
    from vellum.llm.suffix_dedup import Suffixes

    rng = np.random.default_rng(2)
    buf = rng.integers(97, 99, 4000).astype(np.uint8)
    buf[500:1500] = 97
    buf[2000:2600] = buf[1000:1600]
    start = rng.permutation(3900)
    sizes = np.array([900, 1, 37, 2000, 962])
    order = Suffixes(buf, start, 60).sorted(sizes)
    raw, at = buf.tobytes(), 0
    for n in sizes:
        got = [raw[start[i] : start[i] + 60] for i in order[at : at + n]]
        assert got == sorted(raw[s : s + 60] for s in start[at : at + n])
        at += n


def test_language(spark, empty):
    from vellum.llm.language_id import identify, learn

    rng = random.Random(4)
    kinds = {"aa": "abcdef", "bb": "ghijkl", "cc": "mnopqrs"}
    rows = [(i, prose(rng, rng.randint(5, 60), kinds[k]), k) for i, k in enumerate(list(kinds) * 40)]
    langs, model = learn(spark.createDataFrame([*rows, (900, None, "aa"), (901, "zzz", None)], "doc_id long, text string, lang string"))
    assert langs == ["aa", "bb", "cc"]
    test = [(1000 + i, prose(rng, 30, kinds[k]), k) for i, k in enumerate(list(kinds) * 10)]
    mixed = [(2000, prose(rng, 60, kinds["aa"]) + " " + prose(rng, 40, kinds["cc"]), "aa")]
    odd = [(3000, None, "und"), (3001, "", "und"), (3002, "123 456 .,", "und")]
    got = {r["doc_id"]: r for r in identify(spark.createDataFrame(test + mixed + odd, "doc_id long, text string, lang string"), langs, model).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k in test + mixed + odd) and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[2000]["n_langs"] == 2 and abs(got[2000]["score"] - 0.6) < 0.1 and got[1000]["n_langs"] == 1 and got[3000]["score"] == 0
    # a text in pieces, cut inside words too, is judged as in one
    from vellum.llm import language_id as L

    raw = np.frombuffer((prose(rng, 300, kinds["bb"]) + "  " + prose(rng, 200, kinds["cc"]) + " " + "ab" * 900 + "\n").encode(), np.uint8)
    w = L.Words(raw, np.array([0, len(raw)]))
    g = np.concatenate([np.zeros((1, 3)), np.cumsum(model[L.trigrams(raw, np.array([0, len(raw)]))], axis=0, dtype=float)])
    whole = g[w.end] - g[w.start]
    for piece in (7, 64, 1 << 20):
        assert np.allclose(np.concatenate(list(L.word_likelihoods(raw, model, piece))), whole)
    lead, part, size = L.infer(whole, np.array([0, len(whole)]))
    long = L.infer_long(lambda: L.word_likelihoods(raw, model, 50))
    assert long[0] == lead[0] and abs(long[1] - part[0]) < 1e-9 and long[2] == size[0]
    big = prose(rng, 250_000, kinds["bb"]) + " " + prose(rng, 100_000, kinds["cc"])
    rows = spark.createDataFrame([(None, big, 1, "x"), (1, prose(rng, 9, kinds["aa"]), 1, "x"), (1, prose(rng, 9, kinds["aa"]), 1, "x")], "doc_id long, text string, score int, lang_pred string")
    got = identify(rows, langs, model).collect()
    assert sorted((r["doc_id"] or 0, r["lang_pred"], r["n_langs"]) for r in got) == [(0, "bb", 2), (1, "aa", 1), (1, "aa", 1)]
    assert identify(empty, langs, model).count() == 0
    none, table = learn(empty)
    assert none == [] and [r["lang_pred"] for r in identify(spark.createDataFrame(test[:1], "doc_id long, text string, lang string"), none, table).collect()] == ["und"]


def test_mixing(frame, docs, empty, spark):
    from vellum.llm import mixing

    got = mixing.mix_sources(frame, share=0.4, topics=3).collect()
    assert len(got) == len(docs)
    tokens = {i: len(words_of(t)) for i, t, *_ in docs}
    assert all(r["n_tokens"] == tokens[r["doc_id"]] for r in got)
    total = sum(r["n_tokens"] for r in got)
    assert abs(sum(r["n_tokens"] * r["probability"] for r in got) / total - 0.4) < 1e-6
    assert mixing.mix_sources(empty).count() == 0
    rng = np.random.default_rng(1)
    weight, index = rng.random(60), [np.repeat(range(5), 12), np.tile(np.repeat(range(3), 4), 5), np.tile(range(4), 15)]
    targets = [np.array(t) / sum(t) for t in ([1, 2, 3, 4, 5], [5, 1, 1], [1, 1, 1, 1])]
    f = mixing.rake(weight, index, targets)
    for at, t in zip(index, targets, strict=True):
        assert np.allclose(np.bincount(at, weight * f) / weight.sum(), t)
    p = mixing.calibrate(weight, f, 0.7)
    assert abs((p * weight).sum() / weight.sum() - 0.7) < 1e-9 and p.max() <= 1
    cells = spark.createDataFrame([(f"s{a}", f"l{b}", int(c), float(w)) for a, b, c, w in zip(*index, weight, strict=True)], "source string, lang string, topic int, weight double")
    powers = {"source": 0.5, "lang": 0.7, "topic": 0.0}
    one = {(r["source"], r["lang"], r["topic"]): r["probability"] for r in mixing._on_driver(cells, {}, powers, 0.3).collect()}
    two = {(r["source"], r["lang"], r["topic"]): r["probability"] for r in mixing._as_tables(cells, {}, powers, 0.3, rounds=6).collect()}
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-4 for k in one)


def test_topics(spark):
    """Texts of words of their own kind fall into topics of their own, whatever the partitions; a column takes their place."""
    from vellum.llm import mixing

    rng = random.Random(21)
    words = {k: ["".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(30)] for k in range(4)}
    rows = [(i, " ".join(rng.choice(words[i % 4]) for _ in range(40)) + " the of and", "s", "en", f"t{i % 3}") for i in range(400)]
    rows += [(1000, None, "s", "en", None), (1001, "a b c", None, "en", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, subject string")
    one, two = ({r["doc_id"]: r for r in mixing.mix_sources(frame.repartition(n), topics=4).collect()} for n in (1, 7))
    assert one == two and one[1000]["topic"] == one[1001]["topic"] == "0"
    kinds = defaultdict(Counter)
    for i in range(400):
        kinds[one[i]["topic"]][i % 4] += 1
    assert len(kinds) == 4 and sum(max(c.values()) for c in kinds.values()) == 400
    given = {r["doc_id"]: r["topic"] for r in mixing.mix_sources(frame, topic="subject").collect()}
    assert given == {r[0]: r[4] for r in rows}


def test_mixing_query(spark, tmp_path):
    """Probabilities and the sample of the registered query against raking by plain loops over its cells."""
    from vellum.llm.queries import QUERIES

    rows = [(*d, len(d[1] or "")) for d in awkward()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op8_source_mixing"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    dims = ("source", "lang", "topic")
    cells = Counter()
    for r in got:
        cells[tuple(r[d] for d in dims)] += r["n_tokens"]
    total = sum(cells.values())
    factor = dict.fromkeys(cells, 1.0)
    wanted = []
    for k, power in enumerate((0.7, 0.8, 0.9)):
        tokens = Counter()
        for c, n in cells.items():
            tokens[c[k]] += n
        raised = {v: n**power for v, n in tokens.items() if n}
        wanted.append({v: x / sum(raised.values()) for v, x in raised.items()})
    for _ in range(200):
        for k in range(3):
            have = Counter()
            for c, n in cells.items():
                have[c[k]] += n * factor[c]
            for c in cells:
                if have[c[k]] > 0:
                    factor[c] *= wanted[k].get(c[k], 0.0) * total / have[c[k]]
    capped = set()
    while True:
        scale = (0.5 * total - sum(cells[c] for c in capped)) / sum(n * factor[c] for c, n in cells.items() if c not in capped)
        over = {c for c in cells if c not in capped and factor[c] * scale > 1}
        if not over:
            break
        capped |= over
    for r in got:
        c = tuple(r[d] for d in dims)
        assert abs(r["probability"] - (1.0 if c in capped else factor[c] * scale)) < 1e-6, r
    p = np.array([r["probability"] for r in got])
    assert abs(sum(r["kept"] for r in got) - p.sum()) < 5 * np.sqrt((p * (1 - p)).sum())
    assert all(r["kept"] for r in got if r["probability"] == 1.0) and 0 < sum(r["kept"] for r in got) < len(got)


def test_mixing_paths_agree_where_raking_is_slow(spark):
    """Sparse cells that take far more than 12 rounds, values without tokens, capped cells and given targets: one result on either path."""
    from vellum.llm import mixing

    cells = [("s0", "en", 1, 900.0), ("s0", "fr", 0, 900.0), ("s0", "fr", 1, 20.0), ("s0", None, 0, 20.0), ("s0", None, 1, 20.0), ("s1", "en", 0, 20.0), ("s1", "fr", 1, 300.0), ("s2", "en", 0, 5.0), ("s2", "en", 1, 20.0), ("s2", None, 1, 60.0), (None, "en", 1, 60.0), (None, None, 1, 20.0), ("s3", "en", 1, 0.0)]
    frame = spark.createDataFrame(cells, "source string, lang string, topic int, weight double").repartition(3)
    powers = {"source": 0.7, "lang": 0.8, "topic": 0.9}
    weight, index, wanted = np.array([c[3] for c in cells]), [], []
    for k, d in enumerate(mixing.DIMS):
        values = list(dict.fromkeys(c[k] for c in cells))
        index.append(np.array([values.index(c[k]) for c in cells]))
        target = mixing.flattened(dict(zip(values, np.bincount(index[-1], weight), strict=True)), powers[d])
        wanted.append(np.array([target[v] for v in values]))
    assert np.abs(mixing.rake(weight, index, wanted, rounds=12) / mixing.rake(weight, index, wanted) - 1)[:-1].max() > 1e-3
    for targets in ({}, {"source": {"s0": 0.3, "s1": 0.25, "s2": 0.25, "s3": 0.1, "gone": 0.1}}):
        one, two = ({(r["source"], r["lang"], r["topic"]): r["probability"] for r in f(frame, targets, powers, 0.7).collect()} for f in (mixing._on_driver, mixing._as_tables))
        assert one.keys() == two.keys() and max(abs(one[k] - two[k]) for k in one) < 1e-8, targets
        assert max(one.values()) == 1.0


def best_split(word, scores, unknown):
    best = [(0.0, 0)] + [(-1e300, 0)] * len(word)
    for i in range(1, len(word) + 1):
        best[i] = (best[i - 1][0] + unknown, best[i - 1][1] + len(word[i - 1].encode()))
        for j in range(i):
            if word[j:i] in scores and best[j][0] + scores[word[j:i]] > best[i][0]:
                best[i] = (best[j][0] + scores[word[j:i]], best[j][1] + 1)
    return best[-1]


def test_token_counts(frame, docs, empty):
    from vellum.llm.queries import tokenizer_path
    from vellum.llm.token_counts import SPACE, Trie, count_tokens, vocabulary

    path = tokenizer_path("piece_bpe_32k.model")
    scores = vocabulary(path)
    unknown, memo = Trie(scores).unknown, {}
    texts = {i: t for i, t, *_ in docs}
    got = count_tokens(frame, path).collect()
    assert len(got) == len(docs)
    for r in got:
        split = [memo.setdefault(w, best_split(SPACE + w, scores, unknown)) for w in words_of(texts[r["doc_id"]])]
        assert (r["n_words"], r["n_tokens"]) == (len(split), sum(n for _, n in split))
        assert abs(r["score"] - sum(s for s, _ in split)) < 1e-6 * (1 + abs(r["score"]))
    # a long word makes no more than DEPTH nodes and counts the same
    from vellum.llm import token_counts as C

    word = "".join(random.Random(8).choice("aeinost中") for _ in range(3000))
    trie = Trie(scores)
    assert trie.insert(word) == trie.insert(word) and len(trie.score) == C.DEPTH + 1
    want = best_split(word[:600], scores, unknown)
    got = trie.insert(word[:600])
    assert got[1] == want[1] and abs(got[0] - want[0]) < 1e-6
    assert Trie({}).insert("ab中")[1] == 5
    assert count_tokens(empty, path).count() == 0


@pytest.mark.parametrize("window, shard", [(2048, 1 << 20), (64, 2000)])
def test_packing(frame, docs, empty, window, shard):
    from vellum.llm.packing import pack_documents
    from vellum.llm.queries import tokenizer_path

    path = tokenizer_path("byte_bpe_50k.json")
    got = pack_documents(frame, path, window=window, shard_tokens=shard).collect()
    want = Counter()
    for i, t, *_ in docs:
        want[i, tuple(library_ids(t, 1))] += 1
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] > 0
        pieces[r["doc_id"]].append((r["start"], ids, r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, ids in want:
        own = sorted(pieces[i])
        if want[i, ids] == 1:
            assert [s for s, *_ in own] == np.cumsum([0, *(len(x) for _, x, _ in own[:-1])]).tolist()
            assert tuple(x for _, p, _ in own for x in p) == ids and {n for *_, n in own} == {len(ids)}
        else:
            assert sum(len(p) for _, p, _ in own) == want[i, ids] * len(ids)
    for s in sequences.values():
        s.sort()
        n = sum(y for _, y in s)
        assert [o for o, _ in s] == np.cumsum([0, *(y for _, y in s[:-1])]).tolist() and n <= window and n & (n - 1) == 0
    assert pack_documents(empty, path).count() == 0


def test_retrieval_prefers_related():
    from vellum.llm.packing import pack

    rng = np.random.default_rng(0)
    ids = [rng.integers(1000 * (i % 4), 1000 * (i % 4) + 300, 200) for i in range(64)]
    out = pack(ids, 1024, 16)
    by = defaultdict(Counter)
    for d, _, n, q, _ in out:
        by[q][d % 4] += n
    assert np.mean([max(c.values()) / sum(c.values()) for c in by.values()]) > 0.85
