"""Each stage of the corpus pipeline against what it should make of its own input."""

from collections import Counter, defaultdict

import numpy as np

from tests.llm.test_operators import SCHEMA, awkward, base_figures, components, cut_repeats, library_ids, words_of


def test_stages(spark, tmp_path):
    import corpus_pipeline as c

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    rows = [(*d, len(d[1] or ""), 1, "x") for d in awkward() if d[0] is not None]
    spark.createDataFrame(rows, SCHEMA).select(*columns).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    texts = [{d[0]: d[1] for d in rows}]
    for i, (name, f) in enumerate(c.STAGES):
        out = f(spark, docs, str(tmp_path))
        if i == 4:
            break
        assert out.columns == columns, name
        out.write.parquet(str(tmp_path / f"{i}.parquet"))
        docs = spark.read.parquet(str(tmp_path / f"{i}.parquet"))
        got = docs.collect()
        texts.append({r["doc_id"]: r["text"] for r in got})
        if i:
            assert len(got) == len(texts[-1])

    failed = {i for i, t in texts[0].items() if (f := base_figures(t))[0] < 50 or 100 * f[4] > 50 * f[0]}
    assert not failed & texts[1].keys() and len(texts[0]) - len(failed) == len(texts[1])

    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in texts[1].items() if (w := words_of(t, True))}
    same = components(sets, [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    assert texts[2].keys() == set(same.values()) and len(texts[2]) < len(texts[1])

    ids = sorted(texts[2])
    bodies = [(texts[2][i] or "").encode() for i in ids]
    for i, b, gone in zip(ids, bodies, cut_repeats(bodies, 200), strict=True):
        assert texts[3][i] == np.frombuffer(b, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
    assert any(texts[2][i] != texts[3][i] for i in ids)
    assert texts[4].keys() <= texts[3].keys() and all(texts[3][i] == t for i, t in texts[4].items())

    pieces, sequences = defaultdict(list), Counter()
    for r in out.collect():
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]] += r["length"]
    assert pieces.keys() == texts[4].keys()
    for i, p in pieces.items():
        assert sum(n for _, n in p) == len(library_ids(texts[4][i], 1))
    assert all(n <= 2048 and n & (n - 1) == 0 for n in sequences.values())
    assert c.run(spark, str(tmp_path)).count() == sum(map(len, pieces.values()))


def test_rows_are_judged_each_by_itself(spark):
    """Rows without an id and rows of one id with other texts: none goes for another one's sake, and bad ones go."""
    import random

    import corpus_pipeline as c
    from tests.llm.test_operators import prose
    from vellum.llm.minhash_dedup import minhash_dedup

    rng = random.Random(11)
    good = [prose(rng, 120) for _ in range(12)]
    bad = "no id " * 80
    near = good[7] + " " + prose(rng, 1)
    rows = [(None, good[0]), (None, good[1]), (None, bad), (5, good[2]), (5, good[3]), (5, bad), (5, good[2]), (3, good[3]), (6, good[4]), (8, good[5]), (8, good[6]), (9, good[7]), (9, near), (7, bad), (7, good[8])]
    schema = "doc_id long, text string, lang string, source string"
    docs = spark.createDataFrame([(*r, "en", "s") for r in rows], schema).repartition(4)
    texts = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())

    first = c.quality(spark, docs, "")
    assert texts(first) == Counter(r for r in rows if r[1] != bad)
    second = texts(c.near_duplicates(spark, first, ""))
    nines = [k for k in second if k[0] == 9]
    assert len(nines) == 1 and nines[0][1] in (good[7], near)
    assert second - Counter(nines) == Counter([(None, good[0]), (None, good[1]), (5, good[2]), (3, good[3]), (6, good[4]), (8, good[5]), (8, good[6]), (7, good[8])])
    judged = {(r["doc_id"], r["text_key"]): (r["component_id"], r["kept"]) for r in minhash_dedup(first, keyed=True).collect()}
    key = {r["text"]: r["k"] for r in first.selectExpr("text", "xxhash64(text) AS k").collect()}
    assert judged[5, key[good[3]]] == (3, False) and judged[5, key[good[2]]] == (5, True) and judged[None, key[good[0]]] == (None, True)

    many = spark.createDataFrame([(None, prose(rng, 30), "en", "s") for _ in range(300)], schema)
    assert 240 < texts(c.target_weights(spark, many, "")).total() < 300


def test_replacement_characters_of_the_input_stay(spark):
    """Only bytes of a split character go with a repeat: U+FFFD of the document and what looks like its escape stay."""
    import random

    import corpus_pipeline as c
    from tests.llm.test_operators import prose

    rng = random.Random(12)
    passage = "".join(rng.choice("\u00e9\u00e8\ufffdab ") for _ in range(300))
    rows = [(i, f"{prose(rng, 9)} \ufffd\x01 \x01b \x01ab {head}{passage}{tail} \ufffd{prose(rng, 9)}") for i, (head, tail) in enumerate([("\u00e9", "\u00ea"), ("\u0169", "\u012a")])]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, n_chars long")
    bodies = [t.encode() for _, t in rows]
    want = {i: np.frombuffer(b, np.uint8)[~gone].tobytes().decode("utf-8", "ignore") for (i, _), b, gone in zip(rows, bodies, cut_repeats(bodies, 200), strict=True)}
    got = c.repeated_passages(spark, docs, "").collect()
    assert {r["doc_id"]: r["text"] for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got)
    assert all(len(t) < 200 and t.count("\ufffd") == 2 for t in want.values())


def test_workers_let_go(monkeypatch):
    """A worker keeps its tokenizer from one task of packing to the next, not for tasks of other stages, and gives back what a task has freed."""
    import pyarrow as pa

    from vellum.llm import _bpe, _shared, minhash_dedup, mixing, packing, quality_rules, suffix_dedup
    from vellum.llm.queries import BYTE_BPE, tokenizer_path

    given = []
    monkeypatch.setattr(_shared, "give_back", lambda: given.append(1))
    path = tokenizer_path(BYTE_BPE)
    text = pa.array(["some words that are encoded here, and more of them"])
    ids = pa.array([1], pa.int64())

    def docs():
        yield pa.RecordBatch.from_arrays([ids, text, ids], names=["doc_id", "text", "text_key"])

    others = {
        "quality": quality_rules._measured,
        "signatures": minhash_dedup._signed_rows(5, True, 48, 6),
        "ties": minhash_dedup._tied(1, 1),
        "links": minhash_dedup._verify(80),
        "runs": suffix_dedup._anchored(200, 32, 64),
        "blocks": suffix_dedup._sorted_blocks(200),
        "topics": mixing._counted(5),
        "packed": packing._packed(2048, 16),
    }
    for name, f in others.items():
        first = list(packing._tokenized(path, 1)(docs()))
        own = _bpe._open.get(path)
        assert own is not None, name
        assert list(packing._tokenized(path, 1)(docs())) == first and _bpe._open[path] is own, name
        n = len(given)
        rows = docs() if name in ("quality", "signatures") else iter(())
        list(f(rows))
        assert not _bpe._open, name
        assert len(given) == n + 1, name
    part = packing._tokenized(path, 1)(docs())  # a task that is not read to its end
    next(part)
    n = len(given)
    part.close()
    assert len(given) == n + 1
