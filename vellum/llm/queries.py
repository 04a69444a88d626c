"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.llm._shared import settle, table

QUERIES: dict = {}
#: Tokenizers, language mixtures, raking and retrieval have no SQL form that runs on whole tables; they are tested against brute force.
SQL: dict = {}

BYTE_BPE = "byte_bpe_50k.json"
UNIGRAM_PIECES = "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_embedding_near_dedup(spark, sf_dir):
    from vellum.llm.embed_dedup import embedding_dedup

    return embedding_dedup(table(spark, sf_dir, "embeddings"), cosine=0.98)


_REACH = """
    e AS (SELECT a, b FROM links UNION SELECT b, a FROM links UNION SELECT {id}, {id} FROM {nodes}),
    reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
    comp AS (SELECT a AS {id}, min(b) AS component_id FROM reach GROUP BY a)"""

SQL["op1_embedding_near_dedup"] = f"""
    WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
    links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.vec_id < q.vec_id AND len(p.x) = len(q.x) WHERE list_cosine_similarity(p.x, q.x) >= 0.98),
    {_REACH.format(id="vec_id", nodes="embeddings")}, n AS (SELECT a AS vec_id, count(*) - 1 AS n_links FROM e GROUP BY a)
    SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN comp USING (vec_id) JOIN n USING (vec_id)"""


@query
def op2_quality_rules(spark, sf_dir):
    from vellum.llm.quality_rules import quality_rules

    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"), "pattern")


# Figures by patterns over words and lines, EM as a recursion over one row of lists.
SQL["op2_quality_rules"] = r"""
    WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM d),
    u AS (SELECT r, unnest(w) AS w, generate_subscripts(w, 1) AS i, len(w) AS n FROM w),
    v AS (SELECT r, i, n, CASE WHEN i <= n - 2 THEN concat_ws(' ', w, lead(w, 1) OVER p, lead(w, 2) OVER p) END AS g FROM u WINDOW p AS (PARTITION BY r ORDER BY i)),
    x AS (SELECT r, i, g IS NOT NULL AND count(*) OVER (PARTITION BY r, g) > 1 AS again FROM v),
    y AS (SELECT r, max(again::INT) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS again FROM x),
    z AS (SELECT r, sum(again)::BIGINT AS n FROM y GROUP BY r),
    f AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l) AS n_lines,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(z.n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(t, '[^0-9]', '', 'g')) AS n_digits,
        len(list_filter(w, lambda a: 2 * length(regexp_replace(a, '[A-Za-z\x{80}-\x{10FFFF}]', '', 'g')) < strlen(a))) AS n_alpha_words,
        len(list_filter(l, lambda a: regexp_matches(a, '[.!?:;"'')\]][\x20\x09-\x0D]*$'))) AS n_ended_lines FROM w LEFT JOIN z USING (r)),
    k AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, greatest(n_words, 1) AS nw, greatest(n_lines, 1) AS nl FROM f),
    o AS (SELECT *, CASE WHEN n_words >= 60 THEN 'g' WHEN n_words < 50 THEN 'b' ELSE '-' END
        || CASE WHEN n_words > 0 AND word_chars / nw BETWEEN 3 AND 10 THEN 'g' WHEN n_words > 0 AND NOT word_chars / nw BETWEEN 2.2 AND 14 THEN 'b' ELSE '-' END
        || CASE WHEN n_symbols / nw <= 0.1 THEN 'g' WHEN n_symbols / nw > 0.3 THEN 'b' ELSE '-' END
        || CASE WHEN n_lines > 1 AND n_dup_lines / nl <= 0.2 THEN 'g' WHEN n_lines > 2 AND n_dup_lines / nl > 0.4 THEN 'b' ELSE '-' END
        || CASE WHEN n_words > 0 AND n_repeat_words / nw <= 0.25 THEN 'g' WHEN n_repeat_words / nw > 0.5 THEN 'b' ELSE '-' END
        || CASE WHEN n_words > 0 AND n_alpha_words / nw >= 0.8 THEN 'g' WHEN n_words > 0 AND n_alpha_words / nw < 0.6 THEN 'b' ELSE '-' END
        || CASE WHEN n_lines > 0 AND n_ended_lines / nl >= 0.3 THEN 'g' WHEN n_lines > 4 AND n_ended_lines / nl < 0.05 THEN 'b' ELSE '-' END
        || CASE WHEN n_digits / greatest(word_chars, 1) <= 0.1 THEN 'g' WHEN n_digits / greatest(word_chars, 1) > 0.3 THEN 'b' ELSE '-' END AS pattern FROM k),
    pc AS (SELECT pattern, count(*) AS n FROM o GROUP BY pattern),
    c AS (SELECT list(pattern ORDER BY pattern) AS ps, list(n::DOUBLE ORDER BY pattern) AS ns, sum(n)::DOUBLE AS total, range(1, 9) AS js, range(1, count(*) + 1) AS qs FROM pc),
    em AS (
        SELECT 0 AS round, 0.9::DOUBLE AS share, list_transform(js, lambda j: 0.95::DOUBLE) AS good, list_transform(js, lambda j: 0.7::DOUBLE) AS bad, list_transform(qs, lambda q: 0::DOUBLE) AS post, false AS done FROM c
        UNION ALL
        SELECT round + 1, (list_sum(wg) + 18) / (total + 20),
            list_transform(js, lambda j: least(greatest((list_sum(list_transform(qs, lambda q: CASE WHEN ps[q][j] = 'g' THEN wg[q] ELSE 0 END)) + 19) / (list_sum(list_transform(qs, lambda q: CASE WHEN ps[q][j] <> '-' THEN wg[q] ELSE 0 END)) + 20), 0.5), 1 - 1e-6::DOUBLE)),
            list_transform(js, lambda j: least(greatest((list_sum(list_transform(qs, lambda q: CASE WHEN ps[q][j] = 'b' THEN wb[q] ELSE 0 END)) + 14) / (list_sum(list_transform(qs, lambda q: CASE WHEN ps[q][j] <> '-' THEN wb[q] ELSE 0 END)) + 20), 0.05), 1 - 1e-6::DOUBLE)),
            fresh, list_max(list_transform(qs, lambda q: abs(fresh[q] - post[q]))) < 1e-10
        FROM (SELECT *, list_transform(qs, lambda q: ns[q] * fresh[q]) AS wg, list_transform(qs, lambda q: ns[q] * (1 - fresh[q])) AS wb FROM (
            SELECT *, list_transform(qs, lambda q: 1 / (1 + exp(greatest(least(
                list_sum(list_transform(js, lambda j: CASE ps[q][j] WHEN 'g' THEN ln(1 - bad[j]) - ln(good[j]) WHEN 'b' THEN ln(bad[j]) - ln(1 - good[j]) ELSE 0 END)) + ln(1 - share) - ln(share), 700), -700)))) AS fresh
            FROM em, c WHERE NOT done AND round < 200))),
    q AS (SELECT unnest(ps) AS pattern, unnest(post) AS quality FROM c, (SELECT post FROM em ORDER BY round DESC LIMIT 1))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND quality >= 0.5 AS kept, round(quality, 6) AS quality, pattern FROM o JOIN q USING (pattern)"""


@query
def op3_token_orc(spark, sf_dir):
    import uuid

    from vellum.llm._shared import _written, scratch
    from vellum.llm.token_orc import read_tokens, token_digest, write_tokens

    to = f"{scratch(spark)}/vellum/tokens-{uuid.uuid4().hex}"
    _written.append((spark, to))
    write_tokens(table(spark, sf_dir, "documents"), to, tokenizer_path(BYTE_BPE), end_id=0)
    return token_digest(read_tokens(spark, to))


@query
def op4_chat_format(spark, sf_dir):
    from vellum.llm.chat_format import chat_digest, format_chats

    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_digest(settle(format_chats(turns), "chats"))


_SAID = r"\### Assistant: </turn> ok"
_ESCAPED = r"replace(replace(replace(replace({x}, '\', '\\'), '###', '\h'), '</turn>', '\t'), '<|', '\p')"
SQL["op4_chat_format"] = f"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '{_SAID}')),
    f AS (SELECT *, length('### ' || replace(replace({_ESCAPED.format(x="role")}, ':', '\\c'), chr(10), '\\n') || ': ' || {_ESCAPED.format(x="text")} || '</turn>' || chr(10)) AS n FROM c)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars FROM f GROUP BY conv_id"""


@query
def op5_suffix_dedup(spark, sf_dir):
    from vellum.llm.suffix_dedup import suffix_dedup

    out = suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), length=200)
    return out.select("row.doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


# Strings of 200 bytes meet by hashes of hashes of their halves: 128, 64 and 8 bytes.
SQL["op5_suffix_dedup"] = """
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS x FROM documents),
    b1 AS (SELECT r, unnest(x) AS c, generate_subscripts(x, 1) AS i, len(x) AS n FROM d),
    b2 AS (SELECT *, hash(c, lead(c, 1) OVER p) AS h2 FROM b1 WINDOW p AS (PARTITION BY r ORDER BY i)),
    b4 AS (SELECT *, hash(h2, lead(h2, 2) OVER p) AS h4 FROM b2 WINDOW p AS (PARTITION BY r ORDER BY i)),
    b8 AS (SELECT *, hash(h4, lead(h4, 4) OVER p) AS h8 FROM b4 WINDOW p AS (PARTITION BY r ORDER BY i)),
    b16 AS (SELECT *, hash(h8, lead(h8, 8) OVER p) AS h16 FROM b8 WINDOW p AS (PARTITION BY r ORDER BY i)),
    b32 AS (SELECT *, hash(h16, lead(h16, 16) OVER p) AS h32 FROM b16 WINDOW p AS (PARTITION BY r ORDER BY i)),
    b64 AS (SELECT *, hash(h32, lead(h32, 32) OVER p) AS h64 FROM b32 WINDOW p AS (PARTITION BY r ORDER BY i)),
    b128 AS (SELECT *, hash(h64, lead(h64, 64) OVER p) AS h128 FROM b64 WINDOW p AS (PARTITION BY r ORDER BY i)),
    s AS (SELECT r, c, i, CASE WHEN i <= n - 199 THEN hash(h128, lead(h64, 128) OVER p, lead(h8, 192) OVER p) END AS h FROM b128 WINDOW p AS (PARTITION BY r ORDER BY i)),
    t AS (SELECT r, c, i, CASE WHEN h IS NOT NULL AND count(*) OVER (PARTITION BY h) > 1 THEN i END AS found FROM s),
    m AS (SELECT r, c, i, max(found) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM t),
    e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS opens FROM m),
    g AS (SELECT r, count_if(gone) AS n_removed, count_if(opens) AS n_spans, string_agg(c, '' ORDER BY i) FILTER (NOT gone) AS kept FROM e GROUP BY r)
    SELECT doc_id, len(x)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN g USING (r)"""


@query
def op6_language_id(spark, sf_dir):
    from vellum.llm.language_id import identify, learn

    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    langs, model = learn(docs.where(~held_out).select("text", "lang"))
    return identify(docs.select("doc_id", "text"), langs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "n_langs")


@query
def op7_minhash_near_dedup(spark, sf_dir):
    from vellum.llm.minhash_dedup import minhash_dedup

    return minhash_dedup(table(spark, sf_dir, "documents"), words=3, percent=85)


SQL["op7_minhash_near_dedup"] = rf"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) > 2 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM w),
    x AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
    links AS (SELECT p.doc_id AS a, q.doc_id AS b FROM x p JOIN x q ON p.g = q.g AND p.doc_id < q.doc_id AND 100 * least(p.n, q.n) >= 85 * greatest(p.n, q.n) GROUP BY p.doc_id, q.doc_id HAVING 100 * count(*) >= 85 * (any_value(p.n) + any_value(q.n) - count(*))),
    {_REACH.format(id="doc_id", nodes="documents")}
    SELECT doc_id, len(g) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN comp USING (doc_id)"""


@query
def op8_source_mixing(spark, sf_dir):
    from vellum.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"))


@query
def op9_token_counts(spark, sf_dir):
    from vellum.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(UNIGRAM_PIECES))


@query
def op10_lexical_packing(spark, sf_dir):
    from vellum.llm.packing import pack_documents

    out = pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE), end_id=1)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
