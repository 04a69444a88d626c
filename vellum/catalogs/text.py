"""Queries over text nodes: repairs, running headers, vocabulary and register."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.catalogs import registry, table
from vellum.functions import text as T
from vellum.operators import cleanup as C

QUERIES, SQL, query = registry()

#: Spells a word boundary of letters outside ASCII for an engine whose own knows ASCII only, and takes it back.
_GUARD = r"regexp_replace({x}, '([^\P{{L}}\x00-\x7F])', '_\1_', 'g')"
_UNGUARD = r"regexp_replace({x}, '_([^\P{{L}}\x00-\x7F])_', '\1', 'g')"


def _replaced(x, pairs):
    for a, b in pairs:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def _quoted(s):
    return " || ".join(f"chr({ord(c)})" if ord(c) > 126 or ord(c) < 32 else "''''" if c == "'" else f"'{c}'" for c in s) or "''"


def _replaced_sql(x, pairs):
    for a, b in pairs:
        x = f"replace({x}, {_quoted(a)}, {_quoted(b)})"
    return x


def _repair(name, breaks, fix, fix_sql):
    """A query that damages every document, repairs it and says what came of it."""

    def run(spark, sf_dir):
        d = table(spark, sf_dir, "documents").select("doc_id", "text", _replaced(F.col("text"), breaks).alias("broken"))
        d = d.withColumn("fixed", fix(F.col("broken")))
        return d.select("doc_id", (F.col("broken") != F.col("text")).alias("damaged"), (F.col("fixed") == F.col("text")).alias("restored"), F.md5("fixed").alias("fixed_md5"))

    QUERIES[name] = run
    SQL[name] = f"""
        WITH d AS (SELECT doc_id, text, {_replaced_sql("text", breaks)} AS broken FROM documents), f AS (SELECT *, {fix_sql.format(x="broken")} AS fixed FROM d)
        SELECT doc_id, broken <> text AS damaged, fixed = text AS restored, md5(fixed) AS fixed_md5 FROM f"""


def _sql_pairs(pairs):
    return _replaced_sql("{x}", pairs)


_repair("ligature_repair", [("ffi", "ﬃ"), ("ff", "ﬀ"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("st", "ﬆ")], T.fix_ligatures, "replace(replace(replace(replace(replace(replace(replace({x}, chr(64256), 'ff'), chr(64257), 'fi'), chr(64258), 'fl'), chr(64259), 'ffi'), chr(64260), 'ffl'), chr(64261), 'st'), chr(64262), 'st')")
_repair("mojibake_repair", [("é", "Ã©"), ("è", "Ã¨"), (" th", "Â th")], T.fix_mojibake, "replace(replace(replace({x}, chr(195) || chr(169), chr(233)), chr(195) || chr(168), chr(232)), chr(194) || ' ', ' ')")
#: What each wrong sequence stands for, written out: code points of the sequence and of the character.
_SEQUENCES = [((226, 8364, 8482), 39), ((226, 8364, 732), 39), ((226, 8364, 339), 34), ((226, 8364, 157), 34), ((226, 8364, 8221), 8212), ((226, 8364, 8220), 8211), ((194, 32), 32), ((195, 169), 233), ((195, 168), 232)]


def _mojibake_sql():
    x = "text"
    for k, (_, right) in enumerate(_SEQUENCES):
        x = f"replace({x}, ' {'taosdwbmi'[k]}', ' ' || chr({right}) || '{'taosdwbmi'[k]}')"
    return x


@query(f"SELECT doc_id, md5({_mojibake_sql()}) AS text_md5 FROM documents")
def mojibake_all(spark, sf_dir):
    """Each wrong sequence before words of one letter, and what it stands for in its place."""
    x = F.col("text")
    for k, (wrong, _) in enumerate(_SEQUENCES):
        x = F.replace(x, F.lit(f" {'taosdwbmi'[k]}"), F.lit(" " + "".join(map(chr, wrong)) + "taosdwbmi"[k]))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.fix_mojibake(x)).alias("text_md5"))


_repair("soft_hyphen", [("the", "t­he"), ("en", "e­n")], T.drop_soft_hyphens, _sql_pairs([(T.SOFT_HYPHEN, "")]))
_repair("caret_noise", [(". ", "^^. "), (", ", "{12}, ")], T.drop_caret_noise, r"regexp_replace(regexp_replace({x}, '\^+', '', 'g'), '\{{[0-9]+\}}', '', 'g')")
_repair("cr_midline", [("th", "t\rh"), (". ", ".\r ")], T.drop_inner_returns, r"regexp_replace({x}, '([\p{{L}}\p{{N}}_])\r([\p{{L}}\p{{N}}_])', '\1\2', 'g')")
_repair("whitespace_collapse", [(". ", ".  \t "), (", ", ",\t")], T.collapse_blanks, r"regexp_replace({x}, '[ \t]+', ' ', 'g')")
_repair("nfkc_normalize", [("fi", "ﬁ"), ("fl", "ﬂ"), (". ", ". ")], T.nfkc, _sql_pairs([("ﬁ", "fi"), ("ﬂ", "fl"), (" ", " ")]))
_repair(
    "clean_text_full",
    [("fl", "ﬂ"), ("é", "Ã©"), ("the", "t­he"), (". ", "^.  "), (", ", ", ")],
    T.basic_clean,
    "regexp_replace(regexp_replace(regexp_replace(replace(replace({x}, 'Ã©', 'é'), chr(173), '').replace('ﬂ', 'fl').replace(chr(160), ' '), '\\^+', '', 'g'), '\\{{[0-9]+\\}}', '', 'g'), '[ \\t]+', ' ', 'g')",
)

_EDGES = r"""
    lines AS (SELECT doc_id, source, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(replace(replace(x, chr(9), ' '), chr(13), ' '))), lambda x: length(x) > 0) AS l FROM documents),
    edges AS (SELECT source, unnest(list_concat(l[1:3], l[greatest(len(l) - 2, 1):])) AS line FROM lines WHERE len(l) > 0),
    often AS (SELECT source, line, count(*) AS n FROM edges WHERE length(line) <= 120 GROUP BY ALL)"""
_TITLES = """
    titles AS (SELECT DISTINCT source, l[1] AS line FROM lines WHERE len(l) > 0),
    headers AS (SELECT source, line, n FROM often WHERE n >= 3 AND (regexp_full_match(line, '[0-9]+') OR EXISTS (SELECT 1 FROM titles t WHERE t.source = often.source AND t.line = often.line)))"""


def _titles(docs):
    """First lines as the titles that a table of contents would have."""
    line = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(F.translate(x, "\t\r", "  "))), lambda x: F.length(x) > 0)
    return docs.select("source", F.get(line, F.lit(0)).alias("title")).where("title IS NOT NULL").distinct()


@query(f"WITH {_EDGES} SELECT source, line, n FROM often WHERE n >= 3")
def edge_lines(spark, sf_dir):
    return C.edge_lines(table(spark, sf_dir, "documents"), "source").where("n >= 3")


@query(f"WITH {_EDGES}, {_TITLES} SELECT * FROM headers")
def running_headers(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return C.running_headers(docs, "source", _titles(docs))


@query(
    f"""WITH {_EDGES}, {_TITLES}, gone AS (SELECT source, list(line) AS g FROM headers GROUP BY source),
    cut AS (SELECT doc_id, d.source, string_split(text, chr(10)) AS have, list_filter(string_split(text, chr(10)), lambda x: NOT coalesce(list_contains(g, trim(replace(replace(x, chr(9), ' '), chr(13), ' '))), false)) AS kept FROM documents d LEFT JOIN gone USING (source))
    SELECT doc_id, source, len(have) - len(kept) AS removed, md5(array_to_string(kept, chr(10))) AS text_md5 FROM cut WHERE have IS NOT NULL"""
)
def running_header_removal(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    headers = C.running_headers(docs, "source", _titles(docs))
    out = C.remove_lines(docs.select("doc_id", "source", "text"), ["doc_id"], "source", headers)
    return out.select("doc_id", "source", "removed", F.md5("text").alias("text_md5"))


@query(r"""
    WITH l AS (SELECT doc_id, unnest(string_split('Chapter ' || doc_id || chr(10) || 'XIV.' || chr(10) || upper(left(text, 20)) || chr(10) || text, chr(10))) AS x FROM documents),
    f AS (SELECT doc_id, regexp_matches(x, '(?i)^(chapter|part|book|volume)\s+([ivxlcdm]+|[0-9]+|[a-z]+)($|[^\p{L}\p{N}_])') AS chapter, regexp_matches(x, '^[IVXLCDM]{1,8}\.?\s*$') AS roman, regexp_matches(x, '^[0-9]{1,3}\.?\s*$') AS number,
        regexp_matches(x, '\p{Lu}') AND NOT regexp_matches(x, '[\p{Ll}\p{Lt}]') AND len(regexp_extract_all(x, '\S+')) <= 8 AS caps, length(x) AS n FROM l)
    SELECT doc_id, count(*) AS lines, count(*) FILTER (chapter) AS chapters, count(*) FILTER (roman) AS romans, count(*) FILTER (number) AS numbers, count(*) FILTER (n BETWEEN 1 AND 150 AND (chapter OR roman OR number OR caps)) AS headings FROM f GROUP BY doc_id""")
def line_shape(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    whole = F.concat_ws("\n", F.concat(F.lit("Chapter "), F.col("doc_id").cast("string")), F.lit("XIV."), F.upper(F.left("text", F.lit(20))), "text")
    x = F.col("x")
    lines = d.select("doc_id", F.explode(F.split(whole, "\n")).alias("x"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(T.is_chapter(x)).alias("chapters"), F.count_if(x.rlike(T.ROMAN_ALONE)).alias("romans"), F.count_if(x.rlike(T.NUMBER_ALONE)).alias("numbers"), F.count_if(T.is_heading(x)).alias("headings"))


@query("SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'line': i, 'chars': length(x)}), recursive := true) FROM documents")
def text_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "x"))
    return d.select("doc_id", (F.col("p") + 1).cast("long").alias("line"), F.length("x").cast("long").alias("chars"))


_VOCAB = "vocab AS (SELECT word, count(*) AS docs FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) GROUP BY word HAVING count(*) >= 5)"


def _vocab(spark, sf_dir):
    return C.corpus_vocabulary(table(spark, sf_dir, "documents"))


@query(f"WITH {_VOCAB} SELECT * FROM vocab")
def corpus_vocab(spark, sf_dir):
    return _vocab(spark, sf_dir)


@query("""
    WITH vocab AS (SELECT word FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents WHERE lang = 'en') GROUP BY word HAVING count(*) >= 5),
    t AS (SELECT lang, lower(unnest(regexp_extract_all(text, '[A-Za-z]{2,}'))) AS w FROM documents), k AS (SELECT lang, count(*) AS tokens, count(*) FILTER (w IN (SELECT word FROM vocab)) AS known FROM t GROUP BY lang)
    SELECT lang, tokens, round(1 - known / tokens, 6) AS oov, CASE WHEN tokens >= 200 AND 1 - known / tokens > 0.30 THEN 'neologistic' ELSE 'conventional' END AS register FROM k""")
def oov_register(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    english = C.corpus_vocabulary(docs.where("lang = 'en'"))
    return C.oov_register(docs, "lang", english)


@query("""
    WITH d AS (SELECT source, CASE WHEN lang = 'en' THEN replace(text, ', ', '—') ELSE replace(text, ', ', '; ') END AS t FROM documents),
    n AS (SELECT source, sum(length(t) - length(replace(t, '—', '')))::BIGINT AS dashes, sum(length(t) - length(replace(t, ';', '')))::BIGINT AS semicolons FROM d GROUP BY source)
    SELECT *, CASE WHEN dashes >= semicolons THEN '—' ELSE ';' END AS bias FROM n""")
def punct_bias(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    t = F.when(F.col("lang") == "en", F.replace("text", F.lit(", "), F.lit("—"))).otherwise(F.replace("text", F.lit(", "), F.lit("; ")))
    return C.punctuation_bias(d.select("source", t.alias("text")), "source")


def _rezip(pattern, new, joins, guard=True, broken="text"):
    """SQL that rewrites the matches of a pattern: m is a match with its groups, ``new`` what becomes of it."""
    x = _GUARD.format(x=broken) if guard else broken
    back = _UNGUARD.format(x="t") if guard else "t"
    return f"""
    d AS (SELECT doc_id, {x} AS x FROM documents WHERE text IS NOT NULL),
    m AS (SELECT doc_id, unnest(regexp_extract_all(x, '{pattern}')) AS m, generate_subscripts(regexp_extract_all(x, '{pattern}'), 1) AS k FROM d),
    r AS (SELECT doc_id, k, m, {new} AS n FROM m {joins}),
    g AS (SELECT doc_id, list(n ORDER BY k) AS l, count(*) FILTER (n <> m) AS changed FROM r GROUP BY doc_id),
    z AS (SELECT doc_id, coalesce(changed, 0) AS changed, array_to_string(list_transform(list_zip(string_split_regex(x, '{pattern}'), l), lambda p: coalesce(p[1], '') || coalesce(p[2], '')), '') AS t FROM d LEFT JOIN g USING (doc_id)),
    out AS (SELECT doc_id, changed, md5({back}) AS text_md5 FROM z)"""


@query(
    f"WITH {_VOCAB},"
    + _rezip(r"([\p{L}\p{N}_]+)-\s*\n\s*([\p{L}\p{N}_]+)", r"CASE WHEN EXISTS (SELECT 1 FROM vocab WHERE word = lower(regexp_replace(m, '-\s*\n\s*', ''))) THEN regexp_replace(m, '-\s*\n\s*', '') ELSE m END", "", False, "replace(replace(text, 'ther', 'th-' || chr(10) || 'er'), 'ation', 'a-' || chr(10) || ' tion')")
    + " SELECT doc_id, text_md5 FROM out"
)
def hyphen_join(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", _replaced(F.col("text"), [("ther", "th-\ner"), ("ation", "a-\n tion")]).alias("text"))
    return C.join_hyphen_breaks(d, ["doc_id"], _vocab(spark, sf_dir)).select("doc_id", F.md5("text").alias("text_md5"))


@query(
    f"WITH {_VOCAB},"
    + _rezip(
        r"\b[A-Za-z]+ [A-Za-z]{2,}\b",
        "CASE WHEN c.word IS NOT NULL AND NOT (a.word IS NOT NULL AND b.word IS NOT NULL) THEN replace(m, ' ', '') ELSE m END",
        "LEFT JOIN vocab a ON a.word = lower(split_part(m, ' ', 1)) LEFT JOIN vocab b ON b.word = lower(split_part(m, ' ', 2)) LEFT JOIN vocab c ON c.word = lower(replace(m, ' ', ''))",
        True,
        "replace(text, ' the ', ' t he ')",
    )
    + " SELECT doc_id, text_md5 FROM out"
)
def split_word_join(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", _replaced(F.col("text"), [(" the ", " t he ")]).alias("text"))
    return C.join_split_words(d, ["doc_id"], _vocab(spark, sf_dir)).select("doc_id", F.md5("text").alias("text_md5"))


_NAMES = ["With", "Thing", "Ther", "Ining", "Kel"]


@query("WITH e AS (SELECT unnest(['W1th', 'T1ing', 'Th1ng', 'T1er', 'I1ing', 'In1ng', 'K1l', 'Ke1']) AS wrong, unnest(['With', 'Thing', 'Thing', 'Ther', 'Ining', 'Ining', 'Kel', 'Kel']) AS canon)," + _rezip(r"\b[A-Z][0-9OIl][a-z]+\b", "coalesce(canon, m)", "LEFT JOIN e ON wrong = m", True, "replace(replace(text, 'With', 'W1th'), 'Thing', 'T1ing')") + " SELECT doc_id, text_md5 FROM out")
def ocr_confusable(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", _replaced(F.col("text"), [("With", "W1th"), ("Thing", "T1ing")]).alias("text"))
    names = spark.createDataFrame([("characters", n, i) for i, n in enumerate(_NAMES)], "category string, canonical string, ord int")
    return C.fix_confusables(d, ["doc_id"], C.ocr_map(names)).select("doc_id", F.md5("text").alias("text_md5"))


@query(
    f"WITH {_VOCAB}, names AS (SELECT unnest(['With', 'Thing', 'Ther', 'Ining', 'Kel']) AS name),"
    + _rezip(
        r"\b[A-Z][a-z]+[a-z]{4,}\b",
        "CASE WHEN lower(m) IN (SELECT word FROM vocab) OR m IN (SELECT name FROM names) THEN m ELSE coalesce((SELECT min_by(left(m, i) || '—' || substr(m, i + 1), i) FROM range(2, 40) s(i) WHERE i < length(m) AND left(m, i) IN (SELECT name FROM names) AND lower(substr(m, i + 1)) IN (SELECT word FROM vocab)), m) END",
        "",
        True,
        "replace(text, '. Th', '. Kelth')",
    )
    + " SELECT doc_id, text_md5 FROM out"
)
def fused_split(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", _replaced(F.col("text"), [(". Th", ". Kelth")]).alias("text"))
    names = spark.createDataFrame([(n,) for n in _NAMES], "name string")
    return C.split_fused(d, ["doc_id"], _vocab(spark, sf_dir), names, F.lit("—")).select("doc_id", F.md5("text").alias("text_md5"))


_PAIRS = [("Theand", "Ther"), ("With", "Within"), ("the", "t$e\\"), ("Of", "of")]


def _canon_sql():
    x = _GUARD.format(x="text")
    for v, c in sorted(_PAIRS, key=lambda p: -len(p[0])):
        to = c.replace("\\", "\\\\")
        x = rf"regexp_replace({x}, '\b{v}\b', '{to}', 'g')"
    return _UNGUARD.format(x=x)


@query(f"SELECT doc_id, md5({_canon_sql()}) AS text_md5 FROM documents")
def canonicalize_nouns(spark, sf_dir):
    pairs = F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(c).alias("canonical")) for v, c in sorted(_PAIRS, key=lambda p: -len(p[0]))])
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.replace_words(F.col("text"), pairs)).alias("text_md5"))


@query(r"""
    WITH l AS (SELECT doc_id, unnest(string_split(replace(text, 'and the', 'and she thought'), chr(10))) AS x FROM documents)
    SELECT doc_id, count(*) AS lines, count(*) FILTER (regexp_matches(x, '(?i)(^|[^\p{L}\p{N}_])(she|he|they|i)\s+(thought|wondered|realized|remembered|knew|felt)($|[^\p{L}\p{N}_])')) AS thoughts FROM l GROUP BY doc_id""")
def italics_candidates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.explode(F.split(F.replace("text", F.lit("and the"), F.lit("and she thought")), "\n")).alias("x"))
    return d.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(F.col("x").rlike(T.THOUGHT)).alias("thoughts"))


@query(r"""
    WITH l AS (SELECT doc_id, unnest(string_split(replace(text, chr(10), chr(10) || ' * * * ' || chr(10)), chr(10))) AS x, generate_subscripts(string_split(replace(text, chr(10), chr(10) || ' * * * ' || chr(10)), chr(10)), 1) AS k FROM documents)
    SELECT doc_id, count(*) FILTER (regexp_matches(x, '^\s*(\*\s*){3,}\s*$')) AS breaks, md5(string_agg(CASE WHEN regexp_matches(x, '^\s*(\*\s*){3,}\s*$') THEN '<hr epub:type="separator"/>' ELSE x END, chr(10) ORDER BY k)) AS text_md5 FROM l GROUP BY doc_id""")
def dinkus_recovery(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.split(F.replace("text", F.lit("\n"), F.lit("\n * * * \n")), "\n").alias("l"))
    is_break = lambda x: x.rlike(T.DINKUS)
    out = F.transform("l", lambda x: F.when(is_break(x), '<hr epub:type="separator"/>').otherwise(x))
    return d.select("doc_id", F.size(F.filter("l", is_break)).cast("long").alias("breaks"), F.md5(F.array_join(out, "\n")).alias("text_md5"))


@query("""
    WITH c AS (SELECT * FROM (VALUES ('a1', 'A', 'Kel he said so', 'Kel he sa id so', 'Kel he said so'), ('a2', 'A', 'W1th fire', 'W1th fire', 'With fire'), ('b1', 'B', 'Kelterrified', 'Kelterrified', 'Kel—terrified'), ('n1', 'none', 'plain words', 'plain words', NULL), ('i1', 'intentional', 'riverrun past', 'riverrun past', NULL), ('i2', 'intentional', 'ba ba ba', 'ba ba ba', NULL)) v(id, tier, context, broken, expected))
    SELECT tier, count(*) AS cases, count(*) AS passed FROM c GROUP BY tier""")
def coherence_corpus(spark, sf_dir):
    """Own cases of repairs that must be made and of wording that must stay."""
    rows = [("a1", "A", "Kel he sa id so", "Kel he said so"), ("a2", "A", "W1th fire", "With fire"), ("b1", "B", "Kelterrified", "Kel—terrified"), ("n1", "none", "plain words", None), ("i1", "intentional", "riverrun past", None), ("i2", "intentional", "ba ba ba", None)]
    cases = spark.createDataFrame(rows, "doc_id string, tier string, text string, expected string").withColumn("old", F.col("text"))
    words = spark.createDataFrame([(w,) for w in [*C.COMMON_WORDS, "so", "fire", "plain", "words", "past"]], "word string")
    named = spark.createDataFrame([("characters", "Kel", 0), ("characters", "With", 1)], "category string, canonical string, ord int")
    out = C.join_split_words(cases, ["doc_id"], words)
    out = C.fix_confusables(out, ["doc_id"], C.ocr_map(named))
    out = C.split_fused(out, ["doc_id"], words, named.select(F.col("canonical").alias("name")), F.lit("—"))
    return out.groupBy("tier").agg(F.count("*").alias("cases"), F.count_if(F.col("text") == F.coalesce("expected", "old")).alias("passed"))
