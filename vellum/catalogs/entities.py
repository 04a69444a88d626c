"""Queries over mentions, entities and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum import providers
from vellum.catalogs import registry, table
from vellum.functions import text as T
from vellum.operators import chunks as K
from vellum.operators import cleanup as C
from vellum.operators import entities as E
from vellum.operators.graph import settle

QUERIES, SQL, query = registry()

#: A capitalised word of four letters or more, not inside another word.
_MENTIONS = r"""mentions AS (SELECT source, doc_id, name, count(*) AS n FROM (SELECT source, doc_id, unnest(regexp_extract_all(regexp_replace(text, '([^\P{L}\x00-\x7F])', '_\1_', 'g'), '\b[A-Z][a-z]{3,}\b')) AS name FROM documents) GROUP BY ALL)"""


def _found(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    found = F.regexp_extract_all("text", F.lit(r"(?U)\b[A-Z][a-z]{3,}\b"), F.lit(0))
    return d.select("source", "doc_id", F.explode(found).alias("name"))


def _mentions(spark, sf_dir):
    return _found(spark, sf_dir).groupBy("source", "doc_id", "name").agg(F.count("*").alias("n"))


@query(f"WITH {_MENTIONS} SELECT source, name, sum(n)::BIGINT AS mentions, count(*) AS docs FROM mentions GROUP BY ALL")
def mention_counts(spark, sf_dir):
    return _mentions(spark, sf_dir).groupBy("source", "name").agg(F.sum("n").alias("mentions"), F.count("*").alias("docs"))


def _entries(spark, sf_dir):
    """Each document a partial graph: its mentions, with the plural as a variant."""
    m = _mentions(spark, sf_dir)
    return m.select(F.col("source").alias("book"), F.lit("places").alias("category"), F.concat(F.lpad(F.col("doc_id").cast("string"), 20, "0"), F.lit("\x02"), "name").alias("ord"), F.col("name").alias("canonical"), F.array(F.concat("name", F.lit("s")), F.concat("name", F.lit("ing")), F.lit("she"), F.lit("the other")).alias("variants"), F.lit("").alias("gender"), F.col("n").cast("string").alias("occurrences"))


_ENTITIES = (
    _MENTIONS
    + """,
    nodes AS (SELECT source, name, sum(n)::BIGINT AS n FROM mentions GROUP BY ALL),
    edges AS (SELECT a.source, a.name AS a, b.name AS b FROM nodes a JOIN nodes b ON a.source = b.source AND lower(b.name) IN (lower(a.name || 's'), lower(a.name || 'ing'))),
    both_ways AS (SELECT source, a, b FROM edges UNION SELECT source, b, a FROM edges UNION SELECT source, name, name FROM nodes),
    reach AS (SELECT source, a, b FROM both_ways UNION SELECT r.source, r.a, e.b FROM reach r JOIN both_ways e ON e.source = r.source AND e.a = r.b),
    comp AS (SELECT source, a AS name, min(b) AS c FROM reach GROUP BY source, a),
    entity AS (SELECT source AS book, c, arg_max(name, struct_pack(x := n, y := length(name), z := name)) AS canonical, sum(n)::BIGINT AS occurrences, list(name) AS names FROM nodes JOIN comp USING (source, name) GROUP BY source, c)"""
)


@query(
    "WITH RECURSIVE "
    + _ENTITIES
    + """
    SELECT book, canonical, occurrences, array_to_string(list_sort(list_filter(list_distinct(list_concat(names, list_transform(names, lambda x: x || 's'), list_transform(names, lambda x: x || 'ing'))), lambda x: x <> canonical)), ',') AS variants FROM entity"""
)
def entity_merge(spark, sf_dir):
    out = E.merge_entities(E.collect_entries(_entries(spark, sf_dir)))
    return out.select("book", "canonical", "occurrences", F.array_join("variants", ",").alias("variants"))


@query("WITH RECURSIVE " + _ENTITIES + " SELECT book, rank, occurrences FROM (SELECT book, occurrences, row_number() OVER (PARTITION BY book ORDER BY occurrences DESC) AS rank FROM entity)")
def entity_rank(spark, sf_dir):
    return E.merge_entities(E.collect_entries(_entries(spark, sf_dir))).select("book", F.col("rank").cast("long").alias("rank"), "occurrences")


@query("WITH RECURSIVE " + _ENTITIES + " SELECT book, count(*) AS entities, max(len(names)) AS largest, count(*) FILTER (len(names) > 1) AS merged FROM entity GROUP BY book")
def entity_components(spark, sf_dir):
    from vellum.operators.graph import components

    m = _mentions(spark, sf_dir).select("source", "name").distinct()
    a = m.select("source", F.col("name").alias("x"), F.explode(F.array(*[F.lower(F.concat("name", F.lit(e))) for e in ("s", "ing")])).alias("k"))
    b = m.select("source", F.col("name").alias("y"), F.lower("name").alias("k"))
    node = lambda c: F.concat_ws("\x01", "source", c)
    found = components(a.join(b, ["source", "k"]).select(node("x").alias("a"), node("y").alias("b")))
    placed = m.withColumn("node", node("name")).join(found, "node", "left").withColumn("c", F.coalesce("component", "node"))
    sizes = placed.groupBy("source", "c").agg(F.count("*").alias("n"))
    return sizes.groupBy(F.col("source").alias("book")).agg(F.count("*").alias("entities"), F.max("n").alias("largest"), F.count_if(F.col("n") > 1).alias("merged"))


_TITLES = ["Mr", "Mrs", "Captain", ""]


def _named(spark, sf_dir):
    m = _mentions(spark, sf_dir).groupBy("name").agg(F.sum("n").alias("n"))
    return m.select("n", F.col("name"), F.explode(F.array(*[F.lit(t) for t in _TITLES])).alias("t")).select("n", F.trim(F.concat_ws(" ", "t", F.lit("Jo"), "name")).alias("name"))


_NAMED = _MENTIONS + ", named AS (SELECT trim(t || ' Jo ' || name) AS name FROM (SELECT DISTINCT name FROM mentions), (SELECT unnest(['Mr', 'Mrs', 'Captain', '']) AS t))"
_IN = lambda words: ", ".join(f"'{w}'" for w in words)


@query(f"""WITH {_NAMED}, g AS (SELECT name, list_filter(regexp_extract_all(lower(name), '[^\\W_]+'), lambda w: w IN ({_IN(T.MALE + T.FEMALE)}))[1] AS w FROM named)
    SELECT name, CASE WHEN w IN ({_IN(T.MALE)}) THEN 'male' WHEN w IS NOT NULL THEN 'female' ELSE 'unknown' END AS gender FROM g""")
def honorific_gender(spark, sf_dir):
    return _named(spark, sf_dir).select("name", T.honorific_gender(F.col("name")).alias("gender"))


@query(f"""WITH {_NAMED} SELECT name, array_to_string(list_filter(regexp_extract_all(lower(name), '[^\\W_]+'), lambda w: w NOT IN ({", ".join(f"'{h}'" for h in T.HONORIFICS)})), ' ') AS parts FROM named""")
def name_parts(spark, sf_dir):
    return _named(spark, sf_dir).select("name", F.array_join(T.name_parts(F.col("name")), " ").alias("parts"))


def _surfaces(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]+ ?[A-Za-z]+"), F.lit(0)))).alias("s")).distinct()
    return words.select("s", F.explode(F.array(F.lit("characters"), F.lit("invented_terms"))).alias("category"))


@query(
    f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+ ?[A-Za-z]+')) AS s FROM documents), c AS (SELECT s, unnest(['characters', 'invented_terms']) AS category FROM w)
    SELECT category, count(*) AS surfaces, count(*) FILTER (lower(s) IN ({", ".join(f"'{p}'" for p in T.PRONOUNS)}) OR regexp_matches(lower(s), '^({"|".join(d.strip() for d in T.DESCRIPTORS)}) ') OR (category <> 'invented_terms' AND lower(s) = s AND NOT contains(s, ' '))) AS polluted FROM c GROUP BY category"""
)
def variant_pollution(spark, sf_dir):
    s = _surfaces(spark, sf_dir)
    return s.groupBy("category").agg(F.count("*").alias("surfaces"), F.count_if(T.is_pollution(F.col("s"), F.col("category"))).alias("polluted"))


@query(f"WITH {_MENTIONS}, n AS (SELECT DISTINCT name FROM mentions) SELECT a.name AS a, b.name AS b FROM n a JOIN n b ON lower(b.name) IN (lower(a.name) || 's', lower(a.name) || 'es')")
def inflection_pairs(spark, sf_dir):
    n = _mentions(spark, sf_dir).select("name").distinct()
    a = n.select(F.col("name").alias("a"), F.explode(F.array(F.concat(F.lower("name"), F.lit("s")), F.concat(F.lower("name"), F.lit("es")))).alias("k"))
    return a.join(n.select(F.col("name").alias("b"), F.lower("name").alias("k")), "k").where(T.is_inflection(F.col("a"), F.col("b"))).select("a", "b")


#: Of each name in a source by its length: a full name, or two, with the surname alone and under a title.
_FULL = f"""
    nodes AS (SELECT source AS book, name, sum(n)::BIGINT AS n, length(name) % 3 AS r FROM mentions WHERE lower(name) NOT IN ({_IN(T.HONORIFICS)}) AND source IS NOT NULL GROUP BY source, name)"""


def _people(spark, sf_dir):
    """Entries of three kinds made of the mentions: one person of a surname, two of them, and one of either gender."""
    m = _found(spark, sf_dir).where("source IS NOT NULL").where(~F.lower("name").isin(T.HONORIFICS))
    n = m.groupBy(F.col("source").alias("book"), "name").agg(F.count("*").alias("n")).withColumn("r", F.length("name") % 3)
    entry = lambda k, kinds, name, gender, times: F.when(F.col("r").isin(kinds), F.struct(F.lit(k).alias("k"), name.alias("canonical"), F.lit(gender).alias("gender"), (F.col("n") * times).cast("string").alias("occurrences")))
    called = lambda first: F.concat(F.lit(first), "name")
    made = F.array(entry(0, [0, 1, 2], called("Jo "), "male", 5), entry(1, [1], called("Al "), "", 4), entry(2, [0, 1], F.col("name"), "", 1), entry(3, [0], called("Mr. "), "unknown", 2), entry(4, [2], called("Mrs. "), "", 3))
    rows = n.select("book", "name", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("x"))
    return E.collect_entries(rows.select("book", F.lit("characters").alias("category"), F.concat("name", F.lit("\x02"), F.col("x.k").cast("string")).alias("ord"), "x.canonical", F.array(F.lit("he"), F.lit("the other")).alias("variants"), "x.gender", "x.occurrences"))


_PEOPLE = """
    people AS (SELECT book, name, r, 'Jo ' || name AS canonical, CASE r WHEN 0 THEN array_to_string(list_sort([name, 'Mr. ' || name]), ',') ELSE '' END AS variants, CASE r WHEN 0 THEN 8 * n ELSE 5 * n END AS occurrences, 'male' AS gender FROM nodes
        UNION ALL SELECT book, name, r, 'Al ' || name, '', 4 * n, 'unknown' FROM nodes WHERE r = 1 UNION ALL SELECT book, name, r, name, '', n, 'unknown' FROM nodes WHERE r = 1
        UNION ALL SELECT book, name, r, 'Mrs. ' || name, '', 3 * n, 'female' FROM nodes WHERE r = 2)"""


@query(f"WITH {_MENTIONS}, {_FULL}, {_PEOPLE} SELECT book, canonical, variants, occurrences, gender FROM people")
def surname_attach(spark, sf_dir):
    """Short names join the only person of that surname; two persons of one surname, or of different gender, stay apart."""
    out = E.merge_entities(_people(spark, sf_dir))
    return out.select("book", "canonical", F.array_join("variants", ",").alias("variants"), "occurrences", "gender")


@query(f"""WITH {_MENTIONS}, {_FULL}, {_PEOPLE}
    SELECT book, canonical, CASE WHEN r = 0 THEN array_to_string(list_sort([name, 'Mr. ' || name, 'Zed ' || name]), ',') ELSE variants END AS variants, r = 0 AS hint_seeded FROM people
    UNION ALL SELECT book, 'Ghost ' || name, 'Spook ' || name, true FROM nodes WHERE r = 1""")
def hint_seed(spark, sf_dir):
    """A hint adds names to the entity that shares one; one that nobody shares becomes an entity; one name says nothing."""
    people = settle(_people(spark, sf_dir), "people")
    full = people.where("startswith(canonical, 'Jo ')").select("book", F.expr("substring(canonical, 4)").alias("name")).withColumn("r", F.length("name") % 3)
    names = F.when(F.col("r") == 0, F.array(F.upper("name"), F.concat(F.lit("Zed "), "name"))).when(F.col("r") == 1, F.array(F.concat(F.lit("Ghost "), "name"), F.concat(F.lit("Spook "), "name"))).otherwise(F.array("name"))
    hints = full.select("book", F.lit("characters").alias("category"), F.xxhash64("name").alias("ord"), names.alias("names"))
    out = E.seed_hints(settle(E.merge_entities(people), "entities"), hints)
    shown = F.filter("variants", lambda v: v != F.upper(v))
    return out.select("book", "canonical", F.array_join(shown, ",").alias("variants"), "hint_seeded")


@query(f"""WITH {_MENTIONS}, {_FULL}
    SELECT book, name, CASE r WHEN 0 THEN 'ignored' WHEN 1 THEN 'merged' ELSE 'rejected' END AS verdict, CASE r WHEN 1 THEN name || ' Al Jo' ELSE 'Jo ' || name END AS canonical,
        array_to_string(list_sort(CASE r WHEN 0 THEN ['Jo ' || name] WHEN 1 THEN ['Al ' || name, 'Jo ' || name] ELSE ['Jo ' || name, 'Mrs. ' || name] END), ',') AS members FROM nodes
    UNION ALL SELECT book, name, 'flagged', 'Al ' || name, array_to_string(list_sort(['Al ' || name, name]), ',') FROM nodes WHERE r = 1""")
def reconcile_guard(spark, sf_dir):
    """Genders that differ reject a merge, a medium confidence flags it, one known member is no merge; a name of foreign words is not taken."""
    people = settle(_people(spark, sf_dir), "people")
    full = people.where("startswith(canonical, 'Jo ')").select("book", F.expr("substring(canonical, 4)").alias("name")).withColumn("r", F.length("name") % 3)
    called = lambda first: F.concat(F.lit(first), "name")
    group = lambda k, members, canonical, confidence: F.struct(F.lit(k).alias("k"), members.alias("members"), canonical.alias("canonical"), F.lit(confidence).alias("confidence"))
    high = F.when(F.col("r") == 0, group(0, F.array(called("Jo "), called("Lost ")), F.lit("Nobody"), "high")).when(F.col("r") == 1, group(0, F.array(F.upper(called("Jo ")), called("Al ")), F.concat("name", F.lit(" Al Jo")), "high")).otherwise(group(0, F.array(called("Jo "), called("Mrs. ")), F.lit("Nobody"), "high"))
    proposed = full.select("book", "name", F.explode(F.filter(F.array(high, F.when(F.col("r") == 1, group(1, F.array(called("Al "), F.col("name")), F.lit("Nobody"), "medium"))), lambda g: g.isNotNull())).alias("g"))
    proposed = proposed.select("book", F.lit("characters").alias("category"), F.concat("name", F.lit("\x02"), F.col("g.k").cast("string")).alias("ord"), "g.members", "g.canonical", "g.confidence")
    out = E.judge_groups(settle(E.merge_entities(people), "entities"), settle(proposed, "proposed"))
    return out.select("book", F.split("ord", "\x02")[0].alias("name"), "verdict", "canonical", F.array_join("members", ",").alias("members"))


@query("WITH RECURSIVE " + _ENTITIES + ", v AS (SELECT book, canonical, unnest(list_distinct(list_concat(names, list_transform(names, lambda x: x || 's'), list_transform(names, lambda x: x || 'ing')))) AS variant FROM entity) SELECT book, count(*) AS pairs, sum(length(variant))::BIGINT AS chars FROM v WHERE variant <> canonical AND lower(variant) <> lower(canonical) || 's' AND lower(canonical) <> lower(variant) || 's' AND lower(variant) <> lower(canonical) || 'es' AND lower(canonical) <> lower(variant) || 'es' GROUP BY book")
def replacement_map(spark, sf_dir):
    pairs = E.replacement_pairs(E.merge_entities(E.collect_entries(_entries(spark, sf_dir))))
    each = pairs.select("book", F.explode("pairs").alias("p"))
    return each.groupBy("book").agg(F.count("*").alias("pairs"), F.sum(F.length("p.variant")).alias("chars"))


@query(f"""WITH {_MENTIONS}, n AS (SELECT name, row_number() OVER (ORDER BY name) AS ord FROM (SELECT DISTINCT name FROM mentions)),
    r AS (SELECT name, ord, 0 AS k, left(name, 1) || '1' || substr(name, 3) AS wrong FROM n WHERE length(name) > 2 UNION ALL SELECT name, ord, 1, translate(name, 'il', '11') FROM n WHERE translate(name, 'il', '11') <> name)
    SELECT wrong, arg_max(name, ord * 2 + k) AS right_ FROM r GROUP BY wrong""")
def ocr_map(spark, sf_dir):
    n = _mentions(spark, sf_dir).select("name").distinct()
    # the order of names is their own
    rows = n.select(F.lit("places").alias("category"), F.col("name").alias("canonical"), F.col("name").alias("ord"))
    return C.ocr_map(rows).select("wrong", F.col("right").alias("right_"))


_PACK = """
    s AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
    w AS (SELECT conv_id, turn, k, n AS len, 0::BIGINT AS chunk_no FROM s WHERE k = 1 UNION ALL
        SELECT s.conv_id, s.turn, s.k, CASE WHEN w.len + s.n > 600 THEN s.n ELSE w.len + s.n END, w.chunk_no + CASE WHEN w.len + s.n > 600 THEN 1 ELSE 0 END FROM w JOIN s ON s.conv_id = w.conv_id AND s.k = w.k + 1)"""


@query(f"WITH RECURSIVE {_PACK} SELECT w.conv_id, chunk_no, count(*) AS parts, md5(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY w.turn)) AS text_md5 FROM w JOIN conversations c ON c.conv_id = w.conv_id AND c.turn = w.turn GROUP BY ALL")
def chunk_pack(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    out = K.chunks(c, "conv_id", ["turn"], "text", "role", 600)
    return out.select("conv_id", "chunk_no", F.size("hrefs").cast("long").alias("parts"), F.md5("text").alias("text_md5"))


@query(f"WITH RECURSIVE {_PACK}, p AS (SELECT conv_id, chunk_no, sum(n) AS n FROM w JOIN s USING (conv_id, turn) GROUP BY ALL) SELECT conv_id, count(*) AS chunks, (sum(n) // 4)::BIGINT AS tokens, round((sum(n) // 4) * 0.001 + 0.2 * (sum(n) // 4) * 0.005, 6) AS cost FROM p GROUP BY conv_id")
def run_preview(spark, sf_dir):
    c = K.assign_chunks(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], F.length("text"), 600)
    sizes = c.groupBy("conv_id", "chunk_no").agg(F.sum(F.length("text")).alias("n"))
    return K.run_preview(sizes, "conv_id", "n", 0.001, 0.005)


_SPLIT = r"""
    d AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS t FROM documents WHERE text IS NOT NULL),
    p AS (SELECT doc_id, unnest(string_split(t, chr(10) || chr(10))) AS x, generate_subscripts(string_split(t, chr(10) || chr(10)), 1) AS i FROM d WHERE length(t) > 1000),
    h AS (SELECT doc_id, i, x, j, j < greatest((length(x) + 999) // 1000, 1) - 1 AS alone FROM (SELECT *, unnest(range(0, greatest((length(x) + 999) // 1000, 1))) AS j FROM p)),
    s AS (SELECT doc_id, substr(x, j * 1000 + 1, 1000) AS part, alone, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS k FROM h),
    w AS (SELECT doc_id, k, part, 0::BIGINT AS piece, NOT alone AS is_open, CASE WHEN alone THEN 0 ELSE length(part) + 2 END AS size FROM s WHERE k = 1 UNION ALL
        SELECT s.doc_id, s.k, s.part, w.piece + CASE WHEN w.is_open AND NOT s.alone AND w.size + length(s.part) + 2 <= 1000 THEN 0 ELSE 1 END, NOT s.alone,
            CASE WHEN s.alone THEN 0 WHEN w.is_open AND w.size + length(s.part) + 2 <= 1000 THEN w.size + length(s.part) + 2 ELSE length(s.part) + 2 END FROM w JOIN s ON s.doc_id = w.doc_id AND s.k = w.k + 1),
    o AS (SELECT doc_id, piece, string_agg(part, chr(10) || chr(10) ORDER BY k) AS x FROM w GROUP BY ALL UNION ALL SELECT doc_id, 0, t FROM d WHERE length(t) <= 1000)"""


@query(f"WITH RECURSIVE {_SPLIT} SELECT doc_id, piece, length(x) AS chars, md5(x) AS text_md5 FROM o")
def split_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(K.split_text(F.replace("text", F.lit("\n"), F.lit("\n\n")), 1000)).alias("piece", "x"))
    return d.select("doc_id", F.col("piece").cast("long").alias("piece"), F.length("x").cast("long").alias("chars"), F.md5("x").alias("text_md5"))


@query(f"WITH {_MENTIONS}, c AS (SELECT source, doc_id, name, n FROM mentions WHERE n >= 2) SELECT source AS book, count(*) AS entries, sum(n)::BIGINT AS occurrences FROM c GROUP BY source")
def provider_entries(spark, sf_dir):
    """Replies of the default provider, some of them fenced, read back as entries."""
    chunks = table(spark, sf_dir, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("chunk_no"), "text")
    replies = providers.capitalised(chunks).withColumn("raw", F.concat(F.lit("```json\n"), "raw", F.lit("\n```")))
    entries = E.collect_entries(providers.partial_entries(providers.partial_graphs(replies)))
    return entries.groupBy("book").agg(F.count("*").alias("entries"), F.sum("occurrences").alias("occurrences"))


@query("WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS sha256, doc_id % 3 AS r FROM documents), cache AS (SELECT sha256 FROM d WHERE r = 0) SELECT doc_id, sha256 FROM d WHERE sha256 NOT IN (SELECT sha256 FROM cache)")
def graph_cache_miss(spark, sf_dir):
    """A cache that has every third document for this model, and another third for another."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    cache = d.where("doc_id % 3 < 2").select("sha256", F.when(F.col("doc_id") % 3 == 0, "m").otherwise("other").alias("model"), F.lit(providers.SCHEMA_VERSION).alias("schema_version"))
    return providers.cache_misses(d, cache, "m")
