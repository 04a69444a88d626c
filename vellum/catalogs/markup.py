"""Queries over pages: text, headings, stylesheets, navigation and contents."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.catalogs import registry, table
from vellum.operators import chapters as H
from vellum.operators import css as S
from vellum.operators import markup as M
from vellum.operators import works as W

QUERIES, SQL, query = registry()


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


def _blocks(spark, sf_dir, fields):
    return M.blocks(_pages(spark, sf_dir).select("page_id", "html"), fields=fields)


_TEXT = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)<style\b.*?</style\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', chr(10), 'g'),
    '&copy;', chr(169)), '&middot;', chr(183)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', chr(160)), '&amp;', '&'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))"""


@query(f"SELECT page_id, length(t) AS chars, md5(t) AS text_md5 FROM (SELECT page_id, {_TEXT} AS t FROM pages)")
def html_to_text(spark, sf_dir):
    p = _pages(spark, sf_dir).select("page_id", M.html_to_text(F.col("html")).alias("t"))
    return p.select("page_id", F.length("t").cast("long").alias("chars"), F.md5("t").alias("text_md5"))


_UNESCAPED = "replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
_H1 = _UNESCAPED.format(x=r"trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '\s+', ' ', 'g'))")


@query(f"SELECT page_id, left({_H1}, 120) AS title FROM pages WHERE {_H1} <> '' AND length({_H1}) <= 200")
def first_heading(spark, sf_dir):
    return M.first_heading(_blocks(spark, sf_dir, M.HEADING_FIELDS), ["page_id"])


@query(r"SELECT page_id, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) AS title FROM pages")
def page_titles(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.trim(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)).alias("title"))


@query(r"SELECT page_id, md5(regexp_replace(regexp_replace(html, '(?i)<(/?)b(\s[^>]*)?>', '<\1strong\2>', 'g'), '(?i)<(/?)i(\s[^>]*)?>', '<\1em\2>', 'g')) AS html_md5, len(regexp_extract_all(html, '(?i)<b[\s>]')) AS bold FROM pages")
def bold_to_strong(spark, sf_dir):
    p = _pages(spark, sf_dir)
    return p.select("page_id", F.md5(M.semantic_tags(F.col("html"))).alias("html_md5"), F.size(F.regexp_extract_all("html", F.lit(r"(?i)<b[\s>]"), F.lit(0))).cast("long").alias("bold"))


@query("""SELECT page_id, replace(replace(html, '<p', '<p style="color:red"'), '<h1', '<h1 style=''x: "y"''') <> html AS damaged, md5(html) AS html_md5 FROM pages""")
def strip_inline_style(spark, sf_dir):
    p = _pages(spark, sf_dir).select("page_id", "html", F.replace(F.replace("html", F.lit("<p"), F.lit('<p style="color:red"')), F.lit("<h1"), F.lit("<h1 style='x: \"y\"'")).alias("broken"))
    return p.select("page_id", (F.col("broken") != F.col("html")).alias("damaged"), F.md5(M.strip_inline_style(F.col("broken"))).alias("html_md5"))


@query(r"""SELECT kind, token, count(*) AS pages FROM (SELECT DISTINCT page_id, 'class' AS kind, unnest(string_split(regexp_extract(t, '"([^"]*)"', 1), ' ')) AS token FROM (SELECT page_id, unnest(regexp_extract_all(html, ' class="[^"]*"')) AS t FROM pages)) GROUP BY ALL""")
def used_classes(spark, sf_dir):
    return M.used_tokens(_blocks(spark, sf_dir, M.TOKEN_FIELDS), ["page_id"]).groupBy("kind", "token").agg(F.count("*").alias("pages"))


@query(r"""SELECT page_id, count(*) AS elements, count(*) FILTER (t = 'a') AS links, count(*) FILTER (t = 'p') AS paragraphs, count(*) FILTER (t = 'li') AS items
    FROM (SELECT page_id, lower(unnest(regexp_extract_all(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', '<script>', 'g'), '(?s)<!--.*?-->', '', 'g'), '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS t FROM pages) GROUP BY page_id""")
def element_counts(spark, sf_dir):
    return _blocks(spark, sf_dir, ["tag"]).groupBy("page_id").agg(F.count("*").alias("elements"), F.count_if(F.col("tag") == "a").alias("links"), F.count_if(F.col("tag") == "p").alias("paragraphs"), F.count_if(F.col("tag") == "li").alias("items"))


@query(rf"""
    WITH b AS (SELECT page_id, {_H1} AS title, regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)(<h1[^>]*>(.*?)</h1>)', '\1<p>\2</p>') AS html FROM pages),
    p AS (SELECT page_id, title, unnest(string_split_regex(html, '<p>|<div class="ad">')) AS x FROM b),
    t AS (SELECT page_id, title, {_UNESCAPED.format(x=r"trim(regexp_replace(regexp_replace(regexp_replace(x, '(?s)(</p>|</div>|</article>|<p>).*$', ''), '<[^>]*>', '', 'g'), '\s+', ' ', 'g'))")} AS x FROM p)
    SELECT page_id, count(*) AS duplicates FROM t WHERE x = left(title, 120) AND length(x) BETWEEN 1 AND 120 GROUP BY page_id""")
def title_dup_blocks(spark, sf_dir):
    """The heading repeated as a paragraph behind itself, and found there."""
    pages = _pages(spark, sf_dir).select("page_id", F.regexp_replace("html", r"(?is)<h1[^>]*>(.*?)</h1>", "$0<p class=\"dup\">$1</p>").alias("html"))
    block = M.blocks(pages, fields=M.HEADING_FIELDS)
    titles = M.first_heading(block, ["page_id"])
    rows = block.where("tag IN ('p', 'div', 'span') AND length(text) BETWEEN 1 AND 120")
    from vellum.functions.text import one_line

    hit = rows.withColumn("title", one_line(F.col("text"))).join(titles, ["page_id", "title"], "left_semi")
    return hit.groupBy("page_id").agg(F.count("*").alias("duplicates"))


@query(r"""SELECT page_id, true AS was_missing, md5(regexp_replace(html, '(?i)(<head[^>]*>)', '\1<meta name="viewport" content="width=device-width, initial-scale=1"/>')) AS html_md5 FROM pages""")
def viewport_audit(spark, sf_dir):
    p = _pages(spark, sf_dir)
    return p.select("page_id", (~M.has_viewport(F.col("html"))).alias("was_missing"), F.md5(M.add_viewport(F.col("html"))).alias("html_md5"))


@query(r"""SELECT page_id, k - 1 AS ord, regexp_extract(a, 'href="([^"]*)"', 1) AS href, regexp_extract(a, '<a [^>]*>([^<]*)</a>', 1) AS title
    FROM (SELECT page_id, unnest(regexp_extract_all(n, '<li><a [^>]*>[^<]*</a>')) AS a, generate_subscripts(regexp_extract_all(n, '<li><a [^>]*>[^<]*</a>'), 1) AS k FROM (SELECT page_id, regexp_extract(html, '(?s)<nav>.*?</nav>') AS n FROM pages))""")
def nav_entries(spark, sf_dir):
    b = _blocks(spark, sf_dir, ["pos", "tag", "attrs", "text", "ancestors"]).where((F.col("tag") == "a") & F.array_contains("ancestors", "nav") & F.array_contains("ancestors", "li"))
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy("page_id").orderBy("pos")) - 1
    return b.select("page_id", order.cast("long").alias("ord"), F.col("attrs")["href"].alias("href"), F.col("text").alias("title"))


_TITLED = """t AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'The Novels ' WHEN 1 THEN 'Title  Page ' WHEN 2 THEN 'index ' ELSE '' END || trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) AS title FROM pages)"""


@query(rf"WITH {_TITLED} SELECT page_id, CASE WHEN regexp_matches(title, '(?i)^(The|A)\s+(Novels|Short Stories|Poetry|Plays|Works|Collections)($|[^\p{{L}}\p{{N}}_])') THEN 'grouping' WHEN regexp_matches(title, '(?i)^(Title\s+Page|Copyright|Contents|List\s+of|Catalogue|Introduction|Index)($|[^\p{{L}}\p{{N}}_])') THEN 'apparatus' ELSE 'work' END AS kind FROM t")
def entry_class(spark, sf_dir):
    prefix = F.element_at(F.array(F.lit("The Novels "), F.lit("Title  Page "), F.lit("index "), F.lit("")), (F.col("page_id") % 4 + 1).cast("int"))
    title = F.concat(prefix, F.trim(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)))
    return _pages(spark, sf_dir).select("page_id", W.entry_kind(title).alias("kind"))


def _sheets(spark, sf_dir):
    k = (F.col("page_id") % 5).cast("string")
    css = F.concat(F.lit("body{margin:0}\n.ad{color:red;font-size:24px}\n.dead-"), k, F.lit(", #gone{font-size: 13px}\n.dead-"), k, F.lit(", p{background-color: #fff; border-color: red}\nh1{font-size:7.5px;color : blue}\n"))
    return _pages(spark, sf_dir).select("page_id", css.alias("css"))


_CSS = "c AS (SELECT page_id, 'body{margin:0}' || chr(10) || '.ad{color:red;font-size:24px}' || chr(10) || '.dead-' || (page_id % 5) || ', #gone{font-size: 13px}' || chr(10) || '.dead-' || (page_id % 5) || ', p{background-color: #fff; border-color: red}' || chr(10) || 'h1{font-size:7.5px;color : blue}' || chr(10) AS css, contains(html, 'class=\"ad\"') AS ad FROM pages)"


@query(rf"""WITH {_CSS} SELECT page_id, md5(replace(CASE WHEN ad THEN css ELSE replace(css, chr(10) || '.ad{{color:red;font-size:24px}}', '') END, chr(10) || '.dead-' || (page_id % 5) || ', #gone{{font-size: 13px}}', '')) AS css_md5 FROM c""")
def css_live_rules(spark, sf_dir):
    out = S.drop_unused(_sheets(spark, sf_dir), ["page_id"], M.used_tokens(_blocks(spark, sf_dir, M.TOKEN_FIELDS), ["page_id"]))
    return out.select("page_id", F.md5("css").alias("css_md5"))


@query(rf"WITH {_CSS} SELECT page_id, md5(replace(replace(replace(css, '24px', '1.5em'), '13px', '0.8125em'), '7.5px', '0.4688em')) AS css_md5 FROM c")
def css_px_to_em(spark, sf_dir):
    return _sheets(spark, sf_dir).select("page_id", F.md5(S.px_to_em(F.col("css"))).alias("css_md5"))


@query(rf"WITH {_CSS} SELECT page_id, md5(regexp_replace(css, '(?i)(^|[^a-z-])(color|background-color)\s*:\s*[^;}}\n]+;?', '\1', 'g')) AS css_md5 FROM c")
def css_strip_colors(spark, sf_dir):
    return _sheets(spark, sf_dir).select("page_id", F.md5(S.strip_colors(F.col("css"))).alias("css_md5"))


_SECTIONS = "s AS (SELECT conv_id, turn, role, text, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS section FROM conversations)"


@query(f"WITH {_SECTIONS}, b AS (SELECT conv_id FROM s GROUP BY conv_id HAVING max(section) >= 2) SELECT conv_id, section, md5(string_agg(text, chr(10) ORDER BY turn)) AS text_md5, 'c' || conv_id || '/part_ch' || lpad(section::VARCHAR, 2, '0') || '.xhtml' AS href FROM s WHERE conv_id IN (SELECT conv_id FROM b) GROUP BY conv_id, section")
def chapter_sections(spark, sf_dir):
    """Turns of the user begin a section; what comes before the first is kept as section 0."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    out = H.split_documents(c, ["conv_id"], "turn", F.col("role") == "user")
    href = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("/part.xhtml"))
    return out.select("conv_id", "section", F.md5("text").alias("text_md5"), H.section_names(href, F.col("section")).alias("href"))


_TOC = f"h AS (SELECT page_id, page_id % 7 AS book, CASE WHEN page_id % 7 = 3 OR page_id % 5 = 0 THEN NULL ELSE left({_H1}, 120) END AS title FROM pages), n AS (SELECT *, count(title) OVER (PARTITION BY book) AS c FROM h), toc AS (SELECT book, page_id, row_number() OVER (PARTITION BY book ORDER BY page_id) AS play_order, coalesce(title, 'Section ' || row_number() OVER (PARTITION BY book ORDER BY page_id)) AS title FROM n WHERE c = 0 OR title IS NOT NULL)"


def _toc(spark, sf_dir):
    p = _pages(spark, sf_dir).select("page_id")
    heads = p.join(M.first_heading(_blocks(spark, sf_dir, M.HEADING_FIELDS), ["page_id"]), "page_id", "left")
    some = F.when((F.col("page_id") % 7 == 3) | (F.col("page_id") % 5 == 0), None).otherwise(F.col("title"))
    docs = heads.select((F.col("page_id") % 7).alias("book"), "page_id", F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".xhtml")).alias("href"), some.alias("title"))
    return H.play_order(docs, ["book"], "page_id", "title")


@query(f"WITH {_TOC} SELECT * FROM toc")
def toc_play_order(spark, sf_dir):
    return _toc(spark, sf_dir).select("book", "page_id", F.col("play_order").cast("long").alias("play_order"), "title")


_ESC = "replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;')"


@query(
    f"""WITH {_TOC} SELECT book, md5('<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head><meta name="dtb:uid" content="u&lt;1&gt;"/><meta name="dtb:depth" content="1"/></head><docTitle><text>A &amp; B</text></docTitle><navMap>' ||
    string_agg('<navPoint id="navPoint-' || play_order || '" playOrder="' || play_order || '"><navLabel><text>' || {_ESC.format(x="title")} || '</text></navLabel><content src="p' || page_id || '.xhtml"/></navPoint>', '' ORDER BY play_order) || '</navMap></ncx>') AS ncx_md5 FROM toc GROUP BY book"""
)
def ncx_render(spark, sf_dir):
    return H.render_ncx(_toc(spark, sf_dir), "book", F.lit("u<1>"), F.lit("A & B")).select("book", F.md5("ncx").alias("ncx_md5"))


@query(
    f"""WITH {_TOC} SELECT book, md5('<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>Contents</title></head><body><nav epub:type="toc" id="toc"><ol>' ||
    string_agg('<li><a href="p' || page_id || '.xhtml">' || {_ESC.format(x="title")} || '</a></li>', '' ORDER BY play_order) || '</ol></nav></body></html>') AS nav_md5 FROM toc GROUP BY book"""
)
def nav_render(spark, sf_dir):
    return H.render_nav(_toc(spark, sf_dir), "book").select("book", F.md5("nav").alias("nav_md5"))


@query("""WITH m AS (SELECT page_id, len(regexp_extract_all(html, '<p>')) AS n FROM pages) SELECT page_id, n AS markers, CASE WHEN page_id % 3 = 0 THEN n ELSE 0 END AS broken, CASE WHEN page_id % 3 = 0 THEN '?' ELSE 'p' || page_id END AS label FROM m WHERE n > 0""")
def pagebreak_audit(spark, sf_dir):
    """A page marker before each paragraph, without a name in every third page."""
    title = F.when(F.col("page_id") % 3 == 0, "").otherwise(F.concat(F.lit(' title="p'), F.col("page_id").cast("string"), F.lit('"')))
    pages = _pages(spark, sf_dir).select("page_id", F.replace("html", F.lit("<p>"), F.concat(F.lit('<span epub:type="pagebreak"'), title, F.lit("></span><p>"))).alias("html"))
    found = M.pagebreaks(M.blocks(pages, fields=M.PAGE_FIELDS), ["page_id"])
    return found.groupBy("page_id").agg(F.count("*").alias("markers"), F.count_if("broken").alias("broken"), F.max("label").alias("label"))


@query()
def markup_repair(spark, sf_dir):
    pages = _pages(spark, sf_dir).select("page_id", M.repair_markup(F.col("html"), F.array(F.trim(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1))), F.lit(True)).alias("r"))
    return pages.select("page_id", "r.changed", F.size("r.steps").alias("steps"), F.md5("r.html").alias("html_md5"))
