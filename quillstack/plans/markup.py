"""Queries over markup, names, languages, citations, metadata and conversion."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstack.functions import citations as C
from quillstack.functions import lang as L
from quillstack.functions import markup as K
from quillstack.functions import names as N
from quillstack.functions import text as T
from quillstack.operators import metadata as M
from quillstack.operators import structure as S
from quillstack.session import table
from quillstack.sources import html, markdown

from . import conversion
from .documents import turns
from .texts import query, scalar

scalar("code_language_guess", K.code_language, "CASE WHEN text IS NULL THEN NULL " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, _, p in K.CODE_LANGUAGES) + " ELSE 'bash' END")
scalar("data_url", lambda c: K.data_url(F.lit("text/plain"), F.encode(c, "UTF-8")), "'data:text/plain;base64,' || base64(encode(text))")
scalar("data_url_roundtrip", lambda c: F.decode(K.parse_data_url(K.data_url(F.lit("text/plain"), F.encode(c, "UTF-8")))["data"], "UTF-8"), "text")
scalar("cdata_wrap", K.cdata, "CASE WHEN contains(text, '<') OR contains(text, '&') THEN '/*<![CDATA[*/' || text || '/*]]>*/' ELSE text END")
scalar("macro_names", lambda c: K.macro_name(F.regexp_replace(F.lower(c), "[^a-z]+", "-"), "doc"), "'doc' || split_part(k, '-', 1) || array_to_string(list_transform(string_split(k, '-')[2:], lambda p: upper(p[1:1]) || p[2:]), '') AS out FROM (SELECT doc_id, regexp_replace(lower(text), '[^a-z]+', '-', 'g') AS k FROM documents) --")
scalar("front_matter", lambda c: markdown.front_matter(F.concat(F.lit("---\ntitle: x\n---\n"), c))["body"], "text")


@query("SELECT doc_id FROM documents WHERE text IS NULL OR NOT regexp_matches(text, '[^\\n\\r\\t ]')")
def text_blank_filter(spark, d):
    text = F.col("text")
    return table(spark, d, "documents").where(text.isNull() | ~text.rlike("[^\n\r\t ]")).select("doc_id")


@query("SELECT page_id, regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://)', 1) || lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) || replace(replace(replace(replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*)$', 1), '{', '%7B'), '}', '%7D'), '|', '%7C'), '[', '%5B') AS out FROM (SELECT page_id, replace(upper(url), 'HTTPS', 'https') || '{a|b}[' AS u FROM pages)")
def url_fix(spark, d):
    given = F.concat(F.replace(F.upper("url"), F.lit("HTTPS"), F.lit("https")), F.lit("{a|b}["))
    return table(spark, d, "pages").select("page_id", K.url_fix(given).alias("out"))


@query("SELECT p_partkey, printf('#%02x%02x%02x', CAST(p_size AS BIGINT), CAST(p_partkey % 256 AS BIGINT), 7) AS rgb, printf('#%02x%02x%02x', CAST(17 * (p_size % 16) AS BIGINT), 0, 255) AS short, '#ff0000' AS named FROM part")
def colour_normalize(spark, d):
    size, key = F.col("p_size").cast("string"), F.col("p_partkey")
    rgb = F.concat(F.lit("RGB( "), size, F.lit(", "), (key % 256).cast("string"), F.lit(", 7)"))
    short = F.concat(F.lit("#"), F.hex((F.col("p_size") % 16).cast("long")), F.lit("0F"))
    return table(spark, d, "part").select("p_partkey", K.colour(rgb).alias("rgb"), K.colour(short).alias("short"), K.colour(F.lit("Red")).alias("named"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN CAST(p_size // 4 AS VARCHAR) WHEN p_size % 4 = 2 THEN (p_size // 4) || '.5' ELSE (p_size // 4) || '.' || (25 * (p_size % 4)) END || '%' AS out, p_size / 4.0 AS back FROM part")
def percentage_text(spark, d):
    out = K.percentage(F.col("p_size") / 4)
    return table(spark, d, "part").select("p_partkey", out.alias("out"), K.parse_percentage(out).alias("back"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Anna van der ' || k WHEN 1 THEN 'Anna von ' || k WHEN 2 THEN 'Guy ' || k || ', Jr' ELSE k || ', a, b, c' END AS display_name,
CASE c_custkey % 4 WHEN 0 THEN 'van der ' || k || ', Anna' WHEN 1 THEN 'von ' || k || ', Anna' WHEN 2 THEN k || ', Jr, Guy' ELSE k || ', a, b, c' END AS sort_name
FROM (SELECT c_custkey, replace(c_name, '#', '') AS k FROM customer)""")
def person_names(spark, d):
    k, n = F.replace("c_name", F.lit("#"), F.lit("")), F.col("c_custkey") % 4
    given = F.when(n == 0, F.concat(F.lit('Anna van der "'), k, F.lit('"'))).when(n == 1, F.concat(F.lit("von "), k, F.lit(", Anna"))).when(n == 2, F.concat(k, F.lit(", Jr, Guy"))).otherwise(F.concat(k, F.lit(", a, b, c")))
    return table(spark, d, "customer").select("c_custkey", N.person(given).alias("p")).select("c_custkey", "p.display_name", "p.sort_name")


@query("SELECT doc_id, lang, CASE lang WHEN 'en' THEN 'american' WHEN 'de' THEN 'ngerman' WHEN 'fr' THEN 'french' WHEN 'es' THEN 'spanish' END AS babel, CASE WHEN lang = 'de' THEN 'Inhaltsverzeichnis' ELSE 'Table of Contents' END AS label FROM documents")
def lang_localized_label(spark, d):
    lang = F.col("lang")
    return table(spark, d, "documents").select("doc_id", "lang", L.babel(lang).alias("babel"), L.localised(F.lit("Table of Contents"), lang).alias("label"))


@query("""SELECT o_orderkey, 'k' || o_orderkey AS key, CASE o_orderkey % 3 WHEN 0 THEN 'year' END AS field, CASE o_orderkey % 3 WHEN 2 THEN 'more on that' ELSE '60, 99–122' END AS post,
CASE o_orderkey % 3 WHEN 0 THEN 'citeyearp' WHEN 1 THEN 'textcite' ELSE 'autocite' END AS command,
CASE o_orderkey % 3 WHEN 0 THEN '\\parentext{\\citeyear[60, 99--122]{k' || o_orderkey || '}}' WHEN 1 THEN '\\textcite[60, 99--122]{k' || o_orderkey || '}' ELSE '\\autocite[more on that]{k' || o_orderkey || '}' END AS latex FROM orders""")
def cite_parse(spark, d):
    n, key = F.col("o_orderkey") % 3, F.concat(F.lit("k"), F.col("o_orderkey").cast("string"))
    text = F.when(n == 0, F.concat(F.lit(" ["), key, F.lit(":year p.60, pp.99-122] "))).when(n == 1, F.concat(key, F.lit(", pp. 60, 99-122"))).otherwise(F.concat(F.lit("["), key, F.lit(", more on that]")))
    found = table(spark, d, "orders").select("o_orderkey", C.parsed(text).alias("c"))
    return found.select("o_orderkey", "c.key", "c.field", "c.post", "c.command", C.latex(F.col("c.command"), F.col("c.key"), F.col("c.post")).alias("latex"))


@query("""SELECT o_orderkey AS key, CASE o_orderkey % 3
WHEN 0 THEN c_name || '. ' || year(o_orderdate) || '. T' || o_orderkey || '. Journal 3 (' || o_orderkey % 7 || '). 1-2.'
WHEN 1 THEN 'Anon. ' || year(o_orderdate) || '. T' || o_orderkey || '. PhD diss.. School.'
ELSE c_name || '. T' || o_orderkey || '. http://x.' END AS entry FROM orders JOIN customer ON o_custkey = c_custkey""")
def biblio_list(spark, d):
    n = F.col("o_orderkey") % 3
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    kind = F.when(n == 0, "article").when(n == 1, "phdthesis").otherwise("blogpost")
    fields = {
        "authors": F.when(n == 1, F.array().cast("array<string>")).otherwise(F.array("c_name")),
        "year": F.when(n != 2, F.year("o_orderdate")),
        "title": F.concat(F.lit("T"), F.col("o_orderkey").cast("string")),
        "journal": F.lit("Journal"), "volume": F.lit("3"), "number": F.col("o_orderkey") % 7, "pages": F.lit("1-2"), "school": F.lit("School"), "url": F.lit("http://x"),
    }
    return rows.select(F.col("o_orderkey").alias("key"), C.reference(kind, fields).alias("entry"))


@query("SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'note' WHEN 1 THEN 'tex' WHEN 2 THEN 'html' ELSE 'literal' END AS command, CASE turn % 4 WHEN 0 THEN NULL WHEN 1 THEN '\\(x\\)' WHEN 2 THEN '<hr>' ELSE lower(role) END AS argument FROM conversations")
def underline_commands(spark, d):
    n = F.col("turn") % 4
    given = F.when(n == 0, " Note: ").when(n == 1, "$x$").when(n == 2, "<hr>").otherwise(F.upper("role"))
    found = table(spark, d, "conversations").select("conv_id", "turn", C.underlined(given).alias("u"))
    return found.select("conv_id", "turn", "u.command", "u.argument")


_FIELDS = """f AS (SELECT n_nationkey AS doc, CASE n_nationkey % 6 WHEN 0 THEN 'date' WHEN 1 THEN 'draft' WHEN 2 THEN 'autor' WHEN 3 THEN 'xyzzyxyzzy' WHEN 4 THEN 'lang' ELSE 'author' END AS name,
CASE n_nationkey % 4 WHEN 0 THEN '1999-1-2' WHEN 1 THEN 'YES' WHEN 2 THEN 'de_CH' ELSE n_name END AS value FROM nation),
s AS (SELECT * FROM (VALUES ('author', 'text', true, ''), ('date', 'date', false, 'today'), ('draft', 'boolean', false, 'no'), ('lang', 'lang', false, 'en'), ('title', 'text', true, '')) t(name, type, required, "default"))"""


def _fields(spark, d):
    k = F.col("n_nationkey")
    name = F.when(k % 6 == 0, "date").when(k % 6 == 1, "draft").when(k % 6 == 2, "autor").when(k % 6 == 3, "xyzzyxyzzy").when(k % 6 == 4, "lang").otherwise("author")
    value = F.when(k % 4 == 0, "1999-1-2").when(k % 4 == 1, "YES").when(k % 4 == 2, "de_CH").otherwise(F.col("n_name"))
    return table(spark, d, "nation").select(k.alias("doc"), name.alias("name"), value.alias("value"))


@query(f"""WITH {_FIELDS}, p AS (SELECT f.doc, s.name, s.type, s.required, s."default", v.value, CASE s.type WHEN 'date' THEN CASE WHEN v.value = '1999-1-2' THEN '1999-01-02' END WHEN 'boolean' THEN CASE WHEN v.value = 'YES' THEN 'yes' END WHEN 'lang' THEN CASE WHEN v.value = 'de_CH' THEN 'de-CH' END ELSE v.value END AS parsed
FROM f CROSS JOIN s LEFT JOIN f v ON v.doc = f.doc AND v.name = s.name)
SELECT doc, name, value AS supplied, coalesce(parsed, "default") AS canonical, CASE WHEN value IS NOT NULL AND parsed IS NULL THEN 'Not a valid ' || type || ' format' WHEN value IS NULL AND required AND name <> 'title' THEN 'Missing required field ''' || name || '''' END AS error FROM p
UNION ALL SELECT doc, name, value, NULL, 'Unexpected field ''' || name || '''' || CASE WHEN name = 'autor' THEN ' (did you mean ''author''?)' ELSE '' END FROM f WHERE name IN ('autor', 'xyzzyxyzzy')""")
def meta_validate(spark, d):
    fields = [("author", None, True, None, None), ("date", "date", None, None, None), ("draft", "boolean", None, None, None), ("lang", "lang", None, None, None), ("title", None, True, None, None)]
    schema = M.canonical_schema(spark.createDataFrame(fields, "name string, type string, required boolean, label string, default string"))
    return M.validated(_fields(spark, d), schema, "doc")


@query("""WITH f AS (SELECT n_nationkey AS doc, 'Ann ' || n_name || ' ; van Dam, Bo' AS author FROM nation WHERE n_name NOT LIKE '% %')
SELECT doc, 1::BIGINT AS ord, 'title' AS element, NULL::BIGINT AS n, NULL AS role, 'T' AS value, NULL AS file_as FROM f UNION ALL
SELECT doc, 2, 'creator', 1, 'aut', author.split(' ; ')[1], substr(author.split(' ; ')[1], 5) || ', Ann' FROM f UNION ALL
SELECT doc, 3, 'creator', 2, 'aut', 'Bo van Dam', 'van Dam, Bo' FROM f UNION ALL SELECT doc, 4, 'language', NULL, NULL, 'en', NULL FROM f""")
def dublin_core(spark, d):
    rows = table(spark, d, "nation").where("n_name not like '% %'")
    fields = F.array(*(F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in (("lang", F.lit("en")), ("author", F.concat(F.lit("Ann "), F.col("n_name"), F.lit(" ; van Dam, Bo"))), ("title", F.lit("T")), ("draft", F.lit("no")))))
    return M.dublin_core(rows.select(F.col("n_nationkey").alias("doc"), F.inline(fields)), "doc")


_STYLES = "s AS (SELECT n_regionkey AS doc, n_nationkey AS id, (SELECT max(m.n_nationkey) FROM nation m WHERE m.n_regionkey = n.n_regionkey AND m.n_nationkey < n.n_nationkey) AS parent, CASE WHEN n_nationkey % 3 = 0 THEN n_name END AS font FROM nation n)"


@query(f"WITH RECURSIVE {_STYLES}, w AS (SELECT doc, id, parent, font FROM s UNION ALL SELECT w.doc, w.id, s.parent, s.font FROM w JOIN s ON s.doc = w.doc AND s.id = w.parent WHERE w.font IS NULL) SELECT doc, id, max(font) AS font FROM w GROUP BY doc, id")
def style_inheritance(spark, d):
    before = F.lag("n_nationkey").over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    styles = table(spark, d, "nation").select(F.col("n_regionkey").alias("doc"), F.col("n_nationkey").alias("id"), before.alias("parent"), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).alias("font"))
    return M.inherited(styles, ["doc", "id"], "parent", "font")


@query("SELECT l_orderkey, CAST(min(c) AS BIGINT) AS free FROM (SELECT DISTINCT l_orderkey, unnest([1, 2, 3, 4, 5, 6, 7, 8, 9]) AS c FROM lineitem) k WHERE NOT EXISTS (SELECT 1 FROM lineitem m WHERE m.l_orderkey = k.l_orderkey AND m.l_linenumber = k.c) GROUP BY l_orderkey")
def fresh_id(spark, d):
    return S.free_numbers(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("""WITH b AS (SELECT *, role <> 'user' AS block FROM conversations), i AS (SELECT *, sum(CASE WHEN block AND coalesce(p, false) THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM (SELECT *, lag(block) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM b))
SELECT conv_id, min(turn) AS first, max(turn) AS last, count(*) AS n, CASE WHEN bool_and(role = 'system') THEN 'pre' ELSE 'blockquote' END AS tag FROM i WHERE block GROUP BY conv_id, run""")
def block_runs(spark, d):
    rows = table(spark, d, "conversations").withColumn("kind", F.when(F.col("role") == "system", "code").otherwise("text"))
    return S.block_runs(rows, "conv_id", "turn", "kind", F.col("role") != "user")


@query("SELECT conv_id, turn, role, text FROM conversations WHERE role <> 'system'")
def unsectionize(spark, d):
    return turns(spark, d).where("level is null or level != 1").select("conv_id", "turn", "role", "text")


@query("SELECT c.conv_id, c.turn, (SELECT min(n.turn) FROM conversations n WHERE n.conv_id = c.conv_id AND n.turn > c.turn) AS first, (SELECT max(n.turn) FROM conversations n WHERE n.conv_id = c.conv_id AND n.turn > c.turn) AS last, CAST((SELECT count(*) FROM conversations n WHERE n.conv_id = c.conv_id AND n.turn > c.turn AND n.text IS NOT NULL) AS BIGINT) AS n_arguments FROM conversations c WHERE role = 'user'")
def command_arguments(spark, d):
    found = S.arguments(turns(spark, d), "conv_id", "turn", F.col("role") == "user", "text")
    return found.select("conv_id", "turn", "first", "last", F.col("n_arguments"))


@query("SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) = regexp_extract(html, '<title>([^<]*)</title>', 1) AS same FROM pages WHERE html LIKE '%<h1>%' AND html LIKE '%<title>%'")
def html_title_vs_h1(spark, d):
    of = lambda tag: F.collect_list(F.when(F.col("tag") == tag, F.col("text")))
    found = html.element_texts(table(spark, d, "pages"), ["title", "h1"]).groupBy("doc_id").agg(of("title").alias("titles"), of("h1").alias("heads"))
    pairs = found.select("doc_id", "heads", F.explode("titles").alias("title")).select("doc_id", "title", F.explode("heads").alias("head"))
    return pairs.select(F.col("doc_id").alias("page_id"), (F.col("head") == F.col("title")).alias("same"))


@query(None)
def html_disallowed_tags(spark, d):
    from quillstack.operators.rewrite import ALLOWED

    tree = html.nodes(table(spark, d, "pages")).where(F.col("kind") == "elt")
    return tree.where(~F.col("tag").isin(sorted(ALLOWED))).groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("pages"))


def _converted(name: str, writer: str):
    def run(spark, d):
        out = conversion.converted(table(spark, d, "pages"), "page_id", "html", "html", writer)
        return out.select("page_id", F.length("output").cast("long").alias("n_bytes"), F.sha2("output", 256).alias("digest"))

    run.__name__ = name
    query(None)(run)


for _name, _writer in (("convert_html", "html"), ("convert_latex", "tex"), ("convert_epub", "epub"), ("convert_odt", "odt"), ("convert_docx", "docx"), ("convert_text", "text")):
    _converted(_name, _writer)


@query("SELECT page_id, 0::BIGINT AS ord, 1::BIGINT AS level, 's-1' AS id, trim(regexp_replace(replace(replace(replace(replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1),'&quot;','\"'),'&copy;','©'),'&middot;','·'),'&amp;','&'), '[\n\r\t ]+', ' ', 'g')) AS title FROM pages WHERE html LIKE '%<h1>%'")
def page_contents(spark, d):
    return conversion.toc(table(spark, d, "pages"), "page_id", "html")


@query("SELECT o_orderkey, 'docproblem' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS id, o_custkey AS doc, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS seq, 'No entry ' || o_orderkey || ' of ' || o_orderpriority AS body FROM orders".replace("SELECT o_orderkey, ", "SELECT "))
def document_problems(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("doc"), "o_orderkey", "o_orderpriority", F.lit("body").alias("kind"))
    return S.problems(rows, "doc", "o_orderkey", "kind", F.lit("No entry {} of {}"), [F.col("o_orderkey"), F.col("o_orderpriority")]).select("doc", "seq", "id", "body")


@query("SELECT o_custkey AS doc, min(o_orderkey) AS key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1")
def first_missing_key(spark, d):
    cited = table(spark, d, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("key"))
    known = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("key"))
    return S.first_missing(cited, known, "doc", "key")


@query(f"WITH {_FIELDS}, u AS (SELECT doc, bool_or(name IN ('autor', 'xyzzyxyzzy') OR (name = 'date' AND value <> '1999-1-2') OR (name = 'draft' AND value <> 'YES') OR (name = 'lang' AND value <> 'de_CH')) OR NOT bool_or(name = 'author') AS has_errors FROM f GROUP BY doc) SELECT doc, has_errors FROM u")
def meta_any_error(spark, d):
    fields = [("author", None, True, None, None), ("date", "date", None, None, None), ("draft", "boolean", None, None, None), ("lang", "lang", None, None, None), ("title", None, True, None, None)]
    schema = M.canonical_schema(spark.createDataFrame(fields, "name string, type string, required boolean, label string, default string"))
    return M.has_errors(M.validated(_fields(spark, d), schema, "doc"), "doc")


scalar("multiline_roundtrip", lambda c: F.array_join(T.parse_multiline(T.print_multiline(F.array(F.replace(c, F.lit(";"), F.lit(",")), F.lit("x")))), "|"), "regexp_replace(replace(text, ';', ','), '^\\s+|\\s+$', '', 'g') || '|x'")
