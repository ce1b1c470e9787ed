"""Queries over attributes and tables. Order lines stand in for cells, conversations for documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstack.operators import attributes as A
from quillstack.session import table

from .texts import query, scalar


@query("SELECT p_partkey, greatest(0, CAST(round(CAST((p_partkey % 97 - 10) || '.5' AS DOUBLE) / 1.27) AS BIGINT)) AS indents FROM part")
def odt_indents(spark, d):
    width = F.concat((F.col("p_partkey") % 97 - 10).cast("string"), F.lit(".5cm"))
    return table(spark, d, "part").select("p_partkey", A.indents(width).alias("indents"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN NULL ELSE printf('#%06X', CAST(p_partkey AS BIGINT)) END AS fill FROM part")
def docx_shading(spark, d):
    k, size = F.lower(F.lpad(F.hex("p_partkey"), 6, "0")), F.col("p_size") % 3
    given = F.when(size == 0, "#fffFFF").when(size == 1, "auto").otherwise(F.concat(F.lit("#"), k))
    return table(spark, d, "part").select("p_partkey", A.shading(given).alias("fill"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'font.' || p_name WHEN 1 THEN '../fonts/' || p_name || '.svg' ELSE 'x/../fonts/a.ttf' END AS id FROM part")
def font_ids(spark, d):
    size, name = F.col("p_size") % 3, F.col("p_name")
    given = F.when(size == 0, F.concat(F.lit("../fonts/"), name, F.lit(".OtF"))).when(size == 1, F.concat(F.lit("../fonts/"), name, F.lit(".svg"))).otherwise("x/../fonts/a.ttf")
    return table(spark, d, "part").select("p_partkey", A.font_id(given).alias("id"))


@query("""SELECT l_orderkey, l_linenumber, l_returnflag || ' O x' || CASE l_linestatus WHEN 'O' THEN '' ELSE ' ' || l_linestatus END || ' z' AS classes,
'color:' || l_linestatus || ';width:' || l_linenumber || ';height:1' AS style FROM lineitem""")
def attribute_merge(spark, d):
    flag, status, one = F.col("l_returnflag"), F.col("l_linestatus"), F.lit("1")
    classes = A.merged_classes(F.array(flag, F.lit("O"), F.lit("x")), F.array(status, F.lit("z")))
    style = A.merged_style(F.create_map(F.lit("color"), flag, F.lit("width"), F.col("l_linenumber").cast("string")), F.create_map(F.lit("height"), one, F.lit("color"), status))
    text = F.array_join(F.transform(F.map_entries(style), lambda e: F.concat(e.key, F.lit(":"), e.value)), ";")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(classes, " ").alias("classes"), text.alias("style"))


scalar("names_left_over", lambda c: F.size(A.left_over(F.split(c, " "), ["the", "a", ""])).cast("long"), "CAST(len(list_distinct(list_filter(string_split(text, ' '), lambda w: w NOT IN ('the', 'a', '')))) AS BIGINT)")


@query("SELECT conv_id, NOT (count(*) = 1 AND bool_and(coalesce(role = 'user', false))) AS needs_p FROM conversations GROUP BY 1")
def paragraph_needed(spark, d):
    return A.needs_paragraph(table(spark, d, "conversations"), "conv_id", F.col("role") == "user")


@query("SELECT conv_id, turn, CASE WHEN role = 'system' THEN ltrim('#' || text, '#') END AS label FROM conversations")
def label_split(spark, d):
    nodes = table(spark, d, "conversations").withColumn("name", F.concat(F.lit("#"), F.col("text")))
    labels, rest = A.split_labels(nodes, F.col("role") == "system", "name")
    return labels.select("conv_id", "turn", "label").union(rest.select("conv_id", "turn", F.lit(None).cast("string")))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, (l_linenumber - 1) // 2 AS r, (l_linenumber - 1) % 2 AS k, l_returnflag = 'N' OR l_linestatus = 'F' AS able FROM lineitem),
rows_ AS (SELECT l_orderkey, bool_and(able) AS ok FROM c JOIN (SELECT l_orderkey, min(r) AS r FROM c GROUP BY 1) m USING (l_orderkey, r) GROUP BY 1),
cols AS (SELECT l_orderkey, bool_and(able) AS ok FROM c JOIN (SELECT l_orderkey, min(k) AS k FROM c GROUP BY 1) m USING (l_orderkey, k) GROUP BY 1)
SELECT l_orderkey, l_linenumber, rows_.ok AND r = min(r) OVER w AS header_row, cols.ok AND k = min(k) OVER w AS header_col
FROM c JOIN rows_ USING (l_orderkey) JOIN cols USING (l_orderkey) WINDOW w AS (PARTITION BY l_orderkey)""")
def table_headers(spark, d):
    n = F.col("l_linenumber") - 1
    cells = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", F.floor(n / 2).alias("r"), (n % 2).alias("k"))
    found = A.header_cells(cells, "l_orderkey", "r", "k", F.col("l_returnflag") == "N", F.col("l_linestatus") == "F")
    return found.select("l_orderkey", "l_linenumber", "header_row", "header_col")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN o_orderkey IS NULL THEN 'c' ELSE o_orderpriority || ' c' END AS classes
FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 3 > 0) ON l_orderkey = o_orderkey""")
def column_alignment(spark, d):
    cells = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array(F.lit("c")).alias("class"))
    columns = table(spark, d, "orders").where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("l_orderkey"), F.array("o_orderpriority").alias("class"))
    return A.aligned(cells, columns, ["l_orderkey"]).select("l_orderkey", "l_linenumber", F.array_join("class", " ").alias("classes"))


@query("""WITH u AS (SELECT conv_id, turn AS ord, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS n, 'http://' || text AS href FROM conversations WHERE role = 'user' AND text IS NOT NULL),
s AS (SELECT conv_id, ord, n, 'tystrurl' || translate(CAST(n AS VARCHAR), '0123456789', 'ZABCDEFGHI') AS name, CASE WHEN length(replace(href, '{', '')) = length(replace(href, '}', '')) THEN href
ELSE replace(replace(replace(replace(replace(replace(replace(replace(href, '{', '%7B'), '}', '%7D'), '[', '%5B'), ']', '%5D'), '^', '%5E'), '\\', '%5C'), '"', '%22'), '|', '%7C') END AS safe FROM u)
SELECT conv_id, ord, n, name, '\\urldef{\\' || name || '}\\url{' || safe || '}' AS definition FROM s""".replace("\\\\", "\\"))
def bare_urls(spark, d):
    text = F.concat(F.lit("http://"), F.col("text"))
    links = table(spark, d, "conversations").select("conv_id", "turn", text.alias("label"), F.when(F.col("role") == "user", text).otherwise("http://x").alias("href"))
    return A.bare_urls(links, "conv_id", "turn", "label", "href")
