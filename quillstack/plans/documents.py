"""Queries over structure and metadata operators. Conversations stand in for documents: a system turn is a level-1
heading, a user turn a level-2 heading, an assistant turn a paragraph."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstack.functions import citations as C
from quillstack.operators import metadata as M
from quillstack.operators import structure as S
from quillstack.session import table

from .texts import query


def turns(spark, d):
    level = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2)
    return table(spark, d, "conversations").select("conv_id", "turn", "role", "text", level.cast("long").alias("level"))


_TURNS = "t AS (SELECT conv_id, turn, role, text, CAST(CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 END AS BIGINT) AS level FROM conversations)"
_PARENT = "(SELECT max(u.turn) FROM t u WHERE u.conv_id = t.conv_id AND u.turn < t.turn AND u.level < coalesce(t.level, 7))"


@query(f"WITH {_TURNS} SELECT conv_id, turn, {_PARENT} AS parent_ord FROM t")
def sectionize_conversations(spark, d):
    return S.sections(turns(spark, d), "conv_id", "turn", "level").select("conv_id", "turn", "parent_ord")


@query(f"WITH {_TURNS} SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ord, level, text AS title, {_PARENT} AS parent_ord FROM t WHERE level IS NOT NULL")
def toc_conversations(spark, d):
    return S.toc(turns(spark, d), "conv_id", "turn", "level", "text")


@query("""WITH s AS (SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS section FROM conversations),
n AS (SELECT conv_id, turn, section, row_number() OVER (PARTITION BY conv_id, section ORDER BY turn) AS n FROM s WHERE role = 'assistant')
SELECT conv_id, turn, section, n, section || '-fn' || n AS note_id FROM n""")
def endnote_numbering(spark, d):
    return S.endnotes(turns(spark, d), "conv_id", "turn", F.col("role") == "user", F.col("role") == "assistant").select("conv_id", "turn", "section", "n", "note_id")


@query("""WITH s AS (SELECT *, lag(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS float_ord FROM conversations)
SELECT conv_id, turn, float_ord, float_ord IS NULL AS problem FROM s WHERE role = 'assistant'""")
def caption_attach(spark, d):
    found = S.captions(turns(spark, d), "conv_id", "turn", F.col("role") == "user", F.col("role") == "assistant")
    return found.select("conv_id", "turn", "float_ord", F.col("float_ord").isNull().alias("problem"))


@query("""SELECT conv_id, turn, CAST(coalesce(sum(m) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + sum(m) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS part
FROM (SELECT *, CASE WHEN role = 'user' THEN 1 ELSE 0 END AS m FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def split_at_figure(spark, d):
    return S.split_at(turns(spark, d), "conv_id", "turn", F.col("role") == "user").select("conv_id", "turn", F.col("part").cast("long").alias("part"))


@query("""SELECT conv_id, turn, role FROM (SELECT *, min(CASE WHEN role IN ('system', 'user') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS ok FROM conversations) WHERE ok = 1""")
def take_while_meta(spark, d):
    return S.prefix(turns(spark, d), "conv_id", "turn", F.col("role").isin("system", "user")).select("conv_id", "turn", "role")


@query("""WITH a AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT DISTINCT FROM role AND row_number() OVER (PARTITION BY conv_id ORDER BY turn) > 1 THEN 0 ELSE 1 END AS new FROM conversations),
b AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM a)
SELECT conv_id, CAST(run AS BIGINT) AS run, first(role) AS role, CAST(count(*) AS BIGINT) AS n, string_agg(text, '' ORDER BY turn) AS text FROM b GROUP BY conv_id, run""")
def adjacent_merge(spark, d):
    return S.merge_adjacent(turns(spark, d), "conv_id", "turn", "role", "text").select("conv_id", F.col("run").cast("long").alias("run"), "role", "n", "text")


@query("SELECT l_orderkey, l_linenumber, CAST(l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS BIGINT) AS run FROM lineitem")
def list_relative_depth(spark, d):
    rows = S.relative_depth(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")
    return rows.select("l_orderkey", "l_linenumber", F.col("run").cast("long").alias("run"))


@query("SELECT l_orderkey, l_linenumber, round(100 * l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey), 2) AS percent FROM lineitem")
def column_width_pct(spark, d):
    return S.shares(table(spark, d, "lineitem"), ["l_orderkey"], "l_quantity").select("l_orderkey", "l_linenumber", "percent")


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.lang, l.quality FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
def meta_full_outer(spark, d):
    return M.with_defaults(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").select("doc_id", "quality"), ["doc_id"])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def meta_required_missing(spark, d):
    return M.missing(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id"), ["doc_id"])


@query(r"""WITH w AS (SELECT DISTINCT word FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS word FROM part UNION ALL SELECT lower(substr(n_name, 2, 1) || substr(n_name, 1, 1) || substr(n_name, 3)) FROM nation)),
p AS (SELECT word, min(struct_pack(d := damerau_levenshtein(regexp_replace(word, '[^\x00-\x7F]', '#', 'g'), lower(n_name)), o := n_nationkey, n := lower(n_name))) AS best FROM w CROSS JOIN nation GROUP BY word)
SELECT word, best.n AS suggestion, CAST(best.d AS BIGINT) AS distance FROM p WHERE best.d <= least(3, length(best.n) // 2)""")
def meta_did_you_mean(spark, d):
    nation = table(spark, d, "nation")
    swapped = F.lower(F.concat(F.substring("n_name", 2, 1), F.substring("n_name", 1, 1), F.substr("n_name", F.lit(3))))
    words = table(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).union(nation.select(swapped))
    return M.suggestions(words, nation.select(F.lower("n_name").alias("name"), "n_nationkey"), "word", "name", "n_nationkey")


@query("""WITH a AS (SELECT n_regionkey AS doc, string_agg(n_name, ' ; ' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1),
s AS (SELECT doc, unnest(string_split_regex(names, '\\s*;\\s*')) AS name, generate_subscripts(string_split_regex(names, '\\s*;\\s*'), 1) AS n FROM a)
SELECT doc, 'creator' AS element, CAST(n AS BIGINT) AS n, name FROM s""")
def dublin_contributors(spark, d):
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda r: r.n_name), " ; ")
    rows = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("doc")).agg(names.alias("names")).withColumn("element", F.lit("creator"))
    return M.contributors(rows, "doc", "element", "names")


@query("""SELECT l_orderkey AS doc, CAST(bit_or(CASE l_returnflag WHEN 'A' THEN 130 WHEN 'N' THEN 132 ELSE 136 END) AS BIGINT) AS exit_code FROM lineitem GROUP BY 1""")
def exit_code_bits(spark, d):
    kind = F.when(F.col("l_returnflag") == "A", "meta").when(F.col("l_returnflag") == "N", "body").otherwise("include")
    return M.exit_bits(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), kind.alias("kind")), "doc", "kind")


@query("""SELECT DISTINCT o_orderkey AS key, '(' || CASE o_orderkey % 3 WHEN 0 THEN 'Anon' WHEN 1 THEN c_name ELSE c_name || ' et al.' END || ', ' || coalesce(CAST(year(o_orderdate) AS VARCHAR), 'n.d.') || ')' AS cited
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def cite_format(spark, d):
    entries = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    cited = entries.join(table(spark, d, "lineitem").select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    return cited.select(F.col("o_orderkey").alias("key"), C.in_text(F.lit("autocite"), F.col("c_name"), F.col("o_orderkey") % 3, F.year("o_orderdate"), F.lit("")).alias("cited"))


@query("SELECT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def cite_missing(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_custkey").alias("key"))


@query("SELECT l_orderkey, l_linenumber, p_name, s_name FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey")
def rel_lookup(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    return lines.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left").select("l_orderkey", "l_linenumber", "p_name", "s_name")
