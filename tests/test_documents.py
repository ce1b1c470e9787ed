import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillstack.functions import text as T
from quillstack.functions.kernels import damerau
from quillstack.operators import structure as S
from quillstack.sources import html

from .oracle import compare


def tree(source):
    return [(r[6] or r[7], r[0], r[1], r[2]) for r in html.parse(source)]


def test_unclosed():
    assert tree("<div><p>a<p>b<b>c</div>d") == [("div", 0, 6, -1), ("p", 1, 2, 0), ("a", 2, 2, 1), ("p", 3, 6, 0), ("b", 4, 4, 3), ("b", 5, 6, 3), ("c", 6, 6, 5), ("d", 7, 7, -1)]


def test_opaque_and_void():
    assert [r[0] for r in tree('<script>var t="</p>";</script><br>x<!-- no -->&amp;')] == ["script", "br", "x", "&"]


def test_references_end_with_a_semicolon():
    """As in the SQL of the page queries; a title cut at its length ends in a piece of one."""
    assert [r[0] for r in tree("<h1>a &amp;&amp; b&amp</h1>&copy;&copy2 &ampx; &nosuch; &#65;&#66 &amp;quot; &\ue000&#xE000;&")] == ["h1", "a && b&amp", "©&copy2 &ampx; &nosuch; A&#66 &quot; &\ue000\ue000&"]
    assert html.parse('<a href="?x=1&copy=2&amp;y&lt">')[0][8] == [("href", "?x=1&copy=2&y&lt")]
    assert [r[:2] for r in tree("<x&y>z</x&y>w")] == [("x&y", 0), ("z", 1), ("w", 2)]


def test_pages_against_sql(spark, tmp_path):
    pages = ["<title>a&amp;&amp</title><h1>b&quot</h1>", "<title>&copy;</title><h1>&am</h1>"]
    rows = [(n, "http://x/", page) for n, page in enumerate(pages)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("html_heading_text", "html_title_text", "html_title_vs_h1", "page_contents"):
        assert compare(spark, connection, entry.queries()[name], entry.oracle_sql()[name], str(tmp_path)) == "", name


def test_multiline_against_sql(spark, tmp_path):
    """One SQL trims spaces alone, the other all white space."""
    texts = ["a,\nb , c\t,d \n", "\n x ;  y\r\n", " ; ,", "", "\u00a0a \u2028"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("multiline_literal", "multiline_roundtrip"):
        assert compare(spark, connection, entry.queries()[name], entry.oracle_sql()[name], str(tmp_path)) == "", name


@pytest.mark.parametrize("seed", range(5))
def test_nested_sets(seed):
    rng = random.Random(seed)
    source = "".join(rng.choice(["<p>", "</p>", "<b>", "</b>", "<ul>", "<li>", "</ul>", "x", "<div>", "</div>", "<br>"]) for _ in range(300))
    rows = html.parse(source)
    for pre, last, parent, depth, pos, *_ in rows:
        assert pre <= last and (parent < 0 or rows[parent][0] < pre <= last <= rows[parent][1])
        assert depth == (0 if parent < 0 else rows[parent][3] + 1)


def test_sections_are_a_stack(spark):
    rng = random.Random(1)
    rows = [(d, k, rng.choice([None, 1, 2, 3, 4, 5, 6])) for d in range(20) for k in range(30)]
    got = {(r["doc"], r["ord"]): r["parent_ord"] for r in S.sections(spark.createDataFrame(rows, "doc long, ord long, level long"), "doc", "ord", "level").collect()}
    for d in range(20):
        stack = []
        for _, k, level in (r for r in rows if r[0] == d):
            if level is not None:
                while stack and stack[-1][1] >= level:
                    stack.pop()
            assert got[d, k] == (stack[-1][0] if stack else None)
            if level is not None:
                stack.append((k, level))


def test_damerau():
    assert [damerau(a, b) for a, b in (("ab", "ba"), ("", "abc"), ("kitten", "sitting"), ("ca", "abc"))] == [1, 3, 3, 2]


def test_literals(spark):
    rows = spark.createDataFrame([(x,) for x in ("today", "1999", "2003-12-1", "-5", "x", None)], "s string")
    assert [r[0] for r in rows.select((T.parse_date(F.col("s")) == F.current_date().cast("string")).cast("string")).collect()][0] == "true"
    assert [r[0] for r in rows.where("s is null or s != 'today'").select(T.parse_date(F.col("s"))).collect()] == ["1999", "2003-12-01", None, None, None]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
