from pyspark.sql import functions as F

from quillstack.operators import attributes as A


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_values(spark):
    lit = F.lit
    assert one(spark, A.indents(lit("-3cm")), A.indents(lit("2.54cm")), A.indents(lit("0.64cm")), A.indents(lit("4in")), A.indents(lit(None))) == (0, 2, 1, None, None)
    assert one(spark, A.shading(lit("#ab00ff")), A.shading(lit("#FFffff")), A.shading(lit("auto")), A.shading(lit("#abc"))) == ("#AB00FF", None, None, None)
    assert one(spark, A.font_id(lit("../fonts/Some.Serif.TTF")), A.font_id(lit("fonts/a.ttf"))) == ("font.Some.Serif", "fonts/a.ttf")


def test_merges(spark):
    none = F.lit(None)
    words = lambda *w: F.array(*map(F.lit, w))
    assert one(spark, A.merged_classes(words("q", "b"), none, words("b", "a")), A.with_classes(words("q", "b"), "c", "b"), A.left_over(words("x", "y", "x", "z"), ["y"])) == (["q", "b", "a"], ["b", "c", "q"], ["x", "z"])
    a, b = F.create_map(F.lit("m"), F.lit("1"), F.lit("n"), F.lit("2")), F.create_map(F.lit("o"), F.lit("3"), F.lit("m"), F.lit("4"))
    (both, left, right) = one(spark, A.merged_style(a, b), A.merged_style(a, none.cast("map<string,string>")), A.merged_style(none.cast("map<string,string>"), b))
    assert list(both.items()) == [("m", "4"), ("n", "2"), ("o", "3")] and left == {"m": "1", "n": "2"} and right == {"o": "3", "m": "4"}


def test_headers(spark):
    # Table 1: a header row and no header column; 2: a column of blanks; 3: a null test counts as no.
    cells = [(1, 3, 1, "b"), (1, 3, 2, ""), (1, 4, 1, "x"), (1, 4, 2, "b"), (2, 0, 0, ""), (2, 0, 1, "x"), (2, 1, 0, "b"), (2, 1, 1, "x"), (3, 0, 0, None)]
    rows = spark.createDataFrame(cells, "t long, r long, c long, kind string")
    found = A.header_cells(rows, "t", "r", "c", F.col("kind") == "", F.col("kind") == "b")
    assert found.columns == ["t", "r", "c", "kind", "header_row", "header_col"]
    assert {(x.t, x.r, x.c) for x in found.collect() if x.header_row} == {(1, 3, 1), (1, 3, 2)}
    assert {(x.t, x.r, x.c) for x in found.collect() if x.header_col} == {(2, 0, 0), (2, 1, 0)}


def test_paragraphs_and_labels(spark):
    nodes = spark.createDataFrame([(1, "p", None), (2, "p", None), (2, "a", "##x"), (3, "a", "y"), (4, None, None)], "doc long, tag string, name string")
    assert dict(map(tuple, A.needs_paragraph(nodes, "doc", F.col("tag") == "p").collect())) == {1: False, 2: True, 3: True, 4: True}
    labels, rest = A.split_labels(nodes, F.col("tag") == "a", "name")
    assert sorted(r.label for r in labels.collect()) == ["x", "y"] and rest.count() == 3


def test_addresses(spark):
    links = [(1, 5, "u{", "u{"), (1, 2, "v{}", "v{}"), (1, 3, "text", "w"), (2, 1, "^}", "^}"), (2, 2, None, None)] + [(3, k, "z", "z") for k in range(12)]
    found = A.bare_urls(spark.createDataFrame(links, "doc long, at long, text string, href string"), "doc", "at", "text", "href")
    got = {(r.doc, r.ord): (r.n, r.definition) for r in found.collect()}
    assert got[1, 2] == (1, r"\urldef{\tystrurlA}\url{v{}}") and got[1, 5] == (2, r"\urldef{\tystrurlB}\url{u%7B}")
    assert got[2, 1] == (1, r"\urldef{\tystrurlA}\url{%5E%7D}") and got[3, 9][1] == r"\urldef{\tystrurlAZ}\url{z}" and len(got) == 15


def test_alignment(spark):
    cells = spark.createDataFrame([(1, 1, ["x"]), (1, 2, None), (2, 1, ["k"])], "t long, c long, class array<string>")
    columns = spark.createDataFrame([(1, 1, ["a", "x"]), (1, 2, ["b"])], "t long, c long, class array<string>")
    assert {(r.t, r.c): r["class"] for r in A.aligned(cells, columns, ["t", "c"]).collect()} == {(1, 1): ["a", "x"], (1, 2): ["b"], (2, 1): ["k"]}
