import random

import pytest
from pyspark.sql import functions as F

from quillstack import model
from quillstack.functions import citations as C
from quillstack.functions import lang as L
from quillstack.functions import markup as K
from quillstack.functions import names as N
from quillstack.functions import text as T
from quillstack.model import Element as E
from quillstack.operators import metadata as M
from quillstack.operators import rewrite as R
from quillstack.operators import structure as S
from quillstack.plans import conversion
from quillstack.sinks import epub, html, latex, packages
from quillstack.sources import bibtex, formats, markdown
from quillstack.sources import html as html_source
from quillstack.sources import packages as package_source


def read(source):
    return model.from_rows(html_source.parse(source))


def shown(source, *steps):
    return html.markup(R.rewritten(read(source), list(steps)))


@pytest.mark.parametrize("seed", range(5))
def test_rows_round_trip(seed):
    rng = random.Random(seed)
    source = "".join(rng.choice(["<p>", "</p>", "<b>", "</b>", "<ul>", "<li>", "</ul>", "x", "<div>", "</div>", "<br>"]) for _ in range(200))
    rows = html_source.parse(source)
    assert model.to_rows(model.from_rows(rows)) == rows


def test_deep_tree():
    tree = read("<div>" * 5000 + "x")
    assert R.plain_text(R.tidy(R.splice(tree, lambda e: False))) == "x"


def test_splice_and_kill():
    tree = read("<ul><li>one <i>two</i></li></ul><i>three<u>four</u></i>five")
    assert html.markup(R.splice(tree, lambda e: e.tag == "i")) == "<ul><li>one two</li></ul>three<u>four</u>five"
    assert html.markup(R.kill(tree, lambda e: e.tag == "i")) == "<ul><li>one </li></ul>five"


def test_blank():
    assert R.is_blank(" ") and R.is_blank(E("a", {"name": "x"})) and R.is_blank(E("a", {}, ["", E("span", {}, [""])]))
    assert not R.is_blank("x") and not R.is_blank(E("p", {}, [E("img")]))


def test_plain_text():
    assert R.plain_text([E("h1", {}, [E("a", {"name": "h"}), "This is a ", E("b", {}, ["heading"]), E("footnote", {}, ["note"])])]) == "This is a heading"


def test_tidy():
    assert shown("<b>a</b><b>b<i>c</i></b><b><i>d</i></b><i></i><span>e</span>f", R.tidy) == "<b>ab<i>cd</i></b>ef"
    assert R.tidy(["e", "\u0301"]) == ["\u00e9"]


def test_space():
    assert shown("<p>\n a  <b> b</b>\n</p> <pre> x\n  y</pre>", R.normal_space) == "<p>a <b> b</b></p><pre> x\n  y</pre>"


def test_attributes():
    assert shown('<p onclick="x" class="b a" style="color:red;margin:1px">a<a href="javascript:x" name="n">b</a><img src="i.png" alt="q"></p>', R.clean_attributes) == '<p class="a b" style="color:red;">a<a name="n">b</a><img src="i.png"></p>'
    assert shown('<h1 class="title">a</h1><span class="footnote x">b</span>', R.promote_classes) == '<h1 class="title">a</h1><aside class="footnote x">b</aside>'
    assert shown('<img src="a" style="width:50%">', R.figures) == '<figure style="display:inline;width:50%;"><img src="a"></figure>'
    assert shown('<p id="x">y</p>', R.anchors) == '<p><a name="x"></a>y</p>'


def test_blocks():
    assert shown("<p><code>a</code></p><p><code>b</code></p><p>c</p>", R.blocks) == "<pre>a\nb</pre><p>c</p>"
    assert shown("<ul><li><p>a</p></li></ul><h2><b>x</b></h2>", R.unwrap) == "<ul><li>a</li></ul><h2>x</h2>"
    assert R.split_paragraphs([E("p", {"id": "k"}, ["a", E("figure"), "b"])]) == [E("p", {"id": "k"}, ["a"]), E("figure"), E("p", {}, ["b"])]


def test_sections():
    made = R.sectioned(read('<p>pre</p><h1 id="k">a</h1><p>x</p><h2>b</h2><h1>c</h1>'))
    assert html.markup(made) == '<section class="pre-section"><p>pre</p></section><section id="k"><h1>a</h1><p>x</p><section id="s-2"><h2>b</h2></section></section><section id="s-3"><h1>c</h1></section>'
    assert R.contents(made) == [(1, "k", "a"), (2, "s-2", "b"), (1, "s-3", "c")]
    assert html.markup(R.unsectioned(made)) == "<p>pre</p><h1>a</h1><p>x</p><h2>b</h2><h1>c</h1>"


def test_endnotes():
    made = R.endnotes([E("section", {"id": "s"}, [E("p", {}, ["a", E("footnote", {}, ["n"]), E("footnote", {"id": "own"}, ["m"])])])])
    assert html.markup(made) == '<section id="s"><p>a<a class="noteref" href="#s-fn1">1</a><a class="noteref" href="#own">2</a></p><section class="endnotes"><ol><li id="s-fn1">n</li><li id="own">m</li></ol></section></section>'


def test_latex():
    assert latex.markup(read('<h1>A&amp;B</h1><p>x <b>y_z</b> <a href="http://h/#a">l</a></p><ul><li>i</li></ul><table><tr><td>a</td><td>b</td></tr></table>')) == (
        "\\section{A\\&B}\n\nx \\textbf{y\\_z} \\href{http://h/\\#a}{l}\n\n\\begin{itemize}\n\\item i\n\\end{itemize}\n\n\\begin{tabular}{ll}\na & b \\\\\n\\end{tabular}\n\n"
    )


def test_epub():
    import io
    import zipfile
    from xml.etree import ElementTree

    data = epub.package(R.sectioned(read("<h1>a &amp; b</h1><p>x<br>y</p><h1>c</h1><img src='a'>")), "urn:1", "T")
    archive = zipfile.ZipFile(io.BytesIO(data))
    assert archive.namelist()[0] == "mimetype" and archive.infolist()[0].compress_type == zipfile.ZIP_STORED
    for name in archive.namelist()[1:]:
        ElementTree.fromstring(archive.read(name))
    assert [n for n in archive.namelist() if n.startswith("part")] == ["part-1.xhtml", "part-2.xhtml"]


DOCUMENT = "<h1>Head</h1><p>plain <b>bold</b> <i>it</i> <u><i>both</i></u> 2<sup>3</sup> x<sub>1</sub> <code>c &lt; d</code></p><ul><li>a<ol><li>b</li><li>c</li></ol></li><li>d</li></ul><p>end</p>"


@pytest.mark.parametrize("write, back, kind", [(packages.odt, package_source.odt, "odt"), (packages.docx, package_source.docx, "docx")])
def test_packages_round_trip(spark, write, back, kind):
    data = write(read(DOCUMENT))
    assert html.markup(R.tidy(back(data))) == html.markup(R.tidy(read(DOCUMENT)))
    rows = spark.createDataFrame([(bytearray(data),), (bytearray(b" <p>"),), (bytearray(b"# x"),), (None,)], "content binary")
    assert [r[0] for r in rows.select(formats.sniffed(F.col("content"))).collect()] == [kind, "html", "markdown", None]


def test_deep_packages():
    """Lists of any depth keep their kinds, marks of any depth are written, tables keep rows and cells, spaces are not cut."""
    lists = "<ol><li>x" * 15 + "</li></ol>" * 15
    for write, back in ((packages.odt, package_source.odt), (packages.docx, package_source.docx)):
        assert html.markup(R.tidy(back(write(read(lists))))) == html.markup(R.tidy(read(lists)))
        table = R.rewritten(back(write(read("<table><tr><td>a</td><td><b>b</b></td></tr><tr><td>c</td><td>d</td></tr></table>"))), [R.tidy, R.unwrap])
        rows = [n for n in table[0].kids if n.tag == "tr"]
        assert [[R.plain_text([c]) for c in r.kids] for r in rows] == [["a", "b"], ["c", "d"]]
    deep = read("<p>" + "<i><b>" * 3000 + "y")
    assert R.plain_text(package_source.docx(packages.docx(deep))) == "y"
    assert R.plain_text(package_source.odt(packages.odt(read("<p>a" + " " * 20_000 + "b")))) == "a" + " " * 20_000 + "b"


def test_files(spark, tmp_path):
    """A folder of files of all formats; a broken one says so and the others are converted."""
    for name, data in (("a.odt", packages.odt(read("<h1>A</h1>"))), ("b", packages.docx(read("<p>B</p>"))), ("c.html", b" " * 900 + b"<p>C</p>"), ("d", b" " * 900 + b"<p>D</p>"), ("e.md", b"# E"), ("f.docx", b"broken")):
        (tmp_path / name).write_bytes(data)
    got = {r["path"][-1 if "." not in r["path"].rsplit("/", 1)[1] else -6:].rsplit("/", 1)[-1]: (r["format"], r["output"] and bytes(r["output"]).decode(), r["error"] is None) for r in conversion.files(spark, str(tmp_path), "text").collect()}
    assert got == {"a.odt": ("odt", "A", True), "b": ("docx", "B", True), "c.html": ("html", "C", True), "d": ("html", "D", True), "e.md": ("markdown", "E", True), "f.docx": ("docx", None, False)}
    rows = spark.createDataFrame([(1, bytearray(b"broken")), (2, bytearray(packages.docx(read("<p>x"))))], "page_id long, content binary")
    out = {r["page_id"]: (r["output"] is None, r["error"] is None) for r in conversion.converted(rows, "page_id", "content", "docx", "text").collect()}
    assert out == {1: (True, False), 2: (False, True)}


def test_names_of_formats(spark):
    rows = spark.createDataFrame([("a/b.DOCX",), ("x.markdown",), ("x.pdf",), ("x",)], "path string")
    assert [r[0] for r in rows.select(formats.by_name(F.col("path"))).collect()] == ["docx", "markdown", None, None]


def test_markdown():
    source = "# T\n\npara *i* **b** `c<` [l](u) <http://x>\n\n- a\n- b\n    1. c\n\n> q\n\n```\ncode *x*\n```\n\n---\n\nSub\n---\n"
    assert html.markup(markdown.parse(source)) == '<h1>T</h1><p>para <i>i</i> <b>b</b> <code>c&lt;</code> <a href="u">l</a> <a href="http://x">http://x</a></p><ul><li>a</li><li>b<ol><li>c</li></ol></li></ul><blockquote><p>q</p></blockquote><pre>code *x*</pre><hr><h2>Sub</h2>'


def test_bibtex():
    source = '@string{x = "y"} @Article{k1, author = {Knuth, Donald and {van} Dam, B}, title = "A {B} c", year = 1999, month = jan # " x"}\n@book{k2,title={T}}'
    assert bibtex.parse(source) == [
        ("k1", "article", {"author": "Knuth, Donald and van Dam, B", "title": "A B c", "year": "1999", "month": "jan x"}, ["Knuth, Donald", "{van} Dam, B"]),
        ("k2", "book", {"title": "T"}, []),
    ]


def values(spark, function, *given):
    rows = spark.createDataFrame([(n, x) for n, x in enumerate(given)], "n int, s string")
    return [r[0] for r in rows.orderBy("n").select(function(F.col("s"))).collect()]


def test_people(spark):
    found = values(spark, N.person, "Maria  de la Cruz Ortega", "de la Cruz, Maria Ana", "zu Guttenberg, Jr, Karl", "Aristotle", "p, q, r, s", "  ", 'Ana "Bo" {Li}', None)
    assert [(p.display_name, p.sort_name) if p else None for p in found] == [
        ("Maria de la Cruz Ortega", "de la Cruz Ortega, Maria"), ("Maria Ana de la Cruz", "de la Cruz, Maria Ana"), ("Karl zu Guttenberg, Jr", "zu Guttenberg, Jr, Karl"), ("Aristotle", "Aristotle"), ("p, q, r, s", "p, q, r, s"), ("", ""), ("Ana Bo Li", "Li, Ana Bo"), None,
    ]


def test_people_are_one_function(spark):
    """As an expression person held its parts again and again: a column of 22,000 characters, a plan of 85,000."""
    assert len(str(N.person(F.col("s")))) < 2000
    assert [tuple(p) if p else None for p in values(spark, N.person, "von Hicks, III, Michael", "a,b,c,d", ",", "~x y", None)] == [
        ("Michael", "von", "Hicks", "III", "Michael von Hicks, III", "von Hicks, III, Michael"), (None, None, None, None, "a,b,c,d", "a,b,c,d"), ("", "", "", "", "", ""), ("\u00a0x", "", "y", "", "\u00a0x y", "y, \u00a0x"), None,
    ]


def test_citations(spark):
    assert values(spark, C.cleaned_post, ", p. 7", "pp. 12 - 15,xx", "p 3 pp. 8--9, 11", ", see p. 4", "p. 5 and 6", "pp.", "", "p. c-d") == ["7", "12–15, xx", "3 8–9, 11", "see p. 4", "p. 5 and 6", "pp.", "", "c–d"]
    found = values(spark, C.parsed, "[Ab-1:title, p. 2]", "Ab_2:years x", "  [Ab:year ", "Ab]", "[]", ":author", " Ab: note ")
    assert [(p.key, p.field, p.post, p.command, p.error) for p in found] == [
        ("Ab-1", "title", "2", "citetitlep", None), ("Ab_2", None, ":years x", "textcite", None), (None, None, None, None, "malformed citation, unmatched ["),
        (None, None, None, None, "malformed citation, unmatched ]"), (None, None, None, None, "no citation key"), (None, None, None, None, "no citation key"), ("Ab", None, ": note", "textcite", None),
    ]


def test_citations_are_one_function(spark):
    """As an expression parsed held its parts again and again: a column of 58,000 characters, and minutes for 15,000 rows."""
    assert len(str(C.parsed(F.col("s")))) < 2000 and len(str(C.cleaned_post(F.col("s")))) < 2000
    assert [tuple(p) for p in values(spark, C.parsed, "[k:year p.60, pp.99-122]", "k, , see", None)] == [("k", "year", "60, 99–122", "citeyearp", None), ("k", None, ", see", "textcite", None), (None, None, None, "textcite", None)]


def test_literals(spark):
    assert values(spark, T.parse_multiline, "a\\;b ; c", "x;;", "d\\\\e") == [["a\\;b", "c"], ["x", "", ""], ["d\\e"]]
    assert values(spark, lambda c: T.print_multiline(F.split(c, ",")), "a;b,c\\d") == ["a\\;b; c\\\\d"]
    assert values(spark, lambda c: T.parse_date(c) == F.current_date().cast("string"), "Today") == [True]
    assert values(spark, lambda c: T.print_date(c), "today", "1999-1-2") == ["today", "1999-01-02"]
    assert values(spark, K.document_uuid, "0123456789abcdef0123456789abcdef") == ["urn:uuid:01234567-89ab-5def-8123-456789abcdef"]
    assert values(spark, K.mime, "a/b.JPG", "x.svg", "x") == ["image/jpeg", "image/svg+xml", None]


def test_code_languages(spark):
    given = ["def f(x):\n  return x", "#include <a.h>", "public class A {", "x = y => { z }", "\\begin{a}", "(defn f [x] x)", "SELECT a FROM b", "<?xml version='1.0'?>", "<p>x</p>", "a { b: c; }", "def f\n  1\nend\n", "ls -l", None]
    assert values(spark, K.code_language, *given) == ["python", "c", "java", "javascript", "latex", "clojure", "sql", "xml", "html", "css", "ruby", "bash", None]


def test_inherited(spark):
    """Chains of any length, and rings, end."""
    chain = [(1, k, k - 1 if k else None, "root" if k == 0 else None) for k in range(150)]
    rows = spark.createDataFrame(chain + [(2, 1, 2, None), (2, 2, 1, None), (2, 3, 2, "own"), (2, 4, 3, None), (2, 5, 99, None)], "doc int, id int, parent int, font string")
    got = {(r[0], r[1]): r[2] for r in M.inherited(rows, ["doc", "id"], "parent", "font").collect()}
    assert {v for (d, _), v in got.items() if d == 1} == {"root"} and len(got) == 155
    assert [got[2, k] for k in range(1, 6)] == [None, None, "own", "own", None]


def test_suggestions(spark):
    known = spark.createDataFrame([("heading", 0), ("leading", 1), ("abc", 2), ("é", 3)], "name string, n int")
    words = spark.createDataFrame([("eading",), ("headnig",), ("abz",), ("xyz",), ("leadingé",), (None,)], "word string")
    assert {tuple(r) for r in M.suggestions(words, known, "word", "name", "n").collect()} == {("eading", "heading", 1), ("headnig", "heading", 1), ("abz", "abc", 1), ("leadingé", "leading", 1)}


def test_metadata_views(spark):
    fields = spark.createDataFrame([(1, "a", "x", "x", None), (1, "b", "bad", "no", "e"), (1, "c", "bad", None, "e"), (2, "a", None, "d", None)], "doc int, name string, supplied string, canonical string, error string")
    names = lambda df: sorted((r["doc"], r["name"]) for r in df.collect())
    assert names(M.raw_items(fields)) == [(1, "a"), (1, "b"), (1, "c")] and names(M.items(fields)) == [(1, "a"), (1, "b"), (2, "a")]
    assert {tuple(r) for r in M.has_errors(fields, "doc").collect()} == {(1, True), (2, False)}
    assert names(M.overridden(fields, fields.where("doc = 2").withColumn("name", F.lit("z")), "doc")) == [(1, "a"), (1, "b"), (1, "c"), (2, "z")]


def test_scalars(spark):
    assert values(spark, K.colour, "#ABC", "red", "rgba(1, 2, 255, 0.5)", "rgb(100%, 0%, 50.2%)", "hsl(120, 100%, 25%)", "HSL(-60, 100%, 50%)", "x", None) == ["#aabbcc", "#ff0000", "#0102ff", "#ff0080", "#008000", "#ff00ff", None, None]
    assert values(spark, K.url_fix, "HTTP://Ex.ORG/A{b", "ftp://User:P@Ex.ORG:21?Q", "no url") == ["HTTP://ex.org/A%7Bb", "ftp://User:P@ex.org:21?Q", "no url"]
    assert values(spark, lambda c: K.macro_name(c, "doc"), "multi-part-name", "name", "Bad") == ["docmultiPartName", "docname", None]
    assert values(spark, L.babel, "de_CH", "en", "zh") == ["ngerman", "american", None]
    assert values(spark, lambda c: L.localised(F.lit("Contents"), c), "de-CH", "ms", "en") == ["Inhalt", "Contents", "Contents"]
    assert values(spark, T.latex_quote, "\\{a}[~\u00a0<_^") == ["{\\textbackslash}\\{a\\}{[}{\\textasciitilde}~{\\textless}\\_\\^{}"]
    assert values(spark, T.latex_quote, "a\ufdd0b_", "\ufdd8") == ["a\ufdd0b\\_", "\ufdd8"]
    assert values(spark, K.parse_data_url, "data:image/png;base64,AAE=", "http://x")[0].data == b"\x00\x01"
    assert values(spark, lambda c: K.indent(c, 2), "a \n\nb") == ["  a\n\n  b"]


def test_free_numbers(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4), ("b", 2), ("c", 0)], "g string, n int")
    assert {r[0]: r[1] for r in S.free_numbers(rows, "g", "n").collect()} == {"a": 3, "b": 1, "c": 1}


@pytest.mark.parametrize("writer", sorted(conversion.WRITERS))
def test_null_and_empty(spark, writer):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "<h1>x")], "page_id long, html string")
    assert conversion.converted(rows, "page_id", "html", "html", writer).count() == 3
    assert conversion.converted(rows.where("false"), "page_id", "html", "html", writer).count() == 0


def test_long_parts_stay_whole(spark):
    long = "b" * 1_000_003
    assert values(spark, lambda c: F.length(K.macro_name(c, "doc")), f"a-{long}") == [3 + 1 + len(long)]
    assert values(spark, lambda c: F.length(K.default_label(c)), long) == [len(long)]
