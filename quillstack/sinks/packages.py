"""ODT and DOCX packages from trees: blocks, lists, tables and inline marks. DOCX links keep their text alone; images are left out."""

from __future__ import annotations

import io
import zipfile
from itertools import groupby
from xml.sax.saxutils import escape, quoteattr

from quillstack.model import Element, Kids, folded, texts
from quillstack.sources.packages import SPACES

_TIME = (1980, 1, 1, 0, 0, 0)
_ADDRESS = {prefix: space for space, prefix in SPACES.items()}
_ODT_MIME = "application/vnd.oasis.opendocument.text"

#: Properties of the named text styles. Fixed values.
ODT_STYLES = {"b": 'fo:font-weight="bold"', "i": 'fo:font-style="italic"', "u": 'style:text-underline-style="solid"', "s": 'style:text-line-through-style="solid"', "sub": 'style:text-position="sub 58%"', "sup": 'style:text-position="super 58%"', "code": 'style:font-name="Courier New"'}
DOCX_MARKS = {"b": "<w:b/>", "i": "<w:i/>", "u": '<w:u w:val="single"/>', "s": "<w:strike/>", "sub": '<w:vertAlign w:val="subscript"/>', "sup": '<w:vertAlign w:val="superscript"/>', "code": '<w:rFonts w:ascii="Courier New"/>'}


#: How the markup of a block begins.
_BLOCKS = ("<text:p", "<text:h", "<text:list ", "<table:table>")


def _archive(files: list[tuple[str, str]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, text in files:
            info = zipfile.ZipInfo(name, _TIME)
            info.compress_type = zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED
            archive.writestr(info, text)
    return out.getvalue()


def list_depth(kids: Kids) -> int:
    """How deep lists nest."""
    return max([0, *folded(kids, lambda _: 0, lambda e, inner: max([0, *inner]) + (e.tag in ("ul", "ol")))])


def _odt_text(text: str) -> str:
    return escape(text).replace(" ", "<text:s/>").replace("\t", "<text:tab/>")


def odt_fragment(kids: Kids) -> str:
    """Inline marks, links and blocks as ODT markup."""

    def one(e: Element, inner: list[str]) -> str:
        body = "".join(inner)
        if e.tag in ODT_STYLES:
            return f'<text:span text:style-name="{e.tag}">{body}</text:span>'
        if e.tag == "a" and "href" in e.attrs:
            return f'<text:a xlink:href={quoteattr(e.attrs["href"])}>{body}</text:a>'
        if e.tag == "br":
            return "<text:line-break/>"
        if e.tag in ("ul", "ol"):
            return f'<text:list text:style-name="{e.tag}">{body}</text:list>'
        if e.tag == "li":
            runs = [(own, "".join(run)) for own, run in groupby(inner, lambda part: part.startswith(_BLOCKS))]
            return "<text:list-item>" + "".join(run if own else f"<text:p>{run}</text:p>" for own, run in runs) + "</text:list-item>"
        if e.tag in ("td", "th"):
            runs = [(own, "".join(run)) for own, run in groupby(inner, lambda part: part.startswith(_BLOCKS))]
            return "<table:table-cell>" + "".join(run if own else f"<text:p>{run}</text:p>" for own, run in runs) + "</table:table-cell>"
        if e.tag == "tr":
            return f"<table:table-row>{body}</table:table-row>"
        if e.tag == "table":
            return f"<table:table>{body}</table:table>"
        if e.tag in ("p", "title", "subtitle"):
            return f'<text:p text:style-name="{e.tag}">{body}</text:p>'
        if e.tag[:1] == "h" and e.tag[1:].isdigit():
            return f'<text:h text:outline-level="{e.tag[1:]}">{body}</text:h>'
        return body

    return "".join(folded(kids, _odt_text, one))


def odt(kids: Kids) -> bytes:
    spaces = "".join(f' xmlns:{p}="{_ADDRESS[p]}"' for p in ("office", "style", "text", "table", "draw", "fo", "xlink"))
    styles = "".join(f'<style:style style:name="{n}" style:family="text"><style:text-properties {p}/></style:style>' for n, p in ODT_STYLES.items())
    styles += "".join(f'<style:style style:name="{n}" style:display-name="{n.title()}" style:family="paragraph"/>' for n in ("title", "subtitle"))
    levels = "".join(f'<text:list-level-style-number text:level="{n}"/>' for n in range(1, max(10, list_depth(kids)) + 1))
    styles += f'<text:list-style style:name="ol">{levels}</text:list-style><text:list-style style:name="ul">{levels.replace("number", "bullet")}</text:list-style>'
    content = f'<?xml version="1.0" encoding="UTF-8"?><office:document-content{spaces}><office:automatic-styles>{styles}</office:automatic-styles><office:body><office:text>{odt_fragment(kids)}</office:text></office:body></office:document-content>'
    manifest = f'<?xml version="1.0" encoding="UTF-8"?><manifest:manifest xmlns:manifest="urn:oasis:names:tc:opendocument:xmlns:manifest:1.0"><manifest:file-entry manifest:full-path="/" manifest:media-type="{_ODT_MIME}"/><manifest:file-entry manifest:full-path="content.xml" manifest:media-type="text/xml"/></manifest:manifest>'
    return _archive([("mimetype", _ODT_MIME), ("META-INF/manifest.xml", manifest), ("content.xml", content)])


def docx_runs(kids: Kids) -> str:
    """Inline children as runs, however deep they nest; links are written as their texts."""
    out = []
    waiting: list[tuple[Element | str, frozenset[str]]] = [(n, frozenset()) for n in reversed(kids)]
    while waiting:
        n, marks = waiting.pop()
        if isinstance(n, str):
            properties = "".join(DOCX_MARKS[m] for m in DOCX_MARKS if m in marks)
            out.append(f'<w:r>{f"<w:rPr>{properties}</w:rPr>" if properties else ""}<w:t xml:space="preserve">{escape(n)}</w:t></w:r>')
        elif n.tag == "br":
            out.append("<w:r><w:br/></w:r>")
        else:
            waiting.extend((x, marks | {n.tag}) for x in reversed(n.kids))
    return "".join(out)


def docx(kids: Kids) -> bytes:
    paragraphs: list[str] = []

    def item(kids: Kids, level: int, kind: str) -> None:
        inline = [n for n in kids if not (isinstance(n, Element) and n.tag in ("ul", "ol"))]
        number = f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{1 if kind == "ul" else 2}"/></w:numPr>'
        paragraphs.append(f"<w:p><w:pPr>{number}</w:pPr>{docx_runs(inline)}</w:p>")
        for n in kids:
            if isinstance(n, Element) and n.tag in ("ul", "ol"):
                for x in n.kids:
                    item(x.kids if isinstance(x, Element) else [x], level + 1, n.tag)

    def table(e: Element) -> None:
        """Rows of cells; what a cell holds is written as paragraphs."""
        rows = [r for part in e.kids if isinstance(part, Element) for r in ([part] if part.tag == "tr" else part.kids) if isinstance(r, Element) and r.tag == "tr"]
        paragraphs.append("<w:tbl>")
        for row in rows:
            paragraphs.append("<w:tr>")
            for cell in (c for c in row.kids if isinstance(c, Element)):
                paragraphs.append("<w:tc>")
                for inline, run in groupby(cell.kids, lambda n: isinstance(n, str) or n.tag in ODT_STYLES or n.tag in ("a", "span", "br")):
                    for n in [Element("p", {}, list(run))] if inline else run:
                        block(n)
                paragraphs.append("<w:p/></w:tc>" if not cell.kids else "</w:tc>")
            paragraphs.append("</w:tr>")
        paragraphs.append("</w:tbl>")

    def block(n: Element | str) -> None:
        if isinstance(n, Element) and n.tag in ("ul", "ol"):
            for x in n.kids:
                item(x.kids if isinstance(x, Element) else [x], 0, n.tag)
        elif isinstance(n, Element) and n.tag == "section":
            for x in n.kids:
                block(x)
        elif isinstance(n, Element) and n.tag == "table":
            table(n)
        elif isinstance(n, Element) or n.strip():
            tag = n.tag if isinstance(n, Element) else "p"
            style = {"title": "Title", "subtitle": "Subtitle"}.get(tag, f"Heading{tag[1:]}" if tag[:1] == "h" and tag[1:].isdigit() else "")
            style = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
            paragraphs.append(f"<w:p>{style}{docx_runs(n.kids if isinstance(n, Element) else [n])}</w:p>")

    for n in kids:
        block(n)
    w = f'xmlns:w="{_ADDRESS["w"]}"'
    types = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
    relations = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
    kinds = "".join(f'<w:abstractNum w:abstractNumId="{k}">' + "".join(f'<w:lvl w:ilvl="{n}"><w:numFmt w:val="{f}"/></w:lvl>' for n in range(max(9, list_depth(kids)))) + "</w:abstractNum>" for k, f in ((1, "bullet"), (2, "decimal")))
    numbering = f'<w:numbering {w}>{kinds}<w:num w:numId="1"><w:abstractNumId w:val="1"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="2"/></w:num></w:numbering>'
    styles = f'<w:styles {w}>' + "".join(f'<w:style w:styleId="{i}"><w:name w:val="{n}"/></w:style>' for i, n in [("Title", "Title"), ("Subtitle", "Subtitle"), *((f"Heading{k}", f"heading {k}") for k in range(1, 7))]) + "</w:styles>"
    return _archive([("[Content_Types].xml", types), ("_rels/.rels", relations), ("word/document.xml", f"<w:document {w}><w:body>{''.join(paragraphs)}</w:body></w:document>"), ("word/numbering.xml", numbering), ("word/styles.xml", styles)])


def free_relation(names: list[str]) -> str:
    """The first unused rIdN."""
    used = set(names)
    n = 1
    while f"rId{n}" in used:
        n += 1
    return f"rId{n}"


def title_of(kids: Kids) -> str:
    return next((texts(n.kids) for n in kids if isinstance(n, Element) and n.tag == "title"), "")
