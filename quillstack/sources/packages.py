"""Word-processor packages to trees: ODT and DOCX, read by zip and XML alone.

Both become paragraphs, headings, nested lists, tables, links, notes, figures and inline marks. A DOCX mark that is
switched off (val 0 or false) does not count; equations and drawings without a picture are left out.
"""

from __future__ import annotations

import io
import re
import zipfile

from quillstack.functions.markup import CODE_FONTS
from quillstack.model import Element, Kids

from .xml import everywhere, named, tree

#: Namespaces and the prefixes used for them here. Fixed values.
SPACES = {
    "urn:oasis:names:tc:opendocument:xmlns:office:1.0": "office",
    "urn:oasis:names:tc:opendocument:xmlns:style:1.0": "style",
    "urn:oasis:names:tc:opendocument:xmlns:text:1.0": "text",
    "urn:oasis:names:tc:opendocument:xmlns:table:1.0": "table",
    "urn:oasis:names:tc:opendocument:xmlns:drawing:1.0": "draw",
    "urn:oasis:names:tc:opendocument:xmlns:xsl-fo-compatible:1.0": "fo",
    "urn:oasis:names:tc:opendocument:xmlns:svg-compatible:1.0": "svg",
    "http://www.w3.org/1999/xlink": "xlink",
    "http://schemas.openxmlformats.org/wordprocessingml/2006/main": "w",
    "http://schemas.openxmlformats.org/officeDocument/2006/relationships": "r",
    "http://schemas.openxmlformats.org/drawingml/2006/main": "a",
    "http://schemas.openxmlformats.org/package/2006/relationships": "rel",
}
HEADING = re.compile(r"^heading[ _]?(\d)$", re.IGNORECASE)


def _is_code(font: str | None) -> bool:
    return bool(font) and (font.lower().endswith(" mono") or font in CODE_FONTS)


def _wrapped(kids: Kids, tags: list[str]) -> Kids:
    for tag in tags if kids else []:
        kids = [Element(tag, {}, kids)]
    return kids


def nested_lists(items: list[tuple[int, str, Kids]]) -> Kids:
    """Items of (level from 0, ul or ol, contents) as lists inside the items before them."""
    top: Kids = []
    stack: list[Element] = []
    for level, kind, kids in items:
        del stack[level + 1 :]
        if len(stack) == level + 1 and stack[-1].tag != kind:
            stack.pop()
        while len(stack) <= level:
            made = Element(kind)
            if stack:
                if not stack[-1].kids:
                    stack[-1].kids.append(Element("li"))
                stack[-1].kids[-1].kids.append(made)
            else:
                top.append(made)
            stack.append(made)
        stack[-1].kids.append(Element("li", {}, kids))
    return top


class _Odt:
    def __init__(self, archive: zipfile.ZipFile):
        read = lambda name: tree(archive.read(name), SPACES) if name in archive.namelist() else Element("none")
        content, styles = read("content.xml"), read("styles.xml")
        self.styles: dict[str, dict[str, str]] = {}
        self.lists: dict[str, list[str]] = {}
        # The content's styles come last and override those of the style file.
        for part in (styles, content):
            for s in everywhere(part, "style:style"):
                own = {k: v for p in named(s, "style:text-properties", "style:paragraph-properties") for k, v in p.attrs.items()}
                own |= {"parent": s.attrs.get("style:parent-style-name", ""), "name": s.attrs.get("style:display-name", s.attrs.get("style:name", ""))}
                self.styles[s.attrs.get("style:name", "")] = own
            for s in everywhere(part, "text:list-style"):
                self.lists[s.attrs.get("style:name", "")] = ["ol" if n.tag.endswith("number") else "ul" for n in named(s, "text:list-level-style-number", "text:list-level-style-bullet")]
        self.body = next(iter(everywhere(content, "office:text")), Element("none"))

    def style(self, name: str | None, key: str) -> str | None:
        """A property of the style or of the nearest ancestor that has it; a ring of parents ends."""
        seen: set[str] = set()
        while name and name not in seen:
            seen.add(name)
            own = self.styles.get(name, {})
            if key in own:
                return own[key]
            name = own.get("parent")
        return None

    def marks(self, name: str | None) -> list[str]:
        get = lambda key: self.style(name, key) or ""
        position = get("style:text-position").split(" ")[0]
        tests = [
            ("code", _is_code(get("style:font-name")) or _is_code(get("fo:font-family").strip("'\""))),
            ("sub", position == "sub" or position.startswith("-")),
            ("sup", position == "super" or (position[:1].isdigit() and position.strip("0%") != "")),
            ("s", get("style:text-line-through-style") not in ("", "none")),
            ("i", get("fo:font-style") == "italic"),
            ("b", get("fo:font-weight") == "bold"),
            ("u", get("style:text-underline-style") not in ("", "none")),
        ]
        return [tag for tag, holds in tests if holds]

    def paragraph_tag(self, name: str | None) -> str:
        seen: set[str] = set()
        while name and name not in seen:
            seen.add(name)
            shown = self.styles.get(name, {}).get("name", name).lower().replace("_20_", " ")
            if shown in ("title", "subtitle"):
                return shown
            if m := HEADING.match(shown):
                return f"h{min(6, int(m.group(1)))}"
            name = self.styles.get(name, {}).get("parent")
        return "p"

    def inline(self, e: Element) -> Kids:
        out: Kids = []
        for n in e.kids:
            if isinstance(n, str):
                out.append(n)
            elif n.tag == "text:span":
                out.extend(_wrapped(self.inline(n), self.marks(n.attrs.get("text:style-name"))))
            elif n.tag == "text:a":
                out.append(Element("a", {"href": n.attrs.get("xlink:href", "")}, self.inline(n)))
            elif n.tag == "text:s":
                out.append(" " * int(n.attrs.get("text:c", "1") or 1))
            elif n.tag == "text:tab":
                out.append("\t")
            elif n.tag == "text:line-break":
                out.append(Element("br"))
            elif n.tag in ("text:bookmark", "text:bookmark-start"):
                out.append(Element("a", {"name": n.attrs.get("text:name", "")}))
            elif n.tag == "text:note":
                out.append(Element("footnote", {}, [x for body in named(n, "text:note-body") for x in self.blocks(body)]))
            elif n.tag == "draw:frame":
                out.extend(Element("img", {"src": i.attrs.get("xlink:href", "")}) for i in everywhere(n, "draw:image"))
            elif n.tag != "office:annotation":
                out.extend(self.inline(n))
        return out

    def items(self, e: Element, level: int, style: str | None) -> list[tuple[int, str, Kids]]:
        kinds = self.lists.get(style or "", [])
        kind = kinds[level] if level < len(kinds) else "ul"
        out: list[tuple[int, str, Kids]] = []
        for item in named(e, "text:list-item", "text:list-header"):
            plain = [n for n in item.kids if isinstance(n, Element) and n.tag != "text:list"]
            if plain:
                kids = self.blocks(Element("li", {}, plain))
                lone = len(kids) == 1 and isinstance(kids[0], Element) and kids[0].tag == "p"
                out.append((level, kind, kids[0].kids if lone else kids))
            for inner in named(item, "text:list"):
                out.extend(self.items(inner, level + 1, inner.attrs.get("text:style-name", style)))
        return out

    def blocks(self, e: Element) -> Kids:
        out: Kids = []
        for n in e.kids:
            if isinstance(n, str):
                continue
            if n.tag in ("text:p", "text:h"):
                tag = self.paragraph_tag(n.attrs.get("text:style-name"))
                if n.tag == "text:h" and tag == "p":
                    tag = f"h{max(1, min(6, int(n.attrs.get('text:outline-level', '1') or 1)))}"
                if self.style(n.attrs.get("text:style-name"), "fo:break-before") == "page":
                    out.append(Element("pagebreak"))
                out.append(Element(tag, {}, self.inline(n)))
            elif n.tag == "text:list":
                out.extend(nested_lists(self.items(n, 0, n.attrs.get("text:style-name"))))
            elif n.tag == "table:table":
                rows = [Element("tr", {}, [Element("td", {}, self.blocks(c)) for c in named(r, "table:table-cell")]) for r in everywhere(n, "table:table-row")]
                out.append(Element("table", {}, rows))
            elif n.tag in ("text:section", "text:table-of-content", "text:index-body"):
                out.extend(self.blocks(n))
        return out


def _on(properties: Element | None, *names: str) -> bool:
    found = named(properties, *names) if properties is not None else []
    return any(n.attrs.get("w:val", "1") not in ("0", "false", "none", "off") for n in found)


def _value(e: Element | None, *path: str) -> str | None:
    for tag in path:
        e = next(iter(named(e, tag)), None) if e is not None else None
    return e.attrs.get("w:val") if e is not None else None


class _Docx:
    def __init__(self, archive: zipfile.ZipFile):
        names = set(archive.namelist())
        read = lambda name: tree(archive.read(name), SPACES) if name in names else Element("none")
        self.document = read("word/document.xml")
        self.relations = {}
        self.notes: dict[tuple[str, str], Element] = {}
        for part in ("document", "footnotes", "endnotes"):
            self.relations[part] = {r.attrs.get("Id", ""): r.attrs.get("Target", "") for r in everywhere(read(f"word/_rels/{part}.xml.rels"), "rel:Relationship")}
        for part, tag in (("footnotes", "w:footnote"), ("endnotes", "w:endnote")):
            for note in everywhere(read(f"word/{part}.xml"), tag):
                self.notes[part, note.attrs.get("w:id", "")] = note
        numbering = read("word/numbering.xml")
        formats = {(a.attrs.get("w:abstractNumId"), lvl.attrs.get("w:ilvl")): _value(lvl, "w:numFmt") for a in everywhere(numbering, "w:abstractNum") for lvl in named(a, "w:lvl")}
        self.formats = {(num.attrs.get("w:numId"), level): kind for num in everywhere(numbering, "w:num") for (abstract, level), kind in formats.items() if abstract == _value(num, "w:abstractNumId")}
        self.style_names = {s.attrs.get("w:styleId"): _value(s, "w:name") or "" for s in everywhere(read("word/styles.xml"), "w:style")}

    def run(self, e: Element, part: str) -> Kids:
        out: Kids = []
        for n in (x for x in e.kids if isinstance(x, Element)):
            if n.tag == "w:t":
                out.extend(x for x in n.kids if isinstance(x, str))
            elif n.tag == "w:tab":
                out.append("\t")
            elif n.tag == "w:br":
                out.append(Element("pagebreak" if n.attrs.get("w:type") == "page" else "br"))
            elif n.tag in ("w:softHyphen", "w:noBreakHyphen"):
                out.append("­" if n.tag == "w:softHyphen" else "‑")
            elif n.tag in ("w:footnoteReference", "w:endnoteReference"):
                where = "footnotes" if n.tag.startswith("w:foot") else "endnotes"
                note = self.notes.get((where, n.attrs.get("w:id", "")))
                out.append(Element("footnote", {}, self.blocks(note, where) if note is not None else []))
            elif n.tag == "w:drawing":
                targets = [self.relations[part].get(b.attrs.get("r:embed", ""), "") for b in everywhere(n, "a:blip")]
                out.extend(Element("img", {"src": t}) for t in targets if t)
        p = next(iter(named(e, "w:rPr")), None)
        up = _value(p, "w:vertAlign")
        font = next((f.attrs.get("w:ascii") for f in named(p, "w:rFonts")), None) if p is not None else None
        tests = [("code", _is_code(font)), ("sub", up == "subscript"), ("sup", up == "superscript"), ("s", _on(p, "w:strike")), ("i", _on(p, "w:i", "w:iCs")), ("b", _on(p, "w:b", "w:bCs")), ("u", _on(p, "w:u"))]
        return _wrapped(out, [tag for tag, holds in tests if holds])

    def inline(self, e: Element, part: str) -> Kids:
        out: Kids = []
        for n in (x for x in e.kids if isinstance(x, Element)):
            if n.tag == "w:r":
                out.extend(self.run(n, part))
            elif n.tag == "w:hyperlink":
                href = self.relations[part].get(n.attrs.get("r:id", "")) or "#" + n.attrs.get("w:anchor", "")
                out.append(Element("a", {"href": href}, self.inline(n, part)))
            elif n.tag == "w:bookmarkStart":
                out.append(Element("a", {"name": n.attrs.get("w:name", "")}))
            elif n.tag in ("w:ins", "w:smartTag", "w:sdt", "w:sdtContent"):
                out.extend(self.inline(n, part))
        return out

    def table(self, e: Element, part: str) -> Element:
        look = next((x for p in named(e, "w:tblPr") for x in named(p, "w:tblLook")), Element("none"))
        first_row, first_column = (look.attrs.get(k) == "1" for k in ("w:firstRow", "w:firstColumn"))
        widths = [float(c.attrs.get("w:w", "0") or 0) for g in named(e, "w:tblGrid") for c in named(g, "w:gridCol")]
        whole = sum(widths)
        columns = [Element("col", {"style": f"width:{100 * w / whole:.2f}%;"}) for w in widths] if whole else []
        rows = []
        for y, r in enumerate(named(e, "w:tr")):
            cells = [Element("th" if (first_row and y == 0) or (first_column and x == 0) else "td", {}, self.blocks(c, part)) for x, c in enumerate(named(r, "w:tc"))]
            rows.append(Element("tr", {}, cells))
        return Element("table", {}, [*([Element("colgroup", {}, columns)] if columns else []), *rows])

    def blocks(self, e: Element, part: str = "document") -> Kids:
        out: Kids = []
        items: list[tuple[int, str, Kids]] = []

        def flush() -> None:
            out.extend(nested_lists(items))
            items.clear()

        for n in (x for x in e.kids if isinstance(x, Element)):
            if n.tag == "w:p":
                p = next(iter(named(n, "w:pPr")), None)
                kids = self.inline(n, part)
                number = _value(p, "w:numPr", "w:numId")
                if number is not None and number != "0":
                    level = _value(p, "w:numPr", "w:ilvl") or "0"
                    items.append((int(level), "ul" if self.formats.get((number, level), "bullet") in ("bullet", "none", None) else "ol", kids))
                    continue
                flush()
                style = _value(p, "w:pStyle") or ""
                shown = (self.style_names.get(style) or style).lower()
                m = HEADING.match(shown)
                tag = shown if shown in ("title", "subtitle") else f"h{min(6, int(m.group(1)))}" if m else "p"
                side = _value(p, "w:jc")
                out.append(Element(tag, {"class": side} if side in ("center", "right") else {}, kids))
            elif n.tag == "w:tbl":
                flush()
                out.append(self.table(n, part))
            elif n.tag in ("w:sdt", "w:sdtContent"):
                flush()
                out.extend(self.blocks(n, part))
        flush()
        return out


def odt(data: bytes) -> Kids:
    document = _Odt(zipfile.ZipFile(io.BytesIO(data)))
    return document.blocks(document.body)


def docx(data: bytes) -> Kids:
    document = _Docx(zipfile.ZipFile(io.BytesIO(data)))
    return [x for body in named(document.document, "w:body") for x in document.blocks(body)]
