"""Rewrites of one document's tree, each a function from children to children. They never look at another document,
so a chain of them runs in one pass over the rows without a shuffle (see plans.conversion)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from itertools import groupby

from quillstack.model import Element, Kids, folded, texts

#: Elements that are content without text; inline elements; elements that neighbours merge into. Fixed values.
NEVER_BLANK = {"figure", "img", "hr", "br", "footnote", "pagebreak"}
INLINE = {"a", "b", "cite", "code", "i", "s", "small", "span", "sub", "sup", "u", "wbr"}
MERGED = {"b", "blockquote", "code", "i", "s", "small", "span", "sub", "sup", "u"}
HEADINGS = {f"h{n}": n for n in range(1, 7)}
ALLOWED = INLINE | set(HEADINGS) | {"blockquote", "br", "caption", "col", "colgroup", "dd", "div", "dl", "dt", "figcaption", "figure", "footnote", "hr", "img", "li", "ol", "p", "pagebreak", "pre", "section", "subtitle", "table", "tbody", "td", "tex2jax_process", "tfoot", "th", "thead", "title", "tr", "ul"}
#: Classes that are tags of their own on some elements. Fixed values.
PROMOTED = {"title": {"h1"}, "subtitle": {"h2"}, "footnote": {"span", "div", "aside"}, "pagebreak": {"span", "div"}, "tex2jax_process": {"span"}}
PROTOCOLS = {"http", "https", "ftp", "sftp", "urn", "data", "mailto"}

_SPACE = re.compile("[\n\r\t ]+")


def is_blank(node: Element | str) -> bool:
    """Without visible content: white space, or an element that may be empty around blank children."""
    return folded([node], lambda t: not t.strip(), lambda e, kids: e.tag not in NEVER_BLANK and all(kids))[0]


def _rebuilt(kids: Kids, of_element: Callable[[Element, Kids], Kids]) -> Kids:
    """Children where each element is what of_element makes of it and its rebuilt children."""
    made = folded(kids, lambda t: [t], lambda e, parts: of_element(e, [x for part in parts for x in part]))
    return [x for part in made for x in part]


def splice(kids: Kids, matches: Callable[[Element], bool]) -> Kids:
    """Matching elements go, their children stay in place."""
    return _rebuilt(kids, lambda e, inner: inner if matches(e) else [Element(e.tag, e.attrs, inner)])


def kill(kids: Kids, matches: Callable[[Element], bool]) -> Kids:
    """Matching elements go with all below them."""
    return _rebuilt(kids, lambda e, inner: [] if matches(e) else [Element(e.tag, e.attrs, inner)])


def plain_text(kids: Kids) -> str:
    return unicodedata.normalize("NFC", texts(kill(kids, lambda e: e.tag == "footnote")))


def only_body(kids: Kids) -> Kids:
    """The body's children where there is a body, without head, script and style."""
    kids = kill(kids, lambda e: e.tag in ("head", "script", "style", "nav", "template"))
    return splice(kids, lambda e: e.tag in ("html", "body"))


def promote_classes(kids: Kids) -> Kids:
    def one(e: Element, inner: Kids) -> Kids:
        names = e.attrs.get("class", "").split()
        tag = next((c for c in names if e.tag in PROMOTED.get(c, ())), e.tag)
        left = [c for c in names if c != tag]
        attrs = {k: v for k, v in e.attrs.items() if k != "class"}
        return [Element(tag, {**attrs, "class": " ".join(left)} if left else attrs, inner)]

    return _rebuilt(kids, one)


def _safe(url: str) -> bool:
    scheme = re.match(r"\s*([A-Za-z][A-Za-z0-9+.-]*):", url)
    return scheme is None or scheme.group(1).lower() in PROTOCOLS


def _style(tag: str, style: str) -> str:
    pairs = dict((p.split(":", 1)[0].strip().lower(), p.split(":", 1)[1].strip()) for p in style.split(";") if ":" in p)
    if tag == "figure":
        pairs.setdefault("display", "block")
        names = ["display", "width"]
    else:
        names = ["width"] if tag in ("img", "col") else ["color", "background-color"]
    return "".join(f"{n}:{pairs[n]};" for n in names if n in pairs)


def clean_attributes(kids: Kids) -> Kids:
    """Of attributes style, class, id, data-*, names and addresses of links, sources of images, starts of lists stay."""

    def one(e: Element, inner: Kids) -> Kids:
        attrs = {}
        for k, v in e.attrs.items():
            if k == "width" and e.tag == "col":
                k, v = "style", f"width:{v}"
            own = {"a": ("name", "href"), "img": ("src",), "ol": ("start",), "ul": ("start",)}.get(e.tag, ())
            if k in ("class", "id") or k.startswith("data-") or (k in own and (k not in ("href", "src") or _safe(v))):
                attrs[k] = v
            elif k == "style" and (kept := _style(e.tag, v)):
                attrs[k] = kept
        return [Element(e.tag, attrs, inner)]

    return _rebuilt(kids, one)


def allowed_tags(kids: Kids) -> Kids:
    return splice(kids, lambda e: e.tag not in ALLOWED)


def figures(kids: Kids) -> Kids:
    """A lone img becomes an inline figure that has its width; a figure's caption comes first."""

    def one(e: Element, inner: Kids) -> Kids:
        if e.tag == "img":
            width = re.search(r"width:[^;]*;?", e.attrs.get("style", ""))
            attrs = {k: v for k, v in e.attrs.items() if k != "style"}
            return [Element("figure", {"style": "display:inline;" + (width.group(0).rstrip(";") + ";" if width else "")}, [Element("img", attrs)])]
        if e.tag == "figure":
            inner = [x for n in inner for x in (n.kids if isinstance(n, Element) and n.tag == "figure" else [n])]
            caption = [n for n in inner if isinstance(n, Element) and n.tag == "figcaption"]
            inner = caption + [n for n in inner if n not in caption]
        return [Element(e.tag, e.attrs, inner)]

    return _rebuilt(kids, one)


def anchors(kids: Kids) -> Kids:
    """An id becomes a named anchor at the element's beginning, but for dl, ol, ul and elements without content."""

    def one(e: Element, inner: Kids) -> Kids:
        if "id" not in e.attrs or e.tag in ("dl", "ol", "ul", "img", "br", "hr", "col", "a", "table", "tr", "tbody", "thead"):
            return [Element(e.tag, e.attrs, inner)]
        attrs = {k: v for k, v in e.attrs.items() if k != "id"}
        return [Element(e.tag, attrs, [Element("a", {"name": e.attrs["id"]}), *inner])]

    return _rebuilt(kids, one)


def tidy(kids: Kids) -> Kids:
    """Neighbours of one kind merge: texts (in NFC), inline elements and quotes of equal attributes. What merging brings
    side by side merges too. Inline elements without children, and bare spans, dissolve. Works from the top down with
    a stack of its own, as merged children are merged in turn."""
    top = Element("", {}, kids)
    todo = [top]
    while todo:
        parent = todo.pop()
        flat: Kids = []
        waiting = list(reversed(parent.kids))
        while waiting:
            node = waiting.pop()
            if isinstance(node, Element) and node.tag == "span" and not node.attrs:
                waiting.extend(reversed(node.kids))
            else:
                flat.append(node)
        merged: Kids = []
        for key, run in groupby(flat, lambda n: "" if isinstance(n, str) else (n.tag, tuple(sorted(n.attrs.items())))):
            group = list(run)
            if key == "":
                joined = unicodedata.normalize("NFC", "".join(group))
                merged.extend([joined] if joined else [])
            elif key[0] in MERGED:
                inner = [x for n in group for x in n.kids]
                if inner or key[0] not in INLINE:
                    merged.append(Element(key[0], dict(group[0].attrs), inner))
            else:
                merged.extend(Element(n.tag, n.attrs, n.kids) for n in group)
        parent.kids = merged
        todo.extend(n for n in merged if isinstance(n, Element))
    return top.kids


def normal_space(kids: Kids) -> Kids:
    """Outside pre, white space folds to one space; at the edges of blocks it goes."""

    def folded_run(inner: Kids) -> Kids:
        out: Kids = []
        for n, node in enumerate(inner):
            if isinstance(node, str):
                node = _SPACE.sub(" ", node)
                before, after = inner[n - 1] if n else None, inner[n + 1] if n + 1 < len(inner) else None
                if before is None or (isinstance(before, Element) and before.tag not in INLINE and before.tag != "footnote"):
                    node = node.lstrip(" ")
                if after is None or (isinstance(after, Element) and after.tag not in INLINE and after.tag != "footnote"):
                    node = node.rstrip(" ")
                if not node:
                    continue
            out.append(node)
        return out

    def one(e: Element, inner: Kids) -> Kids:
        if e.tag == "pre":
            return [Element("pre", e.attrs, [texts(e.kids)])]
        if e.tag in INLINE:
            return [Element(e.tag, e.attrs, [_SPACE.sub(" ", n) if isinstance(n, str) else n for n in inner])]
        return [Element(e.tag, e.attrs, folded_run(inner))]

    return folded_run(_rebuilt(kids, one))


def unwrap(kids: Kids) -> Kids:
    """A lone paragraph in an item, definition or note is unwrapped; a paragraph around one break or quote too; an empty heading is its contents."""

    def one(e: Element, inner: Kids) -> Kids:
        lone = inner[0] if len(inner) == 1 and isinstance(inner[0], Element) else None
        if e.tag in ("li", "dt", "dd", "footnote") and lone is not None and lone.tag == "p":
            return [Element(e.tag, {**lone.attrs, **e.attrs}, lone.kids)]
        if e.tag == "p" and lone is not None and lone.tag in ("pagebreak", "blockquote"):
            return [lone]
        if e.tag in HEADINGS:
            inner = splice(inner, lambda x: x.tag in ("b", "i", "u", "span", "br"))
            if not plain_text(inner).strip():
                return inner
        return [Element(e.tag, e.attrs, inner)]

    return _rebuilt(kids, one)


def blocks(kids: Kids) -> Kids:
    """Runs of paragraphs that hold code only become one pre, their lines in order."""

    def joined(inner: Kids) -> Kids:
        def is_code(n: Element | str) -> bool:
            return isinstance(n, Element) and n.tag == "p" and len(n.kids) == 1 and isinstance(n.kids[0], Element) and n.kids[0].tag == "code"

        out: Kids = []
        for code, run in groupby(inner, is_code):
            group = list(run)
            out.extend([Element("pre", {}, ["\n".join(texts(n.kids) for n in group)])] if code else group)
        return out

    return joined(_rebuilt(kids, lambda e, inner: [Element(e.tag, e.attrs, joined(inner))]))


def split_paragraphs(kids: Kids) -> Kids:
    """A paragraph with a block figure becomes what is before, the figure, and what is after; attributes stay with the first."""

    def one(e: Element, inner: Kids) -> Kids:
        def is_figure(n: Element | str) -> bool:
            return isinstance(n, Element) and n.tag == "figure" and "display:inline" not in n.attrs.get("style", "")

        if e.tag != "p" or not any(map(is_figure, inner)):
            return [Element(e.tag, e.attrs, inner)]
        out: Kids = []
        attrs = e.attrs
        for figure, run in groupby(inner, is_figure):
            group = list(run)
            if figure:
                out.extend(group)
            elif not all(map(is_blank, group)):
                out.append(Element("p", attrs, group))
                attrs = {}
        return out

    return _rebuilt(kids, one)


def sectioned(kids: Kids, prefix: str = "s") -> Kids:
    """Sections nested by heading level. Content before the first heading is a section of class pre-section; ids come
    from the heading or are numbered."""
    top = Element("", {}, [])
    stack: list[tuple[int, Element]] = [(0, top)]
    n = 0
    for node in kids:
        level = HEADINGS.get(node.tag) if isinstance(node, Element) else None
        if level is not None:
            while stack[-1][0] >= level:
                stack.pop()
            n += 1
            name = node.attrs.get("id") or next((x.attrs["name"] for x in node.kids if isinstance(x, Element) and x.tag == "a" and "name" in x.attrs), f"{prefix}-{n}")
            made = Element("section", {"id": name}, [Element(node.tag, {k: v for k, v in node.attrs.items() if k != "id"}, node.kids)])
            stack[-1][1].kids.append(made)
            stack.append((level, made))
        elif len(stack) == 1:
            if not top.kids and is_blank(node):
                continue
            if not top.kids:
                top.kids.append(Element("section", {"class": "pre-section"}, []))
            top.kids[-1].kids.append(node)
        else:
            stack[-1][1].kids.append(node)
    return top.kids


def unsectioned(kids: Kids) -> Kids:
    return splice(kids, lambda e: e.tag == "section" and "endnotes" not in e.attrs.get("class", "").split())


def endnotes(kids: Kids) -> Kids:
    """Each top section's notes become numbered links and a section of class endnotes at its end."""
    out: Kids = []
    for top in kids:
        if not isinstance(top, Element) or top.tag != "section":
            out.append(top)
            continue
        section = top.attrs.get("id", "pre")
        notes: Kids = []

        def one(e: Element, inner: Kids) -> Kids:
            if e.tag != "footnote":
                return [Element(e.tag, e.attrs, inner)]
            name = e.attrs.get("id") or f"{section}-fn{len(notes) + 1}"
            notes.append(Element("li", {"id": name}, inner))
            return [Element("a", {"class": "noteref", "href": f"#{name}"}, [str(len(notes))])]

        inner = _rebuilt(top.kids, one)
        if notes:
            inner = [*inner, Element("section", {"class": "endnotes"}, [Element("ol", {}, notes)])]
        out.append(Element("section", top.attrs, inner))
    return out


def contents(kids: Kids) -> list[tuple[int, str, str]]:
    """(level, section id, heading text) of each section in order."""
    found: list[tuple[int, str, str]] = []
    waiting = list(reversed(kids))
    while waiting:
        node = waiting.pop()
        if isinstance(node, Element):
            first = node.kids[0] if node.tag == "section" and node.kids else None
            if isinstance(first, Element) and first.tag in HEADINGS:
                found.append((HEADINGS[first.tag], node.attrs.get("id", ""), plain_text(first.kids)))
            waiting.extend(reversed(node.kids))
    return found


#: The order in which a page becomes a document.
STEPS = [only_body, promote_classes, clean_attributes, allowed_tags, figures, tidy, normal_space, blocks, unwrap, split_paragraphs, sectioned, endnotes]


def rewritten(kids: Kids, steps: list[Callable[[Kids], Kids]] | None = None) -> Kids:
    for step in STEPS if steps is None else steps:
        kids = step(kids)
    return kids
