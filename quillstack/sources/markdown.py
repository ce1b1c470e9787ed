"""Markdown: front matter between --- lines, then headings, lists, quotes, code, rules, paragraphs and inline marks."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstack.model import Element, Kids

_FRONT = r"^---[ \t]*\r?\n([\s\S]*?)\r?\n---[ \t]*(?:\r?\n|$)([\s\S]*)$"


def front_matter(c: Column) -> Column:
    """(meta, body): meta is null where the text does not begin with a front matter."""
    has = c.rlike(_FRONT)
    return F.struct(F.when(has, F.regexp_extract(c, _FRONT, 1)).alias("meta"), F.when(has, F.regexp_extract(c, _FRONT, 2)).otherwise(c).alias("body"))


_INLINE = re.compile(r"\\([\\`*_{}\[\]()#+.!-])|`([^`]+)`|!\[([^\]]*)\]\(([^)\s]*)\)|\[([^\]]*)\]\(([^)\s]*)\)|\*\*(.+?)\*\*|__(.+?)__|\*(.+?)\*|\b_(.+?)_\b|<(https?://[^>\s]+)>", re.DOTALL)


def inline(text: str) -> Kids:
    out: Kids = []
    at = 0
    for m in _INLINE.finditer(text):
        out.append(text[at : m.start()])
        at = m.end()
        escaped, code, alt, src, label, href, strong, strong2, soft, soft2, url = m.groups()
        if escaped is not None:
            out.append(escaped)
        elif code is not None:
            out.append(Element("code", {}, [code]))
        elif src is not None:
            out.append(Element("img", {"src": src, "alt": alt}))
        elif href is not None:
            out.append(Element("a", {"href": href}, inline(label)))
        elif strong or strong2:
            out.append(Element("b", {}, inline(strong or strong2)))
        elif soft or soft2:
            out.append(Element("i", {}, inline(soft or soft2)))
        else:
            out.append(Element("a", {"href": url}, [url]))
    return [n for n in [*out, text[at:]] if n != ""]


_ITEM = re.compile(r"^( {0,3})([*+-]|\d+[.)])[ \t]+(.*)$")


def parse(text: str, in_item: bool = False) -> Kids:
    """Blocks of a text. Inside an item, a list may begin right behind a paragraph's line."""
    lines = text.replace("\r\n", "\n").expandtabs(4).split("\n")
    out: Kids = []
    at = 0
    while at < len(lines):
        line = lines[at]
        if not line.strip():
            at += 1
        elif m := re.match(r"^(#{1,6})[ ]+(.*?)[ #]*$", line):
            out.append(Element(f"h{len(m.group(1))}", {}, inline(m.group(2))))
            at += 1
        elif m := re.match(r"^(```+|~~~+)", line):
            stop = next((k for k in range(at + 1, len(lines)) if lines[k].startswith(m.group(1))), len(lines))
            out.append(Element("pre", {}, ["\n".join(lines[at + 1 : stop])]))
            at = stop + 1
        elif line.startswith("    "):
            stop = next((k for k in range(at, len(lines)) if lines[k].strip() and not lines[k].startswith("    ")), len(lines))
            out.append(Element("pre", {}, ["\n".join(x[4:] for x in lines[at:stop]).rstrip("\n")]))
            at = stop
        elif re.match(r"^ {0,3}([*_-])( *\1){2,} *$", line):
            out.append(Element("hr"))
            at += 1
        elif line.startswith(">"):
            stop = next((k for k in range(at, len(lines)) if not lines[k].strip()), len(lines))
            out.append(Element("blockquote", {}, parse("\n".join(re.sub("^> ?", "", x) for x in lines[at:stop]))))
            at = stop
        elif m := _ITEM.match(line):
            ordered = m.group(2)[0].isdigit()
            items: list[list[str]] = []
            while at < len(lines):
                m = _ITEM.match(lines[at])
                if m and m.group(2)[0].isdigit() == ordered:
                    items.append([m.group(3)])
                elif lines[at].startswith("  ") and lines[at].strip():
                    items[-1].append(re.sub("^ {1,4}", "", lines[at]))
                elif not lines[at].strip() and at + 1 < len(lines) and (lines[at + 1].startswith("  ") or _ITEM.match(lines[at + 1])):
                    items[-1].append("")
                else:
                    break
                at += 1
            made = []
            for item in items:
                inner = parse("\n".join(item), in_item=True)
                if inner and isinstance(inner[0], Element) and inner[0].tag == "p":
                    inner = [*inner[0].kids, *inner[1:]]
                made.append(Element("li", {}, inner))
            out.append(Element("ol" if ordered else "ul", {}, made))
        else:
            stop = next((k for k in range(at + 1, len(lines)) if not lines[k].strip() or re.match(r"^(#{1,6} |>|```|~~~)", lines[k]) or re.match(r"^(=+|-+) *$", lines[k]) or (in_item and _ITEM.match(lines[k]))), len(lines))
            body = "\n".join(x.strip() for x in lines[at:stop])
            under = re.match(r"^(=+|-+) *$", lines[stop]) if stop < len(lines) else None
            out.append(Element(("h1" if under.group(1)[0] == "=" else "h2") if under else "p", {}, inline(body)))
            at = stop + 1 if under else stop
    return out
