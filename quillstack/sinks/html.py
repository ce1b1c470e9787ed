"""HTML: trees as markup, attributes sorted by name, and a page around them."""

from __future__ import annotations

from html import escape

from quillstack.model import Element, Kids, folded
from quillstack.sources.html import VOID

#: Tags of the document model that HTML has not, with the tag and class that stand for them. Fixed values.
CLASSED = {"title": ("h1", "title"), "subtitle": ("h2", "subtitle"), "footnote": ("aside", "footnote"), "pagebreak": ("div", "pagebreak"), "tex2jax_process": ("span", "tex2jax_process")}


def _open(e: Element, tag: str, classes: str) -> str:
    attrs = dict(e.attrs)
    names = sorted({*attrs.pop("class", "").split(), *([classes] if classes else [])})
    if names:
        attrs["class"] = " ".join(names)
    return "<" + tag + "".join(f' {k}="{escape(v)}"' for k, v in sorted(attrs.items())) + ">"


def _element(e: Element, inner: list[str]) -> str:
    tag, classes = CLASSED.get(e.tag, (e.tag, ""))
    return _open(e, tag, classes) + ("" if tag in VOID else "".join(inner) + f"</{tag}>")


def markup(kids: Kids) -> str:
    return "".join(folded(kids, lambda t: escape(t, quote=False), _element))


def page(kids: Kids, title: str = "", lang: str = "en", fields: dict[str, str] | None = None) -> str:
    """A whole page: metadata as a definition list in front of the sections."""
    items = "".join(f"<dt>{escape(k)}</dt><dd>{escape(v)}</dd>" for k, v in (fields or {}).items())
    head = f'<dl id="document-properties">{items}</dl>' if items else ""
    return f'<!DOCTYPE html>\n<html lang="{escape(lang)}"><head><meta charset="utf-8"><title>{escape(title, quote=False)}</title></head><body>{head}{markup(kids)}</body></html>\n'
