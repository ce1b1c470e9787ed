"""LaTeX: trees as commands and environments."""

from __future__ import annotations

from quillstack.functions.text import LATEX
from quillstack.model import Element, Kids, folded

_QUOTE = str.maketrans(LATEX)

#: Commands by heading level, by inline tag, and environments by block tag. Fixed values.
SECTIONS = ["part", "chapter", "section", "subsection", "subsubsection", "paragraph", "subparagraph", "subsubparagraph"]
COMMANDS = {"b": "textbf", "i": "emph", "u": "uline", "s": "sout", "sub": "textsubscript", "sup": "textsuperscript", "code": "texttt", "small": "small", "footnote": "footnote", "caption": "caption", "figcaption": "caption", "title": "title", "subtitle": "subtitle"}
ENVIRONMENTS = {"ul": "itemize", "ol": "enumerate", "blockquote": "quote", "dl": "description", "figure": "figure"}


def quote(text: str) -> str:
    return text.translate(_QUOTE)


def _address(url: str) -> str:
    for mark in '{}[]^\\"|':
        url = url.replace(mark, f"%{ord(mark):X}")
    return url.replace("#", "\\#").replace("%", "\\%")


def _table(e: Element, inner: list[str]) -> str:
    rows = [x for x in inner if x.strip()]
    columns = max((r.count(" & ") + 1 for r in rows), default=1)
    return "\\begin{tabular}{" + "l" * columns + "}\n" + "".join(rows) + "\\end{tabular}\n\n"


def _element(e: Element, inner: list[str], shift: int) -> str:
    body = "".join(inner)
    if e.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        return f"\\{SECTIONS[max(0, min(len(SECTIONS) - 1, int(e.tag[1]) - 1 + shift))]}{{{body}}}\n\n"
    if e.tag in COMMANDS:
        return f"\\{COMMANDS[e.tag]}{{{body}}}" + ("\n\n" if e.tag in ("title", "subtitle") else "")
    if e.tag in ENVIRONMENTS:
        return f"\\begin{{{ENVIRONMENTS[e.tag]}}}\n{body}\\end{{{ENVIRONMENTS[e.tag]}}}\n\n"
    if e.tag == "a":
        if "href" not in e.attrs:
            return (f"\\label{{{e.attrs['name']}}}" if "name" in e.attrs else "") + body
        href = e.attrs["href"]
        return f"\\hyperref[{href[1:]}]{{{body}}}" if href.startswith("#") else f"\\href{{{_address(href)}}}{{{body}}}"
    simple = {"p": body + "\n\n", "li": f"\\item {body}\n", "dt": f"\\item[{body}] ", "dd": body + "\n", "br": "\\\\\n", "hr": "\\hrule\n\n", "pagebreak": "\\clearpage\n\n", "td": body + " & ", "th": f"\\textbf{{{body}}} & "}
    if e.tag in simple:
        return simple[e.tag]
    if e.tag == "tr":
        return body.removesuffix(" & ") + " \\\\\n"
    if e.tag == "table":
        return _table(e, inner)
    if e.tag == "img":
        return f"\\includegraphics{{{_address(e.attrs.get('src', ''))}}}"
    if e.tag == "pre":
        return "\\begin{alltt}\n" + body + "\n\\end{alltt}\n\n"
    if e.tag == "section" and "id" in e.attrs:
        return f"\\label{{{e.attrs['id']}}}\n{body}"
    return body


def markup(kids: Kids, shift: int = 2) -> str:
    return "".join(folded(kids, quote, lambda e, inner: _element(e, inner, shift)))


def document(kids: Kids, language: str = "american", shift: int = 2) -> str:
    return f"\\documentclass{{article}}\n\\usepackage[{language}]{{babel}}\n\\usepackage{{hyperref,ulem,graphicx,alltt}}\n\\begin{{document}}\n{markup(kids, shift)}\\end{{document}}\n"
