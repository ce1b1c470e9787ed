"""Scalar functions of the document model as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: LaTeX's special characters and what stands for them. Fixed values.
LATEX = {
    "#": "\\#", "$": "\\$", "%": "\\%", "&": "\\&", "<": "{\\textless}", ">": "{\\textgreater}", "\\": "{\\textbackslash}", "^": "\\^{}",
    "_": "\\_", "`": "\\`{}", "{": "\\{", "|": "{\\textbar}", "}": "\\}", "~": "{\\textasciitilde}", "[": "{[}", "]": "{]}", "\u00a0": "~",
}


def space_normalize(c: Column) -> Column:
    """Runs of newline, carriage return, tab and space become one space; other white space stays."""
    return F.regexp_replace(c, r"[\n\r\t ]+", " ")


def _replaced(c: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def html_escape(c: Column) -> Column:
    return _replaced(c, ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))


def odt_escape(c: Column) -> Column:
    return _replaced(html_escape(c), (" ", "<text:s/>"), ("\t", "<text:tab/>"))


#: Noncharacters that stand, for a moment, for characters which occur in what stands for others.
_MARKS = {k: chr(0xFDD0 + n) for n, k in enumerate("\\{}[]~^`#$%&_")}


def latex_quote(c: Column) -> Column:
    """Special characters as LaTeX writes them. A text that holds the noncharacters itself goes character by character."""
    fast = F.translate(c, "".join(_MARKS), "".join(_MARKS.values()))
    fast = _replaced(fast, *((k, v) for k, v in LATEX.items() if k not in _MARKS))
    fast = _replaced(fast, *((m, LATEX[k]) for k, m in _MARKS.items()))
    table = F.create_map(*(F.lit(x) for pair in LATEX.items() for x in pair))
    slow = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.element_at(table, x), x)), "")
    return F.when(c.rlike("[\ufdd0-\ufddf]"), slow).otherwise(fast)


def anchor_slug(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9]+", "-")


def href_escape(c: Column) -> Column:
    """Braces, brackets and the like as %XX, then # and % get a backslash."""
    fixed = [("{", "%7B"), ("}", "%7D"), ("[", "%5B"), ("]", "%5D"), ("^", "%5E"), ("\\", "%5C"), ('"', "%22"), ("|", "%7C")]
    return _replaced(_replaced(c, *fixed), ("%", "\\%"), ("#", "\\#"))


def de_unicode(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\x00-\x7F]", "#")


def truncated(c: Column, most: int = 50) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)


def url_letters(c: Column) -> Column:
    """Digits as letters, for names that can't hold digits."""
    return F.translate(c.cast("string"), "0123456789", "ZABCDEFGHI")


def parse_boolean(c: Column) -> Column:
    return F.when(F.lower(c) == "yes", True).when(F.lower(c) == "no", False)


#: Where a multiline value is cut: at semicolons behind an even number of backslashes. Fixed value.
_CUT = r"(?<!\\)(?:\\\\)*;"


def parse_multiline(c: Column, space: str = " \t\n\x0b\f\r") -> Column:
    """Parts between semicolons that no backslash escapes, without space around them, doubled backslashes as one. Line breaks at an end of a part are kept where `space` has none."""
    return F.transform(F.split(c, _CUT, -1), lambda p: F.replace(F.trim(p, F.lit(space)), F.lit("\\\\"), F.lit("\\")))


def print_multiline(parts: Column) -> Column:
    """Parts with backslashes doubled and semicolons escaped, between semicolons."""
    return F.array_join(F.transform(parts, lambda p: _replaced(p, ("\\", "\\\\"), (";", "\\;"))), "; ")


def print_boolean(c: Column) -> Column:
    return F.when(c, "yes").when(~c, "no")


def print_date(supplied: Column, roundtrip: bool = True) -> Column:
    """The date in its canonical form; today stays today on a round trip."""
    return F.when(supplied == "today", "today").otherwise(parse_date(supplied)) if roundtrip else parse_date(supplied)


def parse_date(c: Column) -> Column:
    """Today, a year or integer as it stands, an ISO date in its full form, else null."""
    return (
        F.when(F.lower(c) == "today", F.current_date().cast("string"))
        .when(c.rlike("^-?[1-9][0-9]+$"), c)
        .when(c.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), F.try_to_date(c, "y-M-d").cast("string"))
    )


def emu(c: Column, unit: str) -> Column:
    return c.cast("long") * {"px": 12700, "emu": 1, "twips": 635}[unit]


def snapped_width(percent: Column) -> Column:
    """Steps of a 33-step page."""
    return F.round(33 * percent / 100).cast("long")


def figure_class(percent: Column) -> Column:
    return F.when(percent >= 100, "fullwidth").when(percent > 75, "block").otherwise("inline")
