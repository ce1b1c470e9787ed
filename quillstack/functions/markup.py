"""Colours, addresses, code languages, percentages, identifiers and media as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The colour names of CSS 2.1. Fixed values.
COLOURS = {"aqua": "#00ffff", "black": "#000000", "blue": "#0000ff", "fuchsia": "#ff00ff", "gray": "#808080", "green": "#008000", "lime": "#00ff00", "maroon": "#800000", "navy": "#000080", "olive": "#808000", "orange": "#ffa500", "purple": "#800080", "red": "#ff0000", "silver": "#c0c0c0", "teal": "#008080", "white": "#ffffff", "yellow": "#ffff00"}

#: Cues of code languages in the order they are tried: texts of which one has to occur, and a pattern.
CODE_LANGUAGES = [
    ("latex", ["\\"], r"\\(begin|end|documentclass|usepackage|section|emph|textbf)\{"),
    ("c", ["#"], r"(\A|\n)\s*#\s*(include|define|ifn?def|pragma)\b"),
    ("python", ["def ", "import ", "class "], r"(\A|\n)\s*((def|class) \w+[^\n]*:[ \t]*(\n|\z)|from [\w.]+ import |import \w+)"),
    ("java", ["class ", "void ", "import java"], r"\b(public|private|protected)\s+(static\s+|final\s+)*(class|interface|void|int|String)\b|\bimport java"),
    ("javascript", ["function", "=>", "const ", "let ", "var "], r"\bfunction\s*\w*\s*\(|=>\s*\{|\b(const|let|var)\s+\w+\s*="),
    ("clojure", ["("], r"\((defn?|defmacro|ns|let|fn)\s"),
    ("sql", ["elect", "ELECT", "nsert", "NSERT", "reate", "REATE", "elete", "ELETE", "pdate", "PDATE"], r"(\A|\n)\s*(?i:select\s[^;]*\sfrom\s|insert\s+into\s|create\s+(table|view|index)\s|delete\s+from\s|update\s+\w+\s+set\s)"),
    ("xml", ["<?xml", "xmlns"], r"<\?xml\s|\sxmlns(:\w+)?="),
    ("html", ["</", "<!"], r"(?i:<!doctype\s+html)|</(?i:html|head|body|div|span|p|a|ul|ol|li|table|h[1-6])>"),
    ("css", ["{"], r"[\w.#*-]+\s*\{\s*[\w-]+\s*:[^{};]+;"),
    ("ruby", ["end"], r"(\A|\n)\s*(def|module|class|do|if|unless)\b[^\n:]*\n[\s\S]*\n\s*end\s*(\n|\z)"),
]

#: Fonts that set code, besides all whose name ends in " mono". Fixed values.
CODE_FONTS = ["Anonymous Pro", "Consolas", "Courier", "Courier New", "Envy Code R", "Fixed", "GNU Unifont", "Inconsolata", "Inconsolata-g", "Lucida Console", "M+ 1m", "Menlo", "Monaco", "Monofur", "OCR-A", "OCR-B", "Pragmata Pro", "Source Code Pro", "Terminal", "Terminus", "fixed"]

EXTENSIONS = {"image/jpeg": ".jpg", "image/png": ".png", "image/gif": ".gif", "image/svg+xml": ".svg"}
MIMES = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif", ".svg": "image/svg+xml"}


def chosen(c: Column, table: dict[str, str]) -> Column:
    """The table's value for c, or null."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), c)


def _byte(share: Column) -> Column:
    """A share from 0 to 1 as two hexadecimal digits."""
    return F.lower(F.lpad(F.hex(F.round(255 * F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))).cast("long")), 2, "0"))


def colour(c: Column) -> Column:
    """#rgb, #rrggbb, rgb(), rgba(), hsl(), hsla() (alpha dropped) and names as #rrggbb; anything else is null."""
    c = F.lower(F.trim(c))
    parts = F.regexp_extract_all(c, F.lit(r"(-?\d+(?:\.\d+)?)"), F.lit(1))
    number = lambda k: F.get(parts, F.lit(k)).cast("double")
    whole = [F.lpad(F.hex(F.least(F.floor(number(k)), F.lit(255)).cast("long")), 2, "0") for k in range(3)]
    shares = [_byte(number(k) / 100) for k in range(3)]
    hue, vivid, light = F.pmod(number(0), F.lit(360.0)) / 30, number(1) / 100, number(2) / 100
    reach = vivid * F.least(light, 1 - light)

    def channel(shift: int) -> Column:
        at = F.pmod(hue + shift, F.lit(12.0))
        return _byte(light - reach * F.greatest(F.lit(-1.0), F.least(at - 3, 9 - at, F.lit(1.0))))

    three = lambda unit: rf"\(\s*\d+(\.\d+)?{unit}\s*,\s*\d+(\.\d+)?{unit}\s*,\s*\d+(\.\d+)?{unit}\s*(,.*)?\)$"
    return (
        F.when(c.rlike("^#[0-9a-f]{6}$"), c)
        .when(c.rlike("^#[0-9a-f]{3}$"), F.regexp_replace(c, "([0-9a-f])", "$1$1"))
        .when(c.rlike("^rgba?" + three("")), F.lower(F.concat(F.lit("#"), *whole)))
        .when(c.rlike("^rgba?" + three("%")), F.concat(F.lit("#"), *shares))
        .when(c.rlike(r"^hsla?\(\s*-?\d+(\.\d+)?\s*,\s*\d+(\.\d+)?%\s*,\s*\d+(\.\d+)?%\s*(,.*)?\)$"), F.concat(F.lit("#"), channel(0), channel(8), channel(4)))
        .otherwise(chosen(c, COLOURS))
    )


def percent_encoded(c: Column) -> Column:
    """Braces, brackets and the like as %XX."""
    for mark in '{}[]^\\"|':
        c = F.replace(c, F.lit(mark), F.lit(f"%{ord(mark):X}"))
    return c


def url_fix(c: Column) -> Column:
    """Host in lower case, users as they are; braces, brackets and the like behind it as %XX."""
    whole = r"^([A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?)([^/?#@]*)([\s\S]*)$"
    rest = percent_encoded(F.regexp_extract(c, whole, 3))
    return F.when(c.rlike(whole), F.concat(F.regexp_extract(c, whole, 1), F.lower(F.regexp_extract(c, whole, 2)), rest)).otherwise(c)


def code_language(c: Column) -> Column:
    """The first language of which a cue occurs, else bash. Plain searches come before the patterns."""
    out = F.when(c.isNull(), None)
    for name, needles, pattern in CODE_LANGUAGES:
        there = c.contains(needles[0])
        for needle in needles[1:]:
            there |= c.contains(needle)
        out = out.when(there & c.rlike(pattern), name)
    return out.otherwise("bash")


def is_code_font(c: Column) -> Column:
    return F.lower(c).endswith(" mono") | c.isin(CODE_FONTS)


def percentage(c: Column) -> Column:
    """At most two decimals, trailing zeros cut."""
    return F.concat(F.regexp_replace(F.format_string("%.2f", c.cast("double")), r"\.?0+$", ""), F.lit("%"))


def parse_percentage(c: Column) -> Column:
    return F.regexp_extract(c, r"^\s*(-?[0-9.]+)%$", 1).try_cast("double")


def data_url(mime: Column, data: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.replace(F.base64(data), F.lit("\r\n"), F.lit("")))


def parse_data_url(c: Column) -> Column:
    """(mime, data) of a base64 data address, or null."""
    whole = r"^data:([^;,]*);base64,([A-Za-z0-9+/=\s]*)$"
    return F.when(c.rlike(whole), F.struct(F.regexp_extract(c, whole, 1).alias("mime"), F.unbase64(F.regexp_extract(c, whole, 2)).alias("data")))


def extension(mime: Column) -> Column:
    return chosen(mime, EXTENSIONS)


def mime(path: Column) -> Column:
    """The kind of media that a file name's extension tells, or null."""
    return chosen(F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1)), MIMES)


def media_href(data: Column, mime: Column, folder: str | None) -> Column:
    """A file name from the content where media go to a folder, else the content itself."""
    if folder is None:
        return data_url(mime, data)
    return F.concat(F.lit(folder.rstrip("/") + "/"), digest(data), F.coalesce(extension(mime), F.lit("")))


def digest(c: Column) -> Column:
    return F.substring(F.sha2(c, 512), 1, 32)


def drawing_number(c: Column) -> Column:
    return F.conv(F.substring(F.sha2(c, 512), 1, 8), 16, 10).cast("long")


def generated_id(document: Column, ordinal: Column) -> Column:
    """The same for the same document and place: letters and digits of a digest."""
    return F.concat(F.lit("G."), F.upper(F.substring(F.sha2(F.concat_ws("/", document.cast("string"), ordinal.cast("string")), 256), 1, 12)))


def document_uuid(digest_: Column) -> Column:
    """32 hexadecimal digits as a UUID of version 5 (name based, SHA) and the usual variant."""
    variant = F.lower(F.hex((F.conv(F.substring(digest_, 17, 1), 16, 10).cast("int") % 4 + 8).cast("long")))
    part = lambda a, n: F.substring(digest_, a, n)
    return F.concat(F.lit("urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def macro_name(c: Column, prefix: str) -> Column:
    """prefix + first part, later parts capitalised; null where other than a-z and dashes occur."""
    parts = F.split(c, "-")
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2))))
    return F.when(~c.rlike("[^a-z-]"), F.concat(F.lit(prefix), parts[0], F.array_join(rest, "")))


def default_label(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def heading_level(level: Column, shift: int) -> Column:
    return F.least(F.lit(6), F.greatest(F.lit(1), level + shift))


def attributes(attrs: Column) -> Column:
    """A map as HTML attributes sorted by name, values escaped."""
    pairs = F.array_sort(F.map_entries(attrs))
    escaped = lambda v: F.replace(F.replace(F.replace(F.replace(v, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    return F.array_join(F.transform(pairs, lambda p: F.concat(F.lit(" "), p.key, F.lit('="'), escaped(p.value), F.lit('"'))), "")


def cdata(c: Column) -> Column:
    """Script and style texts with < or & inside are wrapped."""
    return F.when(c.rlike("[<&]"), F.concat(F.lit("/*<![CDATA[*/"), c, F.lit("/*]]>*/"))).otherwise(c)


def indent(c: Column, by: int) -> Column:
    """Each line that isn't blank moves right; space at line ends goes."""
    return F.regexp_replace(F.regexp_replace(c, "(?m)[ \t]+$", ""), "(?m)^(?=[^\n])", " " * by)
