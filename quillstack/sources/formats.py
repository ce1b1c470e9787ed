"""What format a file has: by its name, or by its first bytes."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstack.functions.markup import chosen

#: Formats by extension. Fixed values.
EXTENSIONS = {"docx": "docx", "odt": "odt", "html": "html", "htm": "html", "md": "markdown", "txt": "markdown", "markdown": "markdown"}


def by_name(path: Column) -> Column:
    """The format of the path's extension, or null."""
    return chosen(F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)), EXTENSIONS)


_ODT = b"application/vnd.oasis.opendocument.text"


def is_odt(content: Column) -> Column:
    """A zip whose first member is the uncompressed mimetype of a text document, behind an extra field of any length."""
    byte = lambda at: F.coalesce(F.conv(F.hex(F.substring(content, at, 1)), 16, 10).cast("int"), F.lit(0))
    behind = 39 + byte(29) + 256 * byte(30)
    named = (F.substring(content, 1, 4) == F.lit(b"PK\x03\x04")) & (F.substring(content, 31, 8) == F.lit(b"mimetype"))
    return named & (F.substr(content, behind, F.lit(len(_ODT))) == F.lit(_ODT))


def is_docx(content: Column) -> Column:
    """A zip with a content-types part and a word folder."""

    def run(values: pd.Series) -> pd.Series:
        def one(data: bytes | None) -> bool:
            if data is None or not data.startswith(b"PK"):
                return False
            try:
                names = zipfile.ZipFile(io.BytesIO(data)).namelist()
            except zipfile.BadZipFile:
                return False
            return "[Content_Types].xml" in names and any(n.startswith("word/") for n in names)

        return values.map(one).astype(bool)

    return F.pandas_udf(run, "boolean")(content)


def sniffed(content: Column) -> Column:
    """odt, docx, html (the first character that isn't white space is <), else markdown; null stays null."""
    head = F.decode(content, "ISO-8859-1")
    return F.when(content.isNull(), None).when(is_odt(content), "odt").when(is_docx(content), "docx").when(head.rlike(r"^(\xEF\xBB\xBF)?\s*<"), "html").otherwise("markdown")
