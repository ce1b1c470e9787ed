"""Attributes and tables as rows: classes, styles, header cells, column alignment, labels, addresses set as text.

All of it is built-in functions. Operators on rows shuffle once, on the document or the table; a table is a part of a
document, so no group outgrows one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstack.functions.markup import percent_encoded
from quillstack.functions.text import url_letters

#: The width of one level of indentation, half an inch. Fixed value.
INDENT_CM = 1.27


def indents(width: Column) -> Column:
    """Levels of indentation of a width in cm, 0 for negative ones; null where it isn't a number and "cm"."""
    number = F.regexp_extract(width, r"^\s*([+-]?[0-9]*\.?[0-9]+)cm$", 1)
    return F.when(number != "", F.greatest(F.lit(0), F.round(number.cast("double") / INDENT_CM).cast("long")))


def shading(rgb: Column) -> Column:
    """#RRGGBB in upper case; null for white, which is no shading, and for what is no such colour."""
    colour = F.upper(rgb)
    return F.when(colour.rlike("^#[0-9A-F]{6}$") & (colour != "#FFFFFF"), colour)


def font_id(href: Column) -> Column:
    """font.NAME for a font file beside the text's folder; other addresses stay."""
    return F.regexp_replace(href, r"^\.\./fonts/(.*)\.(?i:otf|ttf)$", "font.$1")


def merged_classes(*classes: Column) -> Column:
    """The classes of all, each once, in order of appearance; null counts as none."""
    return F.array_distinct(F.concat(*(F.coalesce(c, F.array().cast("array<string>")) for c in classes)))


def with_classes(classes: Column, *more: str) -> Column:
    """The classes and `more`, each once, sorted."""
    return F.array_sort(merged_classes(classes, F.array(*map(F.lit, more)).cast("array<string>")))


def merged_style(first: Column, second: Column) -> Column:
    """Properties of both maps, those of the second before those of the first; null counts as none."""
    none = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(first, none), F.coalesce(second, none)
    over = F.transform_values(a, lambda k, v: F.when(F.map_contains_key(b, k), F.element_at(b, k)).otherwise(v))
    return F.map_concat(over, F.map_filter(b, lambda k, v: ~F.map_contains_key(a, k)))


def left_over(given: Column, handled: list[str]) -> Column:
    """Names that nothing has handled."""
    return F.array_except(given, F.array(*map(F.lit, handled)))


def needs_paragraph(nodes: DataFrame, doc: str, block: Column) -> DataFrame:
    """(doc, needs_p) for each document with nodes: true unless its one node is a block."""
    found = nodes.groupBy(doc).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce(block, F.lit(False))).alias("blocks"))
    return found.select(doc, (~((F.col("n") == 1) & F.col("blocks"))).alias("needs_p"))


def label_names(name: Column) -> Column:
    return F.ltrim(name, F.lit("#"))


def split_labels(nodes: DataFrame, label: Column, name: str) -> tuple[DataFrame, DataFrame]:
    """Nodes that only name a place, with their label, and all others. Both read the same scan; nothing is shuffled."""
    is_label = F.coalesce(label, F.lit(False))
    return nodes.where(is_label).withColumn("label", label_names(F.col(name))), nodes.where(~is_label)


def header_cells(cells: DataFrame, table: str, row: str, col: str, blank: Column, bold: Column) -> DataFrame:
    """cells with header_row and header_col: is the cell in a first row, or first column, of blank and bold cells alone?

    First is the smallest number in the table. Bold means that one bold paragraph is the whole cell.
    """
    whole = Window.partitionBy(table)
    able = F.coalesce(blank, F.lit(False)) | F.coalesce(bold, F.lit(False))
    line = lambda c: F.col(c) == F.min(c).over(whole)
    marked = cells.select("*", able.alias("_able"), line(row).alias("_top"), line(col).alias("_left"))
    all_of = lambda c: F.col(c) & F.bool_and(F.when(F.col(c), F.col("_able"))).over(whole)
    return marked.select(*cells.columns, all_of("_top").alias("header_row"), all_of("_left").alias("header_col"))


def aligned(cells: DataFrame, columns: DataFrame, keys: list[str]) -> DataFrame:
    """cells(keys, class, ...) with the classes of the column at the same keys (table, column) added, sorted; one row a column."""
    named = columns.select(*keys, F.col("class").alias("_column"))
    found = cells.join(named, keys, "left")
    classes = F.when(F.col("_column").isNull(), F.col("class")).otherwise(F.array_sort(merged_classes(F.col("class"), F.col("_column"))))
    return found.select(*[classes.alias("class") if c == "class" else F.col(c) for c in cells.columns])


def url_name(n: Column) -> Column:
    """The command of the n-th address; digits aren't allowed in a command's name."""
    return F.concat(F.lit("tystrurl"), url_letters(n))


def bare_urls(links: DataFrame, doc: str, order: str, text: str, href: str) -> DataFrame:
    """Links whose text is their address: (doc, ord, n, name, definition), numbered in each document.

    An address whose braces don't pair is percent-encoded.
    """
    address = F.col(href)
    count = lambda mark: F.length(address) - F.length(F.replace(address, F.lit(mark), F.lit("")))
    safe = F.when(count("{") != count("}"), percent_encoded(address)).otherwise(address)
    n = F.row_number().over(Window.partitionBy(doc).orderBy(order)).cast("long")
    found = links.where(F.col(text) == address).select(doc, F.col(order).alias("ord"), n.alias("n"), safe.alias("safe"))
    name = url_name(F.col("n"))
    return found.select(doc, "ord", "n", name.alias("name"), F.concat(F.lit("\\urldef{\\"), name, F.lit("}\\url{"), F.col("safe"), F.lit("}")).alias("definition"))
