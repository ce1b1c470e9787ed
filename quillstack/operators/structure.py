"""Structure of ordered rows as windows: sections, tables of contents, endnotes, captions, merges, prefixes.

All take rows of (doc, ord, ...) and partition by document, so one shuffle on the document serves a whole chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstack.functions.text import truncated

LEVELS = 6


def _ordered(doc: str, order: str) -> Window:
    return Window.partitionBy(doc).orderBy(order)


def sections(rows: DataFrame, doc: str, order: str, level: str) -> DataFrame:
    """parent_ord: the nearest earlier heading of a smaller level (null level: no heading, any heading counts)."""
    w = _ordered(doc, order).rowsBetween(Window.unboundedPreceding, -1)
    above = [F.when(F.coalesce(F.col(level), F.lit(LEVELS + 1)) > n, F.last(F.when(F.col(level) == n, F.col(order)), ignorenulls=True).over(w)) for n in range(1, LEVELS + 1)]
    return rows.withColumn("parent_ord", F.greatest(*above))


def toc(rows: DataFrame, doc: str, order: str, level: str, title: str) -> DataFrame:
    found = sections(rows, doc, order, level).where(F.col(level).isNotNull())
    return found.select(doc, F.row_number().over(_ordered(doc, order)).cast("long").alias("ord"), F.col(level).alias("level"), F.col(title).alias("title"), "parent_ord")


def endnotes(rows: DataFrame, doc: str, order: str, top: Column, note: Column) -> DataFrame:
    """Notes numbered anew in each top-level section; ids are section and number."""
    numbered = rows.withColumn("section", F.sum(top.cast("long")).over(_ordered(doc, order).rowsBetween(Window.unboundedPreceding, 0)))
    kept = numbered.where(note)
    n = F.row_number().over(Window.partitionBy(doc, "section").orderBy(order)).cast("long")
    return kept.withColumn("n", n).withColumn("note_id", F.concat(F.col("section").cast("string"), F.lit("-fn"), F.col("n").cast("string")))


def captions(rows: DataFrame, doc: str, order: str, floats: Column, caption: Column) -> DataFrame:
    """Captions with the place of the float directly before them, or null: a problem."""
    w = _ordered(doc, order)
    return rows.withColumn("float_ord", F.lag(F.when(floats, F.col(order))).over(w)).where(caption)


def split_at(rows: DataFrame, doc: str, order: str, mark: Column) -> DataFrame:
    """part: the stretch a row is in, where each mark is a stretch of its own."""
    w = _ordered(doc, order)
    before = F.sum(mark.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("part", F.coalesce(before, F.lit(0)) + F.sum(mark.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def prefix(rows: DataFrame, doc: str, order: str, holds: Column) -> DataFrame:
    """The leading rows for which `holds` is true without a break."""
    w = _ordered(doc, order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_all", F.min(holds.cast("int")).over(w)).where("_all = 1").drop("_all")


def merge_adjacent(rows: DataFrame, doc: str, order: str, same: str, text: str) -> DataFrame:
    """Runs of neighbours with an equal `same` as one row, texts joined in order."""
    w = _ordered(doc, order)
    new = F.when(F.lag(same).over(w).eqNullSafe(F.col(same)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    runs = rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda r: r[text]), "")
    return runs.groupBy(doc, "run").agg(F.first(same).alias(same), F.count(F.lit(1)).alias("n"), joined.alias(text))


def relative_depth(rows: DataFrame, doc: str, level: str) -> DataFrame:
    """Consecutive levels form a run: level minus rank is the run's key."""
    return rows.withColumn("run", F.col(level) - F.row_number().over(_ordered(doc, level)))


def shares(rows: DataFrame, group: list[str], width: str) -> DataFrame:
    return rows.withColumn("percent", F.round(100 * F.col(width) / F.sum(width).over(Window.partitionBy(*group)), 2))


def block_runs(rows: DataFrame, doc: str, order: str, kind: str, block: Column) -> DataFrame:
    """Runs of block rows as one: (doc, first, last, n, kind), where a run of code alone is pre and any other a quote."""
    w = _ordered(doc, order)
    marked = rows.withColumn("_block", block)
    island = F.sum(F.when(F.col("_block") & F.coalesce(F.lag("_block").over(w), F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = marked.withColumn("_run", island).where("_block").groupBy(doc, "_run")
    out = runs.agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"), F.bool_and(F.col(kind) == "code").alias("_code"))
    return out.select(doc, "first", "last", "n", F.when(F.col("_code"), "pre").otherwise("blockquote").alias("tag"))


def arguments(rows: DataFrame, doc: str, order: str, command: Column, text: str) -> DataFrame:
    """Each command row with the range of the rows after it up to the document's end (first, last; null without any)
    and how many of them have a text: a range, as the texts themselves would be held once for each command."""
    w = _ordered(doc, order)
    after = w.rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumn("first", F.lead(order).over(w)).withColumn("last", F.last(order).over(after)).withColumn("n_arguments", F.count(text).over(after)).where(command)


def problems(rows: DataFrame, doc: str, order: str, kind: str, message: Column, args: list[Column]) -> DataFrame:
    """Diagnostics (doc, seq, id, kind, body): places {} of the message take the arguments, each cut to 50 characters and
    on one line; ids count the problems of each document in order."""
    body = message
    for value in args:
        shown = F.regexp_replace(truncated(value.cast("string")), "\n", " ")
        at = F.instr(body, "{}")
        body = F.when(at > 0, F.concat(F.substr(body, F.lit(1), at - 1), F.coalesce(shown, F.lit("")), F.substr(body, at + 2))).otherwise(body)
    seq = F.row_number().over(_ordered(doc, order)).cast("long")
    return rows.select(doc, seq.alias("seq"), F.concat(F.lit("docproblem"), seq.cast("string")).alias("id"), F.col(kind).alias("kind"), body.alias("body"))


def first_missing(cited: DataFrame, known: DataFrame, doc: str, key: str) -> DataFrame:
    """The least cited key of each document that no entry of `known` has."""
    return cited.join(known, key, "left_anti").groupBy(doc).agg(F.min(key).alias(key))


def free_numbers(rows: DataFrame, group: str, number: str) -> DataFrame:
    """The least number from 1 that each group does not have; numbers below 1 don't matter."""
    w = Window.partitionBy(group).orderBy(number)
    ranked = rows.where(F.col(number) >= 1).select(group, number).distinct().withColumn("_n", F.row_number().over(w))
    held = ranked.where(F.col(number) == F.col("_n")).groupBy(group).agg(F.count(F.lit(1)).alias("_held"))
    return rows.select(group).distinct().join(held, group, "left").select(group, (F.coalesce("_held", F.lit(0)) + 1).cast("long").alias("free"))
