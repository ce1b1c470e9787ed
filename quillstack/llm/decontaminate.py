"""Benchmark decontamination as a prefix-filtered set join, with DataFrame functions only.

Words are maximal runs of ASCII letters and digits and of non-ASCII characters, lower-cased in A-Z. An item's
windows are its runs of WIDTH words, or all its words if it has fewer. A window's shingles are its pairs of neighbouring
words (a single word is its own shingle), ordered by how often the corpus has them. As a window has to occur whole, its
necessary prefix is its rarest shingle, and a document that lacks it can't hold the window: documents are
joined on this shingle, the window's place follows from the shingle's place and must lie inside the document
(positional and length bound), and the words there are compared with the window's.

Prefixes of at most BLOCK windows (some 20 MB) are broadcast, so the corpus is read once and never shuffled; more are
joined by shuffling the places of shingles, and only documents with candidates meet their words again.

Defined results: null and wordless texts have no words (n_words 0, not contaminated) and such items no windows; a
null item_id is left out of the list; rows with equal doc_id and text get equal results; an empty table gives no
rows, an empty benchmark no hits; texts of any length are read whole; other columns of `docs` stay, whatever their
names, but for those named as results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, stored

WIDTH = 13
BLOCK = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All ASCII but digits and letters. Words come out the same before and after lower-casing.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RESULT = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def words_of(text: str | Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _BETWEEN), "")


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def windows_of(benchmark: DataFrame) -> DataFrame:
    """Distinct windows: win (words joined by spaces), size, items."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(lowered(F.col("text"))).alias("words")).where("size(words) > 0")
    size = F.least(F.size("words"), F.lit(WIDTH))
    cut = items.select("item", "words", size.alias("size"), F.explode(F.sequence(F.lit(1), F.size("words") - size + 1)).alias("at"))
    return cut.select("item", "size", F.array_join(F.slice("words", F.col("at"), F.col("size")), " ").alias("win")).groupBy("win", "size").agg(F.collect_set("item").alias("items"))


def _small(table: DataFrame) -> DataFrame:
    """For a join: broadcast if it has at most BLOCK rows."""
    return F.broadcast(table) if table.count() <= BLOCK else table


def shingles(rows: DataFrame, single: bool) -> DataFrame:
    """rows(words, ...) with each pair of neighbouring words as `key` from place `at` on; with `single` also each word."""
    each = rows.select("*", F.posexplode("words").alias("at", "word"))
    pair = F.concat("word", F.lit(" "), F.get("words", F.col("at") + 1))
    if single:
        return each.withColumn("key", F.explode(F.array(F.lower("word"), F.lower(pair)))).where("key is not null")
    return each.where("at + 1 < size(words)").withColumn("key", F.lower(pair))


def prefixes(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """Each window with its rarest shingle (`key`) and that shingle's place; windows with one that no document has go."""
    cut = windows.select("win", "size", F.split("win", " ").alias("words"))
    single = not cut.where("size = 1").isEmpty()
    placed = shingles(cut, single).where("size = 1 or instr(key, ' ') > 0").select("win", "size", "key", F.col("at").alias("place"))
    vocabulary = _small(stored(placed.select("key").distinct(), "shingles"))
    # How often the benchmark's shingles occur in the corpus.
    seen = shingles(docs.select(words_of("text").alias("words")), single).select("key")
    counts = seen.join(vocabulary, "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    ranked = placed.join(counts, "key", "left").groupBy("win", "size").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "place")).alias("rare"))
    return ranked.where("rare.n > 0").select("win", "size", F.col("rare.key").alias("key"), F.col("rare.place").alias("place"))


def occurrences(source: DataFrame, rare: DataFrame) -> DataFrame:
    """(doc, text, start, size, win) where a document of source(doc, text, words) holds a window."""
    single = not rare.where("size = 1").isEmpty()
    inside = "start >= 0 and start + size <= n"
    start = (F.col("at") - F.col("place")).alias("start")
    same = lowered(F.array_join(F.expr("slice(words, start + 1, size)"), " ")) == F.col("win")
    keyed = shingles(source, single)
    if rare.count() <= BLOCK:
        near = keyed.join(F.broadcast(rare), "key").select("doc", "text", "words", start, "size", "win", F.size("words").alias("n"))
        return near.where(inside).where(same).select("doc", "text", "start", "size", "win")
    near = keyed.select("doc", "text", "key", "at", F.size("words").alias("n")).join(rare, "key").select("doc", "text", start, "size", "win", "n").where(inside)
    there = near.groupBy(F.col("doc").alias("d"), F.col("text").alias("t")).agg(F.collect_set(F.struct("start", "size", "win")).alias("candidates"))
    met = source.join(there, F.col("doc").eqNullSafe(F.col("d")) & F.col("text").eqNullSafe(F.col("t"))).select("doc", "text", "words", F.inline("candidates"))
    return met.where(same).select("doc", "text", "start", "size", "win")


def contamination(docs: DataFrame, benchmark: DataFrame, share: int = 20) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256 and contaminated (share * n_hit >= n_words, n_hit > 0)."""
    windows = stored(windows_of(benchmark), "windows")
    rare = stored(prefixes(windows, docs), "prefixes")
    source = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("text"), words_of("text").alias("words"))
    spans = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("stop"))))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("stop"), F.lit(0).cast("long").alias("hit")),
        lambda a, s: F.struct(F.greatest(a.stop, s.stop).alias("stop"), (a.hit + F.greatest(F.lit(0), s.stop - F.greatest(a.stop, s.start))).alias("hit")),
        lambda a: a.hit,
    )
    # Distinct windows of a document first, then their items: an item's list is not copied for each occurrence.
    per_doc = occurrences(source, rare).groupBy("doc", "text").agg(spans.alias("spans"), F.collect_set("win").alias("wins"))
    listed = per_doc.select("doc", "text", covered.alias("hit"), F.explode("wins").alias("win")).join(windows.select("win", "items"), "win")
    items = listed.select("doc", "text", "hit", F.explode_outer("items").alias("item"))
    marks = stored(items.groupBy("doc", "text").agg(F.max("hit").alias("hit"), F.array_sort(F.collect_set("item")).alias("ids")), "hits")
    d, t, hit, ids, doc, text, n = free(docs, "__d", "__t", "__hit", "__ids", "__doc", "__text", "__n")
    marks = _small(marks.withColumnsRenamed({"doc": d, "text": t, "hit": hit, "ids": ids}))
    whole = docs.withColumn(doc, F.col("doc_id").cast("long")).withColumn(text, F.xxhash64("text")).withColumn(n, F.size(words_of("text")).cast("long"))
    joined = whole.join(marks, F.col(doc).eqNullSafe(F.col(d)) & (F.col(text) == F.col(t)), "left")
    n_hit, found = F.coalesce(hit, F.lit(0)).cast("long"), F.coalesce(ids, F.array().cast("array<string>"))
    kept = [c for c in docs.columns if c not in RESULT]
    return joined.select(
        *kept,
        F.col(n).alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(found).cast("long").alias("n_items"),
        F.sha2(F.array_join(found, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (F.lit(share) * n_hit >= F.col(n))).alias("contaminated"),
    )
