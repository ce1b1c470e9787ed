"""The corpus pipeline: quality, repeated lines, near-duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are written as Parquet and
read again. All but the last return the columns of documents. n_chars follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm import decontaminate, line_chunks, near_dups, packing, quality
from quillstack.llm.common import free, stored
from quillstack.session import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tail probability for the highest grade reaches the threshold.

    A null text is judged as the empty text. Rows that repeat a document are judged alike, each by its own text; labels
    of repeated or null doc_ids are as in llm.quality. Without usable labels every row stays; an empty table stays empty.
    Extra columns stay; of columns named as results (llm.quality.RESULT) the stage needs none to be there.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.graded(docs, model).where("keep").select([c for c in docs.columns if c not in quality.RESULT])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of two lines or more that occur earlier; all documents stay.

    A copy of several lines becomes an empty text and stays under its doc_id. An empty set is linked with nothing, so
    such documents pass near_duplicates and reach packing as a bare end id. Null texts stay null, null doc_ids count as
    the largest, and rows that repeat a doc_id and its text are one occurrence. n_chars follows the text.
    """
    found = line_chunks.remove_chunks(docs, line_chunks.pairs)
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return found.select([F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in own])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the least doc_id.

    Rows without a doc_id stay. A kept doc_id keeps all its different texts, and each of them once where rows repeat
    both (which of rows that differ in other columns only is left open). Null and wordless texts are linked with nothing.
    """
    known = stored(near_dups.near_duplicates(docs).where("kept and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")), "kept")
    (rows,) = free(docs, "__rows")
    n, most = known.agg(F.count(F.lit(1)), F.max("rows")).first()
    kept = known.withColumnRenamed("rows", rows)
    named = docs.join(F.broadcast(kept) if n <= near_dups.NODES else kept, "doc_id")
    if (most or 0) > 1:
        named = named.where(f"{rows} = 1").union(named.where(f"{rows} > 1").dropDuplicates(["doc_id", "text"]))
    return named.select(docs.columns).union(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words fewer than one in twenty lie in a window of the benchmark.

    Null and wordless texts stay. Rows that repeat a document are judged alike; an empty benchmark takes none away.
    """
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).where("not contaminated")
    return found.select([c for c in docs.columns if c not in decontaminate.RESULT])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the sequences that the remaining documents fill; a null text is a bare end id, repeated rows are packed each."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, added=True)


STAGES = [("quality", keep_quality), ("lines", drop_repeated_lines), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("packing", pack)]

#: Hashed features, a fitted model and dynamic programming have no SQL form. tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
