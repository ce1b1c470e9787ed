"""Removal of repeated runs of lines by content-defined chunks.

A chunk ends after a line whose own hash is 0 modulo AVERAGE, so an inserted line moves no boundary but its
neighbours. Chunks have at least LEAST lines and at most MOST; a last line left alone
joins the chunk before it. A chunk of at least two lines, not all blank, that
occurs again anywhere goes, except where it occurs first by (doc_id, hash of the text, line). Equal 64-bit hashes
only nominate: the bytes of a chunk are compared with those of the first occurrence before it goes. A task carries equal
chunks of its stretch of documents once, with their places, so a chunk that a third of all documents hold meets itself
once a stretch.

A repeated passage that holds no whole chunk stays. With `pairs` in place of `chunks` every two neighbouring lines are
such a chunk, so each line of every repeated run of two lines or more goes, wherever the run begins and ends (blank
lines between blank lines stay); the first occurrence of each line stays. That is twice the bytes in the join.

Defined results: a null text stays null and has no lines; a null doc_id counts as the largest; rows that repeat
a doc_id and its text count as one occurrence and are treated alike; an empty table gives no rows; texts and lines of any
length are read whole. Other columns stay, whatever their names, but for n_lines and n_removed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FEW, arrow_rows, discard, free, stored

AVERAGE, LEAST, MOST = 2, 2, 16
#: Bytes of chunks in a stretch of documents.
STRETCH_BYTES = 8 << 20
LAST = (1 << 63) - 1

Spans = Callable[[list[bytes]], list[tuple[int, int]]]

_CHUNKS = "doc long, tkey long, line int, n int, h long"
_CARRIED = "h long, n int, chunk binary, places array<struct<doc: long, tkey: long, line: int>>"
_PLACE = pa.struct([("doc", pa.int64()), ("tkey", pa.int64()), ("line", pa.int32())])


def chunks(lines: list[bytes]) -> list[tuple[int, int]]:
    """(first line, number of lines) of each chunk, in order, without gaps."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, len(lines))
    ends = (h % np.uint64(AVERAGE) == 0).tolist()
    out, first = [], 0
    for k, end in enumerate(ends):
        n = k + 1 - first
        if n >= MOST or end and n >= LEAST:
            out.append((first, n))
            first = k + 1
    if out and first + 1 == len(lines):
        out[-1] = (out[-1][0], out[-1][1] + 1)
    elif first < len(lines):
        out.append((first, len(lines) - first))
    return out


def pairs(lines: list[bytes]) -> list[tuple[int, int]]:
    """(first line, 2) of every two neighbouring lines."""
    return [(k, 2) for k in range(len(lines) - 1)]


def _chunks(batches: Iterator[pa.RecordBatch], spans: Spans) -> Iterator[list[tuple[int, int, int, int, bytes]]]:
    """Per batch (doc, tkey, first line, lines, bytes) of the chunks that may go."""
    for b in batches:
        rows = []
        for doc, key, text in zip(*(b.column(k).to_pylist() for k in ("doc", "tkey", "text"))):
            lines = text.encode("utf-8", "surrogatepass").split(b"\n")
            if len(lines) < 2:
                continue
            for first, n in spans(lines):
                part = b"\n".join(lines[first : first + n])
                if n > 1 and part.strip():
                    rows.append((doc, key, first, n, part))
        yield rows


def _hash(part: bytes) -> int:
    return xxhash.xxh3_64_intdigest(part) - (1 << 63)


def _narrow(batches: Iterator[pa.RecordBatch], spans: Spans) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
    for rows in _chunks(batches, spans):
        columns = list(zip(*((*r[:4], _hash(r[4])) for r in rows))) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc", "tkey", "line", "n", "h"])


def _carried(batches: Iterator[pa.RecordBatch], spans: Spans) -> Iterator[pa.RecordBatch]:
    """Each different chunk of a stretch once, with its places."""
    held: dict[bytes, tuple[int, list]] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        items = list(held.items())
        for k in range(0, len(items), 1000):
            some = items[k : k + 1000]
            columns = [[_hash(part) for part, _ in some], [n for _, (n, _) in some], [part for part, _ in some], [[dict(zip(("doc", "tkey", "line"), p)) for p in places] for _, (_, places) in some]]
            types = [pa.int64(), pa.int32(), pa.binary(), pa.list_(_PLACE)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["h", "n", "chunk", "places"])

    for rows in _chunks(batches, spans):
        for doc, key, line, n, part in rows:
            if part not in held:
                held[part] = (n, [])
                size += len(part)
            held[part][1].append((doc, key, line))
            size += 24
        if size >= STRETCH_BYTES:
            yield from out()
            held, size = {}, 0
    yield from out()


def _without(texts: pd.Series, marks: pd.Series) -> pd.Series:
    """Each text without the marked lines; a mark is first line * 64 + number of lines."""
    out = []
    for text, some in zip(texts, marks):
        if some is not None and len(some):
            lines = text.split("\n")
            for m in some:
                lines[m // 64 : m // 64 + m % 64] = [None] * (m % 64)
            text = "\n".join([x for x in lines if x is not None])
        out.append(text)
    return pd.Series(out, dtype=object)


def remove_chunks(docs: DataFrame, spans: Spans = chunks) -> DataFrame:
    """docs with the repeated chunks, or what else spans gives, gone from text, n_lines before and n_removed lines."""
    arrow_rows(docs.sparkSession)
    doc, tkey, gone = free(docs, "__doc", "__tkey", "__marks")
    keyed = docs.withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).withColumn(tkey, F.xxhash64("text"))
    source = keyed.where("instr(text, '\n') > 0").select(F.col(doc).alias("doc"), F.col(tkey).alias("tkey"), "text")
    place = F.struct("doc", "tkey", "line")
    repeated = source.mapInArrow(lambda it: _narrow(it, spans), _CHUNKS).groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").select("h", "first")
    repeated = stored(repeated, "repeated")
    # Where few chunks are repeated, the others' bytes never leave their tasks.
    met = source.mapInArrow(lambda it: _carried(it, spans), _CARRIED).join(F.broadcast(repeated) if repeated.count() <= FEW else repeated, "h")
    met = stored(met, "chunks")
    first = met.where(F.array_min("places") == F.col("first")).select("h", F.col("chunk").alias("chunk_")).dropDuplicates(["h"])
    # Byte comparison. Chunks that only share the hash of a first occurrence stay.
    same = met.join(first, "h").where("chunk = chunk_").select("n", "first", F.explode("places").alias("p")).where("p != first")
    marks = same.select("p.doc", "p.tkey", (F.col("p.line").cast("long") * 64 + F.col("n")).alias("m")).groupBy("doc", "tkey").agg(F.collect_set("m").alias(gone))
    without = F.pandas_udf(_without, "string")
    joined = keyed.join(marks.withColumnsRenamed({"doc": doc, "tkey": tkey}), [doc, tkey], "left")
    lines = lambda c: F.coalesce(F.size(F.split(c, "\n", -1)), F.lit(0))
    at = lambda m: F.sequence(F.shiftright(m, 6), F.shiftright(m, 6) + F.pmod(m, F.lit(64)) - 1)
    removed = F.coalesce(F.size(F.array_distinct(F.flatten(F.transform(gone, at)))), F.lit(0)).cast("long")
    kept = [F.when(F.col(gone).isNull(), F.col("text")).otherwise(without("text", gone)).alias("text") if c == "text" else F.col(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(lines("text")).cast("long")
    discard(repeated)
    return joined.select(*kept, n_lines.alias("n_lines"), removed.alias("n_removed"))
