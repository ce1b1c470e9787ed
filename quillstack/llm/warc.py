"""WARC archives: writing with revisits, reading with boundary-chain verification.

Archives are plain files of WARC/1.1 records back to back, one file for each task that writes. Spark's text writer makes
them, a record a row and the record's closing blank lines as the row's end, so any store that Spark writes to works.
Which of equal payloads is the response is decided on (page_id, digest, length) alone: payloads are never dealt by digest.

Reading: tasks take byte ranges of the files, cut at the record magic wherever it stands, payloads included. Every
piece that begins with a header is a candidate with the offset of its successor. Inside its range each candidate's chain
is followed to the first offset beyond the range; pointer jumping over those offsets, from offset 0 of each file, finds
where the true chain enters each range, and only candidates on it are records. A record whose payload holds the magic
spans several pieces: its payload is put together again to verify the digest.

Defined results: a null html is an empty payload; among equal payloads of at least `min_bytes` bytes the one with
the largest page_id (nulls smallest) is the response; rows that repeat that page_id, and rows of a null page_id
beside it, are: equal page_id as the response -> response, else revisit. A null url is written as no target. An
empty table gives no records. Payloads of any length and with any content are read back whole. Other columns are
ignored, whatever their names. A file whose chain breaks off, or a payload that differs from its digest, is an error.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import FEW, arrow_rows, discard, partitions, stored, work_dir

MAGIC = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
#: A header is looked for in so many bytes; written ones are far shorter.
HEAD_BYTES = 1 << 16
#: Step in which spans of bytes are matched.
STEP = 1 << 20
_NAME = re.compile(rb"(?m)^([\x21-\x39\x3b-\x7e]+): *(.*?)\r$")

RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
#: at and exit count from where the pieces of a range begin; a row without a size gives the range's bytes in `at`.
_FOUND = "path string, block long, at long, size long, head long, exit long, intact boolean, " + RECORDS
_FIELDS = [f.split(" ")[0] for f in _FOUND.split(", ")]


# --- writing ------------------------------------------------------------------------------------------------


def base32(hexed: Column) -> Column:
    """Base32 of a hexadecimal SHA-1: 20 bits at a time, digits of base 32 renamed."""
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * g, 5), 16, 32), 4, "0") for g in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _one_line(url: Column) -> Column:
    """White space and control characters as %XX."""
    escaped = F.transform(F.split(url, ""), lambda c: F.when((c <= " ") | (c == "\x7f"), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c))
    return F.when(url.rlike(r"[\x00-\x20\x7f]"), F.array_join(escaped, "")).otherwise(url)


def _record() -> Column:
    """A row (page_id, url, html, digest, length, response_id) as a record without its closing blank lines."""
    revisit = F.col("response_id").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    profile = F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    payload = F.when(revisit, "").otherwise(F.col("html"))
    return F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), text("page_id"), F.lit(">"))),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("digest")))),
        line("X-Payload-Length", text("length")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        F.coalesce(line("WARC-Target-URI", _one_line(F.col("url"))), F.lit("")),
        F.when(revisit, F.concat(line("WARC-Profile", profile), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), text("response_id"), F.lit(">"))))).otherwise(""),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(text("length"))),
        F.lit("\r\n"),
        payload,
    )


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Archives of pages(page_id, url, html) in the folder `path`."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("length", F.octet_length("html").cast("long"))
    narrow = rows.select("page_id", "digest", "length")
    largest = F.max("page_id").alias("response_id")
    # Written first, so that the join below is one that Spark splits where many pages share a digest.
    groups = stored(narrow.groupBy("digest", "length").agg(largest, F.count(F.lit(1)).alias("n")).where(f"n > 1 and response_id is not null and length >= {min_bytes}").drop("n"), "digests")
    revisits = stored(narrow.join(groups, ["digest", "length"]).where("not page_id <=> response_id").distinct(), "revisits")
    n = revisits.count()
    if not n:
        typed = rows.withColumn("response_id", F.lit(None).cast("long"))
    else:
        r = revisits.withColumnsRenamed({"page_id": "p", "digest": "d", "length": "l"})
        same = F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")) & (F.col("length") == F.col("l"))
        typed = rows.join(F.broadcast(r) if n <= FEW else r, same, "left")
    typed.select(_record().alias("value")).write.option("lineSep", END.decode()).text(path)
    discard(groups, revisits)


# --- reading ------------------------------------------------------------------------------------------------


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, piece): what stands between magics, by the byte range that reads it, in order."""
    rows = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("piece"))


def header(piece: bytes) -> tuple[int, dict[bytes, bytes]] | None:
    """Where the header that a piece begins with ends, and its fields; None without a length."""
    head = piece.find(END, 0, HEAD_BYTES)
    if head < 0:
        return None
    fields = {name.lower(): value for name, value in _NAME.findall(piece, 0, head + 2)}
    return (head, fields) if fields.get(b"content-length", b"").isdigit() else None


def _id(field: bytes) -> int | None:
    inner = field.removeprefix(b"<urn:page:").removesuffix(b">")
    return int(inner) if inner.removeprefix(b"-").isdigit() else None


def candidate(piece: bytes) -> tuple | None:
    """Of a piece behind a magic: bytes to the successor, header's end, is the payload there and as its digest says, and the fields.

    A payload that goes on behind another magic is neither there nor missing: None.
    """
    found = header(piece)
    if found is None:
        return None
    head, fields = found
    length = int(fields[b"content-length"])
    size = len(MAGIC) + head + 2 * len(END) + length
    kind, digest = fields.get(b"warc-type", b"").decode("latin-1"), fields.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode("latin-1")
    declared = fields.get(b"x-payload-length", b"")
    declared = int(declared) if declared.isdigit() else -1
    intact = None
    if size <= len(MAGIC) + len(piece):
        payload = piece[head + 4 : head + 4 + length]
        whole = size == len(MAGIC) + len(piece) and piece.endswith(END)
        intact = whole and (kind == "revisit" or len(payload) == declared and base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest)
    return size, head, intact, _id(fields.get(b"warc-record-id", b"")), declared, digest, kind, _id(fields.get(b"warc-refers-to", b"")) if kind == "revisit" else None


def exits(at: list[int], size: list[int], total: int) -> list[int | None]:
    """Where each candidate's chain first leaves the `total` bytes of its range; None where no candidate follows."""
    place, out = {a: k for k, a in enumerate(at)}, [None] * len(at)
    for k in range(len(at) - 1, -1, -1):
        after = at[k] + size[k]
        out[k] = after if after >= total else out[place[after]] if after in place else None
    return out


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    key, at, found = None, 0, []

    def out() -> Iterator[pa.RecordBatch]:
        leave = exits([r[0] for r in found], [r[1] for r in found], at)
        rows = [(*key, r[0], r[1], r[2], e, *r[3:]) for r, e in zip(found, leave)] + [(*key, at, *[None] * 9)]
        for k in range(0, len(rows), 2000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 2000]), types)], names=_FIELDS)

    for b in batches:
        for path, block, piece in zip(*(b.column(k).to_pylist() for k in ("path", "block", "piece"))):
            if (path, block) != key:
                if key is not None:
                    yield from out()
                key, at, found = (path, block), 0, []
                if block == 0:  # what stands before the first magic
                    at = len(piece)
                    continue
            if (one := candidate(piece)) is not None:
                found.append((at, *one))
            at += len(MAGIC) + len(piece)
    if key is not None:
        yield from out()


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of candidates in order, those on the chain from where it enters their range."""
    key, expected = None, None
    for b in batches:
        on = []
        for n, (path, block, enter, at, size, intact) in enumerate(zip(*(b.column(k).to_pylist() for k in ("path", "block", "enter", "at", "size", "intact")))):
            if (path, block) != key:
                key, expected = (path, block), enter
            if at == expected:
                if intact is False:
                    raise ValueError(f"{path}: a payload differs from its digest")
                on.append(n)
                expected = at + size
        yield b.take(pa.array(on, pa.int64()))


def entries(found: DataFrame, begins: DataFrame) -> DataFrame:
    """(path, block, enter): the first record of each range, by pointer jumping over the ranges of a file.

    found has candidates with offsets in their file in `at` and `exit`; begins has each file's ranges and its size.
    """
    ends = begins.groupBy("path").agg(F.max("stop").alias("stop")).where("stop > 0")
    goals = found.where("exit is not null").select("path", F.col("exit").alias("at")).union(ends.select("path", F.lit(0).cast("long"))).distinct()
    # Only candidates that some chain enters from outside their range: about one a range.
    nodes = stored(found.select("path", "block", "at", "exit").join(goals, ["path", "at"]), "nodes")
    jump = nodes.select("path", "at", "exit")
    reached = ends.select("path", F.lit(0).cast("long").alias("at"))
    old: list[DataFrame] = []
    while True:
        hop = reached.join(jump.where("exit is not null"), ["path", "at"]).select("path", F.col("exit").alias("at"))
        reached = stored(reached.union(hop).distinct(), "reached")
        next_ = jump.select("path", F.col("at").alias("exit"), F.col("exit").alias("then"), F.lit(True).alias("met"))
        doubled = stored(jump.join(next_, ["path", "exit"], "left").select("path", "at", F.when(F.col("met"), F.col("then")).otherwise(F.col("exit")).alias("exit"), "met"), "jumps")
        old += [reached, doubled]
        if doubled.where("met").isEmpty():
            break
        jump = doubled.drop("met")
    lost = ends.join(reached, (ends.path == reached.path) & (reached.at == ends.stop), "left_anti").first()
    if lost is not None:
        raise ValueError(f"{lost['path']}: the chain of records breaks off")
    out = stored(nodes.join(reached, ["path", "at"], "left_semi").select("path", "block", F.col("at").alias("enter")), "entries")
    discard(nodes, *old)
    return out


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records put together from pieces in order: is each payload as its digest says?"""
    last, state = None, None

    def fits() -> bool:
        return state[1] == 0 and state[0].digest() == base64.b32decode(state[2])

    for b in batches:
        done = []
        for path, record, at, head, length, digest, piece in zip(*(b.column(k).to_pylist() for k in ("path", "record", "at", "head", "length", "digest", "piece"))):
            if (path, record) != last:
                if last is not None:
                    done.append(fits())
                last, state = (path, record), [hashlib.sha1(), length, digest]
            part = (piece[head + 4 :] if at == record else MAGIC + piece)[: state[1]]
            state[0].update(part)
            state[1] -= len(part)
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.bool_())], names=["fits"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([fits()], pa.bool_())], names=["fits"])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with where their magics stand, counted from where the pieces of the range begin."""
    key, at = None, 0
    for b in batches:
        places = []
        for path, block, piece in zip(*(b.column(k).to_pylist() for k in ("path", "block", "piece"))):
            new = (path, block) != key
            if new:
                key, at = (path, block), 0
            first = new and block == 0
            places.append(None if first else at)
            at += len(piece) + (0 if first else len(MAGIC))
        yield pa.RecordBatch.from_arrays([b.column("path"), b.column("block"), pa.array(places, pa.int64()), b.column("piece")], names=["path", "block", "at", "piece"])


def _verify_spans(spark: SparkSession, path: str, spans: DataFrame, begins: DataFrame) -> None:
    """spans(path, record, stop, head, length, digest): records whose payloads hold the magic."""
    n = spans.count()
    if not n:
        return
    steps = spans.withColumn("step", F.explode(F.sequence(F.floor(F.col("record") / STEP), F.floor((F.col("stop") - 1) / STEP))))
    placed = pieces(spark, path).mapInArrow(_placed, "path string, block long, at long, piece binary").where("at is not null")
    placed = placed.join(begins.select("path", "block", "begin"), ["path", "block"]).withColumn("at", F.col("begin") + F.col("at")).withColumn("step", F.floor(F.col("at") / STEP))
    met = placed.join(F.broadcast(steps) if n <= FEW else steps, ["path", "step"]).where("at >= record and at < stop")
    ordered = met.repartition(partitions(spark), "path", "record").sortWithinPartitions("path", "record", "at")
    good = ordered.select("path", "record", "at", "head", "length", "digest", "piece").mapInArrow(_joined, "fits boolean").where("fits").count()
    if good != n:
        raise ValueError("a payload differs from its digest")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives in the folder `path`."""
    arrow_rows(spark)
    found = stored(pieces(spark, path).mapInArrow(_candidates, _FOUND), "candidates")
    # One row for each byte range.
    before = F.sum("at").over(Window.partitionBy("path").orderBy("block"))
    begins = stored(found.where("size is null").select("path", "block", (before - F.col("at")).alias("begin"), before.alias("stop")), "ranges")
    placed = found.where("size is not null").join(begins.select("path", "block", "begin"), ["path", "block"])
    enter = entries(placed.select("path", "block", (F.col("begin") + F.col("at")).alias("at"), (F.col("begin") + F.col("exit")).alias("exit")), begins)
    ranged = placed.join(enter, ["path", "block"]).withColumn("enter", F.col("enter") - F.col("begin"))
    ordered = ranged.select(*_FIELDS, "begin", "enter").repartition(partitions(spark), "path", "block").sortWithinPartitions("path", "block", "at")
    records = stored(ordered.mapInArrow(_walk, _FOUND + ", begin long, enter long"), "records")
    start = F.col("begin") + F.col("at")
    spans = records.where("intact is null").select("path", start.alias("record"), (start + F.col("size")).alias("stop"), "head", F.col("payload_bytes").alias("length"), F.col("payload_digest").alias("digest"))
    _verify_spans(spark, path, spans, begins)
    discard(found, begins, enter)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    path = work_dir(pages.sparkSession, "warc")
    write_archives(pages, path, min_bytes)
    return read_archives(pages.sparkSession, path)
