"""Token ids in Huffman-coded files.

Texts are tokenized in ascending doc_id order into blocks of whole documents. Id counts over the whole corpus
give one canonical, length-limited Huffman code. Each block is then written as one self-contained binary record:
header, directory (doc_id, number of ids), a bit offset for every STRIDE-th id, and the bit stream. Any block can
be decoded alone, and a table lookup decodes all its STRIDE-long runs side by side.

Defined results: a null text is the empty text (end id only); rows are ordered by doc_id, nulls first, then text;
repeated rows are kept, each with its own ids; an empty table gives empty files; other columns are ignored. A
document longer than BLOCK_IDS is a block of its own.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, binary_array, drop_path, partitions, pieces_of, text_or_empty, work_dir

BLOCK_IDS = 1 << 18
STRIDE = 64
LIMIT = 18
MAGIC = b"QSHF\x01"

#: The last row of a shard also has the counts of all ids of the shard.
_STAGED = "shard int, shard_start long, doc_ids array<long>, lengths array<long>, ids binary, used array<int>, counts array<long>"
_CODED = "shard int, start long, block binary"
DECODED = "doc_id long, start long, n_tokens long, ids_crc32 long"


# --- code ---------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits (package-merge); 0 for ids that never occur."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    limit = max(limit, int(np.ceil(np.log2(n))))
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    level, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        m = len(level) // 2
        both = np.concatenate([leaves, level[: 2 * m : 2] + level[1 : 2 * m : 2]])
        by = np.argsort(both, kind="stable")
        level = both[by]
        is_leaf.append(by < n)
    take = 2 * n - 2
    for flags in reversed(is_leaf):
        k = int(flags[:take].sum())
        lengths[order[:k]] += 1
        take = 2 * (take - k)
    return lengths


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Codes per id, and the decoding table: symbol and length for every `width`-bit prefix."""
    width = max(int(lengths.max(initial=1)), 1)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    span = np.left_shift(1, width - lengths[order].astype(np.int64))
    first = np.concatenate([[0], np.cumsum(span)])
    codes = np.zeros(len(lengths), np.uint64)
    codes[order] = (first[:-1] >> (width - lengths[order].astype(np.int64))).astype(np.uint64)
    symbols = np.zeros(1 << width, np.uint32)
    symbols[: first[-1]] = np.repeat(order.astype(np.uint32), span)
    sizes = np.ones(1 << width, np.uint8)
    sizes[: first[-1]] = np.repeat(lengths[order], span)
    return codes, symbols, sizes, width


def encode_block(ids: np.ndarray, doc_ids: list, counts: np.ndarray, start: int, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    bits = int(ends[-1]) if len(ends) else 0
    words = bits // 32 + 2
    value = codes[ids] << (64 - (at & 31) - size).astype(np.uint64)
    where = at >> 5
    out = np.bincount(where, (value >> np.uint64(32)).astype(np.float64), words)
    out += np.bincount(where + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), words)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    head = struct.pack("<5sqqqq", MAGIC, start, len(doc_ids), len(ids), bits)
    ids64 = np.array([0 if d is None else d for d in doc_ids], "<i8")
    return b"".join([head, known.tobytes(), ids64.tobytes(), counts.astype("<i8").tobytes(), at[::STRIDE].astype("<i8").tobytes(), out.astype(">u4").tobytes()])


def decode_block(block: bytes, symbols: np.ndarray, sizes: np.ndarray, width: int) -> tuple[int, list, np.ndarray, np.ndarray]:
    """start, doc_ids, ids per document, all ids."""
    magic, start, docs, n, _ = struct.unpack_from("<5sqqqq", block)
    if magic != MAGIC:
        raise ValueError("not a block of this format")
    at = struct.calcsize("<5sqqqq")
    known = np.frombuffer(block, np.uint8, docs, at)
    ids64 = np.frombuffer(block, "<i8", docs, at := at + docs)
    counts = np.frombuffer(block, "<i8", docs, at := at + 8 * docs)
    lanes = -(-n // STRIDE)
    position = np.frombuffer(block, "<i8", lanes, at := at + 8 * docs).copy()
    stream = np.frombuffer(block, np.uint8, -1, at + 8 * lanes).astype(np.uint32)
    stream = np.concatenate([stream, np.zeros(STRIDE * 4 + 8, np.uint32)])
    windows = (stream[:-3] << 24) | (stream[1:-2] << 16) | (stream[2:-1] << 8) | stream[3:]
    out = np.empty((STRIDE, lanes), np.uint32)
    shift, mask, last = 32 - width, (1 << width) - 1, len(windows) - 1
    for k in range(STRIDE):
        w = windows[np.minimum(position >> 3, last)].astype(np.int64)
        key = (w >> (shift - (position & 7))) & mask
        out[k] = symbols[key]
        position += sizes[key]
    return start, [int(d) if k else None for d, k in zip(ids64, known)], counts, out.T.reshape(-1)[:n]


# --- Spark --------------------------------------------------------------------------------------------------


def _stage(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, added: bool) -> Iterator[pa.RecordBatch]:
    pieces, shard, done = pieces_of(tokenizer, added), TaskContext.get().partitionId(), 0
    end = np.array([end_id], "<u4").tobytes()
    total = np.zeros(max(pieces.vocabulary(), end_id + 1), np.int64)
    wide = len(total) > 1 << 16
    docs: list = []
    held: list[bytes] = []
    size = 0

    def flush(last: bool = False) -> pa.RecordBatch:
        nonlocal docs, held, size, done, total
        lengths = [len(x) // 4 for x in held]
        ids = np.frombuffer(b"".join(held), "<u4")
        total += np.bincount(ids, minlength=len(total))
        used = np.flatnonzero(total)
        row = pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([done], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), binary_array([ids.astype("<u4" if wide else "<u2").tobytes()]), pa.array([used if last else None], pa.list_(pa.int32())), pa.array([total[used] if last else None], pa.list_(pa.int64()))],
            names=["shard", "shard_start", "doc_ids", "lengths", "ids", "used", "counts"],
        )
        done += size
        docs, held, size = [], [], 0
        return row

    for b in batches:
        for doc, ids in zip(b.column("doc_id").to_pylist(), pieces.encode(b.column("text"))):
            n = len(ids) // 4 + 1
            if size and size + n > BLOCK_IDS:
                yield flush()
            docs.append(doc)
            held.append(ids + end)
            size += n
    if docs:
        yield flush(last=True)


def write_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, added: bool = False) -> None:
    """Tokenize docs(doc_id, text) and write `path`/blocks and `path`/codebook."""
    spark = docs.sparkSession
    arrow_rows(spark)
    vocabulary = max(pieces_of(tokenizer, added).vocabulary(), end_id + 1)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty())
    ordered = source.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    staged_path = f"{path}/staged"
    ordered.mapInArrow(lambda it: _stage(it, tokenizer, end_id, added), _STAGED).write.option("compression", "zstd").parquet(staged_path)
    staged = spark.read.schema(_STAGED).parquet(staged_path)
    # One row per id and shard at most, then one per id: bounded by the vocabulary.
    counted = staged.where("used IS NOT NULL").select(F.explode(F.map_from_arrays("used", "counts")).alias("id", "n")).groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(vocabulary, np.int64)
    counts[counted["id"].to_numpy()] = counted["n"].to_numpy()
    lengths = code_lengths(counts)
    codes = canonical(lengths)[0]
    # One row per shard: bounded by the number of partitions.
    totals = staged.groupBy("shard").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).orderBy("shard").collect()
    offsets, at = {}, 0
    for row in totals:
        offsets[row["shard"]] = at
        at += row["n"]
    wide = vocabulary > 1 << 16

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, begin, doc_ids, sizes, ids in zip(*(b.column(k) for k in range(5))):
                start = offsets[shard.as_py()] + begin.as_py()
                values = np.frombuffer(ids.as_buffer(), "<u4" if wide else "<u2")
                block = encode_block(values, doc_ids.as_py(), np.array(sizes.as_py(), np.int64), start, codes, lengths)
                yield pa.RecordBatch.from_arrays([pa.array([shard.as_py()], pa.int32()), pa.array([start], pa.int64()), binary_array([block])], names=["shard", "start", "block"])

    staged.mapInArrow(code, _CODED).write.option("compression", "none").parquet(f"{path}/blocks")
    used = np.flatnonzero(lengths)
    book = [(int(i), int(lengths[i])) for i in used]
    spark.createDataFrame(book, "id int, length int").coalesce(1).write.parquet(f"{path}/codebook")
    drop_path(spark, staged_path)


def read_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document: where it starts, its number of ids, their crc32, and the ids if asked for."""
    book = spark.read.parquet(f"{path}/codebook").toPandas()  # bounded by the vocabulary
    lengths = np.zeros(int(book["id"].max()) + 1 if len(book) else 1, np.uint8)
    lengths[book["id"].to_numpy()] = book["length"].to_numpy()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, symbols, sizes, width = canonical(lengths)
        for b in batches:
            for block in b.column("block"):
                start, docs, counts, ids = decode_block(block.as_buffer().to_pybytes(), symbols, sizes, width)
                ends = np.cumsum(counts)
                raw = ids.astype("<u4").tobytes()
                parts = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends, counts)]
                columns = [pa.array(docs, pa.int64()), pa.array(start + ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + ([binary_array(parts)] if with_ids else []), names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    blocks = spark.read.schema(_CODED).parquet(f"{path}/blocks").select("block")
    return blocks.mapInArrow(decode, DECODED + ", ids binary" * with_ids)


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 0, added: bool = False) -> DataFrame:
    """Write docs as token files in a fresh shared folder and read them back."""
    path = work_dir(docs.sparkSession, "token-files")
    write_files(docs, path, tokenizer, end_id, added)
    return read_files(docs.sparkSession, path)
