"""Removal of repeated word windows by super-k-mer partitioning.

Words are [^\\x20\\x09-\\x0D]+ of the text as it is; a window is WIDTH consecutive words. The minimiser of a window
is the least hash among its runs of MER words. Consecutive windows that share a minimiser travel as one packed
string to the minimiser's bucket, where all windows are sorted and compared word by word.

Before that each task sorts the windows of its own stretch of documents: of equal windows only those of the
smallest doc_id travel, the others are marked at once. So a passage that a third of all documents hold reaches
its bucket once per stretch, not once per document. The number of buckets and partitions follows the size of the
text. A bucket of over BUCKET_MOST bytes (many different windows around one hot minimiser) is not sorted in one
task: its windows go on, each by itself, to buckets dealt by the hash of the whole window.

Defined results: a null text has no words; a null doc_id counts as larger than all others and two nulls as
equal; rows that repeat a doc_id don't mark each other; an empty table gives no rows; other columns are ignored,
whatever their names. Texts of fewer than WIDTH words are kept whole. A text of any length is one row of its stretch.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE_A, arrow_rows, binary_array, partitions, rolling, stored, with_several

WIDTH = 13
MER = 4
#: Words in a stretch that a task sorts by itself; bytes of packed text that a bucket should get, and most it may.
STRETCH_WORDS = 700_000
BUCKET_BYTES, BUCKET_MOST = 8 << 20, 32 << 20
LAST = (1 << 63) - 1

#: nth tells the texts of a repeated doc_id apart and is 0 for all others.
_MARKS = "bucket long, doc long, nth long, data binary"
_STARTS = "bucket long, doc long, nth long, data binary"
REMOVED = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_NAMES = ["bucket", "doc", "nth", "data"]


def numbered(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """An exact number for each word, equal for equal words only, and a 64-bit hash for each."""
    numbers: dict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, len(numbers))
    return ids, hashes[ids] if len(ids) else np.empty(0, np.uint64)


def grouped(ids: np.ndarray, windows: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of `starts` in which equal windows (of hashes `windows`) stand together, and where each group begins."""
    key = windows[starts]
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(order), bool)
    new[1:] = key[1:] != key[:-1]
    after = np.flatnonzero(~new)
    x, y = starts[order[after]], starts[order[after - 1]]
    for k in range(WIDTH):
        if not (ids[x + k] == ids[y + k]).all():  # two hashes collide: sort by the words themselves
            rank = np.unique(np.stack([ids[starts + j] for j in range(WIDTH)]), axis=1, return_inverse=True)[1].reshape(-1)
            order = np.argsort(rank, kind="stable")
            new[1:] = rank[order[1:]] != rank[order[:-1]]
            break
    return order, np.flatnonzero(new)


def minimisers(hashes: np.ndarray) -> np.ndarray:
    """Per window the least hash of its runs of MER words."""
    least = rolling(hashes, MER, BASE_A)
    span, have = WIDTH - MER + 1, 1
    while have < span:
        step = min(have, span - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    return least


def _spans(doc: np.ndarray, nth: np.ndarray, at: np.ndarray) -> Iterator[tuple[None, int, int, bytes]]:
    """Marked windows of each document as pairs of the first start and the number of starts in a row."""
    if not len(doc):
        return
    order = np.lexsort((at, nth, doc))
    d, t, p = doc[order], nth[order], at[order]
    other = np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1])])
    runs = np.flatnonzero(other | np.concatenate([[True], p[1:] != p[:-1] + 1]))
    pairs = np.stack([p[runs], np.diff(np.append(runs, len(p)))], axis=1).astype("<i4")
    edges = np.append(np.flatnonzero(other[runs]), len(runs))
    for a, b in zip(edges[:-1], edges[1:]):
        yield None, int(d[runs[a]]), int(t[runs[a]]), pairs[a:b].tobytes()


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=_NAMES)


def _planes(x: np.ndarray, kind: str) -> bytes:
    """The bytes of `x` by significance, which packs better than number by number."""
    return x.astype(kind).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _unplanes(raw: bytes, kind: str, n: int, at: int) -> np.ndarray:
    size = int(kind[-1])
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).reshape(-1).astype(np.int64)


_KINDS = ("<i8", "<i8", "<i4", "<i4")


def packed(pack, columns: list[np.ndarray], text: bytes) -> bytes:
    """Documents (as steps), nth, places and numbers of words of some super-k-mers, and their words."""
    n = len(columns[0])
    steps = np.diff(columns[0], prepend=np.int64(0))
    return pack(b"".join([np.array([n], "<i8").tobytes(), *(_planes(c, k) for c, k in zip([steps, *columns[1:]], _KINDS)), text]))


def unpacked(raw: bytes) -> tuple[list[np.ndarray], list[bytes]]:
    n, at, columns = int(np.frombuffer(raw, "<i8", 1)[0]), 8, []
    for kind in _KINDS:
        columns.append(_unplanes(raw, kind, n, at))
        at += n * int(kind[-1])
    columns[0] = np.cumsum(columns[0])
    return columns, raw[at:].split(b" ")


def _dealt(pack, bucket: np.ndarray, columns: list[np.ndarray], begin: np.ndarray, words: list[bytes]) -> Iterator[pa.RecordBatch]:
    """A packed string per bucket of stretches of `words`; the last of columns is their numbers of words."""
    by = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(bucket[by]) != 0, [True]]))
    for a, b in zip(cuts[:-1], cuts[1:]):
        some = by[a:b]
        text = b" ".join([b" ".join(words[s : s + n]) for s, n in zip(begin[some].tolist(), columns[-1][some].tolist())])
        yield _rows([(int(bucket[some[0]]), None, None, packed(pack, [c[some] for c in columns], text))])


def _scatter(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, int, list[bytes]]] = []
    size = 0
    pack = zstandard.ZstdCompressor(level=3).compress

    def flush() -> Iterator[pa.RecordBatch]:
        held.sort(key=lambda r: r[0])
        words = [w for _, _, ws in held for w in ws]
        counts = np.array([len(ws) for _, _, ws in held])
        begin = np.cumsum(counts) - counts
        # Windows of each document, by position in `words`.
        own = np.maximum(counts - WIDTH + 1, 0)
        starts = np.repeat(begin - (np.cumsum(own) - own), own) + np.arange(own.sum())
        if not len(starts):
            return
        row = np.repeat(np.arange(len(held)), own)
        doc, key = np.array([r[0] for r in held], np.int64)[row], np.array([r[1] for r in held], np.int64)[row]
        at = starts - begin[row]
        ids, hashes = numbered(words)
        order, first = grouped(ids, rolling(hashes, WIDTH, BASE_A), starts)
        least = np.minimum.reduceat(doc[order], first)
        sizes = np.diff(np.append(first, len(order)))
        marked = np.empty(len(order), bool)
        marked[order] = doc[order] > np.repeat(least, sizes)
        out = [(d % buckets, d, t, data) for _, d, t, data in _spans(doc[marked], key[marked], at[marked])]
        for k in range(0, len(out), 1000):
            yield _rows(out[k : k + 1000])
        go = np.flatnonzero(~marked)
        if not len(go):
            return
        mini = minimisers(hashes)[starts[go]]
        new = np.ones(len(go), bool)
        new[1:] = (starts[go[1:]] != starts[go[:-1]] + 1) | (mini[1:] != mini[:-1])
        runs = np.flatnonzero(new)
        lengths = np.diff(np.append(runs, len(go))) + WIDTH - 1
        bucket = (mini[runs] % np.uint64(buckets)).astype(np.int64)
        g = go[runs]
        yield from _dealt(pack, bucket, [doc[g], key[g], at[g], lengths], starts[g], words)

    for b in batches:
        for doc, key, text in zip(*(b.column(k).to_pylist() for k in ("doc", "nth", "text"))):
            words = text.encode("utf-8", "surrogatepass").split()
            if len(words) >= WIDTH:
                held.append((doc, key, words))
                size += len(words)
                if size >= STRETCH_WORDS:
                    yield from flush()
                    held, size = [], 0
    if held:
        yield from flush()


def _windows(blobs: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of some packed strings, where their windows start there, and each window's document, nth and place."""
    unpack = zstandard.ZstdDecompressor().decompress
    parts, words = [], []
    for blob in blobs:
        columns, some = unpacked(unpack(blob))
        parts.append(columns)
        words += some
    docs, keys, ats, lengths = (np.concatenate(c) for c in zip(*parts))
    own = lengths - WIDTH + 1
    begin = np.cumsum(lengths) - lengths
    inside = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
    return words, np.repeat(begin, own) + inside, np.repeat(docs, own), np.repeat(keys, own), np.repeat(ats, own) + inside


def _bucket(blobs: list[bytes]) -> list[tuple[None, int, int, bytes]]:
    """Marks of one bucket: windows whose words also start in a document with a smaller doc_id."""
    words, starts, doc, key, at = _windows(blobs)
    ids, hashes = numbered(words)
    del words
    order, first = grouped(ids, rolling(hashes, WIDTH, BASE_A), starts)
    least = np.minimum.reduceat(doc[order], first)
    marked = order[doc[order] > np.repeat(least, np.diff(np.append(first, len(order))))]
    return list(_spans(doc[marked], key[marked], at[marked]))


def _passed_on(blob: bytes, buckets: int, pack) -> Iterator[pa.RecordBatch]:
    """The windows of a packed string, one by one, to buckets by the hash of the whole window."""
    words, starts, doc, key, at = _windows([blob])
    bucket = (rolling(numbered(words)[1], WIDTH, BASE_A)[starts] % np.uint64(buckets)).astype(np.int64)
    yield from _dealt(pack, bucket, [doc, key, at, np.full(len(starts), WIDTH, np.int64)], starts, words)


def _gather(batches: Iterator[pa.RecordBatch], buckets: int | None) -> Iterator[pa.RecordBatch]:
    """Marks, and with `buckets` the windows of buckets that are too large, dealt anew to so many."""
    pack = zstandard.ZstdCompressor(level=3).compress
    bucket, blobs, size = None, [], 0
    for b in batches:
        through: list[tuple] = []
        for k, doc, key, data in zip(*(b.column(n).to_pylist() for n in _NAMES)):
            if doc is not None:
                through.append((None, doc, key, data))
                continue
            if k != bucket:
                through += _bucket(blobs) if blobs else []
                bucket, blobs, size = k, [], 0
            size += zstandard.frame_content_size(data)
            blobs.append(data)
            if buckets and size > BUCKET_MOST:  # from now on each string of this bucket goes on
                for blob in blobs:
                    yield from _passed_on(blob, buckets, pack)
                blobs = []
        for at in range(0, len(through), 2000):
            yield _rows(through[at : at + 2000])
    rest = _bucket(blobs) if blobs else []
    for at in range(0, len(rest), 2000):
        yield _rows(rest[at : at + 2000])


def _remove(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.string()] * with_text
    for b in batches:
        rows = []
        for doc, text, marks in zip(*(b.column(n).to_pylist() for n in ("doc_id", "text", "marks"))):
            words = text.encode("utf-8", "surrogatepass").split()
            n = len(words)
            if marks:
                first, some = np.frombuffer(b"".join(marks), "<i4").reshape(-1, 2).T
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, first, 1)
                np.add.at(edge, first + some - 1 + WIDTH, -1)
                words = [w for w, c in zip(words, np.cumsum(edge).tolist()) if not c]
            kept = b" ".join(words)
            row = (doc, n, n - len(words), hashlib.sha256(kept).hexdigest())
            rows.append((*row, kept.decode("utf-8", "surrogatepass")) if with_text else row)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names=names)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, doc (never null) and nth, the hash of the text where a doc_id has several texts, else 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("doc", F.coalesce("doc_id", F.lit(LAST)))
    return with_several(rows, "doc")[0].withColumn("nth", F.when(F.col("several"), F.xxhash64("text")).otherwise(F.lit(0))).drop("several")


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Per document its words, how many of them repeated windows cover, and the rest's digest (and text)."""
    spark = docs.sparkSession
    arrow_rows(spark)
    rows = _keyed(docs)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(partitions(spark), -(-3 * total // BUCKET_BYTES))
    tasks = partitions(spark, 3 * total)
    sent = rows.select("doc", "nth", "text").mapInArrow(lambda it: _scatter(it, buckets), _MARKS)
    found = stored(sent.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: _gather(it, 64 * buckets), _STARTS), "marks")
    again = found.where("doc is null").repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: _gather(it, None), _STARTS)
    marks = found.where("doc is not null").union(again).groupBy("doc", "nth").agg(F.collect_list("data").alias("marks"))
    return rows.join(marks, ["doc", "nth"], "left").select("doc_id", "text", "marks").mapInArrow(lambda it: _remove(it, with_text), REMOVED + ", kept string" * with_text)
