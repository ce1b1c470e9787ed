"""Packing documents into fixed-length token sequences by order-preserving dynamic programming.

Documents in ascending doc_id order form one stream of ids per range partition. Cuts may fall at document ends
(free), after sentence ends, and inside sentences longer than FORCED_GAP. The program chooses the windows of at
most `size` ids with the least padding plus cut penalties; the best earlier cut within reach is the head of a
monotone queue. A window whose length is a power of two needs no padding.

Defined results: a null text is empty (its end id only); order is doc_id, nulls first, then text; repeated rows
are packed each; an empty table gives no pieces; other columns are ignored by `pieces`.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, partitions, pieces_of, text_or_empty

SIZE = 2048
SENTENCE_PENALTY = 6.0
FORCED_PENALTY = 48.0
FORCED_GAP = 256
FORCED_STEP = 64
#: Ids after which a stretch of the stream is cut and passed on, so that memory is bounded.
RUN_IDS = 1 << 20

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def sentence_ends(tokenizer) -> np.ndarray:
    """Per id: does its token end with a full stop, exclamation mark or question mark (or their wide forms)?"""
    table = np.zeros(max(tokenizer.get_vocab().values()) + 1, bool)
    for token, i in tokenizer.get_vocab().items():
        table[i] = token.removesuffix("</w>").endswith((".", "!", "?"))
    return table


def padding(length: int, size: int = SIZE) -> int:
    return 0 if length & (length - 1) == 0 else size - length


def candidates(ends: np.ndarray, sentences: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, ascending and without 0, and what each cut costs."""
    cost = np.full(total + 1, np.inf)
    cost[sentences] = SENTENCE_PENALTY
    cost[ends] = 0.0
    at = np.concatenate([[0], np.flatnonzero(np.isfinite(cost[1:])) + 1, [total]])
    for k in np.flatnonzero(np.diff(at) > FORCED_GAP):
        cost[at[k] + FORCED_STEP : at[k + 1] : FORCED_STEP] = FORCED_PENALTY
    cost[total] = min(cost[total], FORCED_PENALTY)
    where = np.flatnonzero(np.isfinite(cost[1:])) + 1
    return where, cost[where]


def best_cuts(where: np.ndarray, cost: np.ndarray, size: int = SIZE) -> list[int]:
    """Window ends with the least padding plus penalties; gaps between candidates are at most `size`."""
    pos = [0, *where.tolist()]
    pen = [0.0, *cost.tolist()]
    index = {p: i for i, p in enumerate(pos)}
    exact = [1 << k for k in range(size.bit_length()) if size // 8 <= 1 << k < size]
    best, back = [0.0] * len(pos), [0] * len(pos)
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])
    for j in range(1, len(pos)):
        p = pos[j]
        low = p - size
        while queue[0][1] < low:
            queue.popleft()
        value, _, i = queue[0]
        value += size - p
        for k in exact:
            h = index.get(p - k)
            if h is not None and best[h] < value:
                value, i = best[h], h
        value += pen[j]
        best[j], back[j] = value, i
        key = value + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, p, j))
    cuts, j = [], len(pos) - 1
    while j:
        cuts.append(pos[j])
        j = back[j]
    return cuts[::-1]


def tail_cuts(start: int, end: int, size: int = SIZE) -> list[int]:
    """Cuts of the last window: powers of two, as long as they save more padding than they cost."""
    cuts, left, best = [start], end - start, None
    spent = 0.0
    while left:
        whole = spent + padding(left, size)
        if best is None or whole < best[0]:
            best = (whole, [*cuts[1:], end])
        half = 1 << (left.bit_length() - 1)
        if half == left:
            break
        cuts.append(cuts[-1] + half)
        left -= half
        spent += FORCED_PENALTY
    return best[1] if best else []


def _pack(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, size: int, added: bool) -> Iterator[pa.RecordBatch]:
    pieces = pieces_of(tokenizer, added)
    is_end = sentence_ends(pieces.tokenizer)
    is_end = np.append(is_end, [False] * max(0, end_id + 1 - len(is_end)))
    end = np.array([end_id], "<u4").tobytes()
    sequence = TaskContext.get().partitionId() << 40
    # Of the run: per document its row, ids not yet cut (bytes), ids before those, all ids.
    run: list[list] = []
    held = 0

    def cut(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal run, held, sequence
        stream = np.frombuffer(b"".join(r[1] for r in run), "<u4")
        lengths = np.array([len(r[1]) // 4 for r in run], np.int64)
        ends = np.cumsum(lengths)
        where, cost = candidates(ends, np.flatnonzero(is_end[stream]) + 1, len(stream))
        cuts = best_cuts(where, cost, size)
        before = cuts[-2] if len(cuts) > 1 else 0
        if last:
            cuts = [*cuts[:-1], *tail_cuts(before, cuts[-1], size)]
        elif before:
            cuts = cuts[:-1]
        columns: list[list] = [[] for _ in range(7)]
        bounds = np.unique(np.concatenate([[0], cuts, ends[ends <= cuts[-1]]]))
        of_doc = np.searchsorted(ends, bounds[:-1], "right")
        of_cut = np.searchsorted(cuts, bounds[:-1], "right")
        first = [0, *cuts]
        for a, b, d, c in zip(bounds[:-1].tolist(), bounds[1:].tolist(), of_doc.tolist(), of_cut.tolist()):
            row, raw, gone, total = run[d]
            at = a - int(ends[d] - lengths[d])
            piece = raw[4 * at : 4 * (at + b - a)]
            for column, value in zip(columns, (row, gone + at, b - a, zlib.crc32(piece), total, sequence + c, a - first[c])):
                column.append(value)
        sequence += len(cuts)
        left = cuts[-1]
        kept = []
        for r, e, n in zip(run, ends.tolist(), lengths.tolist()):
            if e > left:
                skip = max(0, left - (e - n))
                kept.append([r[0], r[1][4 * skip :], r[2] + skip, r[3]])
        run, held = kept, len(stream) - left
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    for b in batches:
        for doc, ids in zip(b.column("doc_id").to_pylist(), pieces.encode(b.column("text"))):
            ids += end
            run.append([doc, ids, 0, len(ids) // 4])
            held += len(ids) // 4
            if held >= RUN_IDS:
                yield from cut(False)
    if run:
        yield from cut(True)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = SIZE, added: bool = False) -> DataFrame:
    """Pieces of docs(doc_id, text): each id lies in exactly one; offsets in a sequence have no gaps."""
    spark = docs.sparkSession
    arrow_rows(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty())
    ordered = source.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(lambda it: _pack(it, tokenizer, end_id, size, added), PIECES)
