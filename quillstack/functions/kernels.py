"""Functions on Arrow batches: what Spark has no built-in for, and what would repeat itself as one expression."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def mapped(function: Callable[[str | None], object], c: Column, fields: list[str] | None = None) -> Column:
    """A function of one text as a Column: a text, or a struct of texts where fields are named (tuples in their order, or None)."""
    kind = pa.struct([(f, pa.string()) for f in fields]) if fields else pa.string()

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([function(t) for t in texts.to_pylist()], kind)

    return F.arrow_udf(run, f"struct<{', '.join(f'{f}: string' for f in fields)}>" if fields else "string")(c)


def nfc(c: Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return F.pandas_udf(run, "string")(c)


def damerau(a: str, b: str) -> int:
    """Least number of insertions, deletions, substitutions and swaps of neighbours, without editing twice in one place barred."""
    far = len(a) + len(b)
    last: dict[str, int] = {}
    d = {(-1, -1): far}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = far, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = far, j
    for i in range(1, len(a) + 1):
        column = 0
        for j in range(1, len(b) + 1):
            row, col = last.get(b[j - 1], 0), column
            same = a[i - 1] == b[j - 1]
            if same:
                column = j
            d[i, j] = min(d[i - 1, j - 1] + (not same), d[i, j - 1] + 1, d[i - 1, j] + 1, d[row - 1, col - 1] + (i - row - 1) + 1 + (j - col - 1))
        last[a[i - 1]] = i
    return d[len(a), len(b)]


def edit_distance(a: Column, b: Column) -> Column:
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], int] = {}
        return pd.Series([known.setdefault(k, damerau(*k)) if k not in known else known[k] for k in zip(x, y)], dtype="int64")

    return F.pandas_udf(run, "long")(a, b)
