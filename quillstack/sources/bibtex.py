"""BibTeX: one row per entry with key, kind, fields and authors. A pass over each text; braces may nest."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTRIES = "doc_id long, ord int, key string, type string, fields map<string,string>, authors array<string>"
_HEAD = re.compile(r"@\s*(\w+)\s*\{\s*([^,\s}]+)\s*,?")
_NAME = re.compile(r"[\s,]*([A-Za-z][\w-]*)\s*=\s*")


def _value(text: str, at: int) -> tuple[str, int]:
    """The value at a place, parts joined by #, and the place behind it."""
    out = []
    while at < len(text):
        if text[at] in '{"':
            depth, k = (1, at + 1) if text[at] == "{" else (0, at + 1)
            quoted = text[at] == '"'
            while k < len(text) and not (quoted and text[k] == '"' and depth == 0):
                depth += {"{": 1, "}": -1}.get(text[k], 0)
                if not quoted and depth == 0:
                    break
                k += 1
            out.append(text[at + 1 : k])
            at = k + 1
        else:
            m = re.compile(r"[^\s,}#]*").match(text, at)
            out.append(m.group(0))
            at = m.end()
        m = re.compile(r"\s*#\s*").match(text, at)
        if not m:
            break
        at = m.end()
    return re.sub(r"\s+", " ", "".join(out)).strip(), at


def parse(text: str) -> list[tuple[str, str, dict[str, str], list[str]]]:
    """(key, kind, fields, authors); comments, preambles and strings are no entries."""
    found = []
    at = 0
    while m := _HEAD.search(text, at):
        at = m.end()
        if m.group(1).lower() in ("comment", "preamble", "string"):
            continue
        fields: dict[str, str] = {}
        while name := _NAME.match(text, at):
            value, at = _value(text, name.end())
            fields.setdefault(name.group(1).lower(), value)
        people = [p for p in re.split(r"\s+and\s+", fields.get("author", "")) if p]
        found.append((m.group(2), m.group(1).lower(), {k: v.replace("{", "").replace("}", "") for k, v in fields.items()}, people))
    return found


def entries(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A null text has no entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.list_(pa.string())]
        names = ["doc_id", "ord", "key", "type", "fields", "authors"]
        for b in batches:
            rows = [(d, n, k, kind, list(f.items()), a) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for n, (k, kind, f, a) in enumerate(parse(t or ""))]
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return docs.select(F.col(key).cast("long"), text).mapInArrow(run, ENTRIES)
