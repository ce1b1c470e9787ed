"""Conversion: one pass over the documents, each read, rewritten and written inside one Arrow kernel; no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack import model
from quillstack.model import Element, Kids
from quillstack.operators import rewrite
from quillstack.session import arrow_rows
from quillstack.sinks import epub, html, latex, packages
from quillstack.sources import formats
from quillstack.sources import html as html_source
from quillstack.sources import markdown
from quillstack.sources import packages as package_source

#: Readers take text or bytes, writers give bytes.
READERS: dict[str, Callable[[object], Kids]] = {
    "html": lambda text: model.from_rows(html_source.parse(_text(text))),
    "markdown": lambda text: markdown.parse(_text(text)),
    "odt": package_source.odt,
    "docx": package_source.docx,
}
WRITERS: dict[str, Callable[[Kids], bytes]] = {
    "html": lambda kids: html.page(kids, _title(kids)).encode(),
    "tex": lambda kids: latex.document(kids).encode(),
    "epub": lambda kids: epub.package(kids, "urn:document", _title(kids) or "Untitled"),
    "odt": packages.odt,
    "docx": packages.docx,
    "text": lambda kids: rewrite.plain_text(kids).encode(),
}


def _text(value: object) -> str:
    return value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)


def _title(kids: Kids) -> str:
    found = rewrite.contents(kids)
    return found[0][2] if found else packages.title_of(kids)


def _tree(read: Callable[[object], Kids], value: object, steps: list | None) -> Kids:
    return rewrite.rewritten([] if value is None else read(value), steps)


def converted(docs: DataFrame, key: str, content: str, reader: str, writer: str, steps: list | None = None) -> DataFrame:
    """(key, output, error) per document; a null document is an empty one. Steps default to all.

    A document that can't be read or written has no output but says why, and the others go on. A task holds one batch of
    documents and their outputs.
    """
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, write = READERS[reader], WRITERS[writer]
        for b in batches:
            out, errors = [], []
            for value in b.column(1).to_pylist():
                try:
                    out.append(write(_tree(read, value, steps)))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  whatever is wrong with one document
                    out.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), pa.array(errors, pa.string())], names=[key, "output", "error"])

    return docs.select(F.col(key).cast("long").alias(key), content).mapInArrow(run, f"{key} long, output binary, error string")


def toc(docs: DataFrame, key: str, content: str, reader: str = "html") -> DataFrame:
    """(key, ord, level, id, title) of each section; a document that can't be read has none."""
    arrow_rows(docs.sparkSession)

    def sections(value: object) -> list[tuple[int, str, str]]:
        try:
            return rewrite.contents(_tree(READERS[reader], value, None))
        except Exception:  # noqa: BLE001
            return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, n, *entry) for d, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if v is not None for n, entry in enumerate(sections(v))]
            columns = list(zip(*rows)) or [()] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[key, "ord", "level", "id", "title"])

    return docs.select(F.col(key).cast("long").alias(key), content).mapInArrow(run, f"{key} long, ord long, level long, id string, title string")


def files(spark: SparkSession, path: str, writer: str) -> DataFrame:
    """(path, format, output, error) of each file in a folder, read by the format that its name or else its first bytes tell."""
    arrow_rows(spark)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    found = found.withColumn("format", F.coalesce(formats.by_name(F.col("path")), formats.sniffed(F.col("content"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content, kind in zip(*(b.column(k).to_pylist() for k in ("path", "content", "format"))):
                out, error = None, None
                try:
                    out = WRITERS[writer](_tree(READERS[kind], content, None))
                except Exception as e:  # noqa: BLE001  whatever is wrong with one file
                    error = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_pydict({"path": [name], "format": [kind], "output": pa.array([out], pa.binary()), "error": pa.array([error], pa.string())})

    return found.mapInArrow(run, "path string, format string, output binary, error string")


def steps_without(*names: str) -> list:
    return [s for s in rewrite.STEPS if s.__name__ not in names]


__all__ = ["Element", "READERS", "WRITERS", "converted", "files", "steps_without", "toc"]
