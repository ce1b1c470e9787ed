"""Session helpers: a tuned session for tests and benches, and code shipping to executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parent.parent


def local_session(cores: str = "8", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that tests and benches share."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quillstack")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give executors this package, unless their PYTHONPATH has it already."""
    context = spark.sparkContext
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(":") or getattr(context, "_quillstack_shipped", False):
        return
    path = Path(tempfile.mkdtemp()) / "quillstack_code.zip"
    with zipfile.ZipFile(path, "w") as out:
        for p in sorted((ROOT / "quillstack").rglob("*.py")):
            out.write(p, p.relative_to(ROOT))
    context.addPyFile(str(path))
    context._quillstack_shipped = True


#: Rows and bytes in an Arrow batch, the same for all operators: long texts make a batch of 10,000 rows too large for a worker's memory.
BATCH_ROWS, BATCH_BYTES = 500, 64 << 20
#: Rows of a few numbers that are broadcast at most; more are joined by shuffling.
FEW = 200_000


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def work_dir(spark: SparkSession, tag: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which driver and executors share; it goes when the application ends.

    Where the setting is absent (tests in local mode) a temporary folder of this process is used; on a
    cluster a machine's own folder would lose data, so that is an error.
    """
    context = spark.sparkContext
    if not hasattr(context, "_quillstack_work"):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="quillstack-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
        run = f"{base.rstrip('/')}/quillstack-{uuid.uuid4().hex}"
        path, store = _path(spark, run)
        store.mkdirs(path)
        store.deleteOnExit(path)
        context._quillstack_work = run
    return f"{context._quillstack_work}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df, written to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = work_dir(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._stored_in = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in tables:
        drop_path(df.sparkSession, df._stored_in)


def drop_path(spark: SparkSession, path: str) -> None:
    p, store = _path(spark, path)
    store.delete(p, True)


def arrow_rows(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def light(df: DataFrame, most: int = FEW) -> DataFrame:
    """For a join: broadcast if it has at most `most` rows. df is counted, so it should be stored or cheap."""
    return F.broadcast(df) if df.count() <= most else df
