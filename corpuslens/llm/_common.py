"""What the operators share: table access, shared scratch space, code shipping and batch iteration."""

from __future__ import annotations

import ctypes
import os
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space, tab, line feed, vertical tab, form feed and carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder below the shared checkpoint folder, deleted when the driver's JVM ends.  Only a local session that names
    none gets one of its own: on a cluster a folder of one machine would lose what the others write."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}/corpuslens-scratch-{os.getuid()}"
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(place)  # what isn't there can't be marked for deletion
    store.deleteOnExit(place)
    return f"{path}/t"


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(*stored_frames: DataFrame) -> None:
    """Deletes tables made by ``stored`` that no later plan reads, before the driver ends."""
    for df in stored_frames:
        delete(df.sparkSession, df._corpuslens_path)


def stored(df: DataFrame, label: str) -> DataFrame:
    """The frame written once to shared storage and read again: later plans start there, whatever executor is lost."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._corpuslens_path = path
    return out


#: Tasks of one shuffle at most; a larger input has larger tasks.
_MOST_TASKS = 1 << 16


def tasks_for(df: DataFrame, bytes_each: int) -> int:
    """Shuffle partitions for work on all of ``df``: so many that each has about ``bytes_each`` of its input files, and the
    session's number at least.  Inputs of unknown size count as nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves().iterator()
    total = 0
    while leaves.hasNext():
        size = int(leaves.next().stats().sizeInBytes())
        total += size if size < 1 << 60 else 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(_MOST_TASKS, -(-total // bytes_each)))


#: Bytes of an Arrow batch, where the session sets no other limit: long texts otherwise make batches of up to 64 MB, held
#: by the executor's JVM and by the Python worker at once.
_BATCH_BYTES = 8_000_000


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once, so that Python workers can import it whatever their path, and bounds the
    batches that they get."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit, None) is None:
        spark.conf.set(limit, str(_BATCH_BYTES))
    context = spark.sparkContext
    if getattr(context, "_corpuslens_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp()) / "corpuslens_code.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    context.addPyFile(str(target))
    context._corpuslens_shipped = True


def release() -> None:
    """Gives memory that a Python worker has freed back to the system, as workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit("")).alias("text")


def slices(column: pa.Array, most_bytes: int, most_rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes of text and rows each, or of one row if that alone is longer."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for row, size in enumerate(sizes.tolist()):
        if row > start and (total + size > most_bytes or row - start >= most_rows):
            yield start, row
            start, total = row, 0
        total += size
    if len(sizes) > start:
        yield start, len(sizes)
