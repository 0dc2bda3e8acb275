"""Shared helpers: materialised intermediate tables, size-checked broadcasts, text batches."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The contracts' white space, as a Java regular expression.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]+"

#: A side of a join is broadcast only if its counted rows stay below this; beyond it, both sides are shuffled.
BROADCAST_ROWS = 400_000

#: Folders of written tables, with their session, until they are deleted.
_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a new local one only where that is unset and Spark runs in one process."""
    place = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="sightline-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _clean() -> None:
    for folder, spark in _written.items():
        try:
            _delete(spark, folder)
        except Exception:  # the session is gone; the folder's owner cleans it
            return


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` to the shared folder and returns it as read from there.

    Lineage ends here, so a lost executor costs a file read and not a recomputation.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/sightline-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(f"{folder}/{tag}")
    _written[folder] = spark
    table = spark.read.schema(df.schema).parquet(f"{folder}/{tag}")
    table._sightline_folder = folder
    return table


def release(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more, and lets Spark drop the shuffle files of the jobs that made them.

    Without it, files of all steps would add up until the session ends.
    """
    for table in tables:
        folder = table._sightline_folder
        if spark := _written.pop(folder, None):
            _delete(spark, folder)
            gc.collect()
            spark._jvm.System.gc()


def frugal(run):
    """A function over Arrow batches that gives memory back when its task is done: idle Python workers stay, and the C
    library and Arrow keep what was freed for them."""

    def wrapped(batches):
        import ctypes

        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return wrapped


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (narrow and materialised) with a broadcast hint if it has at most ``max_rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def fresh(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under internal names, so extra or clashing columns of the input don't matter."""
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in columns.items()))


def slices(batch, columns: list[str], size: int = 4_000_000):
    """Row ranges of an Arrow batch whose texts take about ``size`` bytes, so that temporary arrays stay bounded."""
    import numpy as np
    import pyarrow as pa

    total = np.zeros(batch.num_rows, dtype=np.int64)
    for name in columns:
        column = batch.column(batch.schema.get_field_index(name))
        wide = column.cast(pa.large_binary())
        total += np.diff(np.frombuffer(wide.buffers()[1], dtype=np.int64, count=len(wide) + 1 + wide.offset)[wide.offset :])
    group = (np.cumsum(total) - total) // size
    edges = np.flatnonzero(np.diff(group)) + 1
    bounds = [0, *edges.tolist(), batch.num_rows]
    for a, b in zip(bounds, bounds[1:]):
        if b > a:
            yield batch.slice(a, b - a)
