"""Encoding that can stop and go on: a table that a stream's batches change exactly once.

The table is cut into buckets by a hash of the key, and a version names one folder a bucket. A batch writes new folders for the
buckets it touches, and then one small file, the version, which is created only if it is not there yet. So a batch
that was cut off before that left nothing a reader sees, a batch that comes again after it is known by its number, and of two
writers one fails. Readers of older versions keep their folders until ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionedTable:
    """Rows with unique non-null ``key``, and ``stamp``: what the row was made from (a time, a size, a digest)."""

    def __init__(self, spark: SparkSession, path: str, key: str, stamp: str, schema: str, buckets: int = 16):
        self.spark, self.path, self.key, self.stamp, self.schema, self.buckets = spark, path.rstrip("/"), key, stamp, schema, buckets
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _name(self, number: int) -> str:
        return f"{self.path}/versions/{number:012d}.json"

    def versions(self) -> list[int]:
        place = self._hadoop(f"{self.path}/versions")
        if not self._files.exists(place):
            return []
        return sorted(int(f.getPath().getName().split(".")[0]) for f in self._files.listStatus(place) if f.getPath().getName().endswith(".json"))

    def state(self, number: int | None = None) -> dict:
        """A version (the last by default): its number, the folder of each bucket, the last batch of each writer."""
        known = self.versions()
        if not known:
            return {"version": 0, "folders": {}, "batches": {}}
        stream = self._files.open(self._hadoop(self._name(known[-1] if number is None else number)))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _commit(self, state: dict) -> None:
        """Writes a version whole, then gives it its name; fails if the name is taken."""
        half = self._hadoop(f"{self.path}/versions/.{uuid.uuid4().hex}")
        out = self._files.create(half, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        final = self._hadoop(self._name(state["version"]))
        if self._files.exists(final) or not self._files.rename(half, final):
            self._files.delete(half, False)
            raise RuntimeError(f"another writer made version {state['version']} of {self.path}")

    def read(self, number: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        folders = {b: f for b, f in self.state(number)["folders"].items() if buckets is None or int(b) in buckets}
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*sorted(f"{self.path}/{f}" for f in folders.values()))

    def bucket(self, column: str):
        return F.pmod(F.hash(column), F.lit(self.buckets))

    def needed(self, rows: DataFrame, force: bool = False) -> DataFrame:
        """Of ``rows``, one a key (the greatest stamp), those that the table does not hold with the same stamp."""
        own = rows.where(F.col(self.key).isNotNull())
        last = own.groupBy(self.key).agg(F.max_by(F.struct(*own.columns), F.struct(self.stamp)).alias("_r")).select("_r.*")
        if force:
            return last
        held = self.read().select(self.key, F.col(self.stamp).alias("_held"), F.lit(True).alias("_there"))
        return last.join(held, self.key, "left").where(F.col("_there").isNull() | ~F.col(self.stamp).eqNullSafe(F.col("_held"))).drop("_held", "_there")

    def merge(self, changed: DataFrame, writer: str, batch: int) -> bool:
        """Puts rows in the place of those with the same keys, as batch ``batch`` of ``writer``; False if that was done before.

        Only the buckets that the rows fall into are written again.
        """
        state = self.state()
        if state["batches"].get(writer, -1) >= batch:
            return False
        folder = f"data/{uuid.uuid4().hex}"
        new = changed.select(*self._columns(), self.bucket(self.key).alias("_bucket"))
        new.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}/new")
        new = self.spark.read.parquet(f"{self.path}/{folder}/new")
        touched = {r[0] for r in new.select("_bucket").distinct().collect()}  # at most ``buckets`` numbers
        held = self.read(buckets=touched & {int(b) for b in state["folders"]}).join(new.select(self.key), self.key, "left_anti")
        whole = held.select(*self._columns()).unionByName(new.select(*self._columns())).withColumn("_bucket", self.bucket(self.key))
        if touched:
            whole.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}/whole")
        state["folders"] |= {str(b): f"{folder}/whole/_bucket={b}" for b in touched}
        state["batches"][writer] = batch
        state["version"] += 1
        self._commit(state)
        self._files.delete(self._hadoop(f"{self.path}/{folder}/new"), True)
        return True

    def _columns(self) -> list[str]:
        return self.spark.createDataFrame([], self.schema).columns

    def vacuum(self, keep: int = 1) -> None:
        """Deletes versions but the last ``keep``, and folders that none of these names. No writer may be at work."""
        known = self.versions()
        used = {f for n in known[-keep:] for f in self.state(n)["folders"].values()}
        for n in known[:-keep]:
            self._files.delete(self._hadoop(self._name(n)), False)
        place = self._hadoop(f"{self.path}/data")
        for made in self._files.listStatus(place) if self._files.exists(place) else []:
            whole = self._hadoop(made.getPath(), "whole")
            for part in self._files.listStatus(whole) if self._files.exists(whole) else []:
                if f"data/{made.getPath().getName()}/whole/{part.getPath().getName()}" not in used:
                    self._files.delete(part.getPath(), True)
            if not any(f.startswith(f"data/{made.getPath().getName()}/") for f in used):
                self._files.delete(made.getPath(), True)


def encode_stream(rows: DataFrame, table: VersionedTable, encode: Callable[[DataFrame], DataFrame], checkpoint: str, writer: str = "encode", force: bool = False):
    """A stream writer that encodes what is new or stale and leaves the rest; ``.start()`` it with any trigger.

    ``encode`` gets the rows that need it (one a key) and returns the table's columns. A batch that comes again after a crash
    changes nothing; one that was cut off is done again.
    """

    def batch(part: DataFrame, number: int) -> None:
        if table.state()["batches"].get(writer, -1) < number:
            table.merge(encode(table.needed(part, force)), writer, number)

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
