"""The operators' inputs as projections of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import double, norm


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(rows: DataFrame, key: str, id_col: str, width: int = 4096) -> DataFrame:
    """``place``: each row's number from 0 within its key, by id. Rows are numbered within ranges of ids, whose sizes alone are
    summed by key, so a key that holds most rows is spread over many tasks."""
    ranged = rows.withColumn("_range", F.floor(F.col(id_col) / width))
    sizes = ranged.groupBy(key, "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(key, "_range", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy(key, "_range").orderBy(id_col)) - 1
    return ranged.withColumn("_inside", inside).join(offsets, [key, "_range"]).withColumn("place", F.col("_before") + F.col("_inside")).drop("_range", "_inside", "_before")


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, video, ord, start, end, vec, a, b (null for every fifth), tags."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", double(F.col("embedding")).alias("vec"))
    e = numbered(e, "label", "vec_id").withColumnRenamed("place", "ord")
    s = e.select("vec_id", F.concat(F.lit("v"), F.col("label").cast("string")).alias("video"), F.col("ord").cast("int").alias("ord"), "vec")
    start = F.col("ord") * 10 + (F.col("vec_id") % 4) * 0.5
    tag = lambda n: F.concat(F.lit("t"), (F.col("vec_id") % n).cast("string"))
    return s.select(
        "vec_id", "video", "ord", start.alias("start"), (start + 10).alias("end"), "vec", F.slice("vec", 1, 32).alias("a"),
        F.when(F.col("vec_id") % 5 != 0, F.slice("vec", 33, 32)).alias("b"), F.array(tag(7), tag(11)).alias("tags"),
    )


def modal(rows: DataFrame) -> DataFrame:
    """Scenes in long form: one row a modality that has a vector, with its norm."""
    each = F.array(*(F.struct(F.lit(m).alias("modality"), F.col(m).alias("vec")) for m in ("a", "b")))
    long = rows.select("vec_id", "video", "ord", F.inline(each)).where("vec IS NOT NULL")
    return long.withColumn("norm", norm(F.col("vec")))


def queries_of(long: DataFrame, every: int = 20) -> DataFrame:
    """The stated query set: rows whose id is divisible by ``every``."""
    return long.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("qid"), "video", "ord", "modality", "vec", "norm")


def clips(spark: SparkSession, sf_dir: str, kind: str = "view") -> DataFrame:
    """person, day, at (seconds of the day) of events of a kind."""
    e = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    at = F.hour("ts") * 3600.0 + F.minute("ts") * 60.0 + F.second("ts")
    day = F.concat(F.lit("DAY"), (1 + (F.dayofmonth("ts") - 1) % 7).cast("string"))
    return e.select("event_id", F.col("user_id").alias("person"), day.alias("day"), at.alias("at"), "value")
