"""K-means within groups: all groups go through the same rounds, each with as many clusters as its size asks for.

The rows stay where they are; what changes from round to round is a table of centres, one row a group. Distances are expressions
over a group's centres, sums of vectors are partial aggregations by (group, cluster), so a group may hold most rows.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import small, written


def cluster_count(n: Column, per: int = 8, most: int = 8) -> Column:
    """One cluster for every ``per`` members begun, ``most`` at most; groups of one have one."""
    return F.least(F.floor(n / per) + 1, F.lit(most)).cast("int")


def _squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def nearest(vec: Column, centres: Column) -> Column:
    """Struct ``d, cluster``: the squared distance to the nearest centre (ties: the first) and its number."""
    return F.array_min(F.transform(centres, lambda c, i: F.struct(F.round(_squared(vec, c), 9).alias("d"), i.alias("cluster"))))


def seeds(rows: DataFrame, per: int = 8, most: int = 8) -> DataFrame:
    """``grp, centres``: the vector of the smallest id, then again and again the one farthest from those chosen (ties: the smallest
    id), while any is away from them and the group may have more clusters."""
    first = rows.groupBy("grp").agg(F.min_by("vec", "id").alias("v"), F.count("*").alias("n"))
    chosen = written(first.select("grp", cluster_count(F.col("n"), per, most).alias("k"), F.array("v").alias("centres")), "seeds")
    for k in range(2, most + 1):
        more = chosen.where(F.col("k") >= k)
        if more.isEmpty():
            break
        away = rows.join(small(more), "grp").select("grp", "id", "vec", nearest(F.col("vec"), F.col("centres"))["d"].alias("d")).where("d > 0")
        farthest = away.groupBy("grp").agg(F.max_by("vec", F.struct("d", -F.col("id"))).alias("next"))
        grown = F.when(F.col("next").isNull(), F.col("centres")).otherwise(F.concat("centres", F.array("next")))
        chosen = written(chosen.join(farthest, "grp", "left").select("grp", "k", grown.alias("centres")), "seeds")
    return chosen.select("grp", "centres")


def _moved(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """The means of the rows nearest to each centre; a centre without rows stays."""
    placed = rows.join(small(centres), "grp").select("grp", "vec", nearest(F.col("vec"), F.col("centres"))["cluster"].alias("cluster"))
    means = placed.groupBy("grp", "cluster").agg(vector_to_array(Summarizer.mean(array_to_vector("vec"))).alias("mean"))
    means = means.select("grp", "cluster", F.transform("mean", lambda x: F.round(x, 9)).alias("mean"))
    by_group = means.groupBy("grp").agg(F.map_from_entries(F.collect_list(F.struct("cluster", "mean"))).alias("means"))  # a row a cluster
    return centres.join(by_group, "grp").select("grp", F.transform("centres", lambda c, i: F.coalesce(F.try_element_at("means", i), c)).alias("centres"))


def grouped_kmeans(rows: DataFrame, group: str, id_col: str, vec_col: str, per: int = 8, most: int = 8, rounds: int = 10) -> DataFrame:
    """``group, id_col, cluster, distance``: each row's cluster within its group, and its squared distance from the centre.

    ``n div per + 1`` clusters for a group of n, ``most`` at most; fewer where there are not as many different vectors. Rounds end when no
    centre moves, after ``rounds`` at the latest. Deterministic: seeds are chosen by distance and id, means rounded.
    Rows without a group, id or vector are left out; ids must be different within a group. An empty table has no clusters.
    """
    own = rows.select(F.col(group).alias("grp"), F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    own = written(own.where("grp IS NOT NULL AND id IS NOT NULL AND vec IS NOT NULL"), "vectors")
    centres = seeds(own, per, most)
    for _ in range(rounds):
        after = written(_moved(own, centres), "centres")
        same = centres.join(after.withColumnRenamed("centres", "new"), "grp").where(F.col("centres") != F.col("new")).isEmpty()
        centres = after
        if same:
            break
    found = own.join(small(centres), "grp").withColumn("at", nearest(F.col("vec"), F.col("centres")))
    return found.select(F.col("grp").alias(group), F.col("id").alias(id_col), F.col("at.cluster").cast("int").alias("cluster"), F.col("at.d").alias("distance"))


def medoids(clustered: DataFrame, group: str, id_col: str) -> DataFrame:
    """``group, cluster, medoid, n``: of each cluster the member nearest to its centre (ties: the smallest id)."""
    return clustered.groupBy(group, "cluster").agg(F.min_by(id_col, F.struct("distance", id_col)).alias("medoid"), F.count("*").alias("n"))
