"""Pooling of vectors, tags and bounds up the hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import l2_normalise, pad_or_cut


def mean_vectors(rows: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """``keys, vec``: the component-wise mean of the vectors that aren't null.

    Components are averaged by a partial aggregation on (keys, position); only one row a position is gathered in the end.
    """
    parts = rows.where(F.col(vec).isNotNull()).select(*keys, F.posexplode(vec).alias("_p", "_x"))
    means = parts.groupBy(*keys, "_p").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_m"))), lambda x: x["_m"]).alias("vec"))


def tag_union(rows: DataFrame, keys: list[str], tags: str = "tags") -> DataFrame:
    """``keys, tags``: all tags in order; exploded and made distinct before they are gathered."""
    each = rows.select(*keys, F.explode_outer(tags).alias("_tag")).distinct()
    return each.groupBy(*keys).agg(F.array_sort(F.collect_set("_tag")).alias("tags"))


def time_bounds(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.greatest(F.lit(0.0), F.min("start")).alias("start"), F.greatest(F.lit(0.01), F.max("end")).alias("end"))


def shared_space(rows: DataFrame, keys: list[str], size: int, group: str = "modality", vec: str = "vec") -> DataFrame:
    """``keys, group, vec`` of ``size`` components: unit vectors of each group by its own principal components, padded with 0.

    The groups are few and stated by the rows; the components of each are fitted on all of its rows.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    unit = rows.where(F.col(vec).isNotNull()).withColumn(vec, l2_normalise(F.col(vec)))
    found = None
    for (name,) in sorted(unit.select(group).distinct().collect()):
        own = unit.where(F.col(group) == name).select(*keys, group, array_to_vector(vec).alias("_x"))
        wide = min(size, own.first()["_x"].size)
        turned = PCA(k=wide, inputCol="_x", outputCol="_y").fit(own).transform(own)
        part = turned.select(*keys, group, pad_or_cut(vector_to_array("_y"), size).alias(vec))
        found = part if found is None else found.union(part)
    return found
