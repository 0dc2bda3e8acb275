"""Queries of the engine's operators over the driver's tables, each with equivalent DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import texts, times, vectors
from .operators import changes, clusters, filters, intervals, metrics, pooling, ranking, tagging, vector_index
from .plans import planner, retrieval
from .sources import annotations, tables, views
from .sources.views import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def cos_sql(x: str, y: str) -> str:
    n = lambda v: f"greatest(sqrt(list_inner_product({v}, {v})), 1e-8)"
    return f"round(list_inner_product({x}, {y}) / ({n(x)} * {n(y)}), 12)"


def mean_sql(source: str, keys: str) -> str:
    return f"""SELECT {keys}, list(m ORDER BY p) AS vec FROM (SELECT {keys}, p, avg(x) AS m FROM (SELECT {keys}, unnest(vec) AS x, unnest(range(1, len(vec) + 1)) AS p FROM {source}) GROUP BY ALL) GROUP BY {keys}"""


SCENES = """s0 AS (
  SELECT vec_id, 'v' || label AS video, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS ord, embedding::DOUBLE[] AS vec,
         ['t' || (vec_id % 7), 't' || (vec_id % 11)] AS tags FROM embeddings
), scenes AS (
  SELECT *, ord * 10 + (vec_id % 4) * 0.5::DOUBLE AS start, ord * 10 + (vec_id % 4) * 0.5::DOUBLE + 10 AS "end",
         vec[1:32] AS a, CASE WHEN vec_id % 5 <> 0 THEN vec[33:64] END AS b FROM s0
)"""
MODAL = f"""{SCENES}, modal AS (
  SELECT vec_id, video, ord, 'a' AS modality, a AS vec FROM scenes UNION ALL SELECT vec_id, video, ord, 'b', b FROM scenes WHERE b IS NOT NULL
), qs AS (SELECT vec_id AS qid, video AS q_video, modality, vec AS q_vec FROM modal WHERE vec_id % 20 = 0)"""
PAIRS = f"""{MODAL}, pairs AS (SELECT qid, modality, vec_id AS item, {cos_sql("vec", "q_vec")} AS score FROM modal JOIN qs USING (modality)
), lists AS (SELECT *, row_number() OVER (PARTITION BY qid, modality ORDER BY score DESC, item) AS rank FROM pairs QUALIFY rank <= 10)"""


def lists(spark: SparkSession, sf_dir: str, modalities: tuple[str, ...] = ("a", "b"), depth: int = 10) -> DataFrame:
    """The best scenes of each query and modality; queries are the scenes whose id is divisible by 20."""
    scenes = views.scenes(spark, sf_dir)
    found = None
    for m in modalities:
        own = scenes.where(F.col(m).isNotNull()).select("vec_id", F.col(m).alias("vec"))
        best = ranking.block_top_k(own, own.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "qid"), depth, "vec_id", "vec").withColumn("modality", F.lit(m))
        found = best if found is None else found.union(best)
    return found


# ---- search and fusion


@query(f"""WITH {SCENES}, r AS (
  SELECT q.vec_id AS qid, i.vec_id AS item, {cos_sql("i.vec", "q.vec")} AS score FROM scenes q, scenes i WHERE q.vec_id % 20 = 0
) SELECT qid, item, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item) AS rank, round(score, 6) AS score FROM r QUALIFY rank <= 10""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "embeddings")
    wanted = items.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"))
    found = ranking.block_top_k(items.select("vec_id", "embedding"), wanted, 10, "vec_id", "embedding")
    return found.select("qid", "item", F.col("rank").cast("long"), F.round("score", 6).alias("score"))


def _index(spark: SparkSession, sf_dir: str) -> tuple[vector_index.Index, DataFrame]:
    """An index of all vectors, and the stated queries: the rows whose id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings")
    built = vector_index.build(rows, "vec_id", "embedding", tables.new_folder(spark, "index"))
    return built, rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"))


@query()
def ivf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of each query by the index, from the lists nearest to it."""
    found = vector_index.search(*_index(spark, sf_dir), 10)
    return found.select("qid", "item", F.col("rank").cast("long"), F.round("score", 6).alias("score"))


@query(f"""WITH {SCENES}, r AS (
  SELECT q.vec_id AS qid, i.vec_id AS item, {cos_sql("i.vec", "q.vec")} AS score FROM scenes q, scenes i WHERE q.vec_id % 20 = 0
) SELECT qid, item, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item) AS rank, round(score, 6) AS score FROM r QUALIFY rank <= 10""")
def ivf_search_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``cosine_topk``, by the index's bounds."""
    found = vector_index.search(*_index(spark, sf_dir), 10, exact=True)
    return found.select("qid", "item", F.col("rank").cast("long"), F.round("score", 6).alias("score"))


@query(f"WITH {PAIRS} SELECT qid, item, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM lists GROUP BY ALL")
def rrf_two_modalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rrf(lists(spark, sf_dir), ["qid", "item"])


NORM = f"""{PAIRS}, n AS (
  SELECT qid, item, modality, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS norm
  FROM lists WINDOW w AS (PARTITION BY qid, modality))"""


def _fused(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    fused = ranking.fuse_scores(lists(spark, sf_dir), ["qid", "modality"], ["qid", "item"], how)
    return fused.select("qid", "item", F.round("score", 6).alias("score"))


@query(f"WITH {NORM} SELECT qid, item, round((sum(norm) + avg(norm) * (2 - count(*))) / 2, 6) AS score FROM n GROUP BY ALL")
def fuse_mean_imputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, "avg")


@query(f"WITH {PAIRS} SELECT qid, item, round((sum(score) + avg(score) * (2 - count(*))) / 2, 6) AS score FROM lists GROUP BY ALL")
def fuse_mean_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean imputation over scores as they are."""
    fused = ranking.fuse_scores(lists(spark, sf_dir), ["qid", "modality"], ["qid", "item"], normalise=False)
    return fused.select("qid", "item", F.round("score", 6).alias("score"))


@query(f"WITH {NORM} SELECT qid, item, round(avg(norm), 6) AS score FROM n GROUP BY ALL")
def fuse_exclude_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, "avg")


@query(f"WITH {NORM} SELECT qid, item, round(sum(norm), 6) AS score FROM n GROUP BY ALL")
def fuse_exclude_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, "sum")


@query(f"WITH {NORM} SELECT qid, item, round(max(norm), 6) AS score FROM n GROUP BY ALL")
def fuse_exclude_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, "max")


@query(f"""WITH {PAIRS}, full_list AS (SELECT q.qid, s.vec_id AS item, count(p.score) AS n, sum(p.score) AS total
  FROM (SELECT DISTINCT qid FROM qs) q CROSS JOIN scenes s LEFT JOIN pairs p ON p.qid = q.qid AND p.item = s.vec_id GROUP BY ALL
), c AS (SELECT qid, item, round(CASE WHEN n = 2 THEN total / 2 ELSE -1.0 END, 12) AS score FROM full_list)
SELECT qid, item, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item) AS rank FROM c QUALIFY rank <= 5""")
def concat_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the sum of both cosines is the cosine of the unit vectors put together; whatever lacks a modality scores -1."""
    scenes = views.scenes(spark, sf_dir)
    unit = lambda c: F.transform(vectors.l2_normalise(F.col(c)), lambda x: x / F.sqrt(F.lit(2.0)))
    both = scenes.where("b IS NOT NULL").select("vec_id", F.concat(unit("a"), unit("b")).alias("vec"))
    asked = scenes.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("b").isNotNull().alias("whole"))
    best = ranking.block_top_k(both, both.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "qid"), 5, "vec_id", "vec").select("qid", "item", "score")
    five = lambda rows: rows.select(F.col("vec_id").alias("item")).orderBy("vec_id").limit(5)  # noqa: E731  the first five ties at -1 are all that can be in a list
    rest = asked.where("whole").select("qid").join(F.broadcast(five(scenes.where("b IS NULL"))), how="cross")
    bare = asked.where("NOT whole").select("qid").join(F.broadcast(five(scenes)), how="cross")
    rows = best.union(rest.union(bare).select("qid", "item", F.lit(-1.0)))
    found = ranking.top_k(rows, ["qid"], [F.desc("score"), F.asc("item")], 5)
    return found.select("qid", "item", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


def top_sql(source: str, keys: str, order: str, k: int, name: str = "rank") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS {name} FROM {source} QUALIFY {name} <= {k}"


VIDEOS = f"""{MODAL}, means AS ({mean_sql("modal", "video, modality")}
), vscore AS (SELECT qid, modality, video, {cos_sql("vec", "q_vec")} AS score FROM means JOIN qs USING (modality)
), vlist AS ({top_sql("vscore", "qid, modality", "score DESC, video", 3)}
), vfused AS (SELECT qid, video, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM vlist GROUP BY ALL
), chosen AS ({top_sql("vfused", "qid", "score DESC, video", 3, "video_rank")})"""


def scenes_sql(chosen: str, on: str, k: int = 5) -> str:
    return f"""sscore AS (SELECT qid, modality, video, ord, video_rank, {cos_sql("vec", "q_vec")} AS score FROM modal JOIN {chosen} USING ({on}) JOIN qs USING (qid, modality)
), slist AS ({top_sql("sscore", "qid, video, modality", "score DESC, ord", 2 * k)}
), sfused AS (SELECT qid, video, video_rank, ord, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM slist GROUP BY ALL
) SELECT qid, video, ord, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, video_rank, ord) AS rank FROM sfused QUALIFY rank <= {k}"""


def _hierarchy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    long = views.modal(views.scenes(spark, sf_dir))
    wanted = views.queries_of(long).drop("video", "ord")
    videos = retrieval.with_norm(pooling.mean_vectors(long, ["video", "modality"]))
    return long, wanted, retrieval.top_videos(videos, wanted, 3)


def _scene_columns(rows: DataFrame) -> DataFrame:
    return rows.select("qid", "video", F.col("ord").cast("long"), "score", F.col("rank").cast("long"))


@query(f"WITH {VIDEOS}, {scenes_sql('chosen', 'video')}")
def hier_video_then_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    long, wanted, chosen = _hierarchy(spark, sf_dir)
    return _scene_columns(retrieval.top_scenes(long, chosen, wanted, 5))


WINDOWS = """counts AS (SELECT video, count(*) AS n, least(count(*), 3) AS size FROM scenes GROUP BY video
), starts AS (SELECT video, n, size, unnest(range(0, n - size + 1, 2)) AS first FROM counts
), covered AS (SELECT video, n, size, max(first) AS last FROM starts GROUP BY ALL
), allw AS (SELECT video, size, first FROM starts UNION ALL SELECT video, size, n - size FROM covered WHERE last + size < n
), windows AS (SELECT video, size AS n_scenes, first, row_number() OVER (PARTITION BY video ORDER BY first) - 1 AS "window" FROM allw)"""


@query(f"""WITH {VIDEOS}, {WINDOWS}, wm AS (SELECT w.video, w."window", m.modality, m.vec FROM windows w JOIN modal m ON m.video = w.video AND m.ord >= w.first AND m.ord < w.first + w.n_scenes
), wvec AS ({mean_sql("wm", 'video, "window", modality')}
), wscore AS (SELECT qid, modality, video, "window", video_rank, {cos_sql("vec", "q_vec")} AS score FROM wvec JOIN chosen USING (video) JOIN qs USING (qid, modality)
), wlist AS ({top_sql("wscore", "qid, video, modality", 'score DESC, "window"', 4)}
), wfused AS (SELECT qid, video, video_rank, "window", round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM wlist GROUP BY ALL
), wtop AS ({top_sql("wfused", "qid", 'score DESC, video_rank, "window"', 4)}
), inw AS (SELECT DISTINCT t.qid, t.video, t.video_rank, s.ord FROM wtop t JOIN windows w ON w.video = t.video AND w."window" = t."window" JOIN scenes s ON s.video = w.video AND s.ord >= w.first AND s.ord < w.first + w.n_scenes
), {scenes_sql("inw", "video, ord")}""")
def hier_with_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    long, wanted, chosen = _hierarchy(spark, sf_dir)
    windows = intervals.scene_windows(views.scenes(spark, sf_dir))
    members = intervals.window_members(windows, long)
    pooled = retrieval.with_norm(pooling.mean_vectors(members, ["video", "window", "modality"]))
    best = retrieval.top_windows(pooled, chosen, wanted, 4).select("qid", "video", "video_rank", "window")
    places = windows.withColumn("ord", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n_scenes") - 1)))
    inside = best.join(places, ["video", "window"]).select("qid", "video", "video_rank", "ord").distinct()
    return _scene_columns(retrieval.top_scenes(long, inside, wanted, 5, ("video", "ord")))


@query(f"WITH {MODAL}, own AS (SELECT DISTINCT qid, q_video AS video, 1 AS video_rank FROM qs), {scenes_sql('own', 'video')}")
def skip_video_scene_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = views.modal(views.scenes(spark, sf_dir))
    wanted = views.queries_of(long)
    own = wanted.select("qid", "video").distinct().withColumn("video_rank", F.lit(1))
    return _scene_columns(retrieval.top_scenes(long, own, wanted.drop("video", "ord"), 5))


@query(f"""WITH {MODAL}, sig AS (SELECT qid, modality, 'query' AS signal, q_vec FROM qs UNION ALL SELECT vec_id - 1, modality, 'visual_context', vec FROM modal WHERE vec_id % 20 = 1
), sc AS (SELECT qid, modality, signal, vec_id AS item, {cos_sql("vec", "q_vec")} AS score FROM modal JOIN sig USING (modality)
), r1 AS ({top_sql("sc", "qid, modality, signal", "score DESC, item", 10)}
), f1 AS (SELECT qid, modality, item, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM r1 GROUP BY ALL
), r2 AS (SELECT *, row_number() OVER (PARTITION BY qid, modality ORDER BY score DESC, item) AS rank FROM f1
) SELECT qid, item, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM r2 GROUP BY ALL""")
def dual_signal_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenes = views.scenes(spark, sf_dir)
    first = None
    for m in ("a", "b"):
        own = scenes.where(F.col(m).isNotNull()).select("vec_id", F.col(m).alias("vec"))
        for signal, rest in (("query", 0), ("visual_context", 1)):
            asked = own.where(F.col("vec_id") % 20 == rest).select((F.col("vec_id") - rest).alias("qid"), "vec")
            best = ranking.block_top_k(own, asked, 10, "vec_id", "vec").withColumn("modality", F.lit(m)).withColumn("signal", F.lit(signal))
            first = best if first is None else first.union(best)
    fused = ranking.rrf(first, ["qid", "modality", "item"])
    return ranking.rrf(ranking.top_k(fused, ["qid", "modality"], [F.desc("score"), F.asc("item")]), ["qid", "item"])


@query(f"""WITH {SCENES}, r AS (SELECT q.vec_id AS qid, i.vec_id AS item, {cos_sql("i.vec", "q.vec")} AS score FROM scenes q JOIN scenes i USING (video) WHERE q.vec_id % 20 = 0
) SELECT qid, item, round(exp(score - max(score) OVER w) / sum(exp(score - mx)) OVER w, 6) AS probability, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item) AS rank
FROM (SELECT *, max(score) OVER (PARTITION BY qid) AS mx FROM r) WINDOW w AS (PARTITION BY qid) QUALIFY rank <= 5""")
def softmax_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a video's scenes meet its queries; each block gives a query's best and its sum of exponentials, which are put together."""
    s = views.scenes(spark, sf_dir).select("vec_id", "video", "vec")
    asked = s.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "video", "vec")
    best = ranking.softmax_top_k(s.select(F.col("vec_id").alias("item"), "video", "vec"), asked, "video", 5)
    return best.select("qid", "item", F.round("probability", 6).alias("probability"), F.col("rank").cast("long"))


# ---- pooling and segmentation


@query(f"""WITH {MODAL}, m AS ({mean_sql("modal", "video, modality")})
SELECT video, modality, unnest(range(0, len(vec))) AS place, round(unnest(vec), 6) AS mean FROM m""")
def vector_mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = pooling.mean_vectors(views.modal(views.scenes(spark, sf_dir)), ["video", "modality"])
    return pooled.select("video", "modality", F.posexplode("vec").alias("place", "m")).select("video", "modality", F.col("place").cast("long"), F.round("m", 6).alias("mean"))


@query(f"""WITH {SCENES}, {WINDOWS} SELECT w.video, w."window", array_to_string(list_sort(list_distinct(flatten(list(s.tags)))), ',') AS tags FROM windows w JOIN scenes s ON s.video = w.video AND s.ord >= w.first AND s.ord < w.first + w.n_scenes GROUP BY ALL""")
def window_tags_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.scenes(spark, sf_dir)
    members = intervals.window_members(intervals.scene_windows(s), s)
    return pooling.tag_union(members, ["video", "window"]).select("video", F.col("window").cast("long"), F.array_join("tags", ",").alias("tags"))


@query(f"""WITH {SCENES}, {WINDOWS} SELECT w.video, w."window", w.first, w.n_scenes, greatest(0, min(s.start)) AS start, greatest(0.01, max(s."end")) AS "end"
FROM windows w JOIN scenes s ON s.video = w.video AND s.ord >= w.first AND s.ord < w.first + w.n_scenes GROUP BY ALL""")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.scenes(spark, sf_dir)
    bounds = pooling.time_bounds(intervals.window_members(intervals.scene_windows(s), s), ["video", "window", "first", "n_scenes"])
    return bounds.select("video", *(F.col(c).cast("long") for c in ("window", "first", "n_scenes")), "start", "end")


@query("""WITH d AS (SELECT o_orderkey AS k, o_totalprice / 1000 AS d FROM orders), n AS (
  SELECT k, d, (floor(d / 35.0) + CASE WHEN d - floor(d / 35.0) * 35.0 > 0.3 THEN 1 ELSE 0 END)::BIGINT AS n FROM d
) SELECT k AS o_orderkey, segment, round(segment * 35.0::DOUBLE, 6) AS start, round(least((segment + 1) * 35.0::DOUBLE, d), 6) AS "end" FROM n, unnest(range(n)) AS t(segment)""")
def fixed_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = intervals.fixed_split(table(spark, sf_dir, "orders"), "o_orderkey", F.col("o_totalprice") / 1000)
    return cut.select("o_orderkey", F.col("segment").cast("long"), F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


def clips_sql(name: str, kind: str) -> str:
    return f"""{name} AS (SELECT event_id, user_id AS person, 'DAY' || (1 + (day(ts) - 1) % 7) AS day, hour(ts) * 3600.0::DOUBLE + minute(ts) * 60.0::DOUBLE + second(ts) AS "at", value FROM events WHERE event_type = '{kind}')"""


@query(f"""WITH {clips_sql("clips", "view")}, w AS (
  SELECT *, row_number() OVER (PARTITION BY person, day ORDER BY "at", event_id) - 1 AS ord, lead("at") OVER (PARTITION BY person, day ORDER BY "at", event_id) - 1 AS e FROM clips
) SELECT event_id, ord, "at" AS start, CASE WHEN e > "at" THEN e ELSE "at" + 30 END AS "end" FROM w""")
def clip_end_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = views.clips(spark, sf_dir).withColumnRenamed("at", "start")
    return intervals.clip_ends(clips, ["person", "day"], order=["event_id"]).select("event_id", F.col("ord").cast("long"), "start", "end")


@query(f"""WITH {SCENES}, g AS (SELECT video, ord AS scene, start, "end", vec[1] AS score, lag("end") OVER (PARTITION BY video ORDER BY start, ord) AS before FROM scenes
), i AS (SELECT *, sum(CASE WHEN start - before BETWEEN 0 AND 1.0 THEN 0 ELSE 1 END) OVER (PARTITION BY video ORDER BY start, scene) AS island FROM g
), p AS (SELECT *, row_number() OVER (PARTITION BY video, island ORDER BY start, scene) - 1 AS place FROM i
), z AS (SELECT *, place // 5 AS part, count(*) OVER (PARTITION BY video, island, place // 5) AS size FROM p)
SELECT video, min(start) AS start, arg_max("end", (start, scene)) AS "end", string_agg(scene::VARCHAR, '_' ORDER BY start, scene) AS scenes, count(*) AS n, round(max(score), 6) AS score
FROM z GROUP BY video, island, part, CASE WHEN size < 2 THEN place ELSE -1 END""")
def merge_consecutive(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.scenes(spark, sf_dir).select("video", F.col("ord").alias("scene"), "start", "end", F.col("vec")[0].alias("score"))
    return intervals.merge_consecutive(s, ["video"]).select("video", "start", "end", "scenes", F.col("n").cast("long"), F.round("score", 6).alias("score"))


# ---- joins and filters on clips

ASOF = f"""{clips_sql("clips", "view")}, {clips_sql("targets", "purchase")}, firsts AS (SELECT person, day, min("at") AS least FROM clips GROUP BY ALL
), found AS (SELECT t.event_id, t.person, t.day, t."at", coalesce(c."at", f.least) AS start FROM targets t
  ASOF LEFT JOIN clips c ON t.person = c.person AND t.day = c.day AND t."at" >= c."at" LEFT JOIN firsts f ON f.person = t.person AND f.day = t.day)"""


def _asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = views.clips(spark, sf_dir).select("person", "day", F.col("at").alias("start"))
    return intervals.asof(views.clips(spark, sf_dir, "purchase").drop("value"), clips, ["person", "day"])


@query(f"""WITH {ASOF} SELECT event_id, person, day, "at", start FROM found""")
def asof_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof(spark, sf_dir).select("event_id", "person", "day", "at", "start")


@query(f"WITH {clips_sql('clips', 'view')}, {clips_sql('targets', 'purchase')} SELECT event_id FROM targets t WHERE EXISTS (SELECT 1 FROM clips c WHERE c.person = t.person AND c.day = t.day)")
def semi_has_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.clips(spark, sf_dir, "purchase").join(views.clips(spark, sf_dir), ["person", "day"], "left_semi").select("event_id")


@query(f"""WITH {ASOF} SELECT event_id, start FROM found WHERE EXISTS (SELECT 1 FROM clips c WHERE c.person = found.person AND c.day = found.day AND c."at" = found.start AND c.event_id % 3 <> 0)""")
def has_embedded_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets whose clip, found by the as-of join, has an embedding (clips of two thirds of the ids)."""
    embedded = views.clips(spark, sf_dir).where("event_id % 3 <> 0").select("person", "day", F.col("at").alias("start"))
    return _asof(spark, sf_dir).join(embedded, ["person", "day", "start"], "left_semi").select("event_id", "start")


QSET = """qset AS (SELECT event_id AS qid, user_id AS person, ['DAY' || (1 + event_id % 9)] AS days, [{'s': 3600.0 * (event_id % 24), 'e': 3600.0 * (event_id % 24) + 1800}] AS ranges,
  CASE WHEN event_id % 3 = 0 THEN 'before_query_time' WHEN event_id % 3 = 1 THEN 'after_query_time' ELSE 'unrestricted' END AS relation, (event_id % 20) * 200.0 + (event_id % 24) * 3600.0 AS qt FROM events WHERE event_id % 20 = 0)"""


def qset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated queries: the events whose id is divisible by 20, with days, time ranges and a relation to their time."""
    i = F.col("event_id")
    hour = (i % 24) * F.lit(3600.0)
    rel = F.when(i % 3 == 0, "before_query_time").when(i % 3 == 1, "after_query_time").otherwise("unrestricted")
    asked = table(spark, sf_dir, "events").where(i % 20 == 0)
    days = F.array(F.concat(F.lit("DAY"), (1 + i % 9).cast("string")))
    return asked.select(i.alias("qid"), F.col("user_id").alias("person"), days.alias("days"), F.array(F.struct(hour.alias("s"), (hour + 1800).alias("e"))).alias("ranges"), rel.alias("relation"), ((i % 20) * 200.0 + hour).alias("qt"))


CANDIDATES = f"""{clips_sql("clips", "view")}, {QSET}, cand AS (SELECT q.*, c.event_id, c.day, c."at" FROM qset q JOIN clips c ON c.person = q.person
), c1 AS (SELECT *, list_contains(days, day) AS ok FROM cand), c2 AS (SELECT * FROM c1 QUALIFY ok OR count(*) FILTER (ok) OVER (PARTITION BY qid) = 0)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.clips(spark, sf_dir).join(qset(spark, sf_dir), "person")


def _by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.keep_or_fall_back(_candidates(spark, sf_dir), ["qid"], F.array_contains("days", F.col("day")))


@query(f"WITH {CANDIDATES} SELECT qid, event_id FROM c2")
def day_filter_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_day(spark, sf_dir).select("qid", "event_id")


@query(f"""WITH {CANDIDATES}, t1 AS (SELECT *, ("at" + 30 >= ranges[1].s AND "at" <= ranges[1].e) AND (relation <> 'before_query_time' OR "at" <= qt) AND (relation <> 'after_query_time' OR "at" + 30 >= qt) AS ok2 FROM c2)
SELECT qid, event_id FROM t1 QUALIFY ok2 OR count(*) FILTER (ok2) OVER (PARTITION BY qid) = 0""")
def time_filter_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    passes = filters.in_time(F.col("at"), F.col("ranges"), F.col("relation"), F.col("qt"))
    return filters.keep_or_fall_back(_by_day(spark, sf_dir), ["qid"], passes).select("qid", "event_id")


@query(f"""WITH {clips_sql("clips", "view")}, {clips_sql("targets", "purchase")}
SELECT c.event_id AS clip, t.event_id AS target FROM clips c JOIN targets t ON c.person = t.person AND c.day = t.day AND c."at" + 1800 >= t."at" - 600 AND c."at" <= t."at" """)
def interval_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = views.clips(spark, sf_dir).select("person", "day", F.col("event_id").alias("clip"), F.col("at").alias("start"), (F.col("at") + 1800).alias("end"))
    right = views.clips(spark, sf_dir, "purchase").select("person", "day", F.col("event_id").alias("target"), (F.col("at") - 600).alias("r_start"), F.col("at").alias("r_end"))
    return intervals.overlap_join(left, right, ["person", "day"], 1800.0).select("clip", "target")


@query(f"WITH {SCENES} SELECT q.vec_id AS qid, s.vec_id AS item FROM scenes q JOIN scenes s ON list_has_any(s.tags, [q.tags[1]]) WHERE q.vec_id % 20 = 0")
def tag_overlap_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.scenes(spark, sf_dir)
    wanted = s.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.array(F.upper(F.col("tags")[0])).alias("wanted"))
    return filters.sharing_a_tag(s.select(F.col("vec_id").alias("item"), "tags"), wanted).select("qid", "item")


# ---- metrics

PREDICTIONS = f"""{PAIRS}, gt AS (SELECT vec_id AS qid, video AS gt_video, start - 2 AS gs, "end" + 4 AS ge FROM scenes WHERE vec_id % 20 = 0
), p0 AS (SELECT l.qid, l.rank, s.video, s.start AS s, s."end" AS e, gt_video, gs, ge FROM lists l JOIN scenes s ON s.vec_id = l.item JOIN gt ON gt.qid = l.qid WHERE l.modality = 'a' AND l.item <> l.qid
), p1 AS (SELECT *, video = gt_video AS same, greatest(0, least(e, ge) - greatest(s, gs)) AS shared FROM p0
), preds AS (SELECT *, CASE WHEN same THEN shared / ((e - s) + (ge - gs) - shared) ELSE 0 END AS iou, CASE WHEN same THEN shared / (ge - gs) ELSE 0 END AS iou_gt FROM p1)"""


def _predictions(spark: SparkSession, sf_dir: str, depth: int = 10) -> tuple[DataFrame, DataFrame]:
    s = views.scenes(spark, sf_dir).select("vec_id", "video", "start", "end")
    truth = s.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("video").alias("gt_video"), (F.col("start") - 2).alias("gs"), (F.col("end") + 4).alias("ge"))
    best = lists(spark, sf_dir, ("a",), depth).where("item <> qid").select("qid", "rank", "item")
    rows = best.join(s.withColumnRenamed("vec_id", "item"), "item").join(truth, "qid")
    same = F.col("video") == F.col("gt_video")
    bounds = (F.col("start"), F.col("end"), F.col("gs"), F.col("ge"))
    iou = F.when(same, times.interval_iou(*bounds)).otherwise(0.0)
    by_truth = F.when(same, times.interval_iou(*bounds, by_truth=True)).otherwise(0.0)
    return truth, rows.select("qid", "rank", same.alias("same"), iou.alias("iou"), by_truth.alias("iou_gt"))


def metric_sql(value: str, name: str, default: str = "0") -> str:
    return f"WITH {PREDICTIONS} SELECT round(coalesce(avg(coalesce(v, {default})), 0), 6) AS {name} FROM gt LEFT JOIN (SELECT qid, {value} AS v FROM preds GROUP BY qid) USING (qid)"


def _metric(spark: SparkSession, sf_dir: str, value, name: str, default: float = 0.0) -> DataFrame:
    truth, found = _predictions(spark, sf_dir)
    return metrics.mean_over(truth, found, value, name, default)


@query(metric_sql("max(iou) FILTER (rank = 1)", "tiou"))
def tiou_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metric(spark, sf_dir, F.max(F.when(F.col("rank") == 1, F.col("iou"))), "tiou")


@query(metric_sql("avg((iou > 0)::INT)", "overlap"))
def overlap_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metric(spark, sf_dir, F.avg((F.col("iou") > 0).cast("double")), "overlap")


@query(f"""WITH {PREDICTIONS}, grid AS (SELECT k, tau::DOUBLE AS tau FROM (VALUES (1), (3), (5), (10)) a(k), (VALUES (0.3), (0.5)) b(tau))
SELECT k, tau, round(avg((EXISTS (SELECT 1 FROM preds p WHERE p.qid = gt.qid AND p.rank <= k AND p.iou >= tau))::INT), 6) AS recall FROM gt, grid GROUP BY ALL""")
def recall_at_k_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.recall_table(*_predictions(spark, sf_dir), [1, 3, 5, 10], [0.3, 0.5]).select(F.col("k"), "tau", "recall")


@query(metric_sql("sum(iou_gt) FILTER (rank <= 5)", "simple_recall"))
def simple_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metric(spark, sf_dir, F.sum(F.when(F.col("rank") <= 5, F.col("iou_gt"))), "simple_recall")


@query(metric_sql("max(iou / rank)", "mrr"))
def mrr_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metric(spark, sf_dir, F.max(F.col("iou") / F.col("rank")), "mrr")


@query(metric_sql("coalesce(arg_max(rank, (iou, -rank)) FILTER (iou > 0) - max(iou) * (arg_max(rank, (iou, -rank)) FILTER (iou > 0) - 1), count(*) + 1)", "mean_rank", "1"))
def mean_rank_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metric(spark, sf_dir, metrics.adjusted_rank(), "mean_rank", 1.0)


@query(metric_sql("max(same::INT)", "accuracy"))
def video_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metric(spark, sf_dir, F.max(F.col("same").cast("int")), "accuracy")


@query(f"WITH {PREDICTIONS} SELECT round(coalesce(count(*) FILTER (same) / nullif(count(*), 0), 0), 6) AS precision FROM preds")
def video_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = _predictions(spark, sf_dir)
    return found.agg(F.round(F.coalesce(F.try_divide(F.count_if("same"), F.count("*")), F.lit(0.0)), 6).alias("precision"))


@query(metric_sql("(max(iou) >= 0.3)::INT", "iou_at_tau"))
def iou_at_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metric(spark, sf_dir, (F.max("iou") >= 0.3).cast("int"), "iou_at_tau")


@query(metric_sql("(sum(iou) >= 0.5)::INT", "cumulative_iou"))
def cumulative_iou_at_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metric(spark, sf_dir, (F.sum("iou") >= 0.5).cast("int"), "cumulative_iou")


@query(metric_sql("max(iou) FILTER (rank <= 5)", "miou"))
def miou_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metric(spark, sf_dir, F.max(F.when(F.col("rank") <= 5, F.col("iou"))), "miou")


@query(f"""WITH {ASOF}, truth AS (SELECT event_id AS target, person, day, start FROM found), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY person, day ORDER BY value DESC, event_id) AS rank FROM clips
), hit AS (SELECT target, min(rank) AS rank FROM truth LEFT JOIN ranked r ON r.person = truth.person AND r.day = truth.day AND r."at" = truth.start GROUP BY target)
SELECT k, count(*) FILTER (rank <= k) AS hits, count(*) AS total, round(count(*) FILTER (rank <= k) / count(*), 6) AS recall FROM hit, (VALUES (1), (3), (5), (10)) AS t(k) GROUP BY k""")
def clip_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = ranking.top_k(views.clips(spark, sf_dir), ["person", "day"], [F.desc("value"), F.asc("event_id")])
    truth = _asof(spark, sf_dir).select(F.col("event_id").alias("target"), "person", "day", F.col("start").alias("at"))
    hit = truth.join(clips, ["person", "day", "at"], "left").groupBy("target").agg(F.min("rank").alias("rank"))
    ks = [1, 3, 5, 10]
    row = hit.agg(*(F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks), F.count("*").alias("total"))
    each = F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("hits"), F.col("total").alias("total"), F.round(F.try_divide(f"h{k}", "total"), 6).alias("recall")) for k in ks))
    return row.select(F.inline(each))


@query(f"""WITH {CANDIDATES}, j AS (SELECT qid, qid % 5 <> 0 AS filtered, list_contains(days, day) AS hit FROM cand)
SELECT count(*) AS n, count(*) FILTER (filtered) AS n_filtered, round(count(*) FILTER (filtered AND hit) / nullif(count(*) FILTER (filtered), 0), 6) AS hit_rate, round(count(*) FILTER (filtered) / count(*), 6) AS coverage FROM j""")
def plan_filter_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(spark, sf_dir)
    hit = F.when(F.col("qid") % 5 != 0, F.array_contains("days", F.col("day")))
    return rows.select(hit.alias("hit")).agg(F.count("*").alias("n"), F.count("hit").alias("n_filtered"), F.round(F.try_divide(F.count_if("hit"), F.count("hit")), 6).alias("hit_rate"), F.round(F.try_divide(F.count("hit"), F.count("*")), 6).alias("coverage"))


# ---- planning and parsing


SENTENCES_SQL = """SELECT doc_id AS qid, lower(coalesce(text, '')) || CASE doc_id % 12 WHEN 0 THEN ' who was talking yesterday morning' WHEN 1 THEN ' what will i do this afternoon' WHEN 2 THEN ' where are my keys earlier today'
         WHEN 3 THEN ' on day 3 and day3 at lunch' WHEN 4 THEN ' the day before' WHEN 5 THEN ' the next day at dawn' WHEN 6 THEN ' any day late night' WHEN 7 THEN ' after lunch' WHEN 8 THEN ' before lunch' WHEN 9 THEN ' tonight' WHEN 10 THEN ' breakfast' ELSE '' END AS t,
         CASE WHEN doc_id % 10 < 9 THEN 'DAY' || (1 + doc_id % 7) END AS d, CASE WHEN doc_id % 11 < 10 THEN ((doc_id * 977) % 86400)::DOUBLE END AS s, doc_id % 5 = 0 AS need FROM documents"""
ENDS = [" who was talking yesterday morning", " what will i do this afternoon", " where are my keys earlier today", " on day 3 and day3 at lunch", " the day before", " the next day at dawn", " any day late night", " after lunch", " before lunch", " tonight", " breakfast", ""]


def planner_sql(source: str = SENTENCES_SQL) -> str:
    """The planner's decisions over sentences (qid, t in lower case, d, s, need), from the same fixed values."""
    esc = lambda s: "'" + s.replace("'", "''") + "'"
    has = lambda words: "(" + " OR ".join(f"contains(t, {esc(w)})" for w in words) + ")"
    shift = lambda by: f"CASE WHEN n + ({by}) BETWEEN 1 AND 7 THEN ['DAY' || (n + ({by}))] ELSE []::VARCHAR[] END"
    cases = [("len(explicit) > 0", "explicit", "explicit"), (has(planner.PREVIOUS), shift(-1), "previous"), (has(planner.YESTERDAY), shift(-1), "yesterday"), (has(planner.NEXT), shift(1), "next"), (has(planner.ANY_DAY), "[]::VARCHAR[]", "unrestricted"), ("coalesce(d, '') <> ''", "[upper(d)]", "same_day")]
    days = "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v, _ in cases) + " ELSE []::VARCHAR[] END"
    how = "CASE " + " ".join(f"WHEN {c} THEN {esc(n)}" for c, _, n in cases) + " ELSE 'unrestricted' END"
    label = "CASE " + " ".join(f"WHEN regexp_matches(t, {esc(chr(92) + 'b' + p + chr(92) + 'b')}) THEN {esc(n)}" for p, n in planner.TIME_PHRASES) + " END"
    first = "CASE label " + " ".join(f"WHEN {esc(n)} THEN {min(a for a, _ in r) * 3600.0}" for n, r in planner.TIME_OF_DAY.items()) + " END"
    last = "CASE label " + " ".join(f"WHEN {esc(n)} THEN {max(b for _, b in r) * 3600.0}" for n, r in planner.TIME_OF_DAY.items()) + " END"
    text = "CASE label " + " ".join(f"WHEN {esc(n)} THEN {esc(';'.join(f'{a * 3600}-{b * 3600}' for a, b in r))}" for n, r in planner.TIME_OF_DAY.items()) + " ELSE '' END"
    rel = f"""CASE WHEN how IN ('previous', 'yesterday', 'next') THEN 'unrestricted' WHEN {has(planner.AFTER)} THEN 'after_query_time' WHEN {has(planner.BEFORE)} THEN 'before_query_time'
      WHEN coalesce(s, 0) = 0 THEN 'unrestricted' WHEN s <= first THEN 'after_query_time' WHEN s >= last THEN 'before_query_time' WHEN label IS NOT NULL THEN 'around_query_time'
      WHEN {has(planner.TODAY)} THEN 'before_query_time' ELSE 'unrestricted' END"""
    audio, video = f"(coalesce(need, false) OR {has(planner.AUDIO_WORDS)})", has(planner.VISUAL_WORDS)
    order = f"CASE WHEN {audio} AND {video} THEN 'audio,video,text' WHEN {audio} THEN 'audio,text,video' WHEN {video} THEN 'video,text,audio' ELSE 'text,video,audio' END"
    return f"""WITH src AS (
  {source}
), a AS (SELECT *, regexp_extract(d, '(\\d+)', 1)::INT AS n, list_transform(list_distinct(regexp_extract_all(t, '\\bday\\s*([1-7])\\b', 1)), lambda x: 'DAY' || x) AS explicit FROM src WHERE d IS NOT NULL
  UNION ALL SELECT *, NULL, list_transform(list_distinct(regexp_extract_all(t, '\\bday\\s*([1-7])\\b', 1)), lambda x: 'DAY' || x) FROM src WHERE d IS NULL
), b AS (SELECT *, {days} AS days, {how} AS how, {label} AS label FROM a), c AS (SELECT *, {first} AS first, {last} AS last FROM b)
SELECT qid, array_to_string(list_sort(days), ',') AS days, how AS relative_day, coalesce(label, '') AS time_of_day, {text} AS ranges, {rel} AS relation, {order} AS modalities FROM c"""


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with an ending that names a day or time, as queries of a planner."""
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        i.alias("qid"),
        F.concat(F.coalesce("text", F.lit("")), F.element_at(F.array(*map(F.lit, ENDS)), (i % 12 + 1).cast("int"))).alias("query_text"),
        F.when(i % 10 < 9, F.concat(F.lit("DAY"), (1 + i % 7).cast("string"))).alias("query_date"),
        F.when(i % 11 < 10, ((i * 977) % 86400).cast("double")).alias("query_time_sec"),
        (i % 5 == 0).alias("need_audio"),
    )


@query(planner_sql())
def plan_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = planner.plan(sentences(spark, sf_dir))
    ranges = F.array_join(F.transform("plan.time_ranges", lambda r: F.concat_ws("-", r["s"].cast("long").cast("string"), r["e"].cast("long").cast("string"))), ";")
    return p.select(
        "qid", F.array_join(F.array_sort("plan.allowed_days"), ",").alias("days"), "plan.relative_day", F.coalesce("plan.time_of_day", F.lit("")).alias("time_of_day"),
        ranges.alias("ranges"), "plan.relation", F.array_join("plan.modalities", ",").alias("modalities"),
    )


@query("""SELECT event_id, round(hour(ts) * 3600 + minute(ts) * 60 + second(ts) + (date_part('microsecond', ts) % 1000000 // 10000) / 100.0::DOUBLE, 6) AS seconds, 'DAY' || day(ts) AS day FROM events""")
def time_string_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    name = F.concat(F.lit("day"), F.dayofmonth("ts").cast("string"), F.lit("_A1_X_"), F.date_format("ts", "HHmmssSS"))
    return e.select("event_id", F.round(times.clip_start(name), 6).alias("seconds"), times.day_label(name).alias("day"))


# ---- tags

CENTROIDS = f"""{SCENES}, cent AS ({mean_sql("scenes", "video")}), sims AS (
  SELECT s.vec_id AS item, s.video, c.video AS tag, {cos_sql("s.vec", "c.vec")} AS score FROM scenes s, cent c)"""


def _similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scene against the ten label centroids, used as a tag vocabulary of fixed size."""
    s = views.scenes(spark, sf_dir).withColumn("norm", vectors.norm(F.col("vec")))
    c = pooling.mean_vectors(s, ["video"]).select(F.col("video").alias("tag"), F.col("vec").alias("c"), vectors.norm(F.col("vec")).alias("cn"))
    vocabulary = tables.written(c, "tags")
    if vocabulary.count() > tables.VOCABULARY:
        raise ValueError(f"a vocabulary of tags has at most {tables.VOCABULARY} of them")
    listed = vocabulary.agg(F.collect_list(F.struct("tag", "c", "cn")).alias("_vocabulary"))  # one row, of the counted size
    rows = s.join(F.broadcast(listed)).select("vec_id", "video", "vec", "norm", F.inline("_vocabulary"))
    return rows.select(F.col("vec_id").alias("item"), "video", "tag", F.round(vectors.cosine(F.col("vec"), F.col("c"), F.col("norm"), F.col("cn")), 12).alias("score"))


@query(f"""WITH {CENTROIDS}, l AS (SELECT item, greatest(quantile_cont(score::DOUBLE, 0.7), 0.1) AS lim FROM sims GROUP BY item)
SELECT item, tag, round(score, 6) AS score, row_number() OVER (PARTITION BY item ORDER BY score DESC, tag) AS rank FROM sims JOIN l USING (item) WHERE score > lim QUALIFY rank <= 10""")
def tag_query_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = tagging.tags_by_quantile(_similarities(spark, sf_dir).drop("video"), ["item"])
    return best.select("item", "tag", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


@query(f"""WITH {CENTROIDS}, e AS (SELECT video, tag, 0.8::DOUBLE * max(score) + 0.2::DOUBLE * avg(score) AS score FROM sims GROUP BY ALL
), l AS (SELECT video, greatest(quantile_cont(score, 0.75), 0.1) AS lim FROM e GROUP BY video
), p AS (SELECT video, tag, avg((score > 0.8::DOUBLE * lim)::INT) AS share FROM sims JOIN l USING (video) GROUP BY ALL)
SELECT video, tag, round(score, 6) AS score, round(share, 6) AS share FROM e JOIN l USING (video) JOIN p USING (video, tag) WHERE score > lim AND share >= 0.05""")
def tag_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tagging.frame_tags(_similarities(spark, sf_dir).drop("item"), ["video"])
    return found.select("video", "tag", F.round("score", 6).alias("score"), F.round("share", 6).alias("share"))


GROUPS = [("even", ["t0", "t2", "t4", "t6", "t8", "t10"]), ("odd", ["t1", "t3", "t5", "t7", "t9"]), ("low", ["t0", "t1", "t2", "t3"])]
GROUPS_SQL = ", ".join(f"('{g}', '{t}')" for g, ts in GROUPS for t in ts)


@query(f"""WITH {SCENES}, x AS (SELECT DISTINCT vec_id AS item, unnest(tags) AS tag FROM scenes), sc AS (SELECT item, tag, 0.1::DOUBLE * (1 + item % 5) AS score FROM x
), g AS (SELECT * FROM (VALUES {GROUPS_SQL}) AS v(grp, tag)), m AS (SELECT item, grp, tag, count(*) OVER (PARTITION BY item, grp) - 1 AS c FROM sc JOIN g USING (tag)), b AS (SELECT item, tag, sum(c) AS boost FROM m GROUP BY ALL)
SELECT item, tag, round(score * (1 + 0.1::DOUBLE * coalesce(boost, 0)), 6) AS boosted FROM sc LEFT JOIN b USING (item, tag)""")
def tag_cooccurrence_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = views.scenes(spark, sf_dir).select(F.col("vec_id").alias("item"), F.explode("tags").alias("tag")).distinct()
    groups = spark.createDataFrame([(g, t) for g, ts in GROUPS for t in ts], "grp string, tag string")
    boosted = tagging.co_occurrence(each.withColumn("score", 0.1 * (1 + F.col("item") % 5)), groups)
    return boosted.select("item", "tag", F.round("boosted", 6).alias("boosted"))


@query(f"WITH {SCENES}, x AS (SELECT unnest(tags) AS tag FROM scenes), c AS (SELECT split_part(tag, '_', 1) AS category, tag, count(*) AS n FROM x GROUP BY ALL) SELECT *, sum(n) OVER (PARTITION BY category)::BIGINT AS in_category FROM c")
def tag_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagging.tag_statistics(views.scenes(spark, sf_dir)).select("category", "tag", "n", "in_category")


# ---- annotations, texts, statistics


@query("""WITH l AS (SELECT doc_id % 5 AS person, (quality = toxic)::INT AS correct FROM labels)
SELECT coalesce(person::VARCHAR, 'all') AS person, sum(correct)::BIGINT AS correct, count(*) AS total, round(sum(correct) / count(*), 6) AS accuracy FROM l GROUP BY ROLLUP (person)""")
def choice_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    letter = lambda c: F.element_at(F.array(F.lit("B. it is"), F.lit("The answer is c")), F.col(c).cast("int") + 1)
    rows = table(spark, sf_dir, "labels").select((F.col("doc_id") % 5).alias("person"), (texts.choice_letter(letter("quality")) == texts.choice_letter(letter("toxic"))).cast("int").alias("correct"))
    return rows.rollup("person").agg(F.sum("correct").alias("correct"), F.count("*").alias("total")).select(F.coalesce(F.col("person").cast("string"), F.lit("all")).alias("person"), "correct", "total", F.round(F.col("correct") / F.col("total"), 6).alias("accuracy"))


@query("""WITH ch AS (SELECT doc_id, arg_max('label ' || quality || toxic || part, part) AS new FROM labels, (VALUES (1), (2)) AS v(part) WHERE part = 1 OR doc_id % 2 = 0 GROUP BY 1)
SELECT d.doc_id, md5(coalesce(new, text)) AS text_md5, new IS NOT NULL AS replaced FROM documents d LEFT JOIN ch USING (doc_id)""")
def annotation_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change for every labelled document, a second and later one for those with even ids."""
    rows = table(spark, sf_dir, "labels").withColumn("seq", F.explode(F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    changes = rows.select("doc_id", F.concat(F.lit("label "), *(F.col(c).cast("string") for c in ("quality", "toxic", "seq"))).alias("text"), "seq")
    done = annotations.updated(table(spark, sf_dir, "documents").select("doc_id", "text"), changes, ["doc_id"], "text", "seq")
    return done.select("doc_id", F.md5("text").alias("text_md5"), "replaced")


@query("SELECT count(*) AS total, count(DISTINCT source) AS videos, round(avg(length(text)), 6) AS mean_length, round(avg(n_chars), 6) AS mean_chars, round(avg(length(text) - n_chars), 6) AS mean_delta, count(*) FILTER (trim(text) = '') AS n_empty FROM documents")
def refactor_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "n_chars", F.length("text").alias("n"), (F.trim("text") == "").alias("blank"))
    return d.agg(F.count("*").alias("total"), F.countDistinct("source").alias("videos"), F.round(F.avg("n"), 6).alias("mean_length"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.round(F.avg(F.col("n") - F.col("n_chars")), 6).alias("mean_delta"), F.count_if("blank").alias("n_empty"))


@query("""WITH u AS (SELECT lang AS key, 0 AS part, doc_id AS seq FROM documents UNION ALL SELECT role, 1, conv_id * 1000 + turn FROM conversations UNION ALL SELECT source, 2, doc_id FROM documents)
SELECT key, part, seq FROM u WHERE key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY part, seq) = 1""")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that occur many times in a part and in several parts."""
    docs, said = table(spark, sf_dir, "documents"), table(spark, sf_dir, "conversations")
    parts = [docs.select(F.col("lang").alias("key"), F.col("doc_id").alias("seq")), said.select(F.col("role").alias("key"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq")), docs.select(F.col("source").alias("key"), F.col("doc_id").alias("seq"))]
    return annotations.first_of_each([p.where("key IS NOT NULL") for p in parts], ["key"], "seq").select("key", F.col("part").cast("int"), "seq")


@query(f"""WITH {SCENES}, c AS (SELECT {cos_sql("a", "b")} AS c FROM scenes WHERE b IS NOT NULL) SELECT count(*) AS n, round(avg(c), 6) AS mean, round(stddev_pop(c), 6) AS std FROM c""")
def modality_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = views.modal(views.scenes(spark, sf_dir))
    x, y = (long.where(F.col("modality") == m).select("vec_id", F.col("vec").alias(m), F.col("norm").alias(f"n{m}")) for m in ("a", "b"))
    c = x.join(y, "vec_id").select(vectors.cosine(F.col("a"), F.col("b"), F.col("na"), F.col("nb")).alias("c"))
    return c.agg(F.count("*").alias("n"), F.round(F.avg("c"), 6).alias("mean"), F.round(F.stddev_pop("c"), 6).alias("std"))


@query(f"WITH {SCENES}, x AS (SELECT unnest(range(0, len(vec))) AS place, unnest(vec) AS v FROM scenes) SELECT place, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM x GROUP BY place")
def norm_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = views.scenes(spark, sf_dir).select(F.posexplode("vec").alias("place", "v"))
    return each.groupBy(F.col("place").cast("long").alias("place")).agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("std"))


@query("""SELECT 'vector' AS kind, label::VARCHAR AS name, sum(len(embedding) * 4)::BIGINT AS bytes FROM embeddings GROUP BY label UNION ALL
SELECT 'text', source, sum(strlen(text))::BIGINT FROM documents GROUP BY source ORDER BY bytes DESC, kind, name LIMIT 20""")
def storage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.sum(F.size("embedding") * 4).alias("bytes")).select(F.lit("vector").alias("kind"), F.col("label").cast("string").alias("name"), "bytes")
    t = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.octet_length("text")).alias("bytes")).select(F.lit("text").alias("kind"), F.col("source").alias("name"), "bytes")
    return v.union(t).orderBy(F.desc("bytes"), "kind", "name").limit(20)


@query("""WITH t AS (SELECT conv_id, turn, role, CASE WHEN length(text) > 60 THEN rtrim(left(text, 60)) || '...' ELSE text END AS x FROM conversations)
SELECT conv_id, string_agg(role || ': ' || x, chr(10) ORDER BY turn) AS prompt FROM t GROUP BY conv_id""")
def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("role", F.lit(": "), texts.shortened(F.col("text"), 60)).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "x")))
    return t.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda r: r["x"]), "\n").alias("prompt"))


@query("SELECT event_id, coalesce((props->>'$.k')::BIGINT, -1) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.from_json("props", "k long")["k"], F.lit(-1)).alias("k"))


#: Replies of models with the object that each should give, by event; # stands for the event's id.
REPLIES = [
    ('Sure: ```json\n{"k": 2*#, "b": None, "s": "said “hi”", "h": 60/2, # half "an hour"\n}\n``` done', '{"k": (2#), "b": null, "s": "said “hi”", "h": 30}'),
    ('{"k": #, "s": "x, y"}', '{"k": (#), "s": "x, y"}'),
    ('Answer: {"a": [1, #,], "b": {"c": True,},} and {"other": 1}', '{"a": [1, (#)], "b": {"c": true}}'),
    ("no object, # at all", None),
    ('{"k": #, // a } that counts for nothing\n "x": 3+4-2, "y": 7/2}', '{"k": (#), "x": 5, "y": 3.5}'),
    ('```\n{"s": "a } \\" b #", "n": 24*60, "f": False}\n```', '{"s": "a } \\" b (#)", "n": 1440, "f": false}'),
    ("{“k”: #, “w”: “so”}", '{"k": (#), "w": "so"}'),
    ('{"k": # and no end', None),
]


def _replies_sql() -> str:
    """The objects, with the event's id (or twice it) put in."""
    put = lambda made: "NULL" if made is None else "'" + made.replace("'", "''").replace("(2#)", "' || (2 * event_id) || '").replace("(#)", "' || event_id || '") + "'"
    return "SELECT event_id, CASE event_id % " + str(len(REPLIES)) + " " + " ".join(f"WHEN {n} THEN {put(made)}" for n, (_, made) in enumerate(REPLIES)) + " END AS json FROM events"


@query(_replies_sql())
def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    reply = F.element_at(F.array(*(F.lit(r) for r, _ in REPLIES)), (i % len(REPLIES) + 1).cast("int"))
    numbered = F.regexp_replace(reply, "#(?! half)", i.cast("string"))
    return table(spark, sf_dir, "events").select("event_id", texts.repaired_json(numbered).alias("json"))


@query()
def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("after"))
    return t.where("after IS NOT NULL").select("conv_id", "turn", F.round(texts.rouge_l_score("text", "after"), 6).alias("rouge_l"))


@query()
def bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("after"))
    return t.where("after IS NOT NULL").select("conv_id", "turn", F.round(texts.bleu_score("text", "after"), 6).alias("bleu"))


@query()
def pca_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    rows = views.scenes(spark, sf_dir).select(array_to_vector("vec").alias("vec"))
    found = PCA(k=5, inputCol="vec", outputCol="pc").fit(rows).explainedVariance.toArray().tolist()
    return spark.createDataFrame([(i, round(v, 6), round(sum(found[: i + 1]), 6)) for i, v in enumerate(found)], "component int, explained double, cumulative double")


def _kmeans_sql(per: int, most: int, rounds: int) -> str:
    """The rounds of grouped k-means, unrolled."""
    away = "list_transform(centres, lambda c: round(pow(list_distance(vec, c), 2), 9)) AS ds"
    steps = [f"""r AS (SELECT video AS grp, vec_id AS id, vec FROM scenes
), s1 AS MATERIALIZED (SELECT grp, least(count(*) // {per} + 1, {most}) AS k, [arg_min(vec, id)] AS centres FROM r GROUP BY grp)"""]
    for k in range(2, most + 1):
        steps.append(f"""s{k} AS MATERIALIZED (SELECT s.grp, s.k, CASE WHEN s.k < {k} OR x.v IS NULL THEN s.centres ELSE list_append(s.centres, x.v) END AS centres
  FROM s{k - 1} AS s LEFT JOIN (SELECT grp, first(vec ORDER BY list_min(ds) DESC, id) AS v FROM (SELECT r.grp, id, vec, {away} FROM r JOIN s{k - 1} USING (grp)) WHERE list_min(ds) > 0 GROUP BY grp) AS x USING (grp))""")
    before = f"s{most}"
    placed = "SELECT grp, id, vec, list_min(ds) AS d, list_position(ds, list_min(ds)) - 1 AS cluster FROM (SELECT r.grp, id, vec, {away} FROM r JOIN {before} USING (grp))"
    for n in range(rounds):
        steps.append(f"""m{n} AS (SELECT grp, cluster, list(m ORDER BY q) AS mean FROM (SELECT grp, cluster, q, round(avg(x), 9) AS m FROM (SELECT grp, cluster, unnest(vec) AS x, unnest(range(len(vec))) AS q
  FROM ({placed.format(away=away, before=before)})) GROUP BY ALL) GROUP BY grp, cluster
), c{n} AS MATERIALIZED (SELECT c.grp, list(coalesce(m.mean, c.c) ORDER BY c.cluster) AS centres FROM (SELECT grp, unnest(centres) AS c, unnest(range(len(centres))) AS cluster FROM {before}) AS c LEFT JOIN m{n} AS m USING (grp, cluster) GROUP BY c.grp)""")
        before = f"c{n}"
    return f"WITH {SCENES}, {', '.join(steps)} SELECT grp AS video, cluster::INT AS cluster, first(id ORDER BY d, id) AS medoid, count(*) AS n FROM ({placed.format(away=away, before=before)}) GROUP BY grp, cluster"


@query(_kmeans_sql(8, 8, 5))
def kmeans_medoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key frames: the scene nearest to the centre of each of a video's clusters, one cluster for every eight scenes begun."""
    rows = views.scenes(spark, sf_dir).select("video", "vec_id", "vec")
    return clusters.medoids(clusters.grouped_kmeans(rows, "video", "vec_id", "vec", rounds=5), "video", "vec_id")


CUTS = changes.Settings(penalty=0.95, least=2, most=8)


@query(f"""WITH RECURSIVE {SCENES}, n AS (SELECT video, count(*) AS n FROM scenes GROUP BY video
), sums AS MATERIALIZED (
  SELECT video, ord + 1 AS t, list(p ORDER BY q) AS p, any_value(s) AS s FROM (
    SELECT video, ord, q, sum(x) OVER (PARTITION BY video, q ORDER BY ord) AS p, sum(y) OVER (PARTITION BY video, q ORDER BY ord) AS s
    FROM (SELECT video, ord, list_inner_product(vec, vec) AS y, unnest(vec) AS x, unnest(range(len(vec))) AS q FROM scenes)) GROUP BY ALL
  UNION ALL SELECT video, 0, list_transform(range(64), lambda x: 0.0::DOUBLE), 0 FROM n
), costs AS MATERIALIZED (
  SELECT a.video, a.t AS s, b.t AS t, round(b.s - a.s - pow(list_distance(a.p, b.p), 2) / (b.t - a.t), 9) + {CUTS.penalty} AS cost
  FROM sums AS a JOIN sums AS b ON a.video = b.video AND b.t - a.t BETWEEN {CUTS.least} AND {CUTS.most}
), dp AS (
  SELECT video, 0::BIGINT AS t, [0.0::DOUBLE] AS f, [-1::BIGINT] AS b FROM n
  UNION ALL
  SELECT d.video, d.t + 1, list_append(any_value(d.f), coalesce(min(d.f[c.s + 1] + c.cost), 'inf'::DOUBLE)), list_append(any_value(d.b), first(c.s ORDER BY d.f[c.s + 1] + c.cost, c.s))
  FROM dp AS d JOIN n ON n.video = d.video AND d.t < n.n LEFT JOIN costs AS c ON c.video = d.video AND c.t = d.t + 1 GROUP BY d.video, d.t
), ends AS MATERIALIZED (SELECT dp.video, n, b FROM dp JOIN n ON n.video = dp.video AND n.n = dp.t
), walk AS (
  SELECT video, CASE WHEN n < {CUTS.least} THEN 0 ELSE b[n + 1] END AS first, n AS after FROM ends
  UNION ALL SELECT w.video, e.b[w.first + 1], w.first FROM walk AS w JOIN ends AS e USING (video) WHERE w.first > 0
), w AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY first) - 1 AS scene FROM walk)
SELECT w.video, scene, first, after, min(s.start) AS start, max(s."end") AS "end" FROM w JOIN scenes AS s ON s.video = w.video AND s.ord >= first AND s.ord < after GROUP BY ALL""")
def content_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes of like vectors in each video, with their times."""
    rows = tables.written(views.scenes(spark, sf_dir).select("video", F.col("ord").alias("place"), "vec", "start", "end"), "scenes")
    cuts = changes.content_scenes(rows, CUTS)
    places = cuts.withColumn("place", F.explode(F.sequence("first", F.col("after") - 1)))
    timed = places.join(rows.select("video", F.col("place").cast("long").alias("place"), "start", "end"), ["video", "place"])
    return timed.groupBy("video", "scene", "first", "after").agg(F.min("start").alias("start"), F.max("end").alias("end"))


# ---- abilities of the host engine


@query("""SELECT coalesce(l_returnflag, 'all') AS flag, coalesce(l_linestatus, 'all') AS status, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01' GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def rollup_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate < TIMESTAMP_NTZ '1997-01-01 00:00:00'").rollup("l_returnflag", "l_linestatus")
    summed = rows.agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))
    return summed.select(F.coalesce("l_returnflag", F.lit("all")).alias("flag"), F.coalesce("l_linestatus", F.lit("all")).alias("status"), "revenue", "n")


@query("SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def except_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sold = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_partkey")
    return table(spark, sf_dir, "part").select("p_partkey").subtract(sold)


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS split FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)
), s AS (SELECT user_id, ts, sum(split) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, session""")
def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming.events import sessions

    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return sessions(rows).select("user_id", F.unix_micros("start").alias("start_us"), "n")


from . import chain, flows  # noqa: E402,F401  they register their queries, too
