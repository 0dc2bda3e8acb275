"""Host-level quality rules (operator 10, native).

Rule failures are counted for each document, summed by host, and the hosts' failure rates are shrunk towards an empirical
beta prior (method of moments over the hosts), so that a host with few documents is judged mostly by the corpus. The host
verdicts are joined back: on a rejected host one soft failure is enough to drop a document, elsewhere it takes two. A
document that fails no rule is always kept.

Everything is built from DataFrame functions: words, lines and 3-word windows stay arrays within their row, so the only
shuffles are the partial sums by host and the join of the verdicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, NOT_SPACE, SPACE, bounded_broadcast, fresh, materialise

MIN_WORDS = 50
#: Salts of the verdict join where there are too many hosts to broadcast.
SALTS = 32

FEATURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def _repeat_words(words: Column, hashes: str) -> Column:
    """Words in 3-word windows that occur twice or more; ``hashes`` names the array of window hashes.

    Sorting (hash, position) puts equal windows side by side; the positions of repeated ones, in order, then cover
    min(3, distance to the next) words each.
    """
    h = F.col(hashes)
    ordered = F.col("_sorted")
    repeated = F.filter(ordered, lambda p, j: (p["h"] == F.get(ordered, j - 1)["h"]) | F.coalesce(p["h"] == F.get(ordered, j + 1)["h"], F.lit(False)))
    places = F.array_sort(F.transform(repeated, lambda p: p["i"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )
    return F.when(F.size(h) == F.size(F.array_distinct(h)), F.lit(0)).otherwise(covered)


def with_features(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` plus the long columns FEATURES of its text (null: empty)."""
    own = docs.withColumn("_text", F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    own = own.withColumn("_words", F.filter(F.split("_text", SPACE + "+"), lambda w: w != ""))
    own = own.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(NOT_SPACE)))
    own = own.withColumn(
        "_h",
        F.when(F.size("_words") < 3, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.size("_words") - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))
        ),
    )
    own = own.withColumn("_sorted", F.when(F.size("_h") > F.size(F.array_distinct("_h")), F.array_sort(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    values = {
        "n_words": F.size("_words"),
        "word_chars": F.aggregate("_words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)),
        "n_symbols": F.length("_text") - F.length(F.regexp_replace("_text", r"[#*$%&|<>]", "")),
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": _repeat_words(F.col("_words"), "_h"),
    }
    return own.select(*(F.col(f"`{c}`") for c in docs.columns), *(values[n].cast("long").alias(n) for n in FEATURES))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def soft_failures() -> Column:
    """How many of three rules fail: over one symbol for ten words, over 30 % repeated lines, mean word length not in 3 to 10."""
    rules = [10 * F.col("n_symbols") > F.col("n_words"), 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"), (F.col("word_chars") < 3 * F.col("n_words")) | (F.col("word_chars") > 10 * F.col("n_words"))]
    return sum((F.when(r, 1).otherwise(0) for r in rules), F.lit(0))


def host_verdicts(features: DataFrame, host_col: str, limit: float = 0.5) -> DataFrame:
    """``host, host_docs, host_rate, host_rejected``: failure rates by host, shrunk by the empirical beta prior.

    The prior's mean and strength come from the mean and variance of the hosts' rates; the strength is held between 1 and
    10,000 (equal rates: 10,000). Null hosts are one host.
    """
    failed = F.sum(F.when(base_failed() | (soft_failures() > 0), 1).otherwise(0))
    by_host = features.groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("host_docs"), failed.alias("failed"))
    by_host = materialise(by_host, "hosts")
    rate = F.col("failed") / F.col("host_docs")
    prior = by_host.agg(F.avg(rate).alias("m"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("v"))
    strength = F.when(F.col("v") <= 0, 10000.0).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(10000.0), F.try_divide(F.col("m") * (1 - F.col("m")), F.col("v")) - 1)))
    shrunk = (F.col("failed") + F.col("m") * F.col("k")) / (F.col("host_docs") + F.col("k"))
    judged = by_host.crossJoin(F.broadcast(prior.withColumn("k", strength)))  # one row
    return judged.select("host", "host_docs", F.round(shrunk, 9).alias("host_rate"), (F.round(shrunk, 9) > limit).alias("host_rejected"))


def join_verdicts(features: DataFrame, verdicts: DataFrame, host_col: str) -> DataFrame:
    """``features`` with its host's verdict; a counted bound decides on broadcasting, beyond it hot hosts are salted."""
    verdicts = materialise(verdicts, "verdicts")
    left = features.withColumnRenamed(host_col, "_host")
    if verdicts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        joined = left.join(F.broadcast(verdicts), left["_host"].eqNullSafe(verdicts["host"]))
    else:
        salted = verdicts.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        left = left.withColumn("_salt", F.pmod(F.xxhash64(*FEATURES), F.lit(SALTS)).cast("int"))
        joined = left.join(salted, left["_host"].eqNullSafe(salted["host"]) & (left["_salt"] == salted["_s"])).drop("_s", "_salt")
    return joined.drop("host").withColumnRenamed("_host", host_col)


def verdict() -> Column:
    return ~base_failed() & ~((soft_failures() >= 2) | (F.col("host_rejected") & (soft_failures() >= 1)))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", host_limit: float = 0.5) -> DataFrame:
    """One row per input row: id, FEATURES but n_lines, base_failed, kept, n_soft, host_rate.

    Null or empty texts have no words and fail; null hosts are judged as one host; repeated rows are each judged and
    counted; an empty table gives an empty result. Other columns are ignored.
    """
    own = fresh(docs, id=id_col, text=text_col, host=host_col)
    features = materialise(with_features(own, "text").drop("text").withColumnRenamed("host", "doc_host"), "features")
    judged = join_verdicts(features, host_verdicts(features, "doc_host", host_limit), "doc_host")
    return judged.select(
        F.col("id").alias(id_col),
        *(n for n in FEATURES if n != "n_lines"),
        base_failed().alias("base_failed"),
        verdict().alias("kept"),
        soft_failures().cast("long").alias("n_soft"),
        "host_rate",
    )


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", host_limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all its columns.

    Features are computed once and written without texts; the rejected rows are matched by id and host (null-safely) and a
    hash of the text, on which the verdict depends. Texts are shuffled only where the rejected are too many to broadcast.
    """
    own = fresh(docs, id=id_col, text=text_col, doc_host=host_col).withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    features = materialise(with_features(own, "text").drop("text"), "features")
    judged = join_verdicts(features, host_verdicts(features, "doc_host", host_limit), "doc_host")
    out = materialise(judged.where(~verdict()).select(F.col("id").alias("x_id"), F.col("doc_host").alias("x_host"), F.col("th").alias("x_th")).distinct(), "rejected")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{host_col}`").alias("host"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("th"))
    same = F.col("id").eqNullSafe(F.col("x_id")) & F.col("host").eqNullSafe(F.col("x_host")) & (F.col("th") == F.col("x_th"))
    return rows.join(bounded_broadcast(out), same, "left_anti").select("row.*")
