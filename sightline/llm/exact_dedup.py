"""Exact deduplication by skew-safe combining (operator 6).

Texts are equal when they are identical without white space (U+0020, U+0009-U+000D). The digest of the stripped text only
routes rows; at every stage equality is decided on the whole stripped text:

1. narrow pass: id, digest and length of each row; digests that occur once are done (no equal text can exist);
2. local: the rows of repeated digests are combined within each Arrow batch, one winner per content;
3. salted: local winners meet by (digest, salt), so a group that holds a third of all rows is spread over ``salts`` tasks;
4. global: at most ``salts`` winners of each content meet by digest.

Each stage emits narrow (loser, winner) rows; no group is ever gathered as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, bounded_broadcast, fresh, frugal, materialise

LOCAL = "id long, digest binary, content string, n_cp long, local_keep long, n long"


def stripped(text) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")


def _combine_locally(batches: Iterator) -> Iterator:
    """One row per input row; the winner of each content within the batch also carries content, length and count."""
    import pyarrow as pa

    schema = pa.schema([("id", pa.int64()), ("digest", pa.binary()), ("content", pa.string()), ("n_cp", pa.int64()), ("local_keep", pa.int64()), ("n", pa.int64())])
    for batch in batches:
        ids, digests = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        texts, lengths = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        groups: dict[tuple[bytes, str], list[int]] = {}
        for row, key in enumerate(zip(digests, texts)):
            groups.setdefault(key, []).append(row)
        out: list[list] = [[] for _ in schema]
        for (digest, content), rows in groups.items():
            best = min(rows, key=lambda r: (-lengths[r], ids[r] is None, ids[r] or 0))
            for r in rows:
                won = r == best
                for column, value in zip(out, (ids[r], digest, content if won else None, lengths[best] if won else None, ids[best], len(rows) if won else None)):
                    column.append(value)
        yield pa.record_batch([pa.array(c, type=f.type) for c, f in zip(out, schema)], schema=schema)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """``id_col, keep_id, group_size, kept, text_sha256``: one row per input row.

    The row with the most code points in its original text stays, then the smallest id.
    Null texts count as empty, and empty texts are equal to each other and to texts of white space only. Null ids sort
    last and are matched null-safely. Rows that repeat both id and text are all counted and share one verdict. Extra
    columns are ignored; an empty table gives an empty result.
    """
    own = fresh(docs, id=id_col, text=text_col)
    hashed = own.select("id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_cp"), stripped(F.col("text")).alias("content")).withColumn("digest", F.unhex(F.sha2(F.col("content").cast("binary"), 256)))
    narrow = materialise(hashed.select("id", "digest"), "digests")
    repeated = materialise(narrow.groupBy("digest").count().where("count > 1").select("digest"), "repeated")
    rows = hashed.join(bounded_broadcast(repeated), "digest", "left_semi").select("id", "digest", "content", "n_cp")
    local = materialise(rows.mapInArrow(frugal(_combine_locally), LOCAL), "local")

    order = (F.desc("n_cp"), F.asc_nulls_last("keep"))
    by_salt = Window.partitionBy("digest", "salt", "content")
    winners = local.where("n IS NOT NULL").select("digest", "content", "n_cp", F.col("local_keep").alias("keep"), "n", F.pmod(F.xxhash64("local_keep"), F.lit(salts)).alias("salt"))
    salted = winners.select(
        "digest",
        F.col("keep").alias("local_keep"),
        F.first("keep").over(by_salt.orderBy(*order)).alias("salt_keep"),
        F.row_number().over(by_salt.orderBy(*order)).alias("place"),
        F.sum("n").over(by_salt).alias("n"),
        "n_cp",
        "content",
    ).withColumn("content", F.when(F.col("place") == 1, F.col("content")))
    salted = materialise(salted, "salted")

    by_content = Window.partitionBy("digest", "content")
    best = salted.where("place = 1").select("digest", "content", "n_cp", F.col("salt_keep").alias("keep"), "n")
    final = best.select("digest", F.col("keep").alias("salt_keep"), F.first("keep").over(by_content.orderBy(*order)).alias("keep_id"), F.sum("n").over(by_content).alias("group_size"))

    step = salted.groupBy("digest", "local_keep").agg(F.first("salt_keep").alias("salt_keep")).alias("s")
    final = final.groupBy("digest", "salt_keep").agg(F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size")).alias("f")
    chain = step.join(final, (F.col("s.digest") == F.col("f.digest")) & F.col("s.salt_keep").eqNullSafe(F.col("f.salt_keep"))).select("s.digest", "local_keep", "keep_id", "group_size").alias("c")
    members = local.groupBy("id", "digest").agg(F.first("local_keep").alias("local_keep")).alias("m")
    verdicts = members.join(chain, (F.col("m.digest") == F.col("c.digest")) & F.col("m.local_keep").eqNullSafe(F.col("c.local_keep"))).select("id", "m.digest", "keep_id", "group_size").alias("v")
    return (
        narrow.alias("d")
        .join(verdicts, (F.col("d.digest") == F.col("v.digest")) & F.col("d.id").eqNullSafe(F.col("v.id")), "left")
        .select(
            F.col("d.id").alias(id_col),
            F.when(F.col("group_size").isNull(), F.col("d.id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            F.when(F.col("group_size").isNull(), F.lit(True)).otherwise(F.col("d.id").eqNullSafe(F.col("keep_id"))).alias("kept"),
            F.lower(F.hex("d.digest")).alias("text_sha256"),
        )
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that lose in :func:`exact_dedup`, and with one of each set of fully repeated rows.

    Verdicts are matched by id (null-safely) and digest; texts are shuffled only where the losers are too many to broadcast.
    """
    verdicts = materialise(exact_dedup(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("v_id"), F.unhex("text_sha256").alias("v_digest"), "kept"), "verdicts")
    losers = materialise(verdicts.where("NOT kept").select("v_id", "v_digest").distinct(), "losers")
    twice = materialise(verdicts.where("kept").groupBy("v_id", "v_digest").count().where("count > 1").select("v_id", "v_digest"), "twice")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").alias("id"), F.unhex(F.sha2(stripped(F.col(f"`{text_col}`")).cast("binary"), 256)).alias("digest"))
    same = F.col("id").eqNullSafe(F.col("v_id")) & (F.col("digest") == F.col("v_digest"))
    kept = rows.join(bounded_broadcast(losers), same, "left_anti")
    few = bounded_broadcast(twice)
    return kept.join(few, same, "left_anti").select("row.*").union(kept.join(few, same, "left_semi").dropDuplicates(["id", "digest"]).select("row.*"))
