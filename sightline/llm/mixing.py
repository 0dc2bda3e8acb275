"""Mixing sources to target weights by iterative proportional fitting (operator 3).

Token counts are summed into cells (source, language, topic). Cell weights are raked until the weighted tokens meet the
target marginals of source, language and topic; documents are then sampled with their cell's probability, a common multiple
of its weight chosen so that the expected tokens are a given share of all. Sampling uses a digest of the id, so the same
document is drawn again on any cluster. Texts are never shuffled.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, SPACE, bounded_broadcast, materialise, release

MARGINS = ("source", "lang", "topic")
SALTS = 32
#: Rounds of raking between two written tables.
ROUNDS_A_TABLE = 4


@dataclass(frozen=True)
class Settings:
    """Share of all tokens to expect; target shares by margin, e.g. {"lang": {"en": 0.5}}; where a margin has none, its
    targets are proportional to tokens to the power given in ``powers``; rounds of raking, at least and at most, by how much
    of all tokens a margin may be off its target, and whether more is an error; rounds of capping at 1; seed."""

    share: float = 0.5
    targets: dict = field(default_factory=dict)
    powers: tuple[float, float, float] = (0.7, 0.5, 0.8)
    rounds: int = 8
    most_rounds: int = 64
    tolerance: float = 1e-3
    strict: bool = False
    caps: int = 6
    seed: str = "mix"


def topic_of(text: Column) -> Column:
    """A document's kind, used as its topic where the table has none: table, shouting, short, long or prose."""
    size = F.length(text)
    bars = size - F.length(F.replace(text, F.lit("|"), F.lit("")))
    capitals = size - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return F.when(40 * bars > size, "table").when(3 * capitals > size, "shouting").when(size < 600, "short").when(size > 6000, "long").otherwise("prose")


def n_tokens(text: Column) -> Column:
    return F.size(F.filter(F.split(text, SPACE + "+"), lambda w: w != "")).cast("long")


def draw(id_: Column, seed: str) -> Column:
    """A uniform number of [0, 1) from the id's digest (52 bits)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_.cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double") / float(16**13)


def _with_shares(cells: DataFrame, settings: Settings) -> DataFrame:
    """``cells`` with ``share_<margin>``: target shares that add up to 1 over the margin's values that have tokens."""
    out = cells
    for margin, power in zip(MARGINS, settings.powers):
        fixed = settings.targets.get(margin)
        totals = cells.groupBy(margin).agg(F.sum("tokens").alias("t")).where("t > 0")
        wish = F.pow(F.col("t").cast("double"), F.lit(power))
        if fixed is not None:
            wish = F.coalesce(*(F.when(F.col(margin) == k, F.lit(float(v))) for k, v in sorted(fixed.items())), F.lit(0.0))
        wishes = materialise(totals.select(margin, wish.alias("wish")), f"wishes-{margin}")
        all_wishes = wishes.agg(F.sum("wish")).first()[0] or 0.0
        share = F.try_divide(F.col("wish"), F.lit(float(all_wishes)))
        out = out.join(bounded_broadcast(wishes.select(margin, share.alias(f"share_{margin}"))), margin, "left")
    return out


def rake(cells: DataFrame, settings: Settings) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with ``weight``: weighted token shares meet the last margin's targets exactly and
    the others' as nearly as the rounds allow; cells without tokens have weight 0.

    A step is a sum over each value of a margin, so a round plans three windows and no join. After ``rounds`` rounds they
    go on only while a margin is off by more than ``tolerance`` and comes nearer; targets that the cells can't meet (a
    margin's value that occurs only beside values of small shares) end in a warning, or an error if ``strict``.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    current = materialise(_with_shares(cells, settings).withColumn("weight", F.lit(1.0)), "shares")
    off, done = math.inf, 0
    while done < settings.most_rounds:
        wide = current
        for _ in range(ROUNDS_A_TABLE):
            for margin in MARGINS:
                now = F.sum(F.col("tokens") * F.col("weight")).over(Window.partitionBy(margin))
                miss = F.abs(F.try_divide("now", F.lit(total)) - F.col(f"share_{margin}"))
                factor = F.coalesce(F.try_divide(F.col(f"share_{margin}") * F.lit(total), F.col("now")), F.lit(0.0))
                wide = wide.withColumn("now", now).withColumn(f"miss_{margin}", miss).withColumn("weight", F.col("weight") * factor)
            done += 1
        before, current = current, materialise(wide.drop("now"), "raked")
        release(before)
        last, off = off, max((x for x in current.agg(*(F.max(f"miss_{m}") for m in MARGINS)).first() if x is not None), default=0.0)
        if done >= settings.rounds and (off <= settings.tolerance or off > 0.9 * last):
            break
    if off > settings.tolerance:
        said = f"raking: after {done} rounds a margin is off its target by {off:.2g} of all tokens"
        if settings.strict:
            raise ValueError(said)
        warnings.warn(said, stacklevel=2)
    return current.select(*MARGINS, "tokens", "weight")


def calibrate(cells: DataFrame, settings: Settings) -> DataFrame:
    """Adds ``probability`` = min(1, scale x weight); the scale makes the expected tokens the wanted share, if it can be met.

    Cells at 1 are set aside and the scale solved for the rest, some rounds over; the driver sees two sums of each.
    """
    wanted, scale = None, 0.0
    for _ in range(settings.caps):
        full = (F.col("weight") * F.lit(scale) >= 1) if wanted is not None else F.lit(False)
        row = cells.agg(F.sum("tokens"), F.sum(F.when(full, F.col("tokens"))), F.sum(F.when(~full, F.col("tokens") * F.col("weight")))).first()
        if not row[0] or not row[2]:
            break
        wanted = settings.share * float(row[0])
        scale = max(0.0, wanted - float(row[1] or 0)) / float(row[2])
    return cells.withColumn("probability", F.round(F.least(F.lit(1.0), F.col("weight") * F.lit(scale)), 9))


def _with_probability(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Joins the cells' probabilities; a counted bound decides on broadcasting, beyond it hot cells are salted."""
    cells = materialise(cells.select(*(F.col(m).alias(f"cell_{m}") for m in MARGINS), "probability"), "probabilities")
    same = [rows[f"_{m}"] == cells[f"cell_{m}"] for m in MARGINS]
    if cells.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(cells), same)
    else:
        salted = cells.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_draw"), F.lit(SALTS)).cast("int"))
        joined = rows.join(salted, [*(rows[f"_{m}"] == salted[f"cell_{m}"] for m in MARGINS), rows["_salt"] == salted["_s"]]).drop("_s", "_salt")
    return joined.drop(*(f"cell_{m}" for m in MARGINS))


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, topic: Column | None, seed: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col(f"`{id_col}`").alias("_id"),
        F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("_source"),
        F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("")).alias("_lang"),
        (topic_of(text) if topic is None else F.coalesce(topic.cast("string"), F.lit(""))).alias("_topic"),
        n_tokens(text).alias("_tokens"),
        draw(F.col(f"`{id_col}`"), seed).alias("_draw"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None, settings: Settings = Settings()) -> DataFrame:
    """One row per input row: ``row`` (all its columns), ``_id, _source, _lang, _topic, _tokens, probability, sampled``.

    Null texts have no tokens; null sources, languages and topics count as empty strings; rows with null ids share one draw and
    repeated ids share theirs. Cells without tokens have probability 0. An empty table gives an empty result.
    """
    placed = _placed(docs, id_col, text_col, source_col, lang_col, topic, settings.seed)
    cells = placed.groupBy(*(F.col(f"_{m}").alias(m) for m in MARGINS)).agg(F.sum("_tokens").alias("tokens"))
    cells = materialise(cells, "cells")
    return _with_probability(placed, calibrate(rake(cells, settings), settings)).withColumn("sampled", F.col("_draw") < F.col("probability"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The sampled rows of ``docs``, with its columns."""
    return mix(docs, **options).where("sampled").select("row.*")


def mix_report(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``id_col, source, lang, topic, tokens, probability, sampled`` of every row."""
    mixed = mix(docs, id_col, **options)
    return mixed.select(F.col("_id").alias(id_col), *(F.col(f"_{m}").alias(m) for m in MARGINS), F.col("_tokens").alias("tokens"), F.round("probability", 6).alias("probability"), "sampled")
