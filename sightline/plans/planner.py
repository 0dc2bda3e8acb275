"""Heuristic query plans: days, times of day, relation to the query's time, modality order, workflow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import scaled_ranges, shifted_day

# Seconds of the day for each label.
HOUR = 3600.0
TIME_OF_DAY = {
    "early_morning": [(5, 9)],
    "morning": [(5, 12)],
    "noon": [(11, 14)],
    "afternoon": [(12, 18)],
    "evening": [(18, 22)],
    "night": [(0, 5), (21, 24)],
    "late_night": [(0, 3), (22, 24)],
    "dawn": [(5, 7)],
    "sunrise": [(5, 7)],
    "breakfast": [(6, 10)],
    "lunch": [(11, 14)],
    "dinner": [(18, 21)],
}
# Phrases, the first that occurs as whole words decides.
TIME_PHRASES = [
    ("early morning", "early_morning"), ("this morning", "morning"), ("yesterday morning", "morning"), ("morning", "morning"),
    ("this afternoon", "afternoon"), ("yesterday afternoon", "afternoon"), ("afternoon", "afternoon"),
    ("this evening", "evening"), ("yesterday evening", "evening"), ("evening", "evening"),
    ("late night", "late_night"), ("tonight", "night"), ("last night", "night"), ("night", "night"), ("noon", "noon"),
    ("lunchtime", "lunch"), ("lunch", "lunch"), ("breakfast", "breakfast"), ("dinner", "dinner"), ("sunrise", "sunrise"), ("dawn", "dawn"),
]
# Phrases that occur as substrings.
PREVIOUS = ["the day before", "day before", "previous day"]
YESTERDAY = ["yesterday", "last night"]
NEXT = ["tomorrow", "next day", "following day"]
ANY_DAY = ["other day", "other days", "another day", "any day", "past days"]
AFTER = ["after that", "later that day", "after lunch", "after dinner"]
BEFORE = ["before that", "before lunch", "earlier that day"]
TODAY = ["today", "this day", "earlier", "before"]
AUDIO_WORDS = [
    "say", "said", "hear", "heard", "sound", "sounds", "audio", "noise", "noises", "conversation", "talk", "talking", "voice", "voices", "music",
    "sing", "singing", "siren", "sirens", "shout", "shouting", "yell", "yelling", "ring", "ringing", "phone", "call",
]
VISUAL_WORDS = ["wearing", "holding", "looking", "see", "seen", "look", "color", "colour", "where", "which", "who", "what"]
RETRIEVER_ANY_DAY = [
    "other day", "other days", "another day", "previous day", "previous days", "past days", "earlier days", "day before", "days before",
    "the other day", "the other days",
]

RANGES = "array<struct<s:double,e:double>>"
MODALITIES = ["video", "audio", "text"]


def any_of(text: Column, phrases: list[str]) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | F.contains(text, F.lit(p))
    return found


def strings(*values: Column | str) -> Column:
    return F.array(*(F.lit(v) if isinstance(v, str) else v for v in values)).cast("array<string>")


def explicit_days(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\bday\s*([1-7])\b"), F.lit(1)), lambda d: F.concat(F.lit("DAY"), d)))


def allowed_days(text: Column, date: Column) -> tuple[Column, Column]:
    """Allowed days (empty: all) and how they were found; ``text`` in lower case."""
    days = explicit_days(text)
    cases = [
        (F.size(days) > 0, days, "explicit"),
        (any_of(text, PREVIOUS), F.coalesce(shifted_day(date, -1), strings()), "previous"),
        (any_of(text, YESTERDAY), F.coalesce(shifted_day(date, -1), strings()), "yesterday"),
        (any_of(text, NEXT), F.coalesce(shifted_day(date, 1), strings()), "next"),
        (any_of(text, ANY_DAY), strings(), "unrestricted"),
        (F.coalesce(date, F.lit("")) != "", strings(F.upper(date)), "same_day"),
    ]
    found, label = strings(), F.lit("unrestricted")
    for when, value, name in reversed(cases):
        found, label = F.when(when, value).otherwise(found), F.when(when, F.lit(name)).otherwise(label)
    return found, label


def retriever_days(text: Column, date: Column) -> Column:
    """The days a retriever infers on its own if a plan has none; null: all days."""
    n = F.regexp_extract(date, r"(?i)day(\d+)", 1).try_cast("int")
    day = lambda k: strings(F.concat(F.lit("DAY"), k.cast("string")))
    explicit = explicit_days(text)
    return (
        F.when(F.size(explicit) > 0, explicit)
        .when(F.contains(text, F.lit("yesterday")) & (n > 1), day(n - 1))
        .when(F.contains(text, F.lit("tomorrow")) & (n < 7), day(n + 1))
        .when(any_of(text, RETRIEVER_ANY_DAY), F.lit(None).cast("array<string>"))
        .when(date.isNotNull(), strings(date))
    )


def time_of_day(text: Column) -> tuple[Column, Column]:
    """The label of the first phrase that occurs, and its ranges in seconds."""
    label = F.lit(None).cast("string")
    for phrase, name in reversed(TIME_PHRASES):
        found = F.contains(text, F.lit(phrase)) & text.rlike(rf"\b{phrase}\b")  # the search for bytes spares long texts the expression
        label = F.when(found, F.lit(name)).otherwise(label)
    return label, ranges_of(label)


def ranges_of(label: Column) -> Column:
    """The ranges in seconds of a label; none for others."""
    rows = [F.array(*(F.struct(F.lit(a * HOUR).alias("s"), F.lit(b * HOUR).alias("e")) for a, b in parts)) for parts in TIME_OF_DAY.values()]
    known = F.map_from_arrays(F.array(*map(F.lit, TIME_OF_DAY)), F.array(*rows))
    return F.coalesce(F.try_element_at(known, label), F.array().cast(RANGES))


def relation(text: Column, at: Column, ranges: Column, relative: Column) -> Column:
    first, last = F.array_min(F.transform(ranges, lambda r: r["s"])), F.array_max(F.transform(ranges, lambda r: r["e"]))
    return (
        F.when(relative.isin("previous", "yesterday", "next"), "unrestricted")
        .when(any_of(text, AFTER), "after_query_time")
        .when(any_of(text, BEFORE), "before_query_time")
        .when(F.coalesce(at, F.lit(0.0)) == 0, "unrestricted")
        .when(at <= first, "after_query_time")
        .when(at >= last, "before_query_time")
        .when(F.size(ranges) > 0, "around_query_time")
        .when(any_of(text, TODAY), "before_query_time")
        .otherwise("unrestricted")
    )


def modality_order(text: Column, need_audio: Column, modalities: list[str]) -> Column:
    hinted = F.array_compact(
        F.array(
            F.when(F.coalesce(need_audio, F.lit(False)) | any_of(text, AUDIO_WORDS), F.lit("audio")),
            F.when(any_of(text, VISUAL_WORDS), F.lit("video")),
            F.lit("text"),
        )
    )
    known = strings(*modalities)
    return F.array_union(F.array_intersect(hinted, known), known)


def plan(queries: DataFrame, modalities: list[str] = MODALITIES, use_windows: bool = False, rewrite_query: bool = False) -> DataFrame:
    """``qid, plan`` of rows (qid, query_text, query_date, query_time_sec, need_audio)."""
    q = queries.withColumn("_t", F.lower(F.coalesce("query_text", F.lit(""))))
    t = F.col("_t")
    days, how = allowed_days(t, F.col("query_date"))
    label, _ = time_of_day(t)
    q = q.withColumn("_days", days).withColumn("_how", how).withColumn("_label", label)
    q = q.withColumn("_ranges", ranges_of(F.col("_label")))
    q = q.withColumn("_rel", relation(t, F.col("query_time_sec"), F.col("_ranges"), F.col("_how")))
    steps = [
        F.when(F.lit(rewrite_query), F.lit("rewrite_query")),
        F.when(F.size("_days") > 0, F.lit("day_filter")),
        F.when(F.size("_ranges") > 0, F.lit("time_range_filter")),
        F.when(F.col("_rel").isin("before_query_time", "after_query_time"), F.concat("_rel", F.lit("_filter"))),
        F.lit("video_retrieval"),
        F.when(F.lit(use_windows), F.lit("window_retrieval")),
        F.lit("scene_retrieval"),
        F.when((F.size("_ranges") > 0) | (F.col("_rel") != "unrestricted"), F.lit("temporal_rerank")),
    ]
    made = F.struct(
        F.lit("heuristic").alias("planner"),
        modality_order(t, F.col("need_audio"), modalities).alias("modalities"),
        F.col("_days").alias("allowed_days"),
        F.col("_how").alias("relative_day"),
        F.col("_label").alias("time_of_day"),
        F.col("_ranges").alias("time_ranges"),
        F.col("_rel").alias("relation"),
        F.lit(use_windows).alias("use_windows"),
        F.lit(rewrite_query).alias("rewrite_query"),
        F.array_compact(F.array(*steps)).alias("workflow"),
    )
    return q.select("qid", made.alias("plan"))


def normalised_days(days: Column) -> Column:
    """``DAYn`` of each entry that names a day, once each, in order; null stays null."""
    number = lambda d: F.regexp_extract(d, r"(?i)day\s*(\d+)", 1)
    found = F.filter(F.transform(days, lambda d: F.coalesce(number(d), F.lit(""))), lambda n: n != "")
    return F.array_distinct(F.transform(found, lambda n: F.concat(F.lit("DAY"), n.cast("int").cast("string"))))


#: A model's plan as it comes, and the fields that a plan has.
RAW_PLAN = f"""modalities array<string>, allowed_days array<string>, time_of_day string, time_ranges {RANGES}, relation string, use_windows boolean,
rewrite_query boolean, workflow array<string>"""
FIELDS = ["planner", "modalities", "allowed_days", "relative_day", "time_of_day", "time_ranges", "relation", "use_windows", "rewrite_query", "workflow"]


def normalised_plan(raw: Column, modalities: list[str] = MODALITIES) -> Column:
    """A model's plan (RAW_PLAN) with known modalities once each, day names, ranges in seconds, lower-case labels and steps that
    aren't blank. Days and ranges that aren't given are [], and override; other fields that say nothing are null and don't."""
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    names = F.array_distinct(F.filter(F.transform(raw["modalities"], lambda m: F.lower(F.trim(m))), lambda m: m.isin(*modalities)))
    steps = F.filter(F.transform(raw["workflow"], F.trim), lambda w: w != "")
    made = F.struct(
        F.lit("model").alias("planner"),
        F.when(F.size(names) > 0, names).alias("modalities"),
        F.coalesce(normalised_days(raw["allowed_days"]), strings()).alias("allowed_days"),
        F.lit(None).cast("string").alias("relative_day"),
        F.replace(F.lower(text(raw["time_of_day"])), F.lit(" "), F.lit("_")).alias("time_of_day"),
        F.coalesce(scaled_ranges(raw["time_ranges"]), F.array().cast(RANGES)).alias("time_ranges"),
        F.lower(text(raw["relation"])).alias("relation"),
        raw["use_windows"].alias("use_windows"),
        raw["rewrite_query"].alias("rewrite_query"),
        F.when(F.size(steps) > 0, steps).alias("workflow"),
    )
    return F.when(raw.isNotNull(), made)


def merged_plan(base: Column, override: Column) -> Column:
    """A normalised plan over the heuristic one, field by field; a time of day without ranges gets its label's."""
    fields = {n: F.coalesce(override[n], base[n]) for n in FIELDS}
    fields["time_ranges"] = F.when((F.size(fields["time_ranges"]) <= 0) & fields["time_of_day"].isNotNull(), ranges_of(fields["time_of_day"])).otherwise(fields["time_ranges"])
    return F.when(override.isNull(), base).otherwise(F.struct(*(c.alias(n) for n, c in fields.items())))


def constraints(plan_: Column, text: Column, date: Column, at: Column) -> Column:
    """query_date, query_time_sec, allowed_days, ranges and relation; null where neither a plan nor a date or time is known.

    Days of the plan count even if they are []; only where the plan has none (null) the retriever infers them.
    """
    days = F.coalesce(plan_["allowed_days"], F.array_sort(retriever_days(F.lower(F.coalesce(text, F.lit(""))), date)), strings())
    made = F.struct(
        date.alias("query_date"),
        at.alias("query_time_sec"),
        days.alias("allowed_days"),
        F.coalesce(plan_["time_ranges"], F.array().cast(RANGES)).alias("ranges"),
        F.coalesce(plan_["relation"], F.lit("unrestricted")).alias("relation"),
    )
    return F.when(plan_.isNotNull() | date.isNotNull() | at.isNotNull(), made)


def switches(plan_: Column, modalities: list[str] = MODALITIES, windows: bool = False, rewrite: bool = False) -> Column:
    """What holds for one query: modalities (the plan's first), whether windows are used (never if the default is not to) and
    whether the query is rewritten."""
    known = strings(*modalities)
    preferred = F.array_intersect(F.coalesce(plan_["modalities"], strings()), known)
    return F.struct(
        F.array_union(preferred, known).alias("modalities"),
        (F.coalesce(plan_["use_windows"], F.lit(windows)) if windows else F.lit(False)).alias("use_windows"),
        F.coalesce(plan_["rewrite_query"], F.lit(rewrite)).alias("rewrite_query"),
    )
