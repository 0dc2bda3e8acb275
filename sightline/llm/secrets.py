"""Secret scan (operator 9, native).

Base kinds are regular expressions. The method adds high-entropy strings: over each candidate string a window slides, the
Shannon entropy of its characters is kept up to date by a count for every character, of which the one that enters and the
one that leaves change, and the largest window entropy is held against the limit of the string's character class. What an
allow-list matches is cut out of a candidate first, so a secret beside a harmless word is still found. Positions are code
points, from pieces between matches; no Python runs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

# The base kinds, in their order, with the least length of what must be long enough.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

#: Candidate strings of the method and the sliding window's length.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: (class, what a part of it looks like, least entropy in bits a character of its best window); the first that fits counts.
#: Parts of digits alone are numbers, not secrets, and are left out.
CLASSES = (
    ("hexadecimal", r"^[0-9a-fA-F]+$", 3.0),
    ("letters", r"^[A-Za-z]+$", 4.1),
    ("words", r"^[A-Za-z/_=+-]+$", 4.2),
    ("mixed", r"", 3.6),
)
DIGITS = r"^[0-9]+$"
#: What these match is cut out of candidates: UUIDs, placeholders, alphabets, dates and digests by name.
ALLOWED = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"(?i)example|sample|placeholder|changeme|dummy|xxxx|your_",
    r"(?i)abcdefgh|0123456789|qwertyui",
    r"[12][0-9]{3}-[01][0-9]-[0-3][0-9]",
    r"(?i)sha(1|256|512)-|md5-|base64",
)
#: Elements of an array that are scanned in one go; arrays grow by appending, so long ones are scanned in parts.
PART = 128


def scanned(items: Column, value, combine, start: Column, made, kind: str) -> Column:
    """``made(before, item)`` of each item, where ``before`` combines the values of all items before it.

    Parts of ``PART`` items are combined first, then scanned each from what stands before it, so the work is linear but for
    one step a part.
    """
    n = F.size(items)
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / PART).cast("int") - 1, F.lit(0))), lambda i: F.slice(items, i * PART + 1, F.lit(PART)))
    none = lambda t: F.array().cast(f"array<{t}>")

    def append(a: Column, x: Column, out: Column) -> Column:
        return F.struct(combine(a["at"], x).alias("at"), F.concat(a["out"], F.array(out)).alias("out"))

    totals = F.transform(parts, lambda p: F.aggregate(p, start, lambda a, x: combine(a, value(x))))
    befores = F.aggregate(totals, F.struct(start.alias("at"), none("int").alias("out")), lambda a, t: append(a, t, a["at"]), lambda a: a["out"])
    each = lambda p, before: F.aggregate(p, F.struct(before.alias("at"), none(kind).alias("out")), lambda a, x: append(a, value(x), made(a["at"], x)), lambda a: a["out"])
    return F.flatten(F.zip_with(parts, befores, each))


MATCH = "struct<start:int,end:int,match:string>"


def places(text: Column, pattern: str, gate: Column) -> Column:
    """Arrays of (start, end, match) of the leftmost non-overlapping matches, in code points; empty where ``gate`` is false."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    # an array in an array, so that the pairs are made once
    pairs = F.array(F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda p, m: F.struct(F.length(p).alias("skip"), F.length(m).alias("size"), m.alias("match"))))

    def placed(x: Column) -> Column:
        made = lambda at, m: F.struct((at + m["skip"]).alias("start"), (at + m["skip"] + m["size"]).alias("end"), m["match"].alias("match"))
        return scanned(x, lambda m: m["skip"] + m["size"], lambda a, b: a + b, F.lit(0), made, MATCH)

    found = F.flatten(F.transform(pairs, placed))
    return F.when(gate, found).otherwise(F.array().cast(f"array<{MATCH}>"))


def window_entropy(text: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy (bits) of a ``window`` (at most 31) characters wide window over a candidate at least as long.

    The state has a count for every character, twelve of five bits in a number, and S, the sum of n log2 n over the
    counts: an entering character with n copies inside adds f(n + 1) - f(n), a leaving one with n copies takes away
    f(n) - f(n - 1). Entropy = log2 W - S / W.
    """
    f = [n * math.log2(n) if n else 0.0 for n in range(window + 2)]
    rise = F.array(*(F.lit(f[n + 1] - f[n]) for n in range(window + 1)))
    raw = text.cast("binary")
    one = F.array(*(F.lit(1 << (5 * k)) for k in range(12))).cast("array<bigint>")
    numbers = (ord("z") - ord("+")) // 12 + 1

    def code(i: Column) -> Column:
        return F.ascii(F.substring(raw, i + 1, F.lit(1)).cast("string")) - ord("+")

    def count(counts: Column, c: Column) -> Column:
        return F.call_function("shiftright", F.get(counts, F.floor(c / 12).cast("int")), c % 12 * 5).bitwiseAND(F.lit(31))

    def step(state: Column, i: Column) -> Column:
        codes = F.struct(code(i).alias("enters"), F.when(i >= window, code(i - window)).otherwise(-1).alias("leaves"))
        return F.element_at(F.transform(F.array(codes), lambda c: advance(state, c["enters"], c["leaves"], i)), 1)

    def advance(state: Column, enters: Column, leaves: Column, i: Column) -> Column:
        gone = F.when(leaves >= 0, F.get(rise, count(state["counts"], leaves).cast("int") - 1)).otherwise(0.0)
        here = count(state["counts"], enters) - F.when(enters == leaves, 1).otherwise(0)
        s = state["s"] - gone + F.get(rise, here.cast("int"))
        bit = lambda c, k: F.when(F.floor(c / 12) == k, F.get(one, c % 12)).otherwise(F.lit(0).cast("bigint"))
        counts = F.transform(state["counts"], lambda n, k: n + bit(enters, k) - F.when(leaves >= 0, bit(leaves, k)).otherwise(F.lit(0).cast("bigint")))
        best = F.when(i >= window - 1, F.greatest(state["best"], math.log2(window) - s / window)).otherwise(state["best"])
        return F.struct(counts.alias("counts"), s.alias("s"), best.alias("best"))

    start = F.struct(F.array_repeat(F.lit(0).cast("bigint"), numbers).alias("counts"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))
    return F.aggregate(F.sequence(F.lit(0), F.length(text) - 1), start, step, lambda a: a["best"])


def _limit(text: Column) -> Column:
    chosen = F.lit(CLASSES[-1][2])
    for _, pattern, least in reversed(CLASSES[:-1]):
        chosen = F.when(text.rlike(pattern), least).otherwise(chosen)
    return chosen


def suspicious(text: Column) -> Column:
    """Whether a part of a candidate, without what the allow-list matches, has a window of its class's entropy."""
    parts = F.split(F.regexp_replace(text, "|".join(f"(?:{x})" for x in ALLOWED), " "), " ", -1)
    return F.exists(F.filter(parts, lambda p: (F.length(p) >= WINDOW) & ~p.rlike(DIGITS)), lambda p: window_entropy(p) >= _limit(p))


def outside(candidates: Column, base: Column) -> Column:
    """The candidates that no span of ``base`` contains: in the order of starts, none before or at theirs ends so late."""
    row = lambda start, end, base, match: F.struct(start.alias("start"), (-end).alias("minus"), base.alias("mine"), match.alias("match"))
    spans = F.transform(base, lambda b: row(b["start"], b["end"], F.lit(0), F.lit(None).cast("string")))
    all_ = F.array(F.array_sort(F.concat(spans, F.transform(candidates, lambda m: row(m["start"], m["end"], F.lit(1), m["match"])))))
    reach = lambda x: F.when(x["mine"] == 0, -x["minus"]).otherwise(-1)
    made = lambda before, x: F.struct(x["start"].alias("start"), (-x["minus"]).alias("end"), F.when((x["mine"] == 1) & (before < -x["minus"]), x["match"]).alias("match"))
    marked = F.flatten(F.transform(all_, lambda x: scanned(x, reach, F.greatest, F.lit(-1), made, MATCH)))
    return F.filter(marked, lambda m: m["match"].isNotNull())


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, spans``: per row an array of (start, kind, end), by start, then kind (index into KINDS), ends exclusive.

    Null texts count as empty. Method spans that lie within a base span are not repeated. Each input row gives one row;
    an empty table gives an empty result.
    """
    own = fresh(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    text = F.col("text")
    found = own.select(
        "id",
        F.filter(places(text, ASSIGN, text.rlike(ASSIGN)), lambda m: F.length(F.regexp_extract(m["match"], ASSIGN, 1)) >= 6).alias("assign"),
        places(text, ACCESS, F.contains(text, F.lit("AKIA"))).alias("access"),
        places(text, HEX, text.rlike(HEX)).alias("hex"),
        places(text, CANDIDATE, text.rlike(CANDIDATE)).alias("candidates"),
    )

    def of_kind(matches: Column | str, n: int) -> Column:
        return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(n).alias("kind"), m["end"].alias("end")))

    kinds = [of_kind(k, n) for n, k in enumerate(KINDS[:3])]
    found = found.withColumn("base", F.array_sort(F.concat(*kinds)))
    secret = F.filter(outside(F.col("candidates"), F.col("base")), lambda m: suspicious(m["match"]))
    return found.select(F.col("id").alias(id_col), F.array_sort(F.concat("base", of_kind(secret, 3))).alias("spans"))


def joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_assign, n_access, n_hex, base_sha256, spans, n_entropy`` of :func:`find_secrets`."""
    found = find_secrets(docs, id_col, text_col)
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col(f"`{id_col}`"),
        *(of(n).alias(f"n_{k}") for n, k in enumerate(KINDS[:3])),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        of(3).alias("n_entropy"),
    )
