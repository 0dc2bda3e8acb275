"""The operators' queries over whole tables, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bytebpe import token_digest
from .exact_dedup import exact_dedup
from .licenses import license_scan
from .lines import line_dedup
from .mixing import Settings as MixSettings, mix_report
from .near_dup import Settings, near_dup
from .paragraphs import paragraph_dedup
from .quality import quality_rules
from .runs import run_digest
from .secrets import ACCESS, ALLOWED, ASSIGN, CANDIDATE, CLASSES, DIGITS, HEX, WINDOW, secret_digest
from .sentencepieces import pieces_and_back
from .substrings import substring_digest
from .variants import LOWER, UPPER, spelling_variants


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces_and_back(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


def op5_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op7_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup(table(spark, sf_dir, "documents"), settings=Settings(words=3, num=85))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digest(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digest(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_sentencepiece, op2_license_scan, op3_source_mixing, op4_line_dedup, op5_paragraph_dedup, op6_exact_dedup, op7_minhash_near_dup, op8_suffix_dedup, op9_secret_scan, op10_quality_rules, op11_byte_bpe, op12_periodic_runs, op13_spelling_variants)
    return {f.__name__: f for f in found}


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""


def _mixing_sql() -> str:
    """The raking and capping rounds of op3, unrolled."""
    s, margins = MixSettings(), ("source", "lang", "topic")
    steps = []
    for m, p in zip(margins, s.powers):
        steps.append(f"t_{m} AS MATERIALIZED (SELECT {m}, pow(sum(tokens)::DOUBLE, {p}) / sum(pow(sum(tokens)::DOUBLE, {p})) OVER () AS share FROM cells GROUP BY {m} HAVING sum(tokens) > 0)")
    before = "cells"
    for r in range(s.rounds):
        for m in margins:
            after = f"r{r}_{m}"
            steps.append(
                f"{after} AS MATERIALIZED (SELECT source, lang, topic, tokens, weight * coalesce(share * n.t / nullif(sum(tokens * weight) OVER (PARTITION BY {m}), 0), 0) AS weight"
                f" FROM {before} LEFT JOIN t_{m} USING ({m}), n)"
            )
            before = after
    steps.append(f"c0 AS (SELECT {s.share} * sum(tokens) / sum(tokens * weight) AS scale FROM {before})")
    for k in range(1, s.caps):
        steps.append(
            f"c{k} AS MATERIALIZED (SELECT coalesce(greatest(0, {s.share} * sum(tokens) - coalesce(sum(tokens) FILTER (weight * scale >= 1), 0)) / sum(tokens * weight) FILTER (weight * scale < 1), max(scale)) AS scale FROM {before}, c{k - 1})"
        )
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS text, length(coalesce(text, '')) AS size FROM documents
), placed AS (
  SELECT doc_id, source, lang,
         CASE WHEN 40 * (size - length(replace(text, '|', ''))) > size THEN 'table' WHEN 3 * (size - length(regexp_replace(text, '[A-Z]+', '', 'g'))) > size THEN 'shouting'
              WHEN size < 600 THEN 'short' WHEN size > 6000 THEN 'long' ELSE 'prose' END AS topic,
         len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS tokens,
         ('0x' || left(md5('{s.seed}:' || coalesce(doc_id::VARCHAR, 'null')), 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
  FROM d
), cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens, 1.0::DOUBLE AS weight FROM placed GROUP BY ALL
), n AS (SELECT sum(tokens)::DOUBLE AS t FROM cells), {", ".join(steps)},
p AS (SELECT source, lang, topic, round(least(1.0::DOUBLE, weight * scale), 9) AS probability FROM {before}, c{s.caps - 1})
SELECT doc_id, source, lang, topic, tokens, round(probability, 6) AS probability, draw < probability AS sampled FROM placed JOIN p USING (source, lang, topic)
""".replace("\\\\", "\\")


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _places_sql(kind: int, pattern: str, group: int = 0) -> str:
    """Rows (rid, start, kind, end, match) of a pattern's matches, with the length of its group where one is given."""
    return f"""
  SELECT rid, kind, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s,
         length(m[i]) AS n, m[i] AS match, length(g[i]) AS group_len
  FROM (SELECT rid, {kind} AS kind, regexp_extract_all(text, {_text(pattern)}) AS m, regexp_extract_all(text, {_text(pattern)}, {group}) AS g,
               regexp_split_to_array(text, {_text(pattern)}) AS p FROM d WHERE regexp_matches(text, {_text(pattern)})), unnest(range(1, len(m) + 1)) AS r(i)"""


OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), base AS ({_places_sql(0, ASSIGN, 1)} UNION ALL {_places_sql(1, ACCESS)} UNION ALL {_places_sql(2, HEX)}
), b AS (SELECT rid, kind, s, s + n AS e FROM base WHERE kind > 0 OR group_len >= 6
), cand AS ({_places_sql(3, CANDIDATE)}
), c AS (
  SELECT rid, s, n, unnest(string_split(regexp_replace(match, {_text("|".join(f"(?:{a})" for a in ALLOWED))}, ' ', 'g'), ' ')) AS match FROM cand
  WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.rid = cand.rid AND b.s <= cand.s AND b.e >= cand.s + cand.n)
), parts AS (
  SELECT rid, s, n, match, row_number() OVER () AS part FROM c WHERE length(match) >= {WINDOW} AND NOT regexp_matches(match, {_text(DIGITS)})
), chars AS (
  SELECT rid, s, n, match, part, w, substr(match, w + o, 1) AS ch FROM parts, unnest(range(1, length(match) - {WINDOW} + 2)) AS x(w), range({WINDOW}) AS y(o)
), counts AS (SELECT rid, s, n, match, part, w, ch, count(*) AS k FROM chars GROUP BY ALL
), entropy AS (SELECT rid, s, n, match, part, w, log2({WINDOW}) - sum(k * log2(k)) / {WINDOW} AS h FROM counts GROUP BY ALL
), best AS (SELECT rid, s, n, match, part, max(h) AS h FROM entropy GROUP BY ALL
), hits AS (
  SELECT DISTINCT rid, 3 AS kind, s, s + n AS e FROM best
  WHERE h + 1e-9 >= CASE {" ".join(f"WHEN regexp_matches(match, {_text(r)}) THEN {least}" for _, r, least in CLASSES)} END
), spans AS (
  SELECT *, ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || s || ':' || e AS x FROM (SELECT * FROM b UNION ALL SELECT * FROM hits)
), per AS (
  SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3) AS n_entropy,
         string_agg(x, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(x, ',' ORDER BY s, kind) AS spans
  FROM spans GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_entropy, 0) AS n_entropy
FROM d LEFT JOIN per USING (rid)
"""

OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS rid,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), g AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM w, unnest(range(1, len(words) - 1)) AS r(i)
), c AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g
), p AS (
  SELECT rid, count(DISTINCT i + o) AS n FROM c, (VALUES (0), (1), (2)) AS v(o) WHERE n > 1 GROUP BY rid
), f AS (
  SELECT doc_id, source, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words
  FROM w LEFT JOIN p USING (rid)
), e AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         (10 * n_symbols > n_words)::BIGINT + (10 * n_dup_lines > 3 * n_lines)::BIGINT
         + (word_chars < 3 * n_words OR word_chars > 10 * n_words)::BIGINT AS n_soft
  FROM f
), h AS (
  SELECT source, count(*) AS docs, count(*) FILTER (base_failed OR n_soft > 0) AS failed FROM e GROUP BY source
), m AS (
  SELECT avg(failed::DOUBLE / docs) AS m, var_pop(failed::DOUBLE / docs) AS v FROM h
), k AS (
  SELECT m, CASE WHEN v <= 0 THEN 10000.0::DOUBLE ELSE greatest(1.0::DOUBLE, least(10000.0::DOUBLE, m * (1 - m) / v - 1)) END AS k FROM m
), r AS (
  SELECT source, round((failed + m * k) / (docs + k), 9) AS host_rate FROM h, k
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (n_soft >= 2 OR (host_rate > 0.5 AND n_soft >= 1)) AS kept, n_soft, host_rate
FROM e JOIN r ON e.source IS NOT DISTINCT FROM r.source
"""


def _crc32_sql(text: str) -> str:
    """The unsigned crc32 of a string's UTF-8 bytes, bit by bit."""
    bytes_ = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda c, b: {bits}), 4294967295::BIGINT)"


OP12_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents
), h AS (SELECT *, len(words) AS n, {_crc32_sql("doc_id::VARCHAR")} AS h FROM d
), a AS (SELECT *, h // 10 AS g, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM h
), p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a
), w AS MATERIALIZED (SELECT rid, n, i, words[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END] AS word FROM p, unnest(range(n)) AS r(i)
), e AS (SELECT x.rid, y.i - x.i AS q, x.i FROM w AS x JOIN w AS y ON x.rid = y.rid AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), s AS (SELECT rid, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS part FROM e) GROUP BY rid, q, part HAVING count(*) + q >= greatest(6, 4 * q)
), r AS MATERIALIZED (
  SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s AS o WHERE o.rid = s.rid AND o.q < s.q AND o.start <= s.start AND o.start + o.length >= s.start + s.length)
), k AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS collapsed FROM w WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.rid = w.rid AND w.i >= r.start + q AND w.i < r.start + r.length) GROUP BY rid
), t AS (
  SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS listed, first([start, length, q] ORDER BY length DESC, start, q) AS longest FROM r GROUP BY rid
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, longest[1]::BIGINT AS start, longest[2]::BIGINT AS length, longest[3]::BIGINT AS period, (1000 * longest[2] // longest[3])::BIGINT AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM d LEFT JOIN t USING (rid) LEFT JOIN k USING (rid)
"""

OP13_SQL = f"""
WITH RECURSIVE o AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]+')) AS word FROM documents
), c AS (SELECT word, count(*) AS k, id || ':' || word AS place FROM o WHERE length(word) >= 5 GROUP BY id, word
), h AS (SELECT word, k, {_crc32_sql("place")} AS h FROM c
), g AS (SELECT k, CASE WHEN h % 97 = 0 THEN substr(word, 1, h % length(word)) || substr(word, h % length(word) + 2) ELSE word END AS word FROM h
), v AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM g WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
), less AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM v, unnest(range(1, length(word) + 1)) AS r(i)
), pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM less AS a JOIN less AS b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, v.word, v.n FROM less AS a JOIN v ON a.rest = v.word
  UNION SELECT v.word, a.word, a.n FROM less AS a JOIN v ON a.rest = v.word
), b AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS best, max(near_n) AS best_n FROM pairs GROUP BY word
), f AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * v.n THEN best END AS form, CASE WHEN best_n >= 2 * v.n THEN best_n END AS form_n FROM v LEFT JOIN b USING (word)
), up AS (SELECT word, word AS root FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, up.root, f.n, f.n_near, f.form_n FROM f JOIN up USING (word) JOIN f AS last ON last.word = up.root WHERE last.form IS NULL
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_source_mixing": _mixing_sql(), "op6_exact_dedup": OP6_SQL, "op9_secret_scan": OP9_SQL, "op10_quality_rules": OP10_SQL, "op12_periodic_runs": OP12_SQL, "op13_spelling_variants": OP13_SQL}
