"""Texts: prompts, parsing of replies, JSON repair, BLEU and ROUGE-L."""

from __future__ import annotations

import ast
import json
import math
import operator
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def choice_letter(reply: Column) -> Column:
    """The letter A-D of a multiple-choice reply: at its start, else the first that stands alone; else empty."""
    first = F.nullif(F.regexp_extract(reply, r"(?i)^\s*([ABCD])\b", 1), F.lit(""))
    any_ = F.nullif(F.regexp_extract(reply, r"(?i)\b([ABCD])\b", 1), F.lit(""))
    return F.upper(F.coalesce(first, any_, F.lit("")))


def question_text(trigger: Column, question: Column, choices: list[Column] | None = None) -> Column:
    """``trigger. question Choices: a, b`` without empty parts."""
    start = F.when(F.coalesce(trigger, F.lit("")) != "", F.concat(trigger, F.lit(". "))).otherwise(F.lit(""))
    base = F.concat(start, F.coalesce(question, F.lit("")))
    if not choices:
        return base
    given = F.filter(F.array(*choices), lambda c: F.coalesce(c, F.lit("")) != "")
    return F.when(F.size(given) > 0, F.concat(base, F.lit(" Choices: "), F.array_join(given, ", "))).otherwise(base)


def choice_prompt(trigger: Column, question: Column, choices: list[Column], with_trigger: bool = True) -> Column:
    """A multiple-choice prompt with four options; a blank trigger adds no context."""
    blank = F.lit("")
    said = F.trim(F.coalesce(trigger, blank)) if with_trigger else blank
    context = F.when(said != "", F.concat(F.lit("Context: "), said, F.lit("\n"))).otherwise(blank)
    options = [x for letter, c in zip("ABCD", choices) for x in (F.lit(f"  {letter}. "), F.coalesce(c, blank), F.lit("\n"))]
    # Fixed value: the instruction at the end.
    ask = "\nAnswer with only the letter of the correct option (A, B, C, or D). Do not add any explanation."
    return F.concat(context, F.lit("Question: "), F.trim(F.coalesce(question, blank)), F.lit("\n\nOptions:\n"), *options, F.lit(ask))


def scene_context(caption: Column, speech: Column, events: Column, speakers: Column) -> Column:
    """What is known of a scene, a line each: caption, speech, the first three audio events (label, confidence), speakers."""
    blank = F.lit("")
    line = lambda name, value: F.when(F.coalesce(value, blank) != "", F.concat(F.lit(f"{name}: "), value))
    heard = F.array_join(F.transform(F.slice(F.coalesce(events, F.array()), 1, 3), lambda e: F.format_string("%s (%.2f)", e["label"], e["confidence"])), ", ")
    who = F.array_join(F.array_sort(F.array_distinct(F.coalesce(speakers, F.array()))), ", ")
    lines = F.array_compact(F.array(line("Visual description", caption), line("Dialogue/Speech", speech), line("Audio events", heard), line("Speakers detected", who)))
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(F.lit("[No information available for this scene]"))


def by_modality(text: Column, given: Column, modalities: list[str]) -> Column:
    """A map of each modality's query text; one without a text of its own has the query's."""
    return F.map_from_arrays(F.array(*map(F.lit, modalities)), F.array(*(F.coalesce(F.nullif(F.element_at(given, m), F.lit("")), text) for m in modalities)))


def shortened(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.rtrim(F.left(text, F.lit(n))), F.lit("..."))).otherwise(text)


def joined_texts(texts: Column, most: int) -> Column:
    """The first texts that aren't blank, joined by blank lines."""
    return F.array_join(F.slice(F.filter(texts, lambda t: F.trim(t) != ""), 1, most), "\n\n")


def tags_in_reply(reply: Column, vocabulary: list[str]) -> Column:
    return F.filter(F.array(*map(F.lit, vocabulary)), lambda t: F.contains(F.lower(reply), F.lower(t)))


def answer_part(reply: Column) -> Column:
    """What follows an assistant marker, without a dashed tail."""
    after = F.nullif(F.regexp_extract(reply, r"(?is)assistant:\s*(.*)$", 1), F.lit(""))
    return F.trim(F.regexp_replace(F.coalesce(after, reply), r"(?s)\n-{3,}.*$", ""))


_OPS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv}
_QUOTES = str.maketrans({"“": '"', "”": '"', "‘": "'", "’": "'"})
_NUMBER = r"\d+(?:\.\d+)?"
_STRING = re.compile(r'"(?:[^"\\]|\\.)*"')


def _value_of(expression: str) -> str:
    """The value of an arithmetic expression; whole ones without a point."""

    def value(node: ast.expr) -> float:
        if isinstance(node, ast.BinOp):
            return _OPS[type(node.op)](value(node.left), value(node.right))
        return node.value

    try:
        found = value(ast.parse(expression.strip(), mode="eval").body)
    except (SyntaxError, KeyError, TypeError, AttributeError, ZeroDivisionError):
        return expression
    return str(int(found)) if float(found).is_integer() else str(found)


def _balanced(text: str) -> str | None:
    """The first object in braces; braces in strings and in comments don't count."""
    start, depth, at = text.find("{"), 0, text.find("{")
    while 0 <= at < len(text):
        if string := _STRING.match(text, at):
            at = string.end()
            continue
        if text.startswith(("//", "#"), at) and text[at - 1] in " \t\n,{[":
            at = text.find("\n", at)
            continue
        depth += {"{": 1, "}": -1}.get(text[at], 0)
        at += 1
        if not depth:
            return text[start:at]
    return None


def _strict(body: str) -> str:
    """Comments, Python literals, trailing commas and arithmetic repaired outside strings."""
    out, at = [], 0
    tokens = re.compile(rf"{_STRING.pattern}|(?<![^\s,{{\[])(?://|#)[^\n]*|\b(?:None|True|False)\b|(?<![\w.]){_NUMBER}(?:\s*[-+*/]\s*{_NUMBER})+(?![\w.])|,(?=\s*[}}\]])")
    words = {"None": "null", "True": "true", "False": "false", ",": ""}
    for m in tokens.finditer(body):
        found = m[0]
        made = found if found[0] == '"' else "" if found[0] in "#/" else words[found] if found in words else _value_of(found)
        out += [body[at : m.start()], made]
        at = m.end()
    return "".join([*out, body[at:]])


def repair_json(reply: str | None) -> str | None:
    """The first balanced object of a model's reply as strict JSON, or null.

    What parses is left as it is. Else code fences, comments, Python literals, trailing commas and arithmetic are repaired,
    and at last curly quotes.
    """
    text = re.sub(r"```(?:json)?", "", reply or "")
    for candidate in (text, text.translate(_QUOTES)):
        body = _balanced(candidate)
        for fix in (str, _strict, lambda x: re.sub(r",(\s*[}\]])", r"\1", _strict(x))):
            try:
                return json.dumps(json.loads(fix(body)), ensure_ascii=False)
            except (ValueError, TypeError):
                continue
    return None


@F.pandas_udf(T.StringType())
def repaired_json(replies: pd.Series) -> pd.Series:
    return replies.map(repair_json)


def rouge_l(candidate: str, reference: str) -> float:
    """F measure of the longest common subsequence of lower-case words (unstemmed)."""
    a, b = (re.findall(r"[a-z0-9]+", (x or "").lower()) for x in (candidate, reference))
    if not a or not b:
        return 0.0
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    shared = row[-1]
    return 2 * shared / (len(a) + len(b)) if shared else 0.0


def bleu(candidate: str, reference: str) -> float:
    """BLEU-4 of one pair over white-space words; orders without a match are smoothed by 1 / (2^k x ln-length scale)."""
    a, b = (candidate or "").split(), (reference or "").split()
    if not a or not b:
        return 0.0
    logs, misses = 0.0, 0
    for n in range(1, 5):
        grams = Counter(tuple(a[i : i + n]) for i in range(len(a) - n + 1))
        known = Counter(tuple(b[i : i + n]) for i in range(len(b) - n + 1))
        hit, total = sum((grams & known).values()), max(1, sum(grams.values()))
        if n == 1 and not hit:
            return 0.0
        if not hit:
            misses += 1
            hit = 1 / (2**misses * 5 / math.log(len(a))) if len(a) > 1 else 1e-9
        logs += math.log(hit / total) / 4
    return min(1.0, math.exp(1 - len(b) / len(a))) * math.exp(logs) if len(a) < len(b) else math.exp(logs)


@F.pandas_udf(T.DoubleType())
def rouge_l_score(candidate: pd.Series, reference: pd.Series) -> pd.Series:
    return pd.Series([rouge_l(a, b) for a, b in zip(candidate, reference)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def bleu_score(candidate: pd.Series, reference: pd.Series) -> pd.Series:
    return pd.Series([bleu(a, b) for a, b in zip(candidate, reference)], dtype="float64")


def tagging_text(decomposed, query_text):
    """What a query's tags are read from: its video modality's text (of a map by modality), else the query."""
    return F.coalesce(F.try_element_at(decomposed, F.lit("video")), query_text)


def parsed(reply, schema: str, defaults: dict):
    """A reply's object by ``schema``: strings without the blanks around them, ``defaults`` where a field is missing or null, or
    the reply can't be read."""
    kind = T.StructType.fromDDL(schema)
    found = F.from_json(reply, kind)
    trimmed = lambda f: F.regexp_replace(found[f.name], r"^\s+|\s+$", "") if isinstance(f.dataType, T.StringType) else found[f.name]
    return F.struct(*((F.coalesce(trimmed(f), F.lit(defaults[f.name])) if f.name in defaults else trimmed(f)).alias(f.name) for f in kind))
