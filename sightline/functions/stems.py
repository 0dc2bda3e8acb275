"""The Porter stemmer, with the usual extensions, over distinct words."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

# Words whose stems are irregular; suffixes of the steps with what takes their place, longest match by order.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    ("fulli", "ful"), ("logi", "log"),
]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def shape(word: str) -> str:
    """``c`` and ``v`` for consonants and vowels; y is a vowel behind a consonant."""
    out = ""
    for k, letter in enumerate(word):
        vowel = letter in "aeiou" or (letter == "y" and k > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def measure(stem: str) -> int:
    """How often a consonant follows a vowel."""
    return shape(stem).count("vc")


def _short(stem: str) -> bool:
    """Ends in consonant, vowel, consonant other than w, x, y; or is a vowel and a consonant."""
    kinds = shape(stem)
    return (kinds.endswith("cvc") and stem[-1] not in "wxy") or kinds == "vc"


def _plural(w: str) -> str:
    if w.endswith("ies"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("sses"):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if measure(w[:-3]) else w
    for suffix in ("ed", "ing"):
        stem = w.removesuffix(suffix)
        if stem != w:
            if "v" not in shape(stem):
                return w
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if len(stem) > 1 and stem[-1] == stem[-2] and shape(stem)[-1] == "c":
                return stem if stem[-1] in "lsz" else stem[:-1]
            return stem + "e" if measure(stem) == 1 and _short(stem) else stem
    return w


def _first(w: str, rules: list[tuple[str, str]], again: bool = False) -> str:
    """The first rule whose suffix fits decides; it needs a stem with a measure."""
    if again and w.endswith("alli") and measure(w[:-4]):
        return _first(w[:-2], rules, True)
    for suffix, new in rules:
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            return stem + new if measure(w[:-3] if suffix == "logi" else stem) else w
    return w


def _ending(w: str) -> str:
    for suffix in sorted(STEP_4, key=len, reverse=True):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            return stem if measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))) else w
    return w


def porter(word: str) -> str:
    """The stem of a word, in lower case; words of one or two letters stay."""
    w = word.lower()
    if w in IRREGULAR:
        return IRREGULAR[w]
    if len(w) <= 2:
        return w
    w = _past(_plural(w))
    if w.endswith("y") and len(w) > 2 and shape(w[:-1])[-1] == "c":
        w = w[:-1] + "i"
    w = _ending(_first(_first(w, STEP_2, True), STEP_3))
    if w.endswith("e") and (measure(w[:-1]) > 1 or (measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w[:-1]) > 1 else w


def _stem_batches(least: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            words = batch.column(0).to_pylist()
            yield pa.record_batch([batch.column(0), pa.array([porter(w) if len(w) >= least else w for w in words], pa.string())], names=["word", "stem"])

    return run


def stems(words: DataFrame, column: str = "word", least: int = 1) -> DataFrame:
    """``word, stem`` of the distinct non-null words; those shorter than ``least`` stay as they are."""
    distinct = words.select(words[column].alias("word")).where("word IS NOT NULL").distinct()
    return distinct.mapInArrow(_stem_batches(least), "word string, stem string")
