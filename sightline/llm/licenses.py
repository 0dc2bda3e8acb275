"""License scan by ordered signature rules (operator 2).

A text becomes its words in lower case, joined by single blanks. An Aho-Corasick automaton finds keywords that are derived
from the rules' own alternatives, so every match of a rule holds one; only rules whose keywords occur are tried, and
overlapping detections are resolved: a detection is suppressed if one of no lower priority contains its interval. Some 250
signatures of licence texts, notices and addresses are written by hand one by one and come first; identifiers and other ways
to name a licence follow as hand-written names in hand-written sentences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, frugal
from .license_signatures import SIGNATURES

# The phrases that always count, with their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: label | name | identifier; patterns over words joined by blanks, specific before general.
NAMES = r"""
agpl-3.0 | (?:gnu )?affero general public licen[cs]e(?: version| v)? 3(?: 0)?|(?:gnu )?agpl ?v?3(?: 0)? | agpl 3 0(?: or later| only)?
agpl-1.0 | affero general public licen[cs]e(?: version| v)? 1(?: 0)? | agpl 1 0(?: or later| only)?
lgpl-3.0 | (?:gnu )?lesser general public licen[cs]e(?: version| v)? 3(?: 0)?|(?:gnu )?lgpl ?v?3(?: 0)? | lgpl 3 0(?: or later| only)?
lgpl-2.1 | (?:gnu )?lesser general public licen[cs]e(?: version| v)? 2 1|(?:gnu )?lgpl ?v?2 1 | lgpl 2 1(?: or later| only)?
lgpl-2.0 | (?:gnu )?library general public licen[cs]e(?: version| v)? 2(?: 0)?|(?:gnu )?lgpl ?v?2(?: 0)? | lgpl 2 0(?: or later| only)?
lgpl | (?:gnu )?lesser general public licen[cs]e|(?:gnu )?lgpl | lgpl
gpl-3.0 | (?:gnu )?general public licen[cs]e(?: version| v)? 3(?: 0)?|(?:gnu )?gpl ?v?3(?: 0)? | gpl 3 0(?: or later| only)?
gpl-2.0 | (?:gnu )?general public licen[cs]e(?: version| v)? 2(?: 0)?|(?:gnu )?gpl ?v?2(?: 0)? | gpl 2 0(?: or later| only)?
gpl-1.0 | (?:gnu )?general public licen[cs]e(?: version| v)? 1(?: 0)?|(?:gnu )?gpl ?v?1(?: 0)? | gpl 1 0(?: or later| only)?
gpl | (?:gnu )?general public licen[cs]e|(?:gnu )?gpl | gpl
gfdl-1.3 | (?:gnu )?free documentation licen[cs]e(?: version)? 1 3 | gfdl 1 3(?: or later| only)?
gfdl | (?:gnu )?free documentation licen[cs]e | gfdl
apache-2 | apache(?: software)? licen[cs]e(?: version| v)? 2(?: 0)?|apache 2(?: 0)?|asl 2 0 | apache 2 0
apache-1.1 | apache(?: software)? licen[cs]e(?: version| v)? 1 1 | apache 1 1
apache | apache(?: software)? licen[cs]e | apache
mit-0 | mit no attribution|mit 0 | mit 0
mit | mit|expat|x11|mit x11 | mit
bsd-4-clause | (?:bsd 4 clause|4 clause bsd|original bsd|old bsd) | bsd 4 clause
bsd-3-clause | (?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd) | bsd 3 clause
bsd-2-clause | (?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd) | bsd 2 clause
bsd-0-clause | (?:zero clause bsd|0bsd|bsd zero clause) | 0bsd
bsd | bsd(?: style)? | bsd
isc | isc|internet systems consortium | isc
mpl-2.0 | mozilla public licen[cs]e(?: version| v)? 2(?: 0)?|mpl ?v?2(?: 0)? | mpl 2 0
mpl-1.1 | mozilla public licen[cs]e(?: version| v)? 1 1|mpl ?v?1 1 | mpl 1 1
mpl | mozilla public licen[cs]e|mpl | mpl
epl-2.0 | eclipse public licen[cs]e(?: version| v)? 2(?: 0)? | epl 2 0
epl-1.0 | eclipse public licen[cs]e(?: version| v)? 1(?: 0)? | epl 1 0
cddl-1.1 | common development and distribution licen[cs]e(?: version)? 1 1 | cddl 1 1
cddl-1.0 | common development and distribution licen[cs]e(?: version)? 1 0|cddl | cddl 1 0
cpl-1.0 | common public licen[cs]e(?: version)?(?: 1 0)? | cpl 1 0
eupl-1.2 | european union public licen[cs]e(?: version)?(?: 1 2)?|eupl(?: 1 2)? | eupl 1 2
artistic-2.0 | (?:the )?artistic licen[cs]e(?: version)? 2(?: 0)? | artistic 2 0
artistic-1.0 | (?:the )?artistic licen[cs]e | artistic 1 0(?: perl)?
zlib | zlib(?: libpng)? | zlib
bsl-1.0 | boost software licen[cs]e(?: version)?(?: 1 0)? | bsl 1 0
unlicense | unlicense | unlicense
wtfpl | wtfpl|do what the \w+ you want to public licen[cs]e | wtfpl
postgresql | postgresql | postgresql
psf-2.0 | python software foundation|psf|python | psf 2 0|python 2 0
ruby | ruby | ruby
php-3.01 | php(?: licen[cs]e)?(?: version)?(?: 3 01)? | php 3 01
openssl | openssl|ssleay | openssl
ncsa | university of illinois ncsa|ncsa | ncsa
ms-pl | microsoft public licen[cs]e | ms pl
ms-rl | microsoft reciprocal licen[cs]e | ms rl
odbl-1.0 | open database licen[cs]e|odbl | odbl 1 0
odc-by-1.0 | open data commons attribution licen[cs]e|odc by | odc by 1 0
pddl-1.0 | public domain dedication and licen[cs]e | pddl 1 0
ofl-1.1 | (?:sil )?open font licen[cs]e(?: version)?(?: 1 1)? | ofl 1 1
sspl-1.0 | server side public licen[cs]e | sspl 1 0
busl-1.1 | business source licen[cs]e(?: 1 1)? | busl 1 1
elastic-2.0 | elastic licen[cs]e(?: 2 0)? | elastic 2 0
cc0-1.0 | cc0(?: 1 0)?|creative commons zero|cc 0 | cc0 1 0
cc-by-nc-nd | (?:creative commons|cc) (?:attribution|by) (?:noncommercial|non commercial|nc) (?:noderivatives|noderivs|no derivatives|nd)(?: \d 0)? | cc by nc nd(?: \d 0)?
cc-by-nc-sa | (?:creative commons|cc) (?:attribution|by) (?:noncommercial|non commercial|nc) (?:sharealike|share alike|sa)(?: \d 0)? | cc by nc sa(?: \d 0)?
cc-by-nc | (?:creative commons|cc) (?:attribution|by) (?:noncommercial|non commercial|nc)(?: \d 0)? | cc by nc(?: \d 0)?
cc-by-nd | (?:creative commons|cc) (?:attribution|by) (?:noderivatives|noderivs|no derivatives|nd)(?: \d 0)? | cc by nd(?: \d 0)?
cc-by-sa | (?:creative commons|cc) (?:attribution|by) (?:sharealike|share alike|sa)(?: \d 0)? | cc by sa(?: \d 0)?
cc-by | (?:creative commons|cc) (?:attribution|by)(?: \d 0)? | cc by(?: \d 0)?
"""

#: (priority, weight, sentence): NAME and ID stand for a licence's patterns. A lower priority number wins.
SENTENCES = (
    (1, 1.0, r"spdx licen[cs]e identifier (?:ID)"),
    (2, 0.95, r"(?:released|licen[cs]ed|distributed|available|provided|published|shared|made available|covered|governed)(?: \w+){0,3}? under(?: the)?(?: terms(?: and conditions)? of)?(?: the)? (?:NAME)(?: licen[cs]e)?"),
    (3, 0.9, r"subject to(?: the)?(?: terms(?: and conditions)? of)?(?: the)? (?:NAME)(?: licen[cs]e)?"),
    (4, 0.9, r"under(?: the)?(?: terms(?: and conditions)? of)?(?: the)? (?:NAME) licen[cs]e"),
    (5, 0.8, r"licen[cs]e (?:is |as )?(?:the )?(?:NAME)(?: licen[cs]e)?"),
    (6, 0.7, r"(?:NAME) licen[cs]ed?"),
    (7, 0.6, r"(?:licen[cs]e|licen[cs]ed|licen[cs]ing)(?: \w+){0,4}? (?:ID)"),
)

#: Priorities of the rules, from 0; signatures have the first.
LEVELS = 1 + max(priority for priority, _, _ in SENTENCES)


@dataclass(frozen=True)
class Rule:
    """``needs``: every match's text holds one of these."""

    priority: int
    label: str
    weight: float
    pattern: re.Pattern
    needs: tuple[str, ...]


def _forms(parsed) -> list[tuple[str | None, ...]]:
    """The texts an expression matches, as literal pieces; None stands for any text."""
    out: list[tuple[str | None, ...]] = [()]
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            here = [(chr(value),)]
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in value):
            here = [(chr(c),) for _, c in value]
        elif name == "SUBPATTERN":
            here = _forms(value[3])
        elif name == "BRANCH":
            here = [f for branch in value[1] for f in _forms(branch)]
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            here = ([()] if value[0] == 0 else []) + (_forms(value[2]) if value[1] == 1 else [(None,)])
        else:
            here = [(None,)]
        out = [a + b for a in out for b in here]
    return out


@cache
def keywords(pattern: str) -> tuple[str, ...]:
    """Texts of which every match of the pattern holds one: a text that all forms share, or each form's longest piece."""
    import re._parser

    forms = [["".join(run) for run in _runs(f)] for f in set(_forms(re._parser.parse(pattern)))]
    for text in sorted({x for f in forms for x in f}, key=lambda x: (-len(x), x)):
        if len(text) > 4 and all(any(text in x for x in f) for f in forms):
            return (text,)
    longest = {max(f, key=len) for f in forms}
    return tuple(sorted(x for x in longest if not any(y != x and y in x for y in longest)))


def _runs(form: tuple[str | None, ...]) -> list[list[str]]:
    runs: list[list[str]] = [[]]
    for piece in form:
        if piece is None:
            runs.append([])
        else:
            runs[-1].append(piece)
    return [r for r in runs if r]


@cache
def rules() -> tuple[dict[str, list[Rule]], object]:
    """Rules by keyword, and the automaton of the keywords. Names and identifiers stand between blanks."""
    import ahocorasick

    by_word: dict[str, list[Rule]] = {}
    for line in SIGNATURES.strip().splitlines():
        label, weight, pattern = line.split(" | ", 2)
        rule = Rule(0, label, float(weight), re.compile(rf"\b{pattern}\b", re.A), keywords(pattern))
        for word in rule.needs:
            by_word.setdefault(word, []).append(rule)
    for line in NAMES.strip().splitlines():
        label, name, identifier = (x.strip() for x in re.split(r" \| ", line, maxsplit=2))
        for priority, weight, sentence in SENTENCES:
            filled = sentence.replace("NAME", name).replace("ID", identifier)
            needs = keywords(sentence.replace("NAME", r"\w").replace("ID", r"\w"))
            rule = Rule(priority, label, weight, re.compile(rf"(?<!\S)(?:{filled})(?!\S)", re.A), needs)
            for word in keywords(f" (?:{name if 'NAME' in sentence else identifier}) "):
                by_word.setdefault(word, []).append(rule)
    automaton = ahocorasick.Automaton()
    for word in by_word:
        automaton.add_word(word, word)
    automaton.make_automaton()
    return by_word, automaton


#: Bytes to their lower case, separators to blanks; bytes over 0x7F belong to words.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split(b" ")


def base_places(joined: bytes) -> list[tuple[int, str]]:
    """(word index, label) of every place of a base phrase; ``joined``: words between single blanks, one at either end."""
    found = []
    for phrase, label in BASE:
        sought, at, counted, blanks = b" " + phrase.encode() + b" ", 0, 0, 0
        while (at := joined.find(sought, at)) >= 0:
            blanks += joined.count(b" ", counted, at)  # from the last place on, so a text is counted through once a phrase
            counted = at
            found.append((blanks, label))
            at += 1
    return found


def detect(joined: str) -> list[tuple[int, int, str, float]]:
    """(start, end, label, weight) of the detections that none of the same or a higher priority contains.

    A containing one that is suppressed itself is contained by another, so all detections may be compared. Of equal
    intervals and priorities the first label stays.
    """
    by_word, automaton = rules()
    tried: dict[Rule, None] = {}
    for word in sorted({word for _, word in automaton.iter(f" {joined} ")}):
        tried |= dict.fromkeys(r for r in by_word[word] if any(n in joined for n in r.needs))
    found = sorted((m.start(), -m.end(), r.priority, r.label, r.weight) for r in tried for m in r.pattern.finditer(joined))
    kept, reach = [], [-1] * LEVELS  # the greatest end so far of each priority: who contains a detection starts no later
    for start, end, priority, label, weight in found:
        if max(reach[: priority + 1]) < -end:
            kept.append((start, -end, label, weight))
        reach[priority] = max(reach[priority], -end)
    return sorted(kept)


def scan(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections."""
    words = [w for w in words_of(text) if w]
    joined = b" " + b" ".join(words) + b" "
    base = base_places(joined)
    found = detect(joined.decode("utf-8", "surrogatepass"))
    starts, labels = [i for i, _ in base], {label for _, label in base}
    weights = {label: 1.0 for label in labels}
    for _, _, label, weight in found:
        weights[label] = max(weight, weights.get(label, 0.0))
    doubt = 1.0
    for label in sorted(weights):
        doubt *= 1 - weights[label]
    return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(weights)), round(1 - doubt, 6), len(found)


COLUMNS = "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_detections long"


def _scan_batches(batches: Iterator) -> Iterator:
    import pyarrow as pa

    names = [c.split()[0] for c in COLUMNS.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split()[1]] for c in COLUMNS.split(", ")]
    for batch in batches:
        rows = [(i.as_py(), *scan(t.as_py())) for i, t in zip(batch.column(0), batch.column(1))]
        columns = list(zip(*rows)) or [()] * len(names)
        yield pa.record_batch([pa.array(c, type=t) for c, t in zip(columns, types)], names=names)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections.

    Null texts count as empty: no words, no labels, score 0. Ids may be null or repeated; rows are judged one by one, so
    there is no shuffle. Other columns are ignored; an empty table gives an empty result.
    """
    return fresh(docs, id=id_col, text=text_col).mapInArrow(frugal(_scan_batches), COLUMNS).withColumnRenamed("id", id_col)
