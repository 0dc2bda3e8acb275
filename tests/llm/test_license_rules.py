"""The licence scan tries every rule that can match."""

import re
import re._parser

import pytest

from sightline.llm import licenses

from ..oracle import DATA

IDS = "OFL-1.1 BSL-1.0 MS-PL MS-RL PSF-2.0 CPL-1.0 SSPL-1.0 BUSL-1.1 PDDL-1.0 ODC-By-1.0".split()


def joined(text):
    return " " + b" ".join(w for w in licenses.words_of(text) if w).decode("utf-8", "surrogatepass") + " "


def detect_all(text):
    """Every rule on every text, detections by priority, then length, each held against all that are kept."""
    every = {r for found in licenses.rules()[0].values() for r in found}
    found = [(r.priority, m.start() - m.end(), m.start(), m.end(), r.label, r.weight) for r in every for m in r.pattern.finditer(text)]
    kept = []
    for _, _, a, b, label, weight in sorted(found):
        if not any(x <= a and b <= y for x, y, _, _ in kept):
            kept.append((a, b, label, weight))
    return sorted(kept)


def example(pattern):
    """A text that a rule's pattern matches: its longest form, with a word for anything."""
    return max(("".join("2" if x is None else x for x in f) for f in licenses._forms(re._parser.parse(pattern))), key=len)


SIGNATURES = [line.split(" | ", 2) for line in licenses.SIGNATURES.strip().splitlines()]


def test_signatures_are_many_and_different():
    assert len(SIGNATURES) > 200 and len({p for _, _, p in SIGNATURES}) == len(SIGNATURES)


@pytest.mark.parametrize(("label", "weight", "pattern"), SIGNATURES)
def test_each_signature_fires(label, weight, pattern):
    text = example(pattern)
    found = licenses.detect(joined(f"x {text} y"))
    assert found == detect_all(joined(f"x {text} y"))
    rules = {r for rules in licenses.rules()[0].values() for r in rules if r.pattern.pattern == rf"\b{pattern}\b"}
    assert {r.label for r in rules} == {label} and any(r.pattern.search(joined(text)) for r in rules)
    assert label in {x for _, _, x, _ in found} or any(b - a > len(text) for a, b, _, _ in found)


FULL = {
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "bsd-3-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}


@pytest.mark.parametrize("label", sorted(FULL))
def test_full_texts(label):
    assert label in licenses.scan(FULL[label])[5].split(",")


def test_many_notices_take_linear_time():
    import time

    text = "Licensed under the GNU General Public License version 2 or later. " * 20_000
    start = time.time()
    assert licenses.scan(text)[7] >= 20_000 and time.time() - start < 10


@pytest.mark.parametrize("name", IDS)
def test_identifiers_need_no_other_word(name):
    assert licenses.scan(f"SPDX-License-Identifier: {name}")[5] == name.lower()


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("released under the GPL v3", "gpl-3.0"),
        ("distributed under the terms of the MPL 2.0", "mpl-2.0"),
        ("subject to the terms of the AGPL v3", "agpl-3.0"),
        ("under the SSLeay licence", "openssl"),
        ("the Internet Systems Consortium license", "isc"),
        ("released under the do what the fsck you want to public licence", "wtfpl"),
        ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable", "zlib"),
    ],
)
def test_sentences_need_no_context_word(text, label):
    assert label in licenses.scan(text)[5].split(",")


def test_detect_equals_all_rules(spark):
    names = [n for line in licenses.NAMES.strip().splitlines() for n in line.split(" | ")[1:]]
    forms = {"".join(x or "2" for x in f) for n in names for f in licenses._forms(re._parser.parse(n))}
    texts = [t for n in sorted(forms) for t in (f"released under the {n}", f"subject to {n}", f"license is {n} x", f"spdx license identifier {n}", f"{n} licence")]
    texts += [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()][:60]
    for text in texts:
        assert licenses.detect(joined(text)) == detect_all(joined(text))


def test_base_places_of_a_long_text():
    """Counted from place to place: a text of 64,000 notices takes a moment."""
    import time

    joined = b" " + b"x under the mit license and cc by nc " * 64_000
    start = time.time()
    found = licenses.base_places(joined)
    assert time.time() - start < 5 and len(found) == 128_000
    assert sorted(found)[:3] == [(1, "mit"), (6, "cc-by-nc"), (10, "mit")]
