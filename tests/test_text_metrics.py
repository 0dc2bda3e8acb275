"""Stemmer, ROUGE-L, BLEU and METEOR against plain versions."""

import random
from itertools import combinations

import pytest

from sightline.functions import texts
from sightline.functions.stems import measure, porter, stems
from sightline.operators import text_metrics

# The examples of the algorithm's description.
PUBLISHED = """caresses caress ponies poni caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl
sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc
hesitanci hesit digitizer digit radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal
decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr
electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit
replacement replac adjustment adjust dependent depend adoption adopt communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler
probate probat rate rate cease ceas controll control roll roll generalizations gener oscillators oscil""".split()


def test_published_stems():
    assert [(w, porter(w)) for w in PUBLISHED[::2]] == list(zip(PUBLISHED[::2], PUBLISHED[1::2]))
    assert [measure(w) for w in "tr ee tree y by trouble oats trees ivy troubles private oaten orrery".split()] == [0, 0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 2, 2]
    assert [porter(w) for w in "dying skies dies died spied is enjoying Running geologi".split()] == ["die", "sky", "die", "die", "spi", "is", "enjoy", "run", "geolog"]


def test_stems_of_distinct_words(spark):
    words = spark.createDataFrame([("running",), ("running",), (None,), ("ran",), ("cats",)], "word string")
    assert {(r.word, r.stem) for r in stems(words, least=5).collect()} == {("running", "run"), ("ran", "ran"), ("cats", "cats")}


def pairs_of(spark, rows):
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(rows)], "id long, candidate string, reference string")


def some_texts(seed, count=60, most=40):
    rng = random.Random(seed)
    words = "the cat cats sat on a mat running run runs b1 B1 né's dog dogs , x-y".split()
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(most)))
    return [(text(), text()) for _ in range(count)] + [(None, "a"), ("a", None), ("", ""), ("a", "a"), ("a b", "a b"), ("same words in it here", "same words in it here")]


def test_rouge_l(spark):
    rng = random.Random(4)
    long = [(" ".join(rng.choice("abc") for _ in range(n)), " ".join(rng.choice("abc") for _ in range(m))) for n, m in ((61, 70), (62, 62), (63, 10), (124, 90), (125, 200), (300, 187))]
    rows = some_texts(1) + long
    found = text_metrics.rouge_l(pairs_of(spark, rows))
    assert "Python" not in found._jdf.queryExecution().toString() and "Arrow" not in found._jdf.queryExecution().toString()
    got = {r.id: r.rouge_l for r in found.collect()}
    assert got == pytest.approx({k: texts.rouge_l(a, b) for k, (a, b) in enumerate(rows)})


def test_rouge_l_of_stems(spark):
    rows = some_texts(2)
    stemmed = lambda t: " ".join(porter(w) if len(w) > 3 else w for w in __import__("re").findall("[a-z0-9]+", (t or "").lower()))
    got = {r.id: r.rouge_l for r in text_metrics.rouge_l_stemmed(pairs_of(spark, rows)).collect()}
    assert got == pytest.approx({k: texts.rouge_l(stemmed(a), stemmed(b)) for k, (a, b) in enumerate(rows)})


def test_bleu(spark):
    rows = some_texts(3)
    found = text_metrics.bleu(pairs_of(spark, rows))
    assert "Python" not in found._jdf.queryExecution().toString()
    assert {r.id: r.bleu for r in found.collect()} == pytest.approx({k: texts.bleu(a, b) for k, (a, b) in enumerate(rows)}, abs=1e-12)


def plain_meteor(a, b, stemmed=True):
    a, b = ((x or "").lower().split() for x in (a, b))
    free_a, free_b, found = list(enumerate(a)), list(enumerate(b)), []
    for key in (str, porter) if stemmed else (str,):
        for x in free_a[::-1]:
            y = next((y for y in free_b[::-1] if key(y[1]) == key(x[1])), None)
            if y:
                found.append((x[0], y[0]))
                free_a.remove(x)
                free_b.remove(y)
    found.sort()
    m = len(found)
    if not m:
        return 0, 0, 0.0
    chunks = 1 + sum(y != (x[0] + 1, x[1] + 1) for x, y in zip(found, found[1:]))
    p, r = m / len(a), m / len(b)
    return m, chunks, p * r / (0.9 * p + 0.1 * r) * (1 - 0.5 * (chunks / m) ** 3)


@pytest.mark.parametrize("stemmed", [True, False])
def test_meteor(spark, stemmed):
    rows = some_texts(5)
    got = {r.id: (r.matches, r.chunks, round(r.meteor, 9)) for r in text_metrics.meteor(pairs_of(spark, rows), stemmed).collect()}
    want = {k: plain_meteor(a, b, stemmed) for k, (a, b) in enumerate(rows)}
    assert got == {k: (m, c, round(s, 9)) for k, (m, c, s) in want.items()}


def test_meteor_matches_as_many_as_can_be():
    """Of all alignments of equal words, none has more matches; equal words never cross."""
    rng = random.Random(6)
    for _ in range(200):
        a, b = ([rng.choice("xyz") for _ in range(rng.randrange(1, 6))] for _ in range(2))
        links = [(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x == y]
        most = max((n for n in range(len(links) + 1) for c in combinations(links, n) if len({i for i, _ in c}) == len({j for _, j in c}) == n), default=0)
        assert plain_meteor(" ".join(a), " ".join(b), False)[0] == most


def test_empty_pairs(spark):
    none = spark.createDataFrame([], "id long, candidate string, reference string")
    assert [f(none).count() for f in (text_metrics.rouge_l, text_metrics.rouge_l_stemmed, text_metrics.bleu, text_metrics.meteor)] == [0] * 4


def test_bleu_counts_in_the_row(spark):
    """n-grams of a pair are no rows, so nothing but the pairs themselves is shuffled."""
    pairs = spark.createDataFrame([(1, "a a b a", "a a a c"), (2, "x", None)], "id long, candidate string, reference string")
    plan = text_metrics.bleu(pairs)._jdf.queryExecution().optimizedPlan().toString()
    assert not any(step in plan for step in ("Generate", "Aggregate", "Join"))


def test_words_stay_in_their_row(spark):
    """Neither METEOR nor ROUGE-L over stems shuffles words; the last of equal words are aligned, then stems of the rest."""
    rows = [(1, "a b a cats ran", "a cat a b running ran"), (2, None, "x"), (3, "same same", "same"), (4, "", "")]
    pairs = spark.createDataFrame(rows, "id long, candidate string, reference string").repartition(2)
    for made in (text_metrics.meteor(pairs), text_metrics.rouge_l_stemmed(pairs)):
        assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == pairs._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert text_metrics.aligned(["a", "b", "a"], ["a", "a", "a", "b"]) == [(2, 2), (1, 3), (0, 1)]
    assert {r.id: (r.matches, r.chunks) for r in text_metrics.meteor(pairs).collect()} == {1: (5, 5), 2: (0, 0), 3: (1, 1), 4: (0, 0)}
