"""Byte-level BPE, periodic runs, spelling variants."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sightline.llm import bytebpe, runs, variants

from .brute import SCHEMA, edge_rows


@pytest.fixture(scope="module")
def coder():
    with open(bytebpe.RANK_FILE, "rb") as f:
        return bytebpe.Coder.of(f.read(), bytebpe.PATTERN)


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


# Byte-level BPE


def plain_bpe(coder, text):
    """Pieces of the pattern, each merged pair by pair."""
    import regex

    ranks = {coder.library.decode_single_token_bytes(k): k for k in range(coder.library.n_vocab)}
    out = []
    for piece in regex.findall(bytebpe.PATTERN, text):
        parts = [bytes([b]) for b in piece.encode()]
        while len(parts) > 1:
            rank, i = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        out += [ranks[p] for p in parts]
    return out


TEXTS = st.text(alphabet=st.one_of(st.sampled_from("abthe ,.'sl\n\t\r\x1c\x85　漢🙂é0(=\x00"), st.characters(codec="utf-8")), max_size=80)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_ids_equal_plain_merging(coder, text):
    assert coder.library.encode_ordinary(text) == plain_bpe(coder, text)


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(1, 9))
def test_sections_keep_the_pieces(coder, text, size):
    assert "".join(part for part, _ in bytebpe.sections(text, size)) == text
    assert [k for p in coder.parts(text, size) for k in p] == coder.library.encode_ordinary(text)


def test_long_texts(coder):
    rng = random.Random(3)
    for text in ["a" * 300_000, " " * 200_000 + "x", "word " * 60_000, "漢字" * 80_000, "".join(rng.choice("ab \n'.s1") for _ in range(200_000)), "\n" * 100_000]:
        ids = coder.library.encode_ordinary(text)
        assert coder.digest(text) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(text.encode()))
    assert len(list(bytebpe.sections("word " * 60_000))) == 5


def test_long_runs_of_blanks(coder, monkeypatch):
    import re

    monkeypatch.setattr(bytebpe, "_BLANKS", re.compile(bytebpe._BLANKS.pattern.replace("4096", "3")))
    rng = random.Random(8)
    for _ in range(2000):
        text = "".join(rng.choice([" ", "  ", "    ", "\n\n\n", "\u3000\x85 ", "a", "'s", "7", "!", "é", "\x1c"]) for _ in range(rng.randrange(12)))
        assert [k for p in coder.parts(text) for k in p] == coder.library.encode_ordinary(text)
    monkeypatch.undo()
    count, _, decoded = coder.digest("x" + " " * 2_000_000 + "y\n" * 9 + "\n" * 1_500_000)
    assert count > 1 and decoded == sha(("x" + " " * 2_000_000 + "y\n" * 9 + "\n" * 1_500_000).encode())


def test_tokens_of_edges(spark, coder, edges, empty):
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bytebpe.token_digest(edges).collect())
    want = Counter()
    for row in edge_rows():
        ids = coder.library.encode_ordinary(row[1] or "")
        want[row[0], len(ids), sha(",".join(map(str, ids)).encode()), sha((row[1] or "").encode())] += 1
    assert got == want
    encoded = bytebpe.encode(edges)
    assert Counter((r.id, tuple(r.tokens)) for r in encoded.collect()) == Counter((x[0], tuple(coder.library.encode_ordinary(x[1] or ""))) for x in edge_rows())
    back = bytebpe.decode(encoded).collect()
    assert Counter((r.id, bytes(r.decoded).decode()) for r in back) == Counter((x[0], x[1] or "") for x in edge_rows())
    assert bytebpe.token_digest(empty).count() == 0 and bytebpe.decode(bytebpe.encode(empty)).count() == 0
    named = spark.createDataFrame([("x", "<|endoftext|> a"), (None, None)], "`i.d` string, t string")
    assert {r[0]: r.n_tokens for r in bytebpe.token_digest(named, "i.d", "t").collect()} == {"x": len(plain_bpe(coder, "<|endoftext|> a")), None: 0}


# Periodic runs


def plain_runs(t, least=6, exponent=4):
    n, out = len(t), set()
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and t[j] == t[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least, exponent * q) and not any(all(t[k] == t[k + r] for k in range(i, i + length - r)) for r in range(1, q)):
                out.add((i, length, q))
            i = max(j, i + 1)
    return out


def repetitive(rng):
    t = [rng.randrange(rng.choice([1, 2, 2, 3, 5])) for _ in range(rng.randrange(1, 50))]
    for _ in range(rng.randrange(4)):
        root, at = t[: rng.randrange(1, 6)], rng.randrange(len(t))
        t[at:at] = root * rng.randrange(2, 9)
    return t[:150]


def test_edges_and_runs_equal_brute_force():
    import numpy as np

    rng = random.Random(11)
    for _ in range(1500):
        t = repetitive(rng)
        after, same = runs.edges(t)
        for i, j in enumerate(after):
            assert j == next((k for k in range(i + 1, len(t)) if t[k:] < t[i:]), len(t))
            if j < len(t):
                assert t[i : i + same[i]] == t[j : j + same[i]] and (j + same[i] == len(t) or t[i + same[i]] != t[j + same[i]])
        want = plain_runs(t)
        assert runs.runs_of(t) == want
        letters = np.array(t)
        parts = runs.stretches(runs.gaps(letters, np.zeros(len(t), int)), np.full(len(t), len(t)))
        assert {(a + s, length, p) for a, b in parts for s, length, p in runs.runs_of(t[a:b])} == want


def test_comparisons_are_linear():
    """Letters that count how often they are compared."""

    class Letter(int):
        seen = 0

        def __eq__(self, other):
            Letter.seen += 1
            return int(self) == int(other)

        __hash__ = int.__hash__

    a, b = [0], [0, 1]
    while len(b) < 20_000:
        a, b = b, b + a
    for t in ([0] * 20_000, b[:20_000], list(range(100)) * 200, ([0] * 140 + [1]) * 140):
        Letter.seen = 0
        runs.edges(list(map(Letter, t)))
        assert Letter.seen < 4 * len(t)


def plain_row(doc_id, text, rewrite=True):
    words = (text or "").encode().split()
    tail = runs.planted_tail(doc_id, len(words)) if rewrite else None
    if tail:
        a, p = tail
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(len(words))]
    found = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    milli = 1000 * best[1] // best[2] if found else None
    return doc_id, len(found), *best, milli, sha("".join("%d,%d,%d\n" % r for r in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone))


def test_runs_of_edges(spark, edges, empty):
    small = [r for r in edge_rows() if len(r[1] or "") < 5000]
    got = Counter(map(tuple, runs.run_digest(spark.createDataFrame(small, SCHEMA)).collect()))
    assert got == Counter(plain_row(r[0], r[1]) for r in small)
    rng = random.Random(2)
    made = [(k, " ".join("abéd"[x % 4] * (1 + x // 4) for x in repetitive(rng))) for k in range(300)]
    got = Counter(map(tuple, runs.run_digest(spark.createDataFrame(made, "doc_id long, text string").repartition(3)).collect()))
    assert got == Counter(plain_row(*r) for r in made)
    assert runs.run_digest(edges).count() == len(edge_rows()) and runs.run_digest(empty).count() == 0 == runs.periodic_runs(empty).count()


def test_runs_themselves(spark):
    text = "x " + "a b\n" * 4 + "y  \t" + "c " * 7
    rows = spark.createDataFrame([("k", text), (None, None)], "`i.d` string, t string")
    got = {r.id: (r.runs, r.collapsed) for r in runs.periodic_runs(rows, "i.d", "t").collect()}
    assert got["k"] == ([(1, 8, 2), (10, 7, 1)], "x a b y c") and got[None] == ([], "")


def test_a_very_long_repetition(spark):
    text = " ".join(f"w{k % 5000}" for k in range(100_000))
    r = runs.run_digest(spark.createDataFrame([(1, text)], "doc_id long, text string"), rewrite=None).first()
    assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (1, 0, 100_000, 5000, 20_000)


# Spelling variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def made_words(rng, letters, count, most=7):
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(1, most))) for _ in range(count)})


def test_every_pair_coincides_once():
    rng = random.Random(1)
    for _ in range(600):
        words = made_words(rng, "abcdefgh"[: rng.choice([2, 3, 5])], rng.randrange(2, 60))
        cuts = sorted(rng.sample(range(1, len(words)), min(len(words) - 1, rng.randrange(6))))
        parts = [words[a:b] for a, b in zip([0, *cuts], [*cuts, len(words)])]
        bounds = variants.Bounds([(p[0], p[-1]) for p in parts])
        pairs, alike, known = [], defaultdict(list), set(words)
        for part in parts:
            for word, leaves in zip(part, variants.light_edges(part, bounds)):
                for terminal, kind, depth in variants.changed(word, leaves):
                    if kind == variants.REPLACED:
                        alike[terminal, depth].append(word)
                    elif terminal in known:
                        pairs.append(tuple(sorted((word, terminal))))
        for (terminal, _), members in alike.items():
            members += [terminal] * (terminal in known)
            pairs += [tuple(sorted((x, y))) for i, x in enumerate(members) for y in members[:i]]
        assert sorted(pairs) == [(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if near(a, b)]


def test_light_edges_are_few():
    words = made_words(random.Random(4), "abcdefghijklmnopqrstuvwxyz", 20_000, 10)
    leaves = variants.light_edges(words, variants.Bounds([(words[0], words[-1])]))
    assert max(map(len, leaves)) <= len(words).bit_length() + 1


def plain_variants(counts, factor=2):
    words = sorted(counts)
    by = {w: [v for v in words if near(w, v)] for w in words}
    best = {w: min(by[w], key=lambda v: (-counts[v], v), default=None) for w in words}
    form = {w: best[w] if best[w] and counts[best[w]] >= factor * counts[w] else None for w in words}
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(by[w]), counts[form[w]] if form[w] else None)
    return out


@pytest.mark.parametrize("range_words", [10, 1000])
def test_variants_equal_brute_force(spark, range_words):
    rng = random.Random(range_words)
    vocabulary = made_words(rng, "abé", 90, 8)
    texts = [(k, " ".join(rng.choice(vocabulary) * rng.choice([1, 1, 1, 2]) for _ in range(rng.randrange(40))) + "." + "C" * 6) for k in range(60)]
    chain = [(99, " ".join(["zzzzz"] * 3 + ["zzzzy"] * 6 + ["zzzyy"] * 12 + ["zzyyy"] * 24 + ["zyyyy"] * 48))]
    counts = Counter()
    for k, text in texts + chain:
        import re
        import zlib

        for word in re.findall("[A-Za-zÀ-ÿ]+", text):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in word)
            h = zlib.crc32(f"{k}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 5:
                counts[word] += 1
    counts = {w: n for w, n in counts.items() if n >= 3}
    docs = spark.createDataFrame(texts + chain, "doc_id long, text string")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.spelling_variants(docs, range_words=range_words).collect()}
    assert got == plain_variants(counts)
    assert got["zzzzz"][1] == "zyyyy"


def test_variants_of_edges(spark, edges, empty):
    got = variants.spelling_variants(edges, least_count=1).collect()
    assert len({r.word for r in got}) == len(got) and all(r.root for r in got)
    assert {r.word for r in got} >= {"a" * 450} or any(len(r.word) == 449 for r in got)
    assert variants.spelling_variants(empty).count() == 0
    long = spark.createDataFrame([(None, "A" * 100_000 + " " + "a" * 99_999 + " Àbcde àbcde")] * 2, "doc_id long, text string")
    rows = {r.word: (r.form, r.n, r.n_near) for r in variants.spelling_variants(long, least_count=2, damage=0).collect()}
    assert rows == {"a" * 100_000: (None, 2, 1), "a" * 99_999: (None, 2, 1), "Àbcde": (None, 2, 1), "àbcde": (None, 2, 1)}
