"""Operator 5 on passages that stand at different places of lines."""

import random

from sightline.llm import paragraphs

from .brute import prose


def test_spliced_passages_meet(spark):
    rng = random.Random(5)
    rows, parts = [], []
    for k in range(40):
        words = prose(1000 + k, 50).split()
        joined = " ".join(words)
        wrapped = "\n".join(" ".join(words[a : a + 9]) for a in range(0, 50, 9))
        for place, text in ((0, joined), (1, wrapped if k % 2 else joined)):
            before, after = (prose(rng.randrange(10**6, 10**9), rng.randrange(5, 200)) for _ in range(2))
            rows.append((2 * k + place, f"{before} {text} {after}"))
            parts.append((len(f"{before} ".encode()), len(f"{before} {text}".encode())))
    got = paragraphs.paragraph_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    inside = {r.doc_id for r in got if r.removed and r.keep_doc_id == r.doc_id - 1 and parts[r.doc_id][0] <= r.start and r.end <= parts[r.doc_id][1]}
    assert inside == set(range(1, 80, 2))
    assert {r.keep_doc_id for r in got} == set(range(0, 80, 2)) and all(r.n_members == 2 for r in got)


def unit_windows(raw):
    import numpy as np

    from sightline.llm import shingles as sh

    s = paragraphs.Settings()
    offsets = np.array([0, len(raw)])
    starts, ends, first = sh.word_places(raw, offsets)
    words = sh.hashes_between(raw, starts, ends)
    grams = sh.word_grams(words, s.words)
    return paragraphs.windows(words, grams, first, s), paragraphs.paragraphs(raw, words, starts, ends, first, s), words, first


def test_units_of_short_texts():
    for n in (0, 1, 4, 5, 35):
        found, (begin, size), *_ = unit_windows(prose(1, n).encode())
        assert len(found) == 0 and size.tolist() == ([n] if n >= 20 else [])


def test_windows_equal_a_plain_search():
    import numpy as np

    from sightline.llm import shingles as sh

    s = paragraphs.Settings()
    raw = prose(7, 300).encode()
    found, _, words, _ = unit_windows(raw)
    grams = sh.word_grams(words, s.words)[: len(words) - s.words + 1] >> np.uint64(32)
    plain = {a + int(np.argmin(grams[a : a + s.reach])) for a in range(len(grams) - s.reach + 1)}
    assert sorted(plain & set(range(len(words) - s.window_words + 1))) == found.tolist()


def similarity(a, b, k=5):
    x, y = ({tuple(t.split()[i : i + k]) for i in range(len(t.split()) - k + 1)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_recall_of_similar_paragraphs(spark):
    """Of pairs at 0.80 to 0.95 by brute force, nearly all are found; of pairs just below none is joined."""
    rng = random.Random(12)
    rows, near, far = [], set(), set()
    while len(near) < 400:
        words = prose(rng.randrange(10**9), 90).split()
        other = list(words)
        for _ in range(rng.choice([1, 2, 3, 4])):
            other[rng.randrange(90)] = f"new{rng.randrange(10**9)}"
        a, b = " ".join(words), " ".join(other)
        k = len(rows)
        rows += [(k, a), (k + 1, b)]
        (near if similarity(a, b) >= 0.8 else far).add(k)
    got = paragraphs.paragraph_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = dict(rows)
    whole = {r.keep_doc_id for r in got if r.removed and r.doc_id == r.keep_doc_id + 1 and r.end - r.start == len(texts[r.doc_id])}
    assert not whole & far and len(whole & near) >= 0.995 * len(near)


def test_exact_runs_of_fifty_words_all_meet(spark):
    """Whatever stands around it, in lines cut or wrapped in any way, a run of 50 equal words leaves a removed unit inside."""
    rng = random.Random(13)
    rows, places = [], []
    for k in range(150):
        run = prose(5000 + k, 50).split()
        for copy in (0, 1):
            sep = [" ", "\n", "  ", "\t"]
            inner = "".join(w + rng.choice(sep if copy else [" "]) for w in run)
            left, right = prose(rng.randrange(10**9), rng.randrange(0, 150)), prose(rng.randrange(10**9), rng.randrange(0, 150))
            rows.append((2 * k + copy, f"{left} {inner} {right}"))
            places.append((len(left) + 1, len(left) + 1 + len(inner)))
    got = paragraphs.paragraph_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    caught = {r.doc_id // 2 for r in got if r.removed and r.doc_id % 2 and places[r.doc_id][0] <= r.start and r.end <= places[r.doc_id][1]}
    assert caught == set(range(150))


def parity_words(n=1024):
    """A word of the parities of the bits of 0, 1, 2, ... as a and b, and its complement: equal under any polynomial modulo 2**64."""
    one = "".join("ab"[bin(k).count("1") & 1] for k in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_parity_words_hash_apart(spark):
    import numpy as np

    from sightline.llm import near_dup
    from sightline.llm import shingles as sh

    a, b = parity_words()
    raw = f"{a} {b} {a.upper()} x {a[:-1]}".encode()
    words, first = sh.word_hashes(raw, np.array([0, len(raw)]))
    assert words[0] == words[2] and len(set(words.tolist())) == 4
    pair = words[[0 if c == "a" else 1 for c in a] + [1 if c == "a" else 0 for c in a]]
    runs = sh.sequence_hashes(pair, np.array([0, 1024]), np.array([1024, 1024]))
    assert runs[0] != runs[1]
    docs = spark.createDataFrame([(1, f"{a} same words"), (2, f"{b} same words"), (3, f"{a} same words")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dup.near_dup(docs, settings=near_dup.Settings(words=3, num=85)).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_word_hashes_are_of_bytes_alone():
    import numpy as np

    from sightline.llm import shingles as sh

    texts = [prose(3, 60), "x", "ab" * 40 + " " + "é" * 9, " a  a b ", "12345678 1234567 123456789 12345678"]
    raw, offsets = "".join(texts).encode(), np.cumsum([0, *(len(t.encode()) for t in texts)])
    words, first = sh.word_hashes(raw, offsets)
    known = {}
    for k, t in enumerate(texts):
        mine = t.encode().split()
        assert first[k + 1] - first[k] == len(mine)
        for w, h in zip(mine, words[first[k] : first[k + 1]].tolist()):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def test_edited_passages_meet(spark):
    """Passages of 50 to 150 words, edited to a similarity of 0.8 or more and spliced into other text, leave a removed unit inside."""
    rng = random.Random(21)
    rows, places, kinds = [], [], []
    for size, changes, middle in ((60, 1, True), (60, 1, False), (50, 1, False), (100, 2, False), (150, 3, False)):
        for _ in range(60):
            words = prose(rng.randrange(10**9), size).split()
            other = list(words)
            for place in [size // 2] if middle else rng.sample(range(size), changes):
                other[place] = f"new{rng.randrange(10**9)}"
            assert similarity(" ".join(words), " ".join(other)) >= 0.8 or changes > 1 or size == 50
            for part in (words, other):
                left, right = (prose(rng.randrange(10**9), rng.randrange(5, 200)) for _ in range(2))
                rows.append((len(rows), f"{left} {' '.join(part)} {right}"))
                places.append((len(left) + 1, len(left) + 1 + len(" ".join(part))))
            kinds.append((size, changes, middle, similarity(" ".join(words), " ".join(other)) >= 0.8))
    got = paragraphs.paragraph_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    caught = {r.doc_id // 2 for r in got if r.removed and r.doc_id % 2 and places[r.doc_id][0] <= r.start and r.end <= places[r.doc_id][1] and r.keep_doc_id == r.doc_id - 1}
    for kind in dict.fromkeys(k[:3] for k in kinds):
        near = {n for n, k in enumerate(kinds) if k[:3] == kind and k[3]}
        assert len(caught & near) >= 0.9 * len(near), (kind, len(caught & near), len(near))
    assert {r.keep_doc_id for r in got if r.removed} <= {r.doc_id - 1 for r in got if r.removed}  # nothing else is removed
