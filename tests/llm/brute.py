"""Plain versions of the operators for small tables, and the tables."""

import hashlib
import re
from collections import Counter, defaultdict

SPACES = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, kept string, `a.b` int"

LOREM = "the quick brown fox jumps over a lazy dog while seven wizards quietly mix boxing gloves and jugs of liquid oxygen near an old stone bridge where nobody ever goes at night because strange voices call from below and cold fog hides every path that leads back home again".split()


def prose(seed: int, n: int = 120) -> str:
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(LOREM) + str(rng.randrange(40)) for _ in range(n))


def edge_rows():
    """Nulls, empty and blank texts, copies, near copies, repeated rows, a very long text, clashing column names."""
    base = prose(1)
    near = base.replace(base.split()[60], "changed", 1)
    long = " ".join(prose(k, 400) for k in range(40))
    texts = [None, "", " \t\n", base, base, base.upper(), base + "  ", near, prose(2), "one two", "one two", "x", long, "漢字 🙂 é " * 30, "a" * 450, prose(3) + "\n" + prose(3), "password = abc123def"]
    rows = [(i, t, "s0" if i % 3 else None, "en" if i % 2 else None, None, "clash", 1) for i, t in enumerate(texts)]
    return rows + [rows[3], (None, base, None, None, None, None, None), (None, prose(9), "s1", "de", 1, None, 2)]


def find_roots(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingle_set(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if len(words) >= k else frozenset([tuple(words)])


def near(rows, k, num, den):
    sets = {i: shingle_set(t, k) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    roots = find_roots(links, ids)
    return {i: (len(sets[i]), roots[i], roots[i] == i) for i in ids}


def removed_bytes(rows, length=200):
    """rows: list of texts; for each (bytes, removed, spans, sha256 of the rest)."""
    raw = [(t or "").encode() for t in rows]
    seen = Counter(b[k : k + length] for b in raw for k in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


def exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(f"[{SPACES}]", "", t or "")].append((i, len(t or "")))
    out = {}
    for content, members in groups.items():
        keep = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))[0]
        for i, _ in members:
            out[i, content] = (keep, len(members), i == keep, hashlib.sha256(content.encode()).hexdigest())
    return out
