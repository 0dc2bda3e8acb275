"""Exact, near, line, paragraph and substring deduplication, components, and the pipeline."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sightline.llm import components, exact_dedup, lines, near_dup, paragraphs, queries, substrings

from ..oracle import DATA, same
from .brute import SCHEMA, edge_rows, exact, find_roots, near, prose, removed_bytes


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_exact_equals_duckdb(spark):
    same(queries.op6_exact_dedup(spark, DATA), queries.OP6_SQL)


def test_exact_of_edges(edges, empty):
    got = exact_dedup.exact_dedup(edges).collect()
    known = exact([(r[0], r[1]) for r in edge_rows()])
    assert len(got) == len(edge_rows())
    assert sorted(map(str, ((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got))) == sorted(str((i, *known[i, "".join((t or "").split())])) for i, t in [(r[0], r[1]) for r in edge_rows()])
    assert exact_dedup.exact_dedup(empty).count() == 0
    kept = exact_dedup.drop_exact_duplicates(edges)
    contents = [("".join((r.text or "").split())) for r in kept.collect()]
    assert kept.columns == edges.columns and len(contents) == len(set(contents)) == len({c for _, c in known})


@pytest.mark.parametrize("local", [0, 1000])
def test_components(spark, local):
    rng = random.Random(local)
    links = [(a := rng.randrange(300), rng.choice([a, a + 1, rng.randrange(300)])) for _ in range(220)] + [(500, k) for k in range(501, 560)]
    expected = find_roots([x for x in links if x[0] != x[1]], {n for x in links for n in x if x[0] != x[1]})
    got = components.components(spark.createDataFrame(links, "a long, b long"), "a", "b", local_edges=local)
    assert {r.node: r.comp for r in got.collect()} == expected


def test_near_equals_brute_force(documents):
    got = near_dup.near_dup(documents, settings=near_dup.Settings(words=3, num=85))
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == near([(r.doc_id, r.text) for r in documents.collect()], 3, 85, 100)


def family(n: int) -> list[tuple[int, str]]:
    """Copies of a text with a few changed words each; some pairs are links and many are just not."""
    rng = random.Random(n)
    words = prose(50, 150).split()
    out = []
    for k in range(n):
        w = list(words)
        for _ in range(rng.choice([1, 2, 4, 6])):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        out.append((k, " ".join(w)))
    return out


@pytest.mark.parametrize("block", [8, 512])
def test_near_of_a_large_group(spark, block):
    rows = family(60)
    got = near_dup.near_dup(spark.createDataFrame(rows, "doc_id long, text string"), settings=near_dup.Settings(words=3, num=85, block=block))
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == near(rows, 3, 85, 100)


def test_near_of_edges(edges, empty):
    got = near_dup.near_dup(edges).collect()
    assert len(got) == len(edge_rows())
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert {by_id[i].component_id for i in (3, 4, 5, 6, 7)} == {3} and by_id[10].component_id == 9
    assert all(by_id[i].n_shingles == 0 and by_id[i].kept for i in (0, 1, 2))
    assert sorted((r.component_id, r.kept) for r in got if r.doc_id is None and r.component_id is not None) == [(3, False)]
    assert near_dup.near_dup(empty).count() == 0


def test_near_of_repeated_ids(spark):
    """Two rows of an id with different texts of equal set size, and a near copy of each."""
    a, b = prose(61, 120), prose(62, 120)
    near_a, near_b = (t.replace(t.split()[60], "changed", 1) for t in (a, b))
    rows = [(5, a), (5, b), (7, near_a), (8, near_b), (None, near_b), (5, a), (9, prose(63))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dup.near_dup(df, settings=near_dup.Settings(words=3, num=85)).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [("5", "5", True)] * 3 + [("7", "5", False), ("8", "5", False), ("9", "9", True), ("None", "5", False)]
    apart = near_dup.near_dup(spark.createDataFrame([(5, a), (6, b), (6, near_a)], "doc_id long, text string"), settings=near_dup.Settings(words=3, num=85)).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in apart) == [(5, 5, True), (6, 5, False), (6, 6, True)]
    kept = near_dup.drop_near_duplicates(df).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("5", a), ("5", b), ("9", prose(63))])


def test_near_of_string_ids(spark):
    a = prose(61, 120)
    got = near_dup.near_dup(spark.createDataFrame([("x", a), ("b", a.replace(a.split()[60], "changed", 1)), ("c", prose(64))], "doc_id string, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [("b", "b", True), ("c", "c", True), ("x", "b", False)]


def test_odd_sketch_estimates(spark):
    import numpy as np

    from sightline.llm import shingles

    rng = np.random.default_rng(1)
    s = near_dup.Settings()
    for share in (0.85, 0.95):
        common = rng.integers(0, 2**63, int(2000 * share), dtype=np.uint64)
        sets = [np.concatenate([common, rng.integers(0, 2**63, (2000 - len(common)) // 2, dtype=np.uint64)]) for _ in range(2)]
        bounds = np.cumsum([0, len(sets[0]), len(sets[1])])
        marks = shingles.odd_sketch(shingles.minhash(np.concatenate(sets), bounds, s.bands * s.rows), s.bits).view(np.uint64)
        differing = int(np.bitwise_count(marks[0] ^ marks[1]).sum())
        estimate = 1 + s.bits / (4 * s.bands * s.rows) * np.log(1 - 2 * differing / s.bits)
        assert abs(estimate - share) < 0.12 and differing <= s.max_ones


@pytest.mark.parametrize("block", [4096, 3])
def test_substrings_equal_brute_force(spark, block):
    rng = random.Random(8)
    passage = prose(70, 60)
    texts = [prose(k, 80) + " " + passage[: rng.randrange(150, len(passage))] + " " + prose(k + 500, rng.randrange(1, 60)) for k in range(12)]
    texts += [passage, "é" * 300, "ab" * 300, None, "", texts[0], "x" * 199]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[4])]
    got = substrings.substring_digest(spark.createDataFrame(rows, "doc_id long, text string"), settings=substrings.Settings(block=block)).collect()
    expected = removed_bytes([t for _, t in rows])
    assert sorted(str(tuple(r)) for r in got) == sorted(str((i, *e)) for (i, _), e in zip(rows, expected))


def test_substrings_of_edges(edges, empty):
    got = substrings.substring_dedup(edges).collect()
    assert len(got) == len(edge_rows()) and all(r.n_bytes == len(r.kept) + sum(s.end - s.start for s in r.spans) for r in got)
    assert substrings.substring_digest(empty).count() == 0


def test_paragraphs(spark, edges, empty):
    assert paragraphs.tuned_bands(0.8, 4, 0.999) == 14
    passage, other = prose(80, 60), prose(81, 60)
    changed = passage.replace(passage.split()[30], "new", 1)
    rows = [(1, f"{prose(82, 40)}\n{passage}"), (2, f"{passage}\n{prose(83, 40)}"), (3, changed), (4, other), (5, "short line"), (6, "short line")]
    got = paragraphs.paragraph_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_members, r.keep_doc_id, r.removed) for r in got) == [(1, 3, 1, False), (2, 3, 1, True), (3, 3, 1, True)]
    assert {r.doc_id for r in paragraphs.paragraph_dedup(edges).collect()} >= {3, 4, 5, 6, 7}
    assert paragraphs.paragraph_dedup(empty).count() == 0


def test_lines(spark, edges, empty):
    a = prose(90, 40)
    changed = a.replace(a.split()[20], "zz", 1)
    rows = [(1, f"{a}\nalone one\n\n  same line "), (2, f"same line\n{changed}"), (3, None), (4, prose(91, 40))]
    got = lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.line, r.n_members, r.keep_doc_id, r.keep_line, r.kept) for r in got) == [(1, 0, 2, 1, 0, True), (1, 3, 2, 1, 3, True), (2, 0, 2, 1, 3, False), (2, 1, 2, 1, 0, False)]
    assert {r.doc_id for r in lines.line_dedup(edges).collect()} >= {3, 4, 6}
    assert lines.line_dedup(empty).count() == 0


def line_shingles(text, k):
    raw = text.encode("utf-16-be")
    return {raw[2 * i : 2 * (i + k)] for i in range(max(1, len(raw) // 2 - k + 1))}


def line_links(texts, s):
    sets = [line_shingles(t, s.chars) for t in texts]
    return {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if s.den * len(sets[a] & sets[b]) >= s.num * len(sets[a] | sets[b])}


def test_bands_are_the_lines_of_a_plane():
    bands = lines.Settings().bands
    assert len(bands) == 20 and all(len(set(b)) == 4 for b in bands)
    assert all(sum({x, y} <= set(b) for b in bands) == 1 for x in range(16) for y in range(x))


@pytest.mark.parametrize("size", [40, 80, 300])
def test_recall_of_similar_lines(spark, size):
    """Pairs at 0.80 to 0.95 by brute force, one or two characters or words apart: nearly all meet, and none below the limit."""
    rng, s = random.Random(size), lines.Settings()
    texts = []
    while len(texts) < 1200:
        a = prose(rng.randrange(10**9), 80)[:size].strip()
        b = list(a)
        for _ in range(rng.choice([1, 1, 2, 3, 5]) if size > 60 else 1):
            at = rng.randrange(len(b)) if size > 60 else rng.choice([0, len(b) - 1, 1])
            b[at] = rng.choice("zqxjk")
        texts += [a, "".join(b).strip()]
    known = {k for k in range(0, 1200, 2) if texts[k] != texts[k + 1] and len(line_links(texts[k : k + 2], s))}
    got = lines.line_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    pairs = {r.keep_doc_id for r in got if not r.kept and r.doc_id == r.keep_doc_id + 1 and r.keep_doc_id % 2 == 0 and texts[r.doc_id] != texts[r.keep_doc_id]}
    assert pairs <= known and len(pairs) >= 0.985 * len(known) and len(known) > 100


@pytest.mark.parametrize("block", [4, 128])
def test_a_family_of_lines(spark, block):
    """Lines of one family, many just below the limit, some links across: the same components as by brute force."""
    rng, s = random.Random(3), lines.Settings(block=block)
    words = prose(50, 40).split()
    texts = set()
    while len(texts) < 90:
        w = list(words)
        for _ in range(rng.choice([1, 2, 3, 4])):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        texts.add(" ".join(w))
    texts = sorted(texts)
    got = lines.line_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), settings=s).collect()
    roots = find_roots(line_links(texts, s), range(len(texts)))
    known = {i: r for i, r in roots.items() if sum(x == r for x in roots.values()) > 1}
    found = {r.doc_id: r.keep_doc_id for r in got}
    assert sum(found.get(i) == r for i, r in known.items()) >= 0.98 * len(known) and set(found) <= set(known)


def test_bits_that_differ_bound_similarity(spark):
    """No link is lost by the bits, and most pairs below the limit need no sets; repeated shingles count once."""
    rng, s = random.Random(8), lines.Settings()
    texts = ["ab", "abc", "na" * 30, "na" * 40]
    for size in (30, 60, 300, 900):
        for _ in range(8):
            a = list(prose(rng.randrange(10**9), 200)[:size])
            for edits in (0, 1, 2, 4, 8, 16):
                for _ in range(edits * size // 200 + (edits > 0)):
                    a[rng.randrange(len(a))] = rng.choice("zqxjk")
                texts.append("".join(a))
    rows = spark.createDataFrame(list(enumerate(texts)), "node long, line string")
    every = rows.select(F.col("node").alias("a")).join(rows.select(F.col("node").alias("b")), F.col("a") < F.col("b"))
    kept = {(r.a, r.b) for r in lines._possible(every, lines._sketched(rows, s), s).collect()}
    links = line_links(texts, s)
    assert (2, 3) in links and links <= kept and len(kept) < 1.2 * len(links) + 5


@pytest.mark.parametrize("dense", [1, 100, 10**6])
def test_blocks_give_pairs_of_other_components(spark, dense):
    """With and without sets in the blocks: all links across, few pairs beyond them."""
    rng, s = random.Random(9), lines.Settings(block=8, dense=dense)
    base, texts = prose(51, 30).split(), []
    for _ in range(40):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5])):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    rows = spark.createDataFrame(list(enumerate(texts)), "node long, line string")
    mixed = rows.select(F.lit(7).cast("long").alias("key"), "node", (F.col("node") % 20).alias("comp"), F.lit(40).cast("long").alias("m"))
    found = [(r.a, r.b) for r in lines._blocks(mixed, lines._sketched(rows, s), rows, s).collect()]
    links = {(a, b) for a, b in line_links(texts, s) if a % 20 != b % 20}
    assert len(found) == len(set(found)) and links <= set(found) and len(found) <= (len(links) if dense == 1 else 1.3 * len(links) + 5)


def test_blocks_give_a_pair_once(spark):
    """Members of a family meet in many buckets, each with another choice of them: every pair that may be a link comes from one."""
    rng, s = random.Random(10), lines.Settings(block=4)
    base, texts = prose(52, 40).split(), []
    for _ in range(20):
        w = list(base)
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    rows = spark.createDataFrame(list(enumerate(texts)), "node long, line string")
    buckets = {key: rng.sample(range(20), rng.randrange(3, 18)) for key in range(-5, 10)}
    members = [(key, node, node, len(nodes)) for key, nodes in buckets.items() for node in nodes]
    mixed = spark.createDataFrame(members, "key long, node long, comp long, m long")
    found = sorted((r.a, r.b) for r in lines._blocks(mixed, lines._sketched(rows, s), rows, s).collect())
    together = {(a, b) for nodes in buckets.values() for a in nodes for b in nodes if a < b}
    assert len(found) == len(set(found)) and line_links(texts, s) & together <= set(found) <= together and len(found) > 100


def test_texts_of_lines_are_joined_alike_at_every_size(spark, monkeypatch):
    """Nodes that met are never offered to a broadcast that only small inputs pass."""
    a = prose(95, 40)
    asked = []
    monkeypatch.setattr(lines, "bounded_broadcast", lambda df, most=400_000: asked.append(df.columns) or df)
    got = lines.line_dedup(spark.createDataFrame([(1, a), (2, f"{a}x"), (3, prose(96, 40))], "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == {1, 2} and all("component" in columns for columns in asked)


def test_repeated_lines_and_ties(spark):
    rows = [(2, "same words here\nsame words here"), (2, "same words here"), (None, "same words here"), (1, "other\n  same words here")]
    got = lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 5 and {(r.keep_doc_id, r.keep_line, r.n_members) for r in got} == {(1, 1, 5)} and sum(r.kept for r in got) == 1


def test_no_python_in_native_plans(spark, documents):
    from sightline.llm import quality, secrets

    for df in (lines.line_dedup(documents), secrets.secret_digest(documents), quality.quality_rules(documents)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, DATA)
        assert after.columns == docs.columns, name
        rows = {r.doc_id: r.text for r in before.collect()}
        kept = {r.doc_id for r in after.collect()}
        assert kept <= set(rows) and kept, name
        if name == "exact dedup":
            known = exact(rows.items())
            assert kept == {i for (i, _), v in known.items() if v[2]}
        if name == "near dedup":
            assert kept == {i for i, v in near(list(rows.items()), 5, 80, 100).items() if v[2]}
        before = spark.createDataFrame(after.collect(), docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, before, DATA)
    assert last.count() == before.count() and last.where("NOT round_trip").count() == 0


def test_pipeline_of_edges(spark, edges, empty):
    """Nulls, blank and very long texts, copies, repeated rows and clashing column names, stage by stage."""
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0
    kept = {name: [(r.doc_id, r.text) for r in stage(spark, edges, DATA).collect()] for name, stage in corpus_pipeline.STAGES[:-1]}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, edges, DATA).columns == edges.columns, name
    rows = [(r[0], r[1]) for r in edge_rows()]
    assert all(set(found) <= set(rows) for found in kept.values())
    assert all((t or "").split() for _, t in kept["quality rules"])
    assert len(kept["exact dedup"]) == len({"".join((t or "").split()) for _, t in rows})
    near_kept = kept["near dedup"]
    assert sum(1 for _, t in near_kept if not (t or "").split()) == 3 and sum(1 for _, t in near_kept if t == prose(1)) == 1
    assert 0 < len(kept["source mixing"]) <= len(rows)
    last = corpus_pipeline.STAGES[-1][1](spark, edges, DATA).collect()
    assert len(last) == len(rows) and all(r.round_trip for r in last) and sum(r.n_pieces == 0 for r in last) == 2


def _block_pairs(rng, s, groups):
    """Sorted rows of block pairs: near copies of one of a few texts; some are of two different blocks."""
    import pyarrow as pa

    texts = []
    for k in range(60):
        w = prose(k % 12, 30).split()
        w[rng.randrange(30)] = f"new{k}"
        texts.append(" ".join(w))
    batch = pa.record_batch([pa.array(range(60), pa.int64()), pa.array(texts)], names=["rep", "text"])
    info = pa.Table.from_batches(near_dup.sign(s)([batch])).to_pylist()
    rows = []
    for key in range(groups):
        i, j = rng.choice([(0, 0), (0, 1)])
        for rep in sorted(rng.sample(range(60), rng.choice([2, 3, 4, 30]))):
            rows.append({"key": key, "band": key % 3, "i": i, "j": j, "chunk": rng.choice([i, j]), "rep": rep, "comp": rep % 50} | {c: info[rep][c] for c in ("n", "sketch", "bands")} | {"text": texts[rep]})
    schema = pa.schema([("key", pa.int64()), ("band", pa.int32())] + [(c, pa.int64()) for c in ("i", "j", "chunk", "rep", "comp", "n")] + [("sketch", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64())), ("text", pa.string())])
    return pa.Table.from_pylist(rows, schema)


def test_small_block_pairs_are_compared_together(monkeypatch):
    """The same rows are unsure and the same components are linked as one by one, in few calls."""
    rng, s = random.Random(13), near_dup.Settings(bands=7, rows=2)
    table = _block_pairs(rng, s, 300)
    batches = table.to_batches(max_chunksize=500)

    def outcome():
        unsure = sorted((r["key"], r["rep"]) for b in near_dup._unsure(s)(iter(batches)) for r in b.to_pylist())
        links = [(r["a"] % 50, r["b"] % 50) for b in near_dup._settle(s)(iter(batches)) for r in b.to_pylist()]
        return unsure, find_roots(links, range(50)), len(list(near_dup._groups(iter(batches), s)))

    together = outcome()
    monkeypatch.setattr(near_dup, "SMALL", 1)
    alone = outcome()
    assert together[:2] == alone[:2] and len(together[0]) > 100 and len(set(together[1].values())) < 50
    assert together[2] < 30 and alone[2] == 300


def test_windows_are_joined_alike_at_every_size(spark, monkeypatch):
    """Keys and classes of windows are never offered to a broadcast that only small inputs pass; without any, rows are the same."""
    rng = random.Random(12)
    words = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    passage, line = words(60), words(30)
    rows = [(k, f"{words(40 + k)} {passage} {words(50)}\n{line if k % 2 else words(25)}") for k in range(12)] + [(20, None), (21, line)]
    docs, asked = spark.createDataFrame(rows, "doc_id long, text string"), []
    monkeypatch.setattr(paragraphs, "bounded_broadcast", lambda df, most=400_000: asked.append((df.columns[0], most)) or df)
    got = sorted(tuple(r) for r in paragraphs.paragraph_dedup(docs).collect())
    assert [x for x in asked if x[0] != "rep"] == [("component", 400_000), ("component", 0)]
    monkeypatch.undo()
    again, members = paragraphs.paragraph_dedup(docs).collect(), {}
    assert got == sorted(tuple(r) for r in again)
    for r in again:
        members.setdefault((r.component, r.n_members), []).append(r)
    assert members and all(len(v) == n and sum(not r.removed for r in v) == 1 for (_, n), v in members.items())
