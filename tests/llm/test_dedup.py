"""Exact and near deduplication against brute force, with awkward rows."""

import hashlib
import random
import re
import time

import numpy as np
import pytest

from statloom.llm import exact_dedup, minhash
from statloom.llm.components import connected_components

SCHEMA = "doc_id long, text string, sha string, ids int, salt string, kept boolean, component long"


def frame(spark, rows):
    """Rows of (doc_id, text) with further columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, "x", 1, None, None, 5) for i, t in rows], SCHEMA)


def awkward():
    long = "word " * 60_000
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "A"), (6, "a "), (7, long), (8, long), (None, "a"), (None, None), (9, "é"), (9, "é"), (10, "solo")]
    return rows + [(100 + i, "copy") for i in range(300)]


def test_exact_brute_force(spark):
    rows = awkward()
    got = exact_dedup.exact_dedup(frame(spark, rows).repartition(7)).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    assert len(got) == len(rows)
    for text, ids in groups.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        mine = [r for r in got if r.text_sha256 == sha]
        best = max((i for i in ids if i is not None), default=None)
        assert sorted(str(r.doc_id) for r in mine) == sorted(map(str, ids))
        assert {r.keep_id for r in mine} == {best} and {r.group_size for r in mine} == {len(ids)}
        assert [r.doc_id for r in mine if r.kept] == [best]


def test_exact_empty_and_salts(spark):
    assert exact_dedup.exact_dedup(frame(spark, [])).collect() == []
    one = exact_dedup.exact_dedup(frame(spark, awkward()).repartition(9), salts=3).collect()
    two = exact_dedup.exact_dedup(frame(spark, awkward()).repartition(2), salts=1).collect()
    assert sorted(map(str, one)) == sorted(map(str, two))


def test_distinct_rows(spark):
    rows = awkward()
    df = frame(spark, rows).repartition(5)
    got = exact_dedup.distinct_rows(df)
    assert got.columns == df.columns and got.dtypes == df.dtypes
    found = {(r.text or ""): r.doc_id for r in got.collect()}
    assert found["a"] == 2 and found["copy"] == 399 and len(found) == len({t or "" for _, t in rows}) == got.count()
    assert exact_dedup.distinct_rows(frame(spark, [])).count() == 0


def test_distinct_rows_with_maps(spark):
    rows = [(1, "a", {"k": 1}), (2, "a", {"k": 2}), (2, "a", {"k": 3}), (3, None, None)]
    got = exact_dedup.distinct_rows(spark.createDataFrame(rows, "doc_id long, text string, r map<string,int>").repartition(3))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(["(2, 'a', {'k': 3})", "(3, None, None)"])


def test_exact_lists_are_bounded(spark, monkeypatch):
    """Copies inside one partition fall into chunks; the verdict is the same."""
    monkeypatch.setattr(exact_dedup, "CHUNK_ROWS", 16)
    got = exact_dedup.exact_dedup(frame(spark, awkward()).coalesce(1)).collect()
    assert sorted(map(str, got)) == sorted(map(str, exact_dedup.exact_dedup(frame(spark, awkward()).repartition(4)).collect()))


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if len(words) >= 5 else frozenset([tuple(words)])


def components(rows, percent):
    """Brute force: every pair of rows with an id."""
    sets, up = {}, {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t))
            up[i] = i

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return {i: root(i) for i in ids}


def near_rows(seed, bases=12, copies=14):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(bases):
        base = [r.choice(vocabulary) for _ in range(r.randint(3, 120))]
        for _ in range(copies):
            words = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            rows.append((n, " ".join(words)))
            n += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("percent", [80, 85])
def test_near_brute_force(spark, percent):
    rows = near_rows(percent)
    rows += [(900, None), (901, ""), (902, " \t\n"), (None, rows[0][1]), (903, "one two"), (904, "ONE  two"), (905, "one two three"), (906, "ÀB c d e f g"), (907, "àb c d e f g"), (950, "x " * 40_000), (951, "x " * 40_001), (20, rows[3][1])]
    got = minhash.near_dedup(frame(spark, rows).repartition(6), percent=percent).collect()
    want = components(rows, percent)
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == want.get(r.doc_id)
        assert r.kept == (r.doc_id is None or want[r.doc_id] == r.doc_id)
    sizes = sorted((str(r.doc_id), r.n_shingles) for r in got)
    assert sizes == sorted((str(i), len(shingles(t))) for i, t in rows)
    assert want[903] == want[904] == 903 and want[906] != want[907]


def test_near_blocks_of_one_family(spark):
    """Families above block_shingles are cut into pairs of blocks with the same result."""
    rows = near_rows(3, bases=2, copies=60)
    whole = {r.doc_id: r.component_id for r in minhash.near_dedup(frame(spark, rows)).collect()}
    cut = {r.doc_id: r.component_id for r in minhash.near_dedup(frame(spark, rows), block_shingles=500).collect()}
    assert whole == cut == components(rows, 80)


def test_near_copies_that_leaders_do_not_link(spark):
    """Chains of edits: neighbours are linked, the smallest member isn't linked to most; all in one bucket or in many."""
    r = random.Random(12)
    words = [f"w{r.randrange(300)}" for _ in range(150)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(words)))
        for _ in range(2):
            words[r.randrange(len(words))] = f"v{r.randrange(300)}"
    rows += [(100 + i, " ".join([*words[:140], *(f"u{r.randrange(99)}" for _ in range(r.randint(0, 30)))])) for i in range(40)]
    want = components(rows, 85)
    assert len(set(want.values())) > 3
    for options in ({}, {"block_shingles": 700}, {"rows": 1, "m": 3}, {"rows": 1, "m": 3, "block_shingles": 700}):
        got = {x.doc_id: x.component_id for x in minhash.near_dedup(frame(spark, rows), percent=85, **options).collect()}
        assert got == want


def test_near_many_short_boilerplate_texts(spark):
    """50,000 texts that share most of their words, in pairs of copies that differ in one word of 60."""
    base = spark.range(50_000).selectExpr("id AS doc_id", "id div 2 AS pair", "id % 2 AS side")
    own = ", ".join(f"'p', (pair * {7919 + 2 * k} + {k}) % 99991" for k in range(20))
    shared = " ".join(f"terms{k}" for k in range(38))
    docs = base.selectExpr("doc_id", f"concat_ws(' ', '{shared}', concat_ws(' ', {own}), if(side = 1, 'changed', 'end')) AS text").repartition(8)
    start = time.monotonic()
    found = minhash.near_dedup(docs, percent=85).selectExpr("sum(if(component_id = doc_id div 2 * 2, 0, 1)) AS wrong", "count(*) AS n").first()
    assert (found.n, found.wrong) == (50_000, 0)
    assert time.monotonic() - start < 120


def test_links_take_time_in_proportion():
    """Sets linked in pairs, and sets that share most but not enough."""
    r = np.random.default_rng(3)
    for n in (32_000,):
        sets = [np.unique(np.concatenate([np.arange(20, dtype=np.uint64) + np.uint64(i // 2 * 1000 + 10**6), [np.uint64(r.integers(10**10, 10**12))]])) for i in range(n)]
        start = time.process_time()
        assert len(minhash._links(sets, None, 85, 100)) == n // 2
        assert time.process_time() - start < 10


def test_near_empty(spark):
    assert minhash.near_dedup(frame(spark, [])).collect() == []
    assert [r.kept for r in minhash.near_dedup(frame(spark, [(1, None), (2, "a")])).collect()] == [True, True]


def test_links_against_all_pairs():
    r = np.random.default_rng(5)
    for _ in range(30):
        sets = []
        for _ in range(r.integers(2, 25)):
            base = sets[r.integers(len(sets))] if sets and r.random() < 0.7 else r.integers(0, 10**9, 40).astype(np.uint64)
            keep = base[r.random(len(base)) < 0.96]
            sets.append(np.unique(np.concatenate([keep, r.integers(0, 10**9, r.integers(0, 3)).astype(np.uint64)])))
        sets = [s for s in sets if len(s)]

        def classes(pairs, n):
            up = list(range(n))
            for a, b in pairs:
                x, y = up[a], up[b]
                up = [x if u == y else u for u in up]
            return [up.index(u) for u in up]

        every = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))]
        assert classes(minhash._links(sets, None, 85, 100), len(sets)) == classes(every, len(sets))
        k = len(sets) // 2
        across = [(i, j) for i, j in every if (i < k) != (j < k)]
        if 0 < k < len(sets):
            assert classes(minhash._links(sets[:k], sets[k:], 85, 100), len(sets)) == classes(across, len(sets))


def test_meeting_probability():
    assert minhash.collections_for(0.85, 4) == 10 and minhash.collections_for(0.8, 4) == 14


@pytest.mark.parametrize("hub", [None, 6])
def test_components(spark, hub):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(1000, 1100)] + [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(5000, 5000), (None, 1)]
    got = {x.id: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long"), hub).collect()}
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            p, q = sorted((root(a), root(b)))
            up[q] = p
    assert got == {i: root(i) for i in up}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
