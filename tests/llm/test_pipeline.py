"""The pipeline's stages against the operators' full results and brute force, and the registered SQL."""

import math
import os
import re
from collections import Counter

import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from statloom.llm import lang_id, minhash, ngram_model, packing, quality
from statloom.llm import queries as registered
from statloom.llm.common import written

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data here")


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", text.translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_stage_order_and_columns(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "exact_dedup", "near_dedup", "packing"]
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DIR).columns == docs.columns
    assert corpus_pipeline.run(spark, DIR).count() > 0


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    assert ids(corpus_pipeline.quality_stage(spark, docs, DIR)) == ids(quality.classify(docs, labels).where("kept"))
    assert ids(corpus_pipeline.language_stage(spark, docs, DIR)) == ids(lang_id.identify(docs, lang_id.learn(docs)).where("score >= 0.4"))
    best = {}
    for r in docs.collect():
        best[r.text or ""] = max(r.doc_id, best.get(r.text or "", -1))
    assert ids(corpus_pipeline.exact_stage(spark, docs, DIR)) == sorted(best.values())
    assert ids(corpus_pipeline.near_stage(spark, docs, DIR)) == ids(minhash.near_dedup(docs).where("kept"))
    assert corpus_pipeline.packing_stage(spark, docs, DIR).count() == packing.pack(docs, registered.tokenizer_path()).count()


def test_stages_on_awkward_tables(spark):
    rows = [(5, "word " * 90_000, "en", "s", 450_000), (1, None, "en", "s", 0), (2, "", None, None, 0), (None, "the cat sat", "en", None, None), (3, "The cat sat on the mat.", "en", "s", 23), (3, "The cat sat on the mat.", "en", "s", 23), (4, "THE CAT sat on the mat.", "en", "s", 23)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DIR).count() >= 0
        assert stage(spark, docs.limit(0), DIR).count() == 0
    assert corpus_pipeline.near_stage(spark, docs, DIR).where("doc_id IS NULL").count() == 1


def test_near_stage_with_clashing_columns(spark):
    rows = [(i, f"one two three four five six seven {i // 2}", i, i) for i in range(6)] + [(None, "x", 9, 9), (None, "x", 9, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept long, kept_id long")
    got = corpus_pipeline.near_stage(spark, docs, DIR)
    assert got.columns == docs.columns and sorted(str(r.doc_id) for r in got.collect()) == ["0", "2", "4", "None", "None"]


# --- a brute-force chain ------------------------------------------------------------------------------------------------


def percentile(values, q):
    values = sorted(values)
    at = (len(values) - 1) * q
    low = math.floor(at)
    return values[low] + (at - low) * (values[min(low + 1, len(values) - 1)] - values[low])


def brute_quality(rows, trusted, stretch=3.5, least=50):
    """Ids that the classifier keeps, from counts of all n-grams and plain lists."""
    o = ngram_model.ORDER
    grams = lambda t: [tuple(([None] * (o - 1) + list(t))[j : j + o]) for j in range(len(t))]
    models = [probability([t for i, t, _ in rows if i in trusted and t and ngram_model.fold_of(i) == f], o) for f in (0, 1)]
    logs = [{}, {}]
    found = {}
    for i, t, lang in rows:
        if not t:
            continue
        own = grams(t)
        for f in (0, 1):
            for g in set(own) - logs[f].keys():
                logs[f][g] = math.log(models[f](g))
        by = [-sum(logs[f][g] for g in own) / len(t) for f in (0, 1)]
        ppl = by[1 - ngram_model.fold_of(i)] if i in trusted else sum(by) / 2
        found[i] = (lang or "", int(math.log2(len(t))), ppl, math.log(len(set(own)) / len(t)))
    kept = set()
    for i, (lang, band, *figures) in found.items():
        inside = True
        for at, figure in enumerate(figures):
            levels = [[x for x in found if x in trusted], [x for x in found if x in trusted and found[x][0] == lang], [x for x in found if x in trusted and found[x][:2] == (lang, band)]]
            spread = None
            for ids in levels:
                if not ids:
                    continue
                q = [(percentile([math.floor(found[x][2 + at] * quality.BINS) for x in ids], p) + 0.5) / quality.BINS for p in quality.QUANTILES]
                mine = (q[1], q[1] - q[0], q[2] - q[1])
                spread = mine if spread is None else tuple((len(ids) * a + least * b) / (len(ids) + least) for a, b in zip(mine, spread, strict=True))
            low, high = spread[0] - stretch * spread[1], spread[0] + stretch * spread[2]
            inside &= figure >= low and (at == 1 or figure <= high)
        if inside:
            kept.add(i)
    return kept


def probability(texts, order):
    """Interpolated modified Kneser-Ney with counts of contexts kept aside."""
    counts = {order: Counter(tuple(([None] * (order - 1) + list(t))[j : j + order]) for t in texts for j in range(len(t)))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cuts, totals, left = {}, {}, {}
    for k, own in counts.items():
        n = [max(1, sum(v == i for v in own.values())) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1])
        cuts[k] = [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), i - 0.05) for i in (1, 2, 3)]
        totals[k], left[k] = Counter(), Counter()
        for g, c in own.items():
            totals[k][g[:-1]] += c
            left[k][g[:-1]] += cuts[k][min(c, 3) - 1]

    def p(g):
        if not g:
            return 1 / (len(counts[1]) + 1)
        k = len(g)
        total = totals[k][g[:-1]]
        if not total:
            return p(g[1:])
        c = counts[k][g]
        return ((c - cuts[k][min(c, 3) - 1] if c else 0) + left[k][g[:-1]] * p(g[1:])) / total

    return p


def test_run_against_a_brute_force_chain(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in docs.collect()}
    trusted = {r.doc_id for r in labels.where("quality = 1").collect()}
    kept = brute_quality([(i, r.text, r.lang) for i, r in rows.items()], trusted)
    now = corpus_pipeline.quality_stage(spark, docs, DIR)
    assert {r.doc_id for r in now.collect()} == kept and len(kept) < len(rows)
    junk = [r.doc_id for r in labels.where("quality = 0").collect() if r.doc_id in rows]
    assert len(kept.intersection(junk)) <= 0.25 * len(junk)  # few trusted texts here; the README has the rates of larger tables
    model = lang_id.learn(docs.where(docs.doc_id.isin(list(kept))))
    ids = sorted(kept)
    kept = {i for i, s in zip(ids, model.predict([rows[i].text for i in ids])[1], strict=True) if s >= 0.4}
    last = {}
    for i in sorted(kept):
        last[rows[i].text] = i
    kept = set(last.values())
    sets = {i: shingles(rows[i].text) for i in kept}
    up = {i: i for i in kept}
    for a in sorted(kept):
        for b in sorted(kept):
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and sets[a]:
                low, high = sorted((up[a], up[b]))
                up = {i: low if u == high else u for i, u in up.items()}
    kept = {i for i in kept if up[i] == i}
    library = Tokenizer.from_file(registered.tokenizer_path())
    before = written()
    pieces = corpus_pipeline.run(spark, DIR)
    assert len(written() - before) == 1  # the intermediate tables are gone
    got = {}
    for r in pieces.collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length))
    assert set(got) == kept
    for i, found in got.items():
        n = len(library.encode(rows[i].text, add_special_tokens=False).ids) + 1
        at = 0
        for start, length in sorted(found):
            assert start == at
            at += length
        assert at == n


@pytest.mark.parametrize("name", list(registered.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = registered.queries()[name](spark, DIR)
    found = con.sql(registered.oracle_sql()[name])
    assert sorted(df.columns) == sorted(found.columns)
    assert sorted(map(str, map(tuple, df.select(*found.columns).collect()))) == sorted(map(str, found.fetchall()))
