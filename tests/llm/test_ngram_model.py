"""The sharded n-gram model against a brute-force Kneser-Ney, and what folding characters would not see."""

import math
import random
from collections import Counter

import pytest

from statloom.llm import ngram_model, quality


def brute(texts, order):
    """(probability of the last symbol of an n-gram) of interpolated modified Kneser-Ney over lists of symbols."""
    grams = [tuple(([None] * (order - 1) + list(t))[i : i + order]) for t in texts for i in range(len(t))]
    counts = {order: Counter(grams)}
    for o in range(order - 1, 0, -1):
        counts[o] = Counter(g[1:] for g in counts[o + 1])
    cuts = {}
    for o, found in counts.items():
        n = [max(1, sum(v == i for v in found.values())) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1])
        cuts[o] = [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), i - 0.05) for i in (1, 2, 3)]

    def p(g):
        if not g:
            return 1 / (len(counts[1]) + 1)
        own = counts[len(g)]
        ctx = {h: c for h, c in own.items() if h[:-1] == g[:-1]}
        if not ctx:
            return p(g[1:])
        less = {h: cuts[len(g)][min(c, 3) - 1] for h, c in ctx.items()}
        return (ctx[g] - less[g] if g in ctx else 0) / sum(ctx.values()) + sum(less.values()) / sum(ctx.values()) * p(g[1:])

    return p


@pytest.mark.parametrize("chunk", [4_000_000, 11])
def test_scores_match_brute_force(spark, monkeypatch, chunk):
    """Trusted texts are scored by the other fold's model, others by the mean of both; blocks and chunks change nothing."""
    monkeypatch.setattr(ngram_model, "BLOCK_CHARS", 60)
    monkeypatch.setattr(ngram_model, "CHUNK", chunk)
    monkeypatch.setattr(ngram_model, "HELD_ROWS", 50)
    monkeypatch.setattr(ngram_model, "SLICE_BYTES", 25)
    learned = ["the cat sat on the mat", "the cat ate the rat", "a cat \U0001f600 \U0001f600", "ÄÖÜ äöü ÄÖ", "a rat sat", "the mat", "the cat sat on the mat"]
    asked = ["the cat", "", None, "zzz \U0001f601", "ÄÖÜ the the the", "x", "mat " * 30, "".join(chr(0x4E00 + i) for i in range(400)), "\x00\x01 \x00"]
    rows = list(enumerate(learned)) + [(100 + i, t) for i, t in enumerate(asked)] + [(None, "the cat")]
    df = spark.createDataFrame([(i, t, None, "c") for i, t in rows], "doc_id long, text string, lang string, block string").repartition(2)
    cols = df.columns
    held = ngram_model.blocks(df, "doc_id", "text")
    good = ngram_model.trusted_places(held, spark.createDataFrame([(i,) for i in [*range(len(learned)), 999]], "t long"))
    questions = ngram_model.questions(held, good, "doc_id", "text", cols)
    found = ngram_model.scores(held, questions, ngram_model.answers(questions), good, "doc_id", "text", "lang", cols, "bigint")
    got = {r.doc_id: r for r in found.collect()}
    assert len(got) == len(rows) and got[101].log_ppl is None and got[102].log_ppl is None
    folds = [[t for i, t in enumerate(learned) if ngram_model.fold_of(i) == f] for f in (0, 1)]
    assert all(folds)
    p, o = [brute(texts, ngram_model.ORDER) for texts in folds], ngram_model.ORDER
    for i, t in rows:
        if t:
            flat = [None] * (o - 1) + list(t)
            grams = [tuple(flat[j : j + o]) for j in range(len(t))]
            by = [-sum(math.log(q(g)) for g in grams) / len(t) for q in p]
            trusted = i is not None and i < 100
            want = by[1 - ngram_model.fold_of(i)] if trusted else sum(by) / 2
            assert got[i].chars == len(t) and got[i].good == trusted and got[i].log_ppl == pytest.approx(want, abs=2e-6)
            assert got[i].fresh == pytest.approx(len(set(grams)) / len(t))
    parts = held.select("block", "seq").collect()
    assert len({r.block for r in parts}) > 2 and any(r.seq for r in parts)


def test_one_trusted_text_and_none(spark):
    """With one fold empty both models learn from all; without trusted text every text is as likely."""
    df = spark.createDataFrame([(1, "the cat sat", "en"), (2, "the cat", "en"), (3, "", "en")], "doc_id long, text string, lang string")
    for ids in ([1], []):
        held = ngram_model.blocks(df, "doc_id", "text")
        good = ngram_model.trusted_places(held, spark.createDataFrame([(i,) for i in ids], "t long"))
        questions = ngram_model.questions(held, good, "doc_id", "text", df.columns)
        found = ngram_model.scores(held, questions, ngram_model.answers(questions), good, "doc_id", "text", "lang", df.columns, "bigint")
        got = {r.doc_id: r.log_ppl for r in found.collect()}
        want = brute(["the cat sat"], ngram_model.ORDER) if ids else lambda g: 1.0
        grams = [tuple(([None] * 4 + list("the cat"))[j : j + 5]) for j in range(7)]
        assert got[2] == pytest.approx(-sum(math.log(want(g)) for g in grams) / 7, abs=2e-6) and got[3] is None


def test_rows_come_back_whole(spark):
    """Kept rows keep all their columns, whatever their names and types."""
    rows = [(i, f"text {i}" * i, "en", {"a": i}, [(i, None)], b"x") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, block map<string,long>, seq array<struct<pos:long,payload:string>>, c0 binary")
    held = ngram_model.blocks(df.repartition(3), "doc_id", "text")
    kept = ngram_model.trusted_places(held, spark.createDataFrame([(i,) for i in range(0, 20, 3)], "t long"))
    got = ngram_model.rows_at(held, kept, df.schema)
    assert got.schema == df.schema
    assert sorted(map(str, got.collect())) == sorted(str(r) for r in df.collect() if r.doc_id % 3 == 0)


def test_other_scripts_are_told_apart(spark):
    """Words of a non-Latin script are kept and random letters of it rejected; the model grows with the texts."""
    r = random.Random(7)
    letters = [chr(c) for c in range(0x430, 0x450)]
    words = ["".join(r.choice(letters) for _ in range(r.randint(3, 8))) for _ in range(60)]
    prose = lambda: " ".join(r.choice(words) for _ in range(80))
    noise = lambda: " ".join("".join(r.choice(letters) for _ in range(r.randint(3, 8))) for _ in range(80))
    rows = [(i, prose(), "ru") for i in range(120)] + [(1000 + i, noise(), "ru") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, quality int")
    got = {x.doc_id: x.kept for x in quality.classify(docs, labels).collect()}
    assert not any(k for i, k in got.items() if i >= 1000)
    assert sum(k for i, k in got.items() if i < 120) >= 117
