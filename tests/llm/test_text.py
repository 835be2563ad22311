"""Language identification, quality, HTML extraction, URL filter and chat formatting."""

import hashlib
import math
import os
import random
import time
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.llm import chat, html_text, lang_id, quality, url_filter

WORDS = {"aa": ["the", "and", "ing", "wh", "tion"], "bb": ["der", "und", "sch", "ung", "ß"], "cc": ["le", "eau", "que", "ç", "é"]}


def prose(r, lang, n):
    return " ".join("".join(r.choice(WORDS[lang]) for _ in range(r.randint(1, 3))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(1)
    rows = [(i, prose(r, lang, r.randint(5, 60)), lang, "extra", 1.0) for i in range(240) for lang in [list(WORDS)[i % 3]]]
    rows += [(900, None, "aa", "x", None), (901, "", None, "x", None), (902, "123 !!", "bb", "x", None), (None, "the and", "aa", "x", None), (903, prose(r, "aa", 9000), "aa", "x", 1.0), (5, rows[5][1], "zz", "x", 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, held_out string, score double"), rows


def test_language(spark, labelled):
    df, rows = labelled
    model = lang_id.learn(df)
    got = lang_id.identify(df.repartition(3), model).collect()
    assert len(got) == len(rows)
    right = total = 0
    truth = {i: lang for i, _, lang, *_ in rows if i is not None and i < 900}
    for r in got:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
        if r.held_out and r.doc_id in truth and r.doc_id < 240:
            total += 1
            right += r.lang_pred == truth[r.doc_id] or r.doc_id == 5
    assert right / total > 0.95
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and by_id[903].lang_pred == "aa"
    kept = lang_id.confident_rows(df, model)
    assert kept.columns == df.columns and {900, 901, 902}.isdisjoint(r.doc_id for r in kept.collect()) and kept.count() >= 240


def test_language_learns_only_from_its_part(spark, labelled):
    df, _ = labelled
    a = lang_id.learn(df)
    poisoned = df.withColumn("lang", __import__("pyspark.sql.functions", fromlist=["x"]).expr("CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2 THEN 'poison' ELSE lang END"))
    b = lang_id.learn(poisoned)
    assert a.langs == b.langs and all((a.net.p[k] == b.net.p[k]).all() for k in a.net.p)


def test_language_windows_come_from_the_whole_excerpt(spark):
    """Texts that begin with a long shared passage still teach their languages."""
    assert all(lang_id.spread(i, 40, 16).sum() == 16 and lang_id.spread(i, 40, 16)[20:].any() for i in range(50))
    assert lang_id.spread(1, 3, 16).all()
    r = random.Random(9)
    shared = prose(r, "cc", 400)[:1100]
    rows = [(i, shared + prose(r, lang, 250), lang) for i in range(120) for lang in [("aa", "bb")[i % 2]]]
    model = lang_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    fresh = [(prose(r, lang, 40), lang) for lang in ("aa", "bb") * 10]
    assert sum(p == lang for p, (_, lang) in zip(model.predict([t for t, _ in fresh])[0], fresh, strict=True)) >= 18


def test_language_learns_from_whole_texts(spark):
    """What tells the languages apart may come late in long texts, and repeated ids are learned from in one way."""
    r = random.Random(11)
    shared = prose(r, "cc", 3000)
    rows = [(i, shared[:9000] + prose(r, lang, 4000), lang) for i in range(80) for lang in [("aa", "bb")[i % 2]]]
    rows += [(0, "the other text of this id", "aa")]
    a, b = (lang_id.learn(spark.createDataFrame(x, "doc_id long, text string, lang string").repartition(3)) for x in (rows, rows[::-1]))
    assert all((a.net.p[k] == b.net.p[k]).all() for k in a.net.p)
    fresh = [(prose(r, lang, 40), lang) for lang in ("aa", "bb") * 10]
    assert sum(p == lang for p, (_, lang) in zip(a.predict([t for t, _ in fresh])[0], fresh, strict=True)) >= 18


def test_language_of_given_documents(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data here")
    docs = spark.read.parquet(path)
    found = lang_id.identify(docs, lang_id.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang_pred <> 'und'").collect()
    assert sum(x.lang_pred == x.lang for x in found) >= 0.99 * len(found)


def test_language_without_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = lang_id.learn(empty)
    assert lang_id.identify(empty, model).count() == 0
    one = spark.createDataFrame([(1, "the")], "doc_id long, text string")
    assert lang_id.identify(one, model).first().lang_pred == "und"


def test_gru_gradients():
    """Backpropagation through time against finite differences."""
    net = lang_id.ByteGru(3, seed=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(0)
    x, y = r.integers(97, 103, (6, 5)).astype(np.int16), r.integers(0, 3, 5)
    x[4:, 2] = lang_id.PAD

    def loss():
        p = net.probabilities(x)
        return -sum(math.log(p[t, y[j], j]) for t in range(6) for j in range(5) if x[t, j] != lang_id.PAD) / (x != lang_id.PAD).sum()

    grads = net.gradients(x, y)
    for k in ("out", "bias", "uf", "ub", "wf"):
        flat = net.p[k].reshape(-1)
        for at in r.choice(flat.size, 4) if k != "wf" else [int(x[0, 0]), int(x[1, 1]) + (lang_id.PAD + 1) * 17]:
            old = flat[at]
            flat[at] = old + 1e-2
            up = loss()
            flat[at] = old - 1e-2
            down = loss()
            flat[at] = old
            assert grads[k].reshape(-1)[at] == pytest.approx((up - down) / 2e-2, abs=2e-3)


def test_quality(spark):
    r = random.Random(2)
    rows = [(i, prose(r, "aa", r.randint(40, 120)), "aa") for i in range(300)]
    junk = [(1000 + i, "### " + " ".join("$%&" + w.upper() + "!!" for w in prose(r, "aa", 60).split()), "aa") for i in range(20)]
    odd = [(2000, None, "aa"), (2001, "", "aa"), (2002, prose(r, "aa", 50), None), (None, prose(r, "aa", 50), "aa"), (2003, prose(r, "aa", 20_000), "aa"), (3, rows[3][1], "aa")]
    docs = spark.createDataFrame([(*x, "low", 1) for x in rows + junk + odd], "doc_id long, text string, lang string, low string, b int")
    labels = spark.createDataFrame([(i, int(i is None or i < 1000), 0) for i in [*range(250), *range(1000, 1010), 7, 99_999, None]], "doc_id long, quality int, toxic int")
    got = {(x.doc_id, x.lang): x for x in quality.classify(docs, labels).collect()}
    assert sum(x.kept for (i, _), x in got.items() if i is not None and i < 300) >= 299
    assert not any(x.kept for (i, _), x in got.items() if i is not None and 1000 <= i < 2000)
    assert got[2000, "aa"].perplexity is None and not got[2000, "aa"].kept and not got[2001, "aa"].kept and got[2002, ""].kept
    kept = quality.accepted_rows(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(str(x.doc_id) for x in kept.collect()) == sorted(str(x.doc_id) for x in quality.classify(docs, labels).where("kept").collect())
    assert quality.classify(docs.limit(0), labels).count() == 0
    free = quality.classify(docs, labels.limit(0))
    assert free.where("NOT kept").count() == 2


def test_quality_judges_rare_languages(spark):
    """A language with few or no trusted texts has limits too, as has every length band."""
    r = random.Random(5)
    rows = [(i, prose(r, "aa", r.randint(40, 120)), "aa") for i in range(40)]
    rows += [(100 + i, prose(r, "aa", r.randint(40, 120)), "rare") for i in range(10)]
    junk = [(1000 + i, " ".join("$%&" + w.upper() + "!!" for w in prose(r, "aa", n).split()), lang) for i, (lang, n) in enumerate((x, n) for x in ("aa", "rare", "none", None) for n in (60, 2000))]
    docs = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in [*range(40), *range(100, 103)]], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality.classify(docs, labels).collect()}
    assert all(x.low is not None and x.high is not None for x in got.values())
    assert not any(x.kept for i, x in got.items() if i >= 1000)
    assert sum(x.kept for i, x in got.items() if i < 1000) >= 49


def test_quality_sees_repetition(spark):
    """Texts that repeat one usual word are rejected, though each of its characters is likely."""
    r = random.Random(6)
    rows = [(i, prose(r, "aa", r.randint(40, 120)), "aa") for i in range(120)]
    words = [w for _, t, _ in rows[:10] for w in t.split()[3:4]]
    docs = spark.createDataFrame(rows + [(1000 + i, " ".join([w] * 90), "aa") for i, w in enumerate(words)], "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in quality.classify(docs, spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, quality int")).collect()}
    assert not any(x.kept for i, x in got.items() if i >= 1000)
    assert any(x.low <= x.perplexity <= x.high for i, x in got.items() if i >= 1000)
    assert sum(x.kept for i, x in got.items() if i < 1000) >= 117


def test_quality_of_given_documents(spark):
    """Labelled junk goes, labelled good texts stay, and texts that repeat one usual word go in every language."""
    path = "/root/testdata/sf0.1"
    if not os.path.isdir(path):
        pytest.skip("no test data here")
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet").select(*c) for t, c in (("documents", ("doc_id", "text", "lang")), ("labels", ("doc_id", "quality"))))
    words = {}
    for r in docs.where("length(text) > 500").limit(400).collect():
        words.setdefault(r.lang, []).append(r.text.split()[2])
    repeated = [(-1 - 100 * k - i, " ".join([w] * n), lang) for k, lang in enumerate(sorted(words)) for i, (w, n) in enumerate(zip(words[lang], [20, 60, 200, 1000] * 3, strict=False))]
    found = quality.classify(docs.unionByName(spark.createDataFrame(repeated, "doc_id long, text string, lang string")), labels)
    kept = {(r.quality): (r.n, r.kept) for r in found.join(labels.distinct(), "doc_id").groupBy("quality").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept")).collect()}
    assert kept[0][1] <= 0.02 * kept[0][0] and kept[1][1] >= 0.99 * kept[1][0]
    assert len(repeated) >= 40 and found.where("doc_id < 0 AND kept").count() == 0


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>
<div class="ad">Buy &amp; save.</div><article><h1>Head &lt;line&gt;</h1><p>One <b>bold</b>
 text<br>here. It goes on and on, as articles do.<p>Two &eacute;&nbsp;x is another longer paragraph of this article.</p><script>var x = "<p>no</p>";</script><!-- <p>no</p> --></article><footer>&copy; me</footer></body></html>"""


def test_html(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "<p>"), (1, "u", PAGE), (4, "u", "plain text without a tag"), (5, "u", "<article>" + "<p>A paragraph of prose, once more.</p>" * 5000 + "</article>"), (6, "u", "<<<>>> <p <b> </ <div class='"), (7, "u", "<script>never closed")]
    df = spark.createDataFrame([(*x, "text", 3) for x in rows], "page_id long, url string, html string, text string, n_chars int")
    got = html_text.extract(df.repartition(2)).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by_id = {r.page_id: r.text for r in got}
    assert by_id[1] == "Head <line>\n\nOne bold text here. It goes on and on, as articles do.\n\nTwo é x is another longer paragraph of this article."
    assert by_id[2] == by_id[3] == by_id[7] == "" and by_id[5].count("\n\n") == 4999
    assert html_text.extract(df.limit(0)).count() == 0
    assert html_text.extract(df.where("page_id = 1"), with_blocks=True).first().labels[0].block == "Home"


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ('<p>One <a href="x>link</a> two</p>', ["One link two"]),
        ('<a href="x>l</a> <b class="y">k</b>', ["l k"]),
        ("a<![CDATA[x > y]]>b", ["ab"]),
        ("<!doctype html><?xml v?>z<!-- x > --> w", ["z w"]),
        ("1 < 2 <3 x <d", ["1 < 2 <3 x"]),
        ("<p <b>x</b>", ["x"]),
        ("<p title=\"a > b\" x='<i>'>in</p>", ["in"]),
        ("<script>if(a<b){'</p>'}</script >after", ["after"]),
        ("<!-- never closed <p>x</p>", []),
        ("</ x>k</>m</div>", ["km"]),
    ],
)
def test_broken_markup_is_no_text(page, texts):
    assert [b[1] for b in html_text.blocks(page)] == texts


@pytest.mark.parametrize("unit", ["<b ", "<div>", "<div>x", '<b a="', "<a b='", "</p>", "<script>", "<![CDATA[", "<", "<p>x"])
def test_reading_takes_linear_time(unit):
    start = time.process_time()
    html_text.blocks(unit * (1_000_000 // len(unit)))
    assert time.process_time() - start < 2


class Reader(HTMLParser):
    """An independent reader of pages whose article is an <article>: its blocks, without nested menus and adverts."""

    BREAKS = {"p", "h1", "h2", "h3", "h4", "li", "ul", "ol", "div", "blockquote", "article", "section", "table", "tr", "td", "figure", "figcaption", "pre", "nav", "footer", "header", "aside"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside = self.skipped = 0
        self.parts, self.held = [], []

    def end(self):
        text = " ".join("".join(self.held).split())
        if text:
            self.parts.append(text)
        self.held = []

    def handle_starttag(self, tag, attrs):
        if tag in self.BREAKS:
            self.end()
        self.inside += tag == "article"
        self.skipped += tag in ("script", "style", "nav", "aside", "footer")
        if tag == "br":
            self.held.append(" ")

    def handle_endtag(self, tag):
        if tag in self.BREAKS:
            self.end()
        self.inside -= tag == "article"
        self.skipped -= tag in ("script", "style", "nav", "aside", "footer")

    def handle_data(self, data):
        if self.inside and not self.skipped:
            self.held.append(data)


def test_given_pages_against_an_independent_reader(spark):
    path = "/root/testdata/sf0.001/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data here")
    pages = spark.read.parquet(path)
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        reader = Reader()
        reader.feed(r.html or "")
        reader.close()
        reader.end()
        assert got[r.page_id] == "\n\n".join(reader.parts)


def test_html_held_out_accuracy():
    net, r = html_text.trained(), random.Random(4321)
    wrong = total = 0
    for _ in range(200):
        page, labels = html_text.training_page(r)
        found = html_text.blocks(page)
        assert len(found) == len(labels)
        if found:
            wrong += int(((html_text.label_pages(net, [found])[0] >= 0.5) != np.array(labels)).sum())
            total += len(labels)
    assert wrong / total < 0.02


def test_lstm_gradients():
    net = html_text.BlockLstm(seed=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(1)
    x, real = r.normal(0, 1, (5, 4, html_text.WIDTH)), np.ones((5, 4))
    real[3:, 1] = 0
    y = r.integers(0, 2, (5, 4)).astype(float)

    def loss():
        p = net.probabilities(x, real)
        return -((y * np.log(p) + (1 - y) * np.log(1 - p)) * real).sum() / real.sum()

    grads = net.gradients(x, real, y)
    for k in net.p:
        flat = net.p[k].reshape(-1)
        for at in r.choice(flat.size, min(4, flat.size)):
            old = flat[at]
            flat[at] = old + 1e-2
            up = loss()
            flat[at] = old - 1e-2
            down = loss()
            flat[at] = old
            assert grads[k].reshape(-1)[at] == pytest.approx((up - down) / 2e-2, abs=2e-3)


def test_url_filter(spark):
    urls = ["http://A.org/x", "https://www.example.org/es/1?q", "http://m.example.org/en/1#t", "http://b.com/fr/", "http://b.com/de/x", "http://b.com/it", "http://org", "ftp://x.net", None, "no scheme/org/", "http://x.cheap-pills.example.com/it/1", "http://bad.net/page/", "http://bad.net/page/2", "http://sub.bad.net/page", "HTTP://BAD.net/page?x=1", "://", "http://notorg/x", "http://É.org/a"]
    rows = [(i, u, "h", "c") for i, u in enumerate(urls)] + [(None, urls[0], "h", "c"), (0, urls[0], "h", "c"), (77, "http://bad.net/" + "p" * 200_000, "h", "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, block string")
    listed = spark.createDataFrame([(x,) for x in ["bad.net/page", "cheap-pills.example.com", None, "bad.net/page"]], "u string")
    for limit in (16_000_000, 0):
        got = url_filter.url_filter(df.repartition(3), listed, broadcast_bytes=limit).collect()
        assert len(got) == len(rows)
        by_id = {r.page_id: r for r in got}
        verdicts = [by_id[i].verdict for i in range(len(urls))]
        assert verdicts == ["allow", "block", "block", "allow", "block", "allow", "allow", "allow", "allow", "allow", "block", "block", "allow", "allow", "block", "allow", "allow", "allow"]
        assert [by_id[i].rule for i in range(5)] == ["org/", "example.org/es/", "example.org/en/1", "com/fr/", "com/de/"]
        assert (by_id[8].host, by_id[8].path, by_id[6].path, by_id[14].host) == ("", "", "", "bad.net")
    assert url_filter.url_filter(df.limit(0), listed).count() == 0
    none = url_filter.url_filter(df, listed.limit(0))
    assert none.where("verdict = 'block' AND rule IS NULL").count() == 0


def test_bloom_filter_has_no_false_negatives(spark):
    from pyspark.sql import functions as F

    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("c"))
    blocks = 200
    bloom = url_filter.bloom_filter(keys, blocks, 6)

    def passing(c):
        q = c.select(url_filter._block(F.col("c"), blocks).alias("block"), *(m.alias(f"q{i}") for i, m in enumerate(url_filter._bits(F.col("c"), 6))))
        joined = q.join(bloom, "block")
        for i in range(4):
            joined = joined.where(F.col(f"m{i}").bitwiseAND(F.col(f"q{i}")) == F.col(f"q{i}"))
        return joined.count()

    assert passing(keys) == 3000
    assert passing(spark.range(3000).select(F.concat(F.lit("other"), "id").alias("c"))) < 90


def test_chat(spark):
    turns = [(1, 1, "assistant", "b & <|end|>\n[x] &lt;"), (1, 0, "user", "hi"), (2, 0, "system", None), (2, 1, None, "x"), (2, 1, None, "x"), (2, None, "assistant", ""), (3, 0, "assistant", "l" * 300_000), (None, 0, "user", "no id"), (4, 0, "us<|body|>er", "é🙂")]
    df = spark.createDataFrame([(*t, "z", 1) for t in turns], "conv_id long, turn long, role string, text string, formatted string, pos int")
    got = {r.conv_id: r for r in chat.read_chat(chat.format_chat(df.repartition(3))).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for conv in got:
        mine = sorted(((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in turns if t[0] == conv))
        said = "".join(f"{role}\n{text}\n" for *_, role, text in mine)
        loss = "".join(text for *_, role, text in mine if role == "assistant")
        r = got[conv]
        assert r.n_turns == len(mine) and r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_chat(chat.format_chat(df.limit(0))).count() == 0


def test_chat_parts(spark):
    parts = [("text", "see <this>", None, None), ("image", None, "a.png", 3.0), ("audio", None, "b.wav", 2.5), ("text", "end", None, None), ("document", None, "c.pdf", None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [("text", "ok", None, None), ("image", None, "d.png", 1.0)]), (1, 2, "user", None)], f"conv_id long, turn int, role string, content array<{chat.PART}>")
    r = chat.format_chat(df, content_col="content").first()
    assert "see &lt;this><|image|><|audio|>end<|document|>" in r.formatted
    assert [(a.turn, a.part, a.kind, a.ref, a.tokens) for a in r.attachments] == [(1, 1, "image", "a.png", 768), (1, 2, "audio", "b.wav", 63), (1, 4, "document", "c.pdf", 512), (2, 1, "image", "d.png", 256)]
    assert r.expanded_tokens == 768 + 63 + 512 + 256
    odd = [("video", "cap", "v.mp4", 2.0), ("image", None, "n.png", -3.0), (None, "plain", None, None)]
    o = chat.format_chat(spark.createDataFrame([(1, 0, "user", odd)], f"conv_id long, turn int, role string, content array<{chat.PART}>"), content_col="content").first()
    assert "<|attachment|><|image|>plain" in o.formatted and [(a.kind, a.ref, a.tokens) for a in o.attachments] == [("video", "v.mp4", 0), ("image", "n.png", 0)]
    span = r.turns[1]
    assert r.formatted[span.loss_start : span.loss_start + span.loss_len] == "ok<|image|>"
