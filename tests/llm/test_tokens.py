"""BPE against the tokenizers library, and packing invariants."""

import hashlib
import json
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

from statloom.llm import bpe, packing  # noqa: E402

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    with open(PATH, "rb") as f:
        return bpe.Bpe(f.read())


def ids(b):
    return np.frombuffer(b, "<u4").tolist()


def mixed(n, seed=2):
    r = random.Random(seed)
    out = ["", " ", "a" * 300, "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "\x1c \x85 ", "🙂" * 30, "aAaA" * 40]
    for _ in range(n):
        parts = r.choice([list("aA e"), list("theinrsa.,'\"!-="), list(" \t\n\r\x0b\x1c\x85\xa0　ab1²Ⅷ½一"), ["'s", "'re", " ", "<|endoftext|>", "  ", "é", "ing", "###", "aaaa"], [chr(c) for c in range(0x20, 0x2FFF, 37)]])
        out.append("".join(r.choice(parts) for _ in range(r.randint(0, 40))))
    return out


def test_equal_to_the_library(library, own):
    texts = mixed(3000)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [ids(b) for b in own.encode_batch(texts)] == want
    with open(PATH, "rb") as f:
        encoders = packing.encoder(f.read())
    assert [packing.encode(encoders, t).tolist() for t in texts] == want
    assert [own.decode(np.array(w, "<u4").tobytes()) for w in want] == [library.decode(w, skip_special_tokens=False) for w in want]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    own = bpe.load(open(PATH, "rb").read())
    library = Tokenizer.from_file(PATH)
    got = own.encode_batch([text])[0]
    assert ids(got) == library.encode(text, add_special_tokens=False).ids
    assert own.decode(got) == text


def test_verification_is_what_finds_errors(own):
    """Words whose greedy guess differs from exact merging are exactly those with a crossing merge."""
    r = random.Random(3)
    differ = 0
    for _ in range(800):
        word = "".join(r.choice("theinrsaoulgq") for _ in range(r.randint(2, 14))).encode()
        guess = own.greedy(word)
        a, b = np.array(guess[:-1], np.int64), np.array(guess[1:], np.int64)
        crossed = bool(len(a)) and bool((own.crossing(a, b) < bpe.FAR).any())
        assert crossed == (guess != own.merge(word))
        differ += crossed
    assert differ > 20


def test_long_words_and_texts(own, library, monkeypatch):
    word = "".join(random.Random(4).choice("theinrs") for _ in range(4000))
    assert own.merge(word.encode()) == library.encode(word, add_special_tokens=False).ids
    monkeypatch.setattr(bpe, "LONG_TEXT", 50)
    monkeypatch.setattr(bpe, "RUN", 7)
    for t in mixed(200, 5) + ["the  cat \n\n sat " * 50]:
        assert ids(own.encode_batch([t])[0]) == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"decoder": None}, {"model": {"byte_fallback": True}}, {"added": {"lstrip": True}}])
def test_other_rules_are_refused(change):
    with open(PATH) as f:
        spec = json.load(f)
    bpe.check_spec(spec)
    spec["model"] |= change.pop("model", {})
    spec["added_tokens"][0] |= change.pop("added", {})
    with pytest.raises(ValueError):
        bpe.check_spec(spec | change)


def test_cache_is_bounded(own, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 10)
    texts = mixed(50, 6)
    assert own.encode_batch(texts) == own.encode_batch(texts)


SCHEMA = "doc_id long, text string, ids int, n_tokens string, start string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", None) for i, t in rows], SCHEMA)


def test_operator(spark, library):
    rows = [(1, "the cat"), (2, None), (3, ""), (None, "x<|endoftext|>"), (1, "the cat"), (4, "long " * 50_000)]
    got = bpe.encode_decode(frame(spark, rows).repartition(3), PATH, with_ids=True).collect()
    assert len(got) == len(rows)
    for r in got:
        want = library.encode(r.decoded, add_special_tokens=False).ids
        assert r.ids == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert sorted(r.decoded for r in got) == sorted(t or "" for _, t in rows)
    assert bpe.encode_decode(frame(spark, []), PATH).collect() == []


def check_packing(rows, got, library, window=1024):
    """Every id of every document lies in exactly one piece; windows are gapless and at most full."""
    wanted = sorted(([*library.encode(t or "", add_special_tokens=False).ids, 0] for _, t in rows), key=len)
    pieces = {}
    for r in got:
        assert 1 <= r.length <= window
        pieces.setdefault((str(r.doc_id), r.doc_tokens), []).append(r)
    assert sum(r.length for r in got) == sum(map(len, wanted))
    by_id = {}
    for i, t in rows:
        by_id.setdefault(str(i), []).append(np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4"))
    for (doc, n), ps in pieces.items():
        texts = [a for a in by_id[doc] if len(a) == n]
        ps.sort(key=lambda r: r.start)
        if len(texts) == 1:
            assert [p.start for p in ps] == np.cumsum([0, *(p.length for p in ps[:-1])]).tolist() and sum(p.length for p in ps) == n
        for p in ps:
            assert p.ids_crc32 in {zlib.crc32(a[p.start : p.start + p.length].tobytes()) for a in texts}
    windows = {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    fills = []
    for w in windows.values():
        at = 0
        for offset, n in sorted(w):
            assert offset == at
            at += n
        fills.append(at)
        assert at <= window
    return fills


def test_packing(spark, library):
    r = random.Random(7)
    rows = [(i, " ".join(r.choice(["the", "cat", "sat", "on", "mats"]) for _ in range(r.choice([0, 5, 60, 400, 900, 3000])))) for i in range(120)]
    rows += [(500, None), (501, ""), (None, "no id here"), (7, "repeated"), (7, "repeated"), (502, "word " * 60_000)]
    got = packing.pack(frame(spark, rows).repartition(9), PATH, merge_width=3).collect()
    fills = check_packing(rows, got, library)
    assert sum(f < 1024 for f in fills) <= 1
    assert packing.pack(frame(spark, []), PATH).collect() == []
    assert [r.length for r in packing.pack(frame(spark, [(1, "")]), PATH).collect()] == [1]


def test_packer_bounds():
    p = packing.Packer(10, 3, 0)
    for n in [3, 9, 25, 4, 7, 7, 7, 2, 10]:
        p.add(n, 0, np.arange(n, dtype="<u4"), n)
        assert len(p.open) <= 3 and all(0 < fill < 10 for fill, _ in p.open)
    assert all(sum(r[2] for r in p.out if r[5] == s) == 10 for s in {r[5] for r in p.out})
