"""Byte-level BPE: speculate with greedy longest match, verify neighbouring pairs, merge exactly only where that fails.

A sequence of tokens is the BPE result of a word exactly if each token is the result of its own bytes and no merge ever
crosses the border of two neighbours. While the left token is built, its last symbol runs through the right spine of
its merge tree; the right token's first symbol runs through its left spine. A crossing merge of spine symbols x and y
happens if its rank comes before the merge that ends x and not after the one that ends y (of equal pairs the leftmost
goes first). `Bpe.crossing` tests that for arrays of pairs at once.

Defined results: a null text counts as empty and has no ids; special tokens in a text become their ids as in the
tokenizers library; a word of any length is encoded whole, and a very long text piece by piece with the same ids; rows
that repeat are encoded each; an empty table gives no rows; further columns are ignored. A file with rules that byte-level
BPE doesn't have (normalizer, prefix space, other splitting, flags of added tokens) raises ValueError.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import arrow_map

#: The split pattern of byte-level pre-tokenisers (a fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept in a worker's cache, and the largest word in bytes that is kept.
CACHE_WORDS, CACHE_BYTES = 400_000, 64
FAR = np.iinfo(np.int64).max
#: Texts above this many characters are split into words piece by piece.
LONG_TEXT, RUN = 1_000_000, 100_000
#: Words up to this many bytes are merged by scanning; the heap is for longer ones.
SHORT_WORD, ID_MASK = 48, (1 << 32) - 1


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for bytes."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def check_spec(spec: dict) -> None:
    """Raise ValueError for a file whose rules this encoder doesn't have, rather than encode it wrongly."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    wrong = [f"model {model.get('type')}"] * (model.get("type", "BPE") != "BPE")
    wrong += [f"model.{k}" for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    wrong += ["normalizer"] * bool(spec.get("normalizer"))
    wrong += ["pre_tokenizer"] * (split.get("type") != "ByteLevel" or bool(split.get("add_prefix_space")) or split.get("use_regex") is False)
    wrong += ["decoder"] * ((spec.get("decoder") or {}).get("type") != "ByteLevel")
    wrong += [f"added token {t['content']!r}" for t in spec.get("added_tokens", ()) if any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized"))]
    if wrong:
        raise ValueError(f"not a plain byte-level BPE file: {', '.join(wrong)}")


class Bpe:
    """Encoder and decoder for one tokenizers JSON file, given as bytes."""

    def __init__(self, spec: bytes):
        spec = json.loads(spec)
        check_spec(spec)
        alphabet = byte_alphabet()
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        as_bytes = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items() if t not in self.special}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.pieces = [as_bytes.get(i, b"") for i in range(size)]
        for content, i in self.special.items():
            self.pieces[i] = content.encode()
        self.ids = {b: i for i, b in as_bytes.items()}
        self.left, self.right, self.rank = (np.full(size + 1, v, np.int64) for v in (-1, -1, FAR))
        merged: list[int] = []
        #: The code of a pair that merges is rank << 32 | new id.
        self.codes: dict[int, int] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            x, y = m.split(" ") if isinstance(m, str) else m
            a, b, made = vocab[x], vocab[y], vocab[x + y]
            merged.append(a * size + b)
            self.codes[a * size + b] = r << 32 | made
            if self.rank[made] == FAR:
                self.left[made], self.right[made], self.rank[made] = a, b, r
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        keys = np.array(merged, np.int64)
        order = np.argsort(keys)
        self.size, self.keys = size, keys[order]
        self.ranks = np.arange(len(keys), dtype=np.int64)[order]
        made = np.flatnonzero(self.rank < FAR)
        self.sound = np.ones(size, bool)
        self.sound[made] = self.crossing(self.left[made], self.right[made]) == self.rank[made]
        for t in made[np.argsort(self.rank[made])]:
            self.sound[t] &= self.sound[self.left[t]] and self.sound[self.right[t]]
        longest: dict[bytes, int] = {}
        for b in self.ids:
            longest[b[:2]] = max(longest.get(b[:2], 0), len(b))
        self.longest = longest
        self.words = regex.compile(SPLIT)
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}

    def crossing(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the first merge that would cross the border between tokens a and b; FAR where there is none."""
        best = np.full(len(a), FAR, np.int64)
        x, x_ends = a, np.full(len(a), FAR, np.int64)
        while (x >= 0).any():
            y, y_ends = b, np.full(len(b), FAR, np.int64)
            while (y >= 0).any():
                key = x * self.size + y
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                rank = np.where((x >= 0) & (y >= 0) & (self.keys[at] == key), self.ranks[at], FAR)
                best = np.where((rank < x_ends) & (rank <= y_ends), np.minimum(best, rank), best)
                y, y_ends = np.where(y >= 0, self.left[y], -1), np.where(y >= 0, self.rank[y], FAR)
            x, x_ends = np.where(x >= 0, self.right[x], -1), np.where(x >= 0, self.rank[x], FAR)
        return best

    def greedy(self, word: bytes) -> list[int]:
        ids, longest, at, n, out = self.ids, self.longest, 0, len(word), []
        while at < n:
            end = min(n, at + longest.get(word[at : at + 2], 1))
            while end > at + 1 and word[at:end] not in ids:
                end -= 1
            out.append(ids[word[at:end]])
            at = end
        return out

    def merge(self, word: bytes) -> list[int]:
        """The exact result of one word: short words by scanning a list of pair codes, long ones by a heap."""
        if len(word) > SHORT_WORD:
            return self._merge_long(word)
        code, size = self.codes.get, self.size
        ids = [self.byte_ids[c] for c in word]
        pairs = [code(a * size + b, FAR) for a, b in zip(ids, ids[1:])]  # noqa: B905
        while pairs and (best := min(pairs)) != FAR:
            i = pairs.index(best)
            ids[i] = best & ID_MASK
            del ids[i + 1], pairs[i]
            if i:
                pairs[i - 1] = code(ids[i - 1] * size + ids[i], FAR)
            if i < len(pairs):
                pairs[i] = code(ids[i] * size + ids[i + 1], FAR)
        return ids

    def _merge_long(self, word: bytes) -> list[int]:
        code, size = self.codes.get, self.size
        ids = [self.byte_ids[c] for c in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(c, i) for i in range(n - 1) if (c := code(ids[i] * size + ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            found, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or code(ids[i] * size + ids[j]) != found:
                continue
            ids[i], ids[j], after[i] = found & ID_MASK, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if c := code(ids[i] * size + ids[after[i]]):
                    heapq.heappush(heap, (c, i))
            if before[i] >= 0 and (c := code(ids[before[i]] * size + ids[i])):
                heapq.heappush(heap, (c, before[i]))
        return [i for i in ids if i >= 0]

    def encode_words(self, words: list[str]) -> list[bytes]:
        raw = [w.encode() for w in words]
        guess = [[one] if (one := self.ids.get(b)) is not None else self.greedy(b) for b in raw]
        sizes = np.fromiter(map(len, guess), np.int64, len(guess))
        flat = np.fromiter((i for g in guess for i in g), np.int64, int(sizes.sum()))
        of = np.repeat(np.arange(len(guess)), sizes)
        bad = np.zeros(len(guess), bool)
        bad[of[~self.sound[flat]]] = True
        inner = np.flatnonzero(of[:-1] == of[1:])
        keys, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        crossed = self.crossing(keys // self.size, keys % self.size) < FAR
        bad[of[inner[crossed[back]]]] = True
        packed = flat.astype("<u4").tobytes()
        ends = (np.cumsum(sizes) * 4).tolist()
        out = [packed[e - 4 * n : e] for e, n in zip(ends, sizes.tolist(), strict=True)]
        for i in np.flatnonzero(bad).tolist():
            out[i] = np.array(self.merge(raw[i]), "<u4").tobytes()
        return out

    def _plain(self, texts: list[str]) -> list[bytes]:
        words = [self.words.findall(t) for t in texts]
        needed = set().union(*words) if words else set()
        if len(self.cache) > CACHE_WORDS:
            self.cache = {}
        known = self._known(needed)
        return [b"".join([known[w] for w in ws]) for ws in words]

    def _known(self, words: set[str]) -> dict[str, bytes]:
        """Ids of at least these words. Short words stay in the cache, which is emptied between batches only."""
        missing = list(words.difference(self.cache))
        fresh = dict(zip(missing, self.encode_words(missing), strict=True)) if missing else {}
        long = {w: b for w, b in fresh.items() if len(w) > CACHE_BYTES}
        self.cache.update(fresh)
        if not long:
            return self.cache
        for w in long:
            del self.cache[w]
        return {**self.cache, **long}

    def _long(self, text: str) -> bytes:
        """A very long text in runs of words; the pattern itself finds the same words in any case."""
        out, run = [], []
        for m in self.words.finditer(text):
            run.append(m[0])
            if len(run) >= RUN:
                out.append(self._join(run))
                run = []
        return b"".join([*out, self._join(run)])

    def _join(self, words: list[str]) -> bytes:
        known = self._known(set(words))
        return b"".join([known[w] for w in words])

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes | None] = [None] * len(texts)
        plain: list[int] = []
        for i, t in enumerate(texts):
            if not t:
                out[i] = b""
            elif (self.cut and self.cut.search(t)) or len(t) > LONG_TEXT:
                parts = self.cut.split(t) if self.cut else [t]
                out[i] = b"".join(np.array([self.special[p]], "<u4").tobytes() if p in self.special else self._long(p) for p in parts if p)
            else:
                plain.append(i)
        for i, b in zip(plain, self._plain([texts[i] for i in plain]), strict=True):
            out[i] = b
        return out

    def decode(self, ids: bytes) -> str:
        pieces = self.pieces
        return b"".join([pieces[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_loaded: dict[str, Bpe] = {}


def load(spec: bytes) -> Bpe:
    """One encoder for each worker process and vocabulary."""
    key = hashlib.sha256(spec).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Bpe(spec)
    return _loaded[key]


def encode_decode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with_ids adds ids (array<int>) and decoded (the text).

    tokenizer: path of a tokenizers JSON file, read by the driver and sent to the workers.
    """
    with open(tokenizer, "rb") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())

    def make():
        bpe = load(spec.value)

        def work(batch):
            ids = bpe.encode_batch(batch.column(1).to_pylist())
            decoded = [bpe.decode(b) for b in ids]
            return {
                "doc_id": batch.column(0),
                "n_tokens": [len(b) // 4 for b in ids],
                "ids_sha256": [hashlib.sha256(b).hexdigest() for b in ids],
                "decoded_sha256": [hashlib.sha256(d.encode()).hexdigest() for d in decoded],
                "ids": [np.frombuffer(b, "<i4") for b in ids] if with_ids else None,
                "decoded": decoded,
            }

        return work

    id_type = df.select(F.col(id_col)).schema[0].dataType.simpleString()
    schema = f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return arrow_map(df.select(F.col(id_col), F.col(text_col)), schema, make)
