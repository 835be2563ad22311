"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on the driver, on a bounded sample: `per_lang` labelled
documents of each language (one of each hash bucket of ids), and of the whole text of each at most `windows_each` windows of
WINDOW bytes, those with the least hash of id and place, so from all parts of the text; each language is then weighted to
the same number of windows, `most` at the most. Executors cut the windows, so no text reaches the driver. Every byte position gets language
probabilities from a forward and a backward GRU state; a document's probabilities are the mean over its positions.
Texts are read whole, in windows of WINDOW bytes that run through the network side by side; each window starts from the
zero state, so memory is one slice of texts whatever their length. Gates use the hard sigmoid.

Defined results: a null text or one without a letter is `und` with score 0; without any labelled document every text is
`und`; a null id is never learned from and not held out; of rows with one id and language the least text is learned from; equal
probabilities go to the first language by name; very long texts are read whole; rows repeat independently; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import arrow_map, cuts, shared_table, small_batches

WINDOW, STATE, PAD = 64, 8, 256
#: Windows that run side by side.
WIDE = 2048
LETTER = regex.compile(r"\p{L}")


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(WINDOW, n) byte codes, padded with PAD, and the number of windows of each text."""
    counts = np.array([-(-len(t) // WINDOW) for t in texts], np.int64)
    flat = np.full(int(counts.sum()) * WINDOW, PAD, np.int16)
    at = 0
    for t, c in zip(texts, counts.tolist(), strict=True):
        flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
        at += c * WINDOW
    return np.ascontiguousarray(flat.reshape(-1, WINDOW).T), counts


class ByteGru:
    """Two GRUs of STATE units and a softmax layer. Columns are windows; w, u, b stack update, reset and candidate."""

    def __init__(self, classes: int, seed: int = 1):
        r, h = np.random.default_rng(seed), STATE
        self.p = {"out": r.normal(0, 0.3, (classes, 2 * h)), "bias": np.zeros((classes, 1))}
        for d in "fb":
            self.p[f"w{d}"] = r.normal(0, 0.4, (3 * h, PAD + 1))
            self.p[f"u{d}"] = r.normal(0, 0.3, (3 * h, h))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def states(self, x: np.ndarray, d: str, keep: dict | None = None) -> np.ndarray:
        """(time, STATE, n) states of one direction; keep collects what backpropagation needs."""
        w, u, h = self.p[f"w{d}"], self.p[f"u{d}"], STATE
        n = x.shape[1]
        out = np.empty((len(x), h, n), np.float32)
        s, g, m, t1 = np.zeros((h, n), np.float32), np.empty((3 * h, n), np.float32), np.empty((3 * h, n), np.float32), np.empty((h, n), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            np.take(w, x[t], axis=1, out=g, mode="clip")
            np.matmul(u, s, out=m)
            gates, more = g[: 2 * h], m[: 2 * h]
            gates += more
            gates *= 0.25
            gates += 0.5
            np.clip(gates, 0, 1, out=gates)
            cand = g[2 * h :]
            np.multiply(g[h : 2 * h], m[2 * h :], out=t1)
            cand += t1
            np.tanh(cand, out=cand)
            if keep is not None:
                keep[t] = g.copy(), m[2 * h :].copy(), s.copy()
            np.subtract(s, cand, out=t1)
            t1 *= g[:h]
            np.add(cand, t1, out=out[t])
            s = out[t]
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(time, classes, n) for windows x (time, n)."""
        both = np.concatenate([self.states(x, "f"), self.states(x, "b")], axis=1)
        z = np.matmul(self.p["out"], both)
        z += self.p["bias"]
        np.exp(np.clip(z, -30, 30, out=z), out=z)
        z /= z.sum(axis=1, keepdims=True)
        return z

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Backpropagation through time of the mean cross-entropy over positions that hold a byte."""
        h, n = STATE, x.shape[1]
        keep: dict[str, dict] = {"f": {}, "b": {}}
        both = np.concatenate([self.states(x, d, keep[d]) for d in "fb"], axis=1)
        z = np.matmul(self.p["out"], both) + self.p["bias"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        z[:, y, np.arange(n)] -= 1
        z *= (x != PAD)[:, None, :] / max(1, (x != PAD).sum())
        grads = {"out": np.einsum("tcn,thn->ch", z, both), "bias": z.sum(axis=(0, 2))[:, None]}
        back = np.matmul(self.p["out"].T, z)
        for k, d in enumerate("fb"):
            u = self.p[f"u{d}"]
            gw, gu = np.zeros((PAD + 1, 3 * h), np.float32), np.zeros_like(u)
            ds = np.zeros((h, n), np.float32)
            for t in range(len(x) - 1, -1, -1) if d == "f" else range(len(x)):
                g, m, s = keep[d][t]
                ds += back[t, k * h : (k + 1) * h]
                zed, rst, cand = g[:h], g[h : 2 * h], g[2 * h :]
                dc = ds * (1 - zed) * (1 - cand * cand)
                dz = ds * (s - cand) * 0.25 * ((zed > 0) & (zed < 1))
                dr = dc * m * 0.25 * ((rst > 0) & (rst < 1))
                np.add.at(gw, x[t], np.concatenate([dz, dr, dc]).T)
                into = np.concatenate([dz, dr, dc * rst])
                gu += into @ s.T
                ds = ds * zed + u.T @ into
            grads[f"w{d}"], grads[f"u{d}"] = gw.T, gu
        return grads

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 240, batch: int = 256, rate: float = 0.02, seed: int = 2) -> None:
        r = np.random.default_rng(seed)
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            pick = r.integers(0, x.shape[1], min(batch, x.shape[1]))
            lr = rate * (1 - step / (steps + 1))
            for k, g in self.gradients(np.ascontiguousarray(x[:, pick]), y[pick]).items():
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.99 * m2[k] + 0.01 * g * g
                self.p[k] = (self.p[k] - lr * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)


class Labeller:
    """A trained network with its languages."""

    def __init__(self, langs: list[str], net: ByteGru | None):
        self.langs, self.net = langs, net

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        known = [i for i, t in enumerate(texts) if t and self.net and LETTER.search(t)]
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not known:
            return langs, scores
        raw = [texts[i].encode() for i in known]
        x, counts = windows(raw)
        sums = np.zeros((len(self.langs), x.shape[1]))
        for at in range(0, x.shape[1], WIDE):
            part = np.ascontiguousarray(x[:, at : at + WIDE])
            p = self.net.probabilities(part)
            p *= (part != PAD)[:, None, :]
            sums[:, at : at + WIDE] = p.sum(axis=0)
        starts = np.concatenate([[0], np.cumsum(counts[:-1])])
        mean = np.add.reduceat(sums, starts, axis=1) / [len(b) for b in raw]
        for i, k, v in zip(known, mean.argmax(axis=0).tolist(), mean.max(axis=0).tolist(), strict=True):
            langs[i], scores[i] = self.langs[k], min(1.0, v)
        return langs, scores


def spread(id: object, count: int, most: int) -> np.ndarray:
    """Which of a text's windows are learned from: the `most` with the least hash of id and place."""
    order = np.argsort([zlib.crc32(f"{id} {j}".encode()) for j in range(count)], kind="stable")
    taken = np.zeros(count, bool)
    taken[order[:most]] = True
    return taken


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 256, windows_each: int = 16, most: int = 4000) -> Labeller:
    """Train on the sample described above; rows that are held out are never read for it."""
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("id").isNotNull() & ~held_out(F.col("id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    taught = rows.groupBy("lang", F.pmod(F.xxhash64("id"), F.lit(per_lang)).alias("bucket")).agg(F.min("id").alias("id")).drop("bucket")
    taught = shared_table(taught, "taught")  # of known size, so small that the texts stay where they are
    chosen = rows.join(taught, ["id", "lang"]).groupBy("id", "lang").agg(F.min("text").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, lang, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = text.encode()
                places = np.flatnonzero(spread(one, -(-len(raw) // WINDOW), windows_each)).tolist()
                found = [raw[p * WINDOW : p * WINDOW + WINDOW] for p in places]
                yield pa.RecordBatch.from_arrays([pa.array([str(one)] * len(places), pa.string()), pa.array([lang] * len(places), pa.string()), pa.array(places, pa.int64()), pa.array(found, pa.binary())], names=["id", "lang", "place", "raw"])

    pieces = sorted(map(tuple, chosen.mapInArrow(cut, "id string, lang string, place long, raw binary").collect()))
    if not pieces:
        return Labeller([], None)
    langs = sorted({lang for _, lang, *_ in pieces})
    x, _ = windows([bytes(raw) for *_, raw in pieces])
    y = np.array([langs.index(lang) for _, lang, *_ in pieces])
    # Each language counts alike, whatever its share of the sample.
    r = np.random.default_rng(3)
    most = min(most, max(np.bincount(y)))
    pick = np.concatenate([r.choice(np.flatnonzero(y == k), most) for k in range(len(langs)) if (y == k).any()])
    net = ByteGru(len(langs))
    net.train(x[:, pick], y[pick])
    return Labeller(langs, net)


def identify(df: DataFrame, model: Labeller, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(batch):
            langs, scores = shared.value.predict(batch.column(1).to_pylist())
            return {"doc_id": batch.column(0), "held_out": batch.column(2), "lang_pred": langs, "score": scores}

        return work

    id_type = df.select(F.col(id_col)).schema[0].dataType.simpleString()
    return arrow_map(df.select(F.col(id_col), F.col(text_col), held_out(F.col(id_col))), f"doc_id {id_type}, held_out boolean, lang_pred string, score double", make)


def confident_rows(df: DataFrame, model: Labeller, text_col: str = "text", least: float = 0.4) -> DataFrame:
    """The rows whose text gets a language with at least this score, with all their columns."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        found = [s for at, n in cuts(texts) for s in shared.value.predict(texts.slice(at, n).to_pylist())[1]]
        return pa.array(found, pa.float64())

    return df.where(score(F.col(text_col)) >= least)
