"""Interpolated modified Kneser-Ney model of real characters, its n-grams kept in tables sharded by n-gram.

An n-gram of up to ORDER characters is the exact number hi * 2 ** 63 + lo of its code points, 21 bits each, shifted by
SHIFT so that shorter n-grams differ from longer ones; a text starts after ORDER - 1 border symbols.

1. `blocks` packs the rows into blocks of about BLOCK_CHARS characters, compressed Arrow batches in a table bucketed by
   block, so no later step moves a text again.
2. `questions` lists each block's distinct n-grams with their counts in trusted texts. Trusted texts fall into two folds
   by a hash of their id, with counts and a model each.
3. `answers` sums the counts by n-gram, goes down the orders by count joins and comes back up with probabilities, for
   every n-gram that any block asks for. All these tables are sharded by n-gram; ten figures of each order reach the driver.
4. `scores` joins the questions with the answers, packs them by block and adds up each document's log probabilities in
   its block. A trusted text is scored by the fold that it is not in, any other by the mean of both, so no text is judged
   by counts that it took part in. Answers are single-precision logarithms.

With one fold empty (hardly any trusted text) both models learn from all of it. A block asks once for an n-gram, so a
common n-gram is one row a block, not one a document. Texts above CHUNK characters are worked off in chunks that overlap
by ORDER - 1 symbols. Building the plan runs jobs; the intermediate tables are dropped when nothing needs them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import SLICE_BYTES, bucketed_table, drop_tables, shared_table, slices, small_batches

ORDER, BITS = 5, 21
#: Code points start at SHIFT; 1 is the border.
SHIFT, BORDER = 2, 1
#: Characters of a block of texts; a longer text is a block of its own.
BLOCK_CHARS = 16_000_000
#: Characters that are in work at once.
CHUNK = 4_000_000
#: Rows of n-grams that a worker holds before it merges or packs them.
HELD_ROWS = 500_000
MASK = (1 << BITS) - 1
LEVEL = 6


def fold_of(doc_id) -> int:
    return xxhash.xxh3_64_intdigest(str(doc_id).encode()) & 1


class Grams:
    """Distinct n-grams of ORDER symbols of some texts, and which of them each character ends."""

    def __init__(self, units: list[tuple[int, np.ndarray]]):
        """units: (document, symbols with the ORDER - 1 before them)."""
        flat = np.concatenate([u for _, u in units])
        sizes = np.array([len(u) - ORDER + 1 for _, u in units])
        real = np.ones(len(flat), bool)
        for start in np.cumsum(sizes + ORDER - 1) - sizes - ORDER + 1:
            real[start : start + ORDER - 1] = False
        at = np.flatnonzero(real)
        self.doc = np.repeat(np.array([d for d, _ in units], np.int32), sizes)
        alphabet = pa.array(flat).dictionary_encode()
        place = alphabet.indices.to_numpy().astype(np.int64)
        bits = max(1, (len(alphabet.dictionary) - 1).bit_length())
        code, width = place.copy(), bits
        for j in range(1, ORDER):
            if width + bits > 63:  # a large alphabet: number the distinct shorter n-grams first
                shorter = pa.array(code).dictionary_encode()
                code = shorter.indices.to_numpy().astype(np.int64)
                width = max(1, (len(shorter.dictionary) - 1).bit_length())
            code[j:] |= place[:-j] << width
            width += bits
        del place, real
        code = code[at]
        found = pa.array(code).dictionary_encode()
        self.ids, self.n = found.indices.to_numpy(), len(found.dictionary)
        first = np.zeros(self.n, np.int64)
        first[self.ids[::-1]] = at[::-1]
        self.hi, self.lo = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        for j in range(ORDER):
            s = flat[first - j].astype(np.int64)
            if j < 3:
                self.lo |= s << (BITS * j)
            else:
                self.hi |= s << (BITS * (j - 3))


def in_work(texts: list[str | None], most: int) -> Iterator[Grams]:
    """The n-grams of texts by number, about `most` characters at once."""
    pad = np.full(ORDER - 1, BORDER, np.uint32)
    units, held = [], 0
    for d, text in enumerate(texts):
        if not text:
            continue
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") + np.uint32(SHIFT)
        points = np.concatenate([pad, points])
        for start in range(0, len(points) - ORDER + 1, most):
            unit = points[start : start + most + ORDER - 1]
            if held + len(unit) > most + ORDER and units:
                yield Grams(units)
                units, held = [], 0
            units.append((d, unit))
            held += len(unit)
    if units:
        yield Grams(units)


def _suffix(k: int):
    """(hi, lo) columns of the last k symbols."""
    hi, lo = F.col("hi"), F.col("lo")
    if k > 3:
        return hi.bitwiseAND(F.lit((1 << BITS * (k - 3)) - 1)), lo
    return F.lit(0).cast("long"), lo.bitwiseAND(F.lit((1 << BITS * k) - 1))


def _context():
    """(hi, lo) columns of all symbols but the last."""
    hi, lo = F.col("hi"), F.col("lo")
    return F.shiftright(hi, BITS), F.shiftright(lo, BITS).bitwiseOR(F.shiftleft(hi.bitwiseAND(F.lit(MASK)), 2 * BITS))


def blocks(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """block, seq, payload, ids: rows of any columns as compressed batches, bucketed by block."""
    small_batches(rows.sparkSession)
    text = rows.columns.index(text_col)
    ids = rows.columns.index(id_col)
    kind = rows.schema[ids].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", LEVEL))
        part, block, seq, held = TaskContext.get().partitionId(), 0, 0, 0
        for batch in batches:
            for piece in slices(batch, text, SLICE_BYTES):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, piece.schema, options=options) as out:
                    out.write_batch(piece)
                col = piece.column(ids)
                listed = pa.ListArray.from_arrays(pa.array([0, len(col)], pa.int32()), col)
                yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + block]), pa.array([seq], pa.int32()), pa.array([sink.getvalue().to_pybytes()]), listed], names=["block", "seq", "payload", "ids"])
                seq += 1
                held += (pc.sum(pc.utf8_length(piece.column(text))).as_py() or 0) + len(piece)
                if held >= BLOCK_CHARS:
                    block, seq, held = block + 1, 0, 0

    packed = rows.mapInArrow(pack, f"block long, seq int, payload binary, ids array<{kind}>")
    return bucketed_table(packed, "blocks", "block")


def unpacked(held: pa.Table) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(seq, rows) of a block, one batch at a time."""
    for i in np.argsort(held.column("seq").to_numpy()):
        payload = held.column("payload")[int(i)].as_buffer()
        yield held.column("seq")[int(i)].as_py(), pa.ipc.open_stream(payload).read_next_batch()


def trusted_places(held: DataFrame, trusted: DataFrame) -> DataFrame:
    """block, seq, pos of the rows whose id is in `trusted` (one column)."""
    each = held.select("block", "seq", F.posexplode("ids").alias("pos", "id"))
    return shared_table(each.join(trusted.toDF("id"), "id", "left_semi").select("block", "seq", "pos"), "trusted")


def _good(table: pa.Table) -> dict[int, np.ndarray]:
    """Positions by seq of the rows that have both."""
    seq, pos = (np.array(table.column(c).to_pylist()) for c in ("seq", "pos"))
    return {int(s): pos[seq == s].astype(np.int64) for s in set(seq.tolist())}


def questions(held: DataFrame, good: DataFrame, id_col: str, text_col: str, columns: list[str]) -> DataFrame:
    """block, hi, lo, c0, c1: distinct n-grams of each block, and their counts in trusted texts of either fold."""
    text, ids = columns.index(text_col), columns.index(id_col)

    def merged(parts: list[pa.Table]) -> pa.Table:
        both = pa.concat_tables(parts).group_by(["hi", "lo"], use_threads=False).aggregate([("c0", "sum"), ("c1", "sum")])
        return pa.table([both.column(c) for c in ("hi", "lo", "c0_sum", "c1_sum")], names=["hi", "lo", "c0", "c1"])

    def count(key: tuple, block: pa.Table, flags: pa.Table) -> pa.Table:
        places, parts = _good(flags), []
        for seq, batch in unpacked(block):
            fold = np.full(batch.num_rows, -1)
            for i in places.get(seq, ()):
                fold[i] = fold_of(batch.column(ids)[int(i)].as_py())
            for grams in in_work(batch.column(text).to_pylist(), CHUNK):
                mine = fold[grams.doc]
                c = [pa.array(np.bincount(grams.ids[mine == f], minlength=grams.n)) for f in (0, 1)]
                parts.append(pa.table([pa.array(grams.hi), pa.array(grams.lo), *c], names=["hi", "lo", "c0", "c1"]))
                if sum(len(p) for p in parts) > HELD_ROWS:
                    parts = [merged(parts)]
        if not parts:
            return pa.table({c: pa.array([], pa.int64()) for c in ("block", "hi", "lo", "c0", "c1")})
        out = merged(parts).sort_by([("hi", "ascending"), ("lo", "ascending")])
        del parts
        pa.default_memory_pool().release_unused()
        return out.add_column(0, "block", pa.array(np.full(len(out), key[0].as_py())))

    both = held.select("block", "seq", "payload").groupBy("block").cogroup(good.groupBy("block"))
    return bucketed_table(both.applyInArrow(count, "block long, hi long, lo long, c0 long, c1 long"), "questions", "hi", "lo", shuffle=True)


def _cuts(found: list[int]) -> list[float]:
    n = [max(1, x) for x in found]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), i - 0.05) for i in (1, 2, 3)]


def answers(asked: DataFrame) -> DataFrame:
    """hi, lo, l0, l1: log probability of the last symbol of each n-gram asked for, by either fold's model."""
    spare = []

    def kept(df: DataFrame) -> DataFrame:
        spare.append(shared_table(df, "ngrams"))
        return spare[-1]

    top = kept(asked.groupBy("hi", "lo").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")))
    whole = top.agg(F.sum("c0"), F.sum("c1")).first()
    if not (whole[0] and whole[1]):  # one fold has no text
        top = top.withColumns({"c0": F.col("c0") + F.col("c1"), "c1": F.col("c0") + F.col("c1")})
    orders = {ORDER: top}
    for k in range(ORDER - 1, 0, -1):
        hi, lo = _suffix(k)
        orders[k] = kept(orders[k + 1].groupBy(hi.alias("hi"), lo.alias("lo")).agg(*(F.count_if(F.col(c) > 0).alias(c) for c in ("c0", "c1"))))
    lower = None
    for k in range(1, ORDER + 1):
        grams = orders[k]
        few = grams.agg(*(F.count_if(F.col(c) == i) for c in ("c0", "c1") for i in range(1, 5)), *(F.count_if(F.col(c) > 0) for c in ("c0", "c1"))).first()
        hi, lo = _context()
        grams = grams.withColumns({"chi": hi, "clo": lo})
        for f in (0, 1):
            cut, c = _cuts(list(few[4 * f : 4 * f + 4])), F.col(f"c{f}")
            grams = grams.withColumn(f"less{f}", F.when(c == 0, 0.0).when(c == 1, cut[0]).when(c == 2, cut[1]).otherwise(cut[2]))
        sums = [F.sum(f"{x}{f}").alias(f"{y}{f}") for f in (0, 1) for x, y in (("c", "total"), ("less", "left"))]
        joined = grams.join(grams.groupBy("chi", "clo").agg(*sums), ["chi", "clo"])
        if lower is None:
            # All symbols that no trusted text holds are one symbol more.
            joined = joined.withColumns({f"p{f}": F.lit(1 / (few[8 + f] + 1)) for f in (0, 1)})
        else:
            hi, lo = _suffix(k - 1)
            joined = joined.withColumns({"thi": hi, "tlo": lo}).join(lower, ["thi", "tlo"])
        p = []
        for f in (0, 1):
            seen = (F.col(f"c{f}") - F.col(f"less{f}") + F.col(f"left{f}") * F.col(f"p{f}")) / F.col(f"total{f}")
            p.append(F.when(F.col(f"total{f}") > 0, seen).otherwise(F.col(f"p{f}")).alias(f"p{f}"))
        lower = kept(joined.select(F.col("hi").alias("thi"), F.col("lo").alias("tlo"), *p))
    out = shared_table(lower.select(F.col("thi").alias("hi"), F.col("tlo").alias("lo"), *(F.ln(f"p{f}").cast("float").alias(f"l{f}") for f in (0, 1))), "answers")
    drop_tables(spare)
    return out


def _told(asked: DataFrame, known: DataFrame) -> DataFrame:
    """block, packed: the answers of each block, packed by each task before they are dealt by block."""

    def packing(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts).sort_by([(c, "ascending") for c in ("block", "hi", "lo")])
        block = rows.column("block").to_numpy()
        new = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        for start, end in zip(new.tolist(), [*new[1:].tolist(), len(block)], strict=True):
            hi, lo = (np.diff(rows.column(c).to_numpy()[start:end], prepend=0) for c in ("hi", "lo"))
            logs = [rows.column(c).to_numpy()[start:end].astype(np.float32) for c in ("l0", "l1")]
            raw = b"".join(x.view(np.uint8).reshape(len(x), -1).T.tobytes() for x in (hi, lo, *logs))
            packed = pa.compress(raw, codec="zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.array([int(block[start])]), pa.array([end - start]), pa.array([packed])], names=["block", "n", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= HELD_ROWS:
                yield from packing(held)
                held, n = [], 0
        if n:
            yield from packing(held)

    joined = asked.select("block", "hi", "lo").join(known, ["hi", "lo"]).select("block", "hi", "lo", "l0", "l1")
    return joined.mapInArrow(run, "block long, n long, packed binary")


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Sorts in place: several times faster than hashing, as nearly all keys differ."""
    keys.sort()
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])]


class Answers:
    """Log probabilities of a block's n-grams."""

    def __init__(self, told: pa.Table):
        parts: list[list[np.ndarray]] = [[], [], [], []]
        for n, packed in zip(told.column("n").to_pylist(), told.column("packed").to_pylist(), strict=True):
            raw = np.frombuffer(pa.decompress(packed, decompressed_size=24 * n, codec="zstd"), np.uint8)
            for j, (size, kind) in enumerate(((8, np.int64), (8, np.int64), (4, np.float32), (4, np.float32))):
                of, raw = raw[: size * n], raw[size * n :]
                x = np.ascontiguousarray(of.reshape(size, n).T).view(kind).ravel()
                parts[j].append(np.cumsum(x) if j < 2 else x.astype(np.float64))
        hi, lo, l0, l1 = (np.concatenate(p) if p else np.empty(0) for p in parts)
        self.high, self.low = np.unique(hi), np.unique(lo)
        key = self._key(hi, lo)
        order = np.argsort(key)
        self.keys, self.logs = key[order], np.stack([l0, l1])[:, order]

    def _key(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.high, hi) * len(self.low) + np.searchsorted(self.low, lo)

    def places(self, grams: Grams) -> np.ndarray:
        """Where each distinct n-gram is; all have been asked for."""
        return np.searchsorted(self.keys, self._key(grams.hi, grams.lo))


def scores(held: DataFrame, asked: DataFrame, known: DataFrame, good: DataFrame, id_col: str, text_col: str, lang_col: str, columns: list[str], schema: str) -> DataFrame:
    """block, seq, pos, doc_id, l, good, chars, log_ppl, fresh of each row: characters, minus the mean log probability
    (null without text), and the share of characters that end an n-gram not seen before in the text.

    schema: type of the ids.
    """
    text, ids, lang = (columns.index(c) for c in (text_col, id_col, lang_col))

    def score(key: tuple, block: pa.Table, told: pa.Table) -> pa.Table:
        flagged = told.column("packed").is_null()
        places = _good(told.filter(flagged))
        known = Answers(told.filter(pc.invert(flagged)))
        out = []
        for seq, batch in unpacked(block):
            n = batch.num_rows
            fold = np.full(n, -1)
            for i in places.get(seq, ()):
                fold[i] = fold_of(batch.column(ids)[int(i)].as_py())
            # A trusted text of fold f is scored by the other fold's model.
            share = np.where(fold == -1, 0.5, fold).astype(np.float64)
            total, sizes, pairs = np.zeros(n), np.zeros(n, np.int64), []
            for grams in in_work(batch.column(text).to_pylist(), CHUNK):
                at = known.places(grams)
                for f, weight in ((0, share), (1, 1 - share)):
                    total += weight * np.bincount(grams.doc, known.logs[f][at][grams.ids], n)
                sizes += np.bincount(grams.doc, minlength=n)
                pair = at[grams.ids]
                pair += grams.doc * np.int64(len(known.keys))
                pairs.append(_distinct(pair))
            # A text in several chunks counts an n-gram once.
            distinct = np.bincount((_distinct(np.concatenate(pairs)) if len(pairs) > 1 else pairs[0]) // len(known.keys), minlength=n) if pairs else np.zeros(n)
            with np.errstate(invalid="ignore"):
                ppl, fresh = -total / sizes, distinct / sizes
            out.append(
                pa.table(
                    {
                        "block": pa.array(np.full(n, key[0].as_py())),
                        "seq": pa.array(np.full(n, seq, np.int32)),
                        "pos": pa.array(np.arange(n, dtype=np.int32)),
                        "doc_id": batch.column(ids),
                        "l": pc.fill_null(batch.column(lang).cast(pa.string()), ""),
                        "good": pa.array(fold >= 0),
                        "chars": pa.array(sizes),
                        "log_ppl": pa.array(np.where(sizes > 0, ppl, np.nan), from_pandas=True),
                        "fresh": pa.array(np.where(sizes > 0, fresh, np.nan), from_pandas=True),
                    }
                )
            )
        pa.default_memory_pool().release_unused()
        return pa.concat_tables(out)

    told = _told(asked, known).select("block", "n", "packed", F.lit(None).cast("int").alias("seq"), F.lit(None).cast("int").alias("pos"))
    told = told.unionByName(good.select("block", F.lit(None).cast("long").alias("n"), F.lit(None).cast("binary").alias("packed"), "seq", "pos"))
    both = held.select("block", "seq", "payload").groupBy("block").cogroup(told.groupBy("block"))
    return both.applyInArrow(score, f"block long, seq int, pos int, doc_id {schema}, l string, good boolean, chars long, log_ppl double, fresh double")


def rows_at(held: DataFrame, places: DataFrame, schema) -> DataFrame:
    """The original rows at (block, seq, pos), of the given schema."""

    def take(block: pa.Table, kept: pa.Table) -> pa.Table:
        wanted, out = _good(kept), []
        for seq, batch in unpacked(block):
            out.append(pa.Table.from_batches([batch]).take(pa.array(np.sort(wanted.get(seq, np.empty(0, np.int64))))))
        return pa.concat_tables(out)

    both = held.select("block", "seq", "payload").groupBy("block").cogroup(places.groupBy("block"))
    return both.applyInArrow(take, schema)
