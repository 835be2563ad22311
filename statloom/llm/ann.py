"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

Equal vectors are one class with the smallest ids of its members, since only those can be among the nearest; a vector
that makes up a third of all rows is one row from then on. On a bounded sample of classes (`sample` of them, by hash of
the id) the driver learns a rotation (principal axes, then alternating sign and Procrustes steps) and the Hamming radius
that holds `reach` of the true neighbours inside the sample. Every class is indexed: codes are cut into SUBSTRINGS
pieces, each piece with its own table. By the pigeonhole principle a code within radius r agrees with the query in some
piece up to r // SUBSTRINGS bits, so probing all values within that many flips retrieves every code within r; codes
found are checked against r, then ranked by cosine on the original vectors in double precision. A shard with fewer rows
than a query has probes is checked code by code, which retrieves the same codes.

The index never moves: each task builds the tables of its own rows, `shard_rows` at a time, and answers a block of queries,
of which it keeps the best k + 1 over all its shards; while it has fewer, the radius grows. Query blocks are broadcast one
after the other, each of at most `query_bytes`, so only queries times tasks times k + 1 scores are shuffled, and blocks
grow in number, not in size. How many codes lie within the radius is up to the data: where neighbours are hardly nearer than
other rows, the radius is wide and a query meets a share of all rows.

Defined results: vectors that are null, empty, zero, of another length than the sample's most frequent one, or that hold
null or non-finite components take no part; finite components of any size do, as vectors are scaled by their largest one
before lengths are taken; a query without any candidate returns no row; equal scores rank by id; rows that repeat an id
are separate candidates of which none with the query's own id counts; an empty table gives no rows; further columns are
ignored. Building the plan runs jobs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statloom.llm.common import shared_table

BITS, SUBSTRINGS = 64, 4


def scaled_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows by their largest component, so that no square overflows or vanishes."""
    return vectors / np.abs(vectors).max(axis=1, keepdims=True)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    rows = scaled_rows(vectors)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


class Codes:
    """Rotation to binary codes, and the radius learned with it."""

    def __init__(self, vectors: np.ndarray, reach: float, k: int, rounds: int = 30, seed: int = 5):
        unit = unit_rows(vectors)
        self.bits = min(BITS, unit.shape[1])
        self.centre = unit.mean(axis=0)
        x = unit - self.centre
        _, axes = np.linalg.eigh(x.T @ x)
        axes = axes[:, ::-1][:, : self.bits]
        v = x @ axes
        r = np.linalg.qr(np.random.default_rng(seed).normal(size=(self.bits, self.bits)))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        self.axes = axes @ r
        self.cuts = np.linspace(0, self.bits, SUBSTRINGS + 1).astype(int)
        self.radius = self._radius(unit, reach, k)

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """(n, bits) of 0 and 1."""
        return ((unit_rows(vectors) - self.centre) @ self.axes >= 0).astype(np.uint8)

    def _radius(self, unit: np.ndarray, reach: float, k: int) -> int:
        q = unit[:: max(1, len(unit) // 256)]
        if len(unit) < 2:
            return self.bits
        cosine = q @ unit.T
        order = np.argsort(-cosine, axis=1)[:, 1 : k + 1]
        a, b = self.encode(q).astype(np.int32), self.encode(unit).astype(np.int32)
        apart = a.sum(axis=1)[:, None] + b.sum(axis=1)[None] - 2 * a @ b.T
        return int(np.ceil(np.quantile(np.take_along_axis(apart, order, axis=1), reach)))


class Shard:
    """Tables of one shard: for each substring the rows sorted by value, and all codes as 64-bit words."""

    def __init__(self, codes: Codes, vectors: np.ndarray):
        self.codes = codes
        bits = codes.encode(vectors)
        self.words = pack(bits)
        self.tables = []
        for lo, hi in zip(codes.cuts, codes.cuts[1:], strict=False):
            value = bits[:, lo:hi] @ (1 << np.arange(hi - lo))
            self.tables.append((np.argsort(value, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << (hi - lo)))])))

    def within(self, query: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is within the radius of the query's bits: all of them, by the pigeonhole principle."""
        word = pack(query[None])[0]
        if sum(count_flips(int(hi - lo), radius // SUBSTRINGS) for lo, hi in zip(self.codes.cuts, self.codes.cuts[1:], strict=False)) >= len(self.words):
            return np.flatnonzero(np.bitwise_count(self.words ^ word) <= radius)
        hit = np.zeros(len(self.words), bool)
        for (order, starts), lo, hi in zip(self.tables, self.codes.cuts, self.codes.cuts[1:], strict=False):
            probes = int(query[lo:hi] @ (1 << np.arange(hi - lo))) ^ flips(int(hi - lo), radius // SUBSTRINGS)
            first = starts[probes]
            sizes = starts[probes + 1] - first
            full = np.flatnonzero(sizes)
            first, sizes = first[full], sizes[full]
            ends = np.cumsum(sizes)
            if len(ends):
                hit[order[np.arange(ends[-1]) + np.repeat(first - ends + sizes, sizes)]] = True
        rows = np.flatnonzero(hit)
        return rows[np.bitwise_count(self.words[rows] ^ word) <= radius]


def pack(bits: np.ndarray) -> np.ndarray:
    """Rows of up to 64 bits as unsigned words."""
    wide = np.zeros((len(bits), BITS), np.uint8)
    wide[:, : bits.shape[1]] = bits
    return np.packbits(wide, axis=1).view(np.uint64).ravel()


_flips: dict[tuple[int, int], np.ndarray] = {}


def flips(width: int, most: int) -> np.ndarray:
    """All masks of width bits with at most `most` ones."""
    key = width, min(most, width)
    if key not in _flips:
        _flips[key] = np.array([sum(1 << i for i in c) for n in range(key[1] + 1) for c in combinations(range(width), n)], np.int64)
    return _flips[key]


def count_flips(width: int, most: int) -> int:
    return sum(comb(width, n) for n in range(min(most, width) + 1))


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _best(items: list[tuple], k: int) -> list[tuple]:
    """The first of (minus score, ids) with up to k + 1 distinct first ids."""
    out, seen = [], set()
    for item in sorted(items):
        if len(seen) > k:
            break
        out.append(item)
        seen.add(item[1][0])
    return out


def _search(index: DataFrame, asks: pa.Table, codes, k: int, shard_rows: int) -> DataFrame:
    """cid, ids, score: each task's best classes for each query of the block."""
    sent = index.sparkSession.sparkContext.broadcast((asks.column("qid").to_pylist(), _matrix(asks.column("q")))) if len(asks) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sent is None:
            return
        qids, q = sent.value
        q = scaled_rows(q)
        q_norms, bits = np.linalg.norm(q, axis=1), codes.value.encode(q)
        best: list[list[tuple]] = [[] for _ in qids]

        def answer(held: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(held)
            vectors, ids = scaled_rows(_matrix(rows.column("v"))), rows.column("ids").to_pylist()
            shard, norms = Shard(codes.value, vectors), np.linalg.norm(vectors, axis=1)
            least = np.array([i[0] for i in ids])
            for at, (v, n, b) in enumerate(zip(q, q_norms, bits, strict=True)):
                radius, mine = codes.value.radius, best[at]
                found = shard.within(b, radius)
                had = {i[0] for _, i in mine}
                while len(found) < len(vectors) and len(had) <= k and len(had.union(least[found].tolist())) <= k:
                    radius += SUBSTRINGS
                    found = shard.within(b, radius)
                score = (vectors[found] * v).sum(axis=1) / (norms[found] * n)
                if len(had) > k:  # only what reaches the worst of the best
                    near = score >= -mine[-1][0]
                    found, score = found[near], score[near]
                if not len(found):
                    continue
                order = np.argsort(-score, kind="stable")
                new = np.sort(np.unique(least[found[order]], return_index=True)[1])
                if len(new) > k + 1:  # all that tie with the class that brings id k + 1
                    near = score >= score[order[new[k]]]
                    found, score = found[near], score[near]
                best[at] = _best([*mine, *zip((-score).tolist(), (tuple(ids[i]) for i in found), strict=True)], k)

        held, n = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, shard_rows):
                piece = batch.slice(start, shard_rows)
                if n + piece.num_rows > shard_rows and held:
                    answer(held)
                    held, n = [], 0
                held.append(piece)
                n += piece.num_rows
        if held:
            answer(held)
        flat = [(cid, i, -s) for cid, found in zip(qids, best, strict=True) for s, i in found]
        columns = [pa.array([x[0] for x in flat], pa.int64()), pa.array([x[1] for x in flat], pa.list_(pa.int64())), pa.array([x[2] for x in flat], pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, names=["cid", "ids", "score"])

    return index.select("v", "ids").mapInArrow(run, "cid long, ids array<long>, score double")


def nearest(
    df: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 5,
    sample: int = 4096,
    reach: float = 0.98,
    shard_rows: int = 8192,
    query_bytes: int = 32_000_000,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of df for each row of queries (same columns), without itself."""

    zero = F.lit(0).cast(df.schema[vec_col].dataType.elementType)

    def usable(rows: DataFrame) -> DataFrame:
        v = F.col("v")
        sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
        rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where(F.col("id").isNotNull())
        # Adding zero makes -0.0 and 0.0 one value.
        return rows.where(F.coalesce(sound, F.lit(False))).withColumn("v", F.transform("v", lambda x: x + zero))

    rows = usable(df)
    # k rows of an id and k + 1 ids are enough: without the query's own id there are still k rows, if there are so many.
    by = Window.partitionBy("v").orderBy("id")
    few = rows.groupBy("v", "id").agg(F.count("*").alias("times")).withColumn("n", F.row_number().over(by)).where(F.col("n") <= k + 1)
    held = F.sort_array(F.collect_list(F.struct("id", F.least("times", F.lit(k)).cast("int").alias("times"))))
    ids = F.flatten(F.transform(held, lambda h: F.array_repeat(h["id"], h["times"])))
    # Classes can share ids, so they have a number of their own.
    classes = shared_table(few.groupBy("v").agg(ids.alias("ids")).withColumn("cid", F.monotonically_increasing_id()), "classes")
    taught = classes.orderBy(F.xxhash64(F.col("ids")[0]), F.col("ids")[0], "v").limit(sample).select("v").collect()
    if not taught:
        return classes.select(F.lit(0).cast("long").alias("query_id"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    lengths = np.array([len(r.v) for r in taught])
    dim = int(np.bincount(lengths).argmax())
    codes = df.sparkSession.sparkContext.broadcast(Codes(np.array([r.v for r in taught if len(r.v) == dim], np.float64), reach, k))
    index = classes.where(F.size("v") == dim)
    wanted = usable(queries).where(F.size("v") == dim)
    asked = shared_table(wanted.join(index.select("v", "cid"), "v").select("id", "cid"), "queries")
    asking = index.join(asked.select("cid").distinct(), "cid", "left_semi").select(F.col("cid").alias("qid"), F.col("v").alias("q"))
    blocks = max(1, -(-asked.select("cid").distinct().count() * 8 * dim // query_bytes))
    dealt = shared_table(asking.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")), "asking")
    found = None
    for block in range(blocks):
        part = _search(index, dealt.where(F.col("block") == block).select("qid", "q").toArrow(), codes, k, shard_rows)
        found = part if found is None else found.unionByName(part)

    each = found.select("cid", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("cid").orderBy(F.desc("score"), "vec_id")
    again = Window.partitionBy("cid", "vec_id").orderBy(F.desc("score"))
    each = each.withColumn("again", F.row_number().over(again)).where(F.col("again") <= k)
    each = each.withColumn("ids", F.count_if(F.col("again") == 1).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    top = each.where(F.col("ids") <= k + 1).withColumn("n", F.row_number().over(order))
    lists = top.groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("best"))
    mine = asked.join(lists, "cid").select("id", F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("id")), 1, k).alias("best"))
    out = mine.select(F.col("id").alias("query_id"), F.posexplode("best").alias("pos", "b"))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))
