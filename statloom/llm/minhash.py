"""MinHash near-duplicates with tensored banding and exact verification.

1. Each text becomes its set of 64-bit shingle hashes, a 128-bit digest of that set, and two collections of m half
   keys, each half key folding `rows` minhashes. Table (i, j) is keyed by half key i of the first and j of the second
   collection: m * m tables from 2 * m * rows minhashes instead of 2 * m * m * rows. A pair of similarity s meets in
   some table with probability (1 - (1 - s^rows)^m)^2; m is the smallest number that makes this FOUND at the threshold:
   10 at 0.85 and 14 at 0.8 with rows=4.
2. Equal sets are one class, represented by its smallest id; only representatives go into the tables.
3. A table bucket gives edges from its smallest member, first inside each batch and then over all batches, so a bucket
   of g members makes g - 1 edges; an edge knows whether all its buckets hold two members only.
4. Verification comes before closure: each member is checked against its smallest leader on the full sets, in groups of
   at most STAR_ROWS members a leader, so a group of copies spreads over tasks. Components of these links are cores.
   Edges inside a core are done, and so are refuted ones from buckets of two.
5. Cores that the remaining edges join are families. Inside a family links between cores are decided on the full sets: the
   largest core is dealt into blocks apart from the rest; blocks are small, REST_BLOCKS of them for the rest, and more
   rather than larger than `block_shingles`; each block of the rest meets every block, so pairs inside the largest core are never looked at and no task holds more than two blocks. A probe
   counts the intersections of one set with others through an inverted list; sets with too few shared shingles can't link
   and leave; only sets outside the largest component are probed. A task returns a spanning forest of its links, not pairs.
6. Components of all links, by distributed steps; the verdict returns by class to all rows.

What can be lost: a pair of sets meets in no table with probability 1 - FOUND at the threshold, less above; two shingles
share a 64-bit hash with probability 5e-20 a pair of shingles, which could count a text's shingles one too few.

Defined results: a null, empty or blank text has the empty set, n_shingles 0, and is linked with nothing; fewer words
than a shingle make one shingle; equal sets are linked whatever their texts; very long texts are read whole; rows with the
same id are one document; a row with a null id is linked with nothing and kept; an empty table gives no rows; further
columns are ignored. Building the plan runs jobs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statloom.llm.common import arrow_map, drop_tables, shared_table, slices
from statloom.llm.components import connected_components

ODD = np.uint64(0x9E3779B97F4A7C15)
CACHE_WORDS = 150_000
#: Least probability that a pair right at the threshold meets in a table.
FOUND = 0.9985
#: Members of a leader that one task checks.
STAR_ROWS = 1000
#: Weight of the smallest blocks of a family, a document's weight beside its shingles, and blocks of a family's rest.
BLOCK_LEAST, DOC_WEIGHT, REST_BLOCKS = 20_000, 30, 16
#: Table keys that a worker combines at once.
COMBINED_KEYS = 1_000_000
_words: dict[bytes, int] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) * ODD


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles. bytes.lower and bytes.split treat exactly A-Z and \\x20 \\x09-\\x0D."""
    out = []
    if len(_words) > CACHE_WORDS:
        _words.clear()
    known = _words
    for text in texts:
        words = (text or "").encode().lower().split()
        if not words:
            out.append(np.empty(0, np.uint64))
            continue
        try:
            hashes = [known[w] for w in words]
        except KeyError:
            for w in set(words).difference(known):
                known[w] = xxhash.xxh3_64_intdigest(w)
            hashes = [known[w] for w in words]
        h = np.array(hashes, np.uint64)
        n = max(1, len(h) - width + 1)
        fold = np.full(n, min(len(h), width), np.uint64)
        for k in range(min(width, len(h))):
            fold = mix(fold * ODD + h[k : k + n])
        out.append(np.unique(fold))
        if len(known) > 2 * CACHE_WORDS:
            known.clear()
    return out


def half_keys(sets: list[np.ndarray], m: int, rows: int, seed: int) -> np.ndarray:
    """(documents, 2 * m) half keys of non-empty sets."""
    random = np.random.default_rng(seed)
    flips = random.integers(0, 2**64, 2 * m * rows, np.uint64)
    sizes = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), 2 * m), np.uint64)
    start = 0
    while start < len(sets):  # about 32,000 shingles at once stay in the cache of a core
        end = start + 1
        held = sizes[start]
        while end < len(sets) and held + sizes[end] <= 32_000:
            held += sizes[end]
            end += 1
        flat = np.concatenate(sets[start:end])
        at = np.concatenate([[0], np.cumsum(sizes[start : end - 1])])
        for c in range(2 * m):
            key = np.full(end - start, c + 1, np.uint64)
            for r in range(rows):
                low = np.minimum.reduceat((flat ^ flips[c * rows + r]) * ODD, at)
                key = mix(key * ODD + low)
            out[start:end, c] = key
        start = end
    return out


def table_keys(halves: np.ndarray, m: int) -> np.ndarray:
    """(documents, m * m) keys: every first half key combined with every second one."""
    first, second = mix(halves[:, :m] * ODD), halves[:, m:]
    cell = np.arange(m * m, dtype=np.uint64).reshape(1, m, m)
    return mix(first[:, :, None] + second[:, None, :] * np.uint64(3) + cell).reshape(len(halves), m * m)


def _links(first: list[np.ndarray], second: list[np.ndarray] | None, num: int, den: int, cores: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links (den * intersection >= num * union) of a block, or between two blocks.

    Positions count through `first`, then `second`. Sets of one core count as linked already.
    """
    sets = first + (second or [])
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    side = np.arange(n) >= len(first)
    flat, of = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, of = flat[order], of[order]
    alive = np.ones(n, bool)
    while True:  # exact: a link needs at least num/den of the larger set in common
        runs = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.empty(0, int)
        counts = np.diff(np.append(runs, len(flat)))
        shared = np.repeat(counts >= 2, counts)
        kept = alive & (den * np.bincount(of[shared], minlength=n) >= num * sizes)
        if second is not None and not (kept[: len(first)].any() and kept[len(first) :].any()):
            return []
        if (kept == alive).all() and shared.all():
            break
        stay = shared & kept[of]
        flat, of, alive = flat[stay], of[stay], kept
    if not alive.any():
        return []
    ids = np.repeat(np.arange(len(runs)), counts)
    by_doc = np.argsort(of, kind="stable")
    mine, starts = ids[by_doc], np.searchsorted(of[by_doc], np.arange(n + 1))
    ends = np.append(runs, len(flat))
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    if cores is not None:
        parent = np.unique(np.array(cores, np.int64), return_index=True, return_inverse=True)
        parent = parent[1][parent[2]]
    out: list[tuple[int, int]] = []
    done = ~alive

    def probe(i: int) -> None:
        lists = mine[starts[i] : starts[i + 1]]
        if not len(lists):
            done[i] = True
            return
        met = np.concatenate([of[ends[k] : ends[k + 1]] for k in lists])
        if len(met) > n:
            common = np.bincount(met, minlength=n)
            found = np.flatnonzero(common)
            common = common[found]
        else:
            found, common = np.unique(met, return_counts=True)
        near = (den * common >= num * (sizes[i] + sizes[found] - common)) & (found != i) & alive[found]
        if second is not None:
            near &= side[found] != side[i]
        a = root(i)
        for j in found[near].tolist():
            b = root(j)
            if a != b:
                parent[b] = a
                out.append((i, int(j)))
        done[i] = True

    weight = np.bincount(of, weights=counts[ids], minlength=n) / np.maximum(sizes, 1)
    probe(int(np.argmax(np.where(alive, weight, -1))))
    while True:
        roots = np.array([root(i) for i in range(n)])
        living = np.flatnonzero(alive)
        big = np.bincount(roots[living], minlength=n).argmax()
        open_ = living[(roots[living] != big) & ~done[living]]
        if not len(open_):
            return out
        for i in open_:
            if root(i) != root(big):
                probe(int(i))


def collections_for(similarity: float, rows: int) -> int:
    """Half keys in a collection so that a pair of this similarity meets with probability FOUND."""
    m = 1
    while (1 - (1 - similarity**rows) ** m) ** 2 < FOUND:
        m += 1
    return m


def near_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    m: int | None = None,
    rows: int = 4,
    seed: int = 7,
    block_shingles: int = 2_000_000,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row; linked are sets with 100 * intersection >= percent * union."""
    m = m or collections_for(percent / 100, rows)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    partitions = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))

    def signing():
        def work(batch: pa.RecordBatch) -> dict:
            sets = shingle_sets(batch.column(1).to_pylist(), width)
            full = [s for s in sets if len(s)]
            keys = iter(half_keys(full, m, rows, seed)) if full else iter(())
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            return {
                "doc_id": batch.column(0),
                "n_shingles": [len(s) for s in sets],
                "h1": [int.from_bytes(d[:8], "little", signed=True) for d in digests],
                "h2": [int.from_bytes(d[8:], "little", signed=True) for d in digests],
                "halves": [next(keys).tobytes() if len(s) else None for s in sets],
            }

        return work

    signed = shared_table(arrow_map(docs, "doc_id long, n_shingles long, h1 long, h2 long, halves binary", signing), "signed")
    full = signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = shared_table(full.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "n_shingles", "halves")).alias("r")).select("h1", "h2", "r.*"), "classes")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Batches gathered to about COMBINED_KEYS keys, so that a frequent key is combined before the shuffle."""
        held, n, most = [], 0, COMBINED_KEYS // (m * m)
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= most:
                yield pa.Table.from_batches(held)
                held, n = [], 0
        if n:
            yield pa.Table.from_batches(held)

    def bucketing(local: bool):
        """Edges of local buckets of three and more; or a row a local bucket, with the second member of two."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in joined(batches):
                ids = np.repeat(batch.column(0).to_numpy(), m * m)
                halves = np.frombuffer(b"".join(x for c in batch.column(1).chunks for x in c.to_pylist()), np.uint64).reshape(-1, 2 * m)
                keys = table_keys(halves, m).ravel()
                order = np.lexsort((ids, keys))
                keys, ids = keys[order], ids[order]
                new = np.concatenate([[True], keys[1:] != keys[:-1]])
                first = np.flatnonzero(new)
                sizes = np.diff(np.append(first, len(ids)))
                if not local:
                    two = sizes == 2
                    other = np.zeros(len(first), np.int64)
                    other[two] = ids[first[two] + 1]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[new].view(np.int64)), pa.array(ids[new]), pa.array(other, mask=~two), pa.array(sizes)], names=["k", "id", "other", "n"])
                    continue
                lead, many = np.repeat(ids[first], sizes), np.repeat(sizes > 2, sizes)
                pairs = np.unique(np.stack([lead, ids], 1)[many & (lead != ids)], axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
            pa.default_memory_pool().release_unused()

        return run

    halves = classes.select("doc_id", "halves")
    of_key = Window.partitionBy("k")
    keyed = halves.mapInArrow(bucketing(False), "k long, id long, other long, n long")
    keyed = keyed.withColumns({"lead": F.min("id").over(of_key), "wide": F.sum("n").over(of_key) > 2})
    each = keyed.where((F.col("lead") != F.col("id")) | F.col("other").isNotNull()).select(F.explode(F.array(F.struct(F.col("lead").alias("a"), F.col("id").alias("b")), F.struct(F.col("id").alias("a"), F.col("other").alias("b")))).alias("e"), "wide")
    each = each.select("e.*", "wide").where(F.col("a") != F.col("b"))
    each = each.unionByName(halves.mapInArrow(bucketing(True), "a long, b long").withColumn("wide", F.lit(True)))
    edges = shared_table(each.groupBy("a", "b").agg(F.max("wide").alias("wide")), "edges")
    paired = edges.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = shared_table(docs.join(paired.hint("shuffle_hash"), "doc_id"), "texts")

    # Each member and its smallest leader, who joins every group of the members.
    least = shared_table(edges.groupBy("b").agg(F.min("a").alias("a")), "leaders")
    groups = least.groupBy("a").agg(F.ceil(F.count("*") / STAR_ROWS).cast("int").alias("groups"))
    members = least.join(groups, "a").select("a", F.col("b").alias("doc_id"), F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("part"), F.lit(1).alias("role"))
    leaders = groups.select("a", F.col("a").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), F.lit(0).alias("role"))
    stars = texts.join(members.unionByName(leaders), "doc_id").select("a", "part", "role", "doc_id", "text")
    stars = stars.repartition(partitions, "a", "part").sortWithinPartitions("a", "part", "role")

    def checking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets = None, []
        for batch in batches:
            for piece in slices(batch, 4):
                a, part, role, ids = (piece.column(c).to_pylist() for c in range(4))
                found: list[tuple[int, int, bool]] = []
                for key, is_member, doc_id, s in zip(zip(a, part, strict=True), role, ids, shingle_sets(piece.column(4).to_pylist(), width), strict=True):
                    if now != key:
                        now, sets = key, []
                    if not is_member:
                        sets.append(s)
                        continue
                    shared = [len(np.intersect1d(s, lead, assume_unique=True)) for lead in sets]
                    linked = any(100 * c >= percent * (len(s) + len(lead) - c) for c, lead in zip(shared, sets, strict=True))
                    found.append((key[0], doc_id, linked))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found])], names=["a", "b", "linked"])

    checked = shared_table(stars.mapInArrow(checking, "a long, b long, linked boolean").groupBy("a", "b").agg(F.max("linked").alias("linked")), "checked")
    links = checked.where("linked").select("a", "b")
    cores = shared_table(connected_components(links), "cores")

    # Edges between cores that no check has refuted, or whose buckets hold more than their two ends.
    core_of = lambda end: cores.select(F.col("id").alias(end), F.col("component").alias(f"core_{end}"))
    left = edges.join(checked.where("NOT linked"), ["a", "b"], "left").where(F.col("wide") | F.col("linked").isNull()).select("a", "b")
    left = left.join(core_of("a"), "a", "left").join(core_of("b"), "b", "left")
    left = left.select(F.coalesce("core_a", "a").alias("a"), F.coalesce("core_b", "b").alias("b")).where("a <> b")
    families = shared_table(connected_components(left), "families")

    known = texts.select("doc_id").distinct().join(cores.select(F.col("id").alias("doc_id"), F.col("component").alias("core")), "doc_id", "left")
    known = known.select("doc_id", F.coalesce("core", "doc_id").alias("core"))
    known = known.join(families.select(F.col("id").alias("core"), F.col("component").alias("family")), "core")
    known = shared_table(known.join(classes.groupBy("doc_id").agg((F.sum("n_shingles") + DOC_WEIGHT).alias("weight")), "doc_id"), "members")
    weights = known.groupBy("family", "core").agg(F.sum("weight").alias("weight"))
    largest = weights.groupBy("family").agg(F.max_by("core", F.struct("weight", "core")).alias("largest"), F.max("weight").alias("inner"), F.sum("weight").alias("weight"))
    outer = F.col("weight") - F.col("inner")
    # The rest is dealt into up to REST_BLOCKS blocks, and more only where these would be too large. Blocks of the core are
    # about as large as the rest that they meet, so both travel about as often.
    unit = F.least(F.lit(block_shingles), F.greatest(F.lit(BLOCK_LEAST), F.ceil(outer / REST_BLOCKS)))
    of_rest = F.greatest(F.lit(1), F.ceil(outer / unit).cast("int"))
    of_core = F.ceil(F.col("inner") / F.greatest(F.lit(BLOCK_LEAST), F.least(outer, F.lit(block_shingles)))).cast("int")
    split = (of_core > 1) | (F.col("weight") > F.least(F.lit(BLOCK_LEAST), F.lit(block_shingles)))
    largest = largest.select("family", F.when(split, F.col("largest")).alias("largest"), F.when(split, of_rest).otherwise(1).alias("rest_blocks"), F.when(split, of_core).otherwise(0).alias("core_blocks"))
    member = known.join(largest, "family")
    in_core = F.coalesce(F.col("core") == F.col("largest"), F.lit(False))
    own = F.when(in_core, F.col("rest_blocks") + F.pmod(F.xxhash64("doc_id"), F.col("core_blocks"))).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("rest_blocks"))).cast("int")
    met = F.when(in_core, F.col("rest_blocks")).otherwise(F.col("rest_blocks") + F.col("core_blocks"))
    member = member.select("doc_id", "family", "core", own.alias("own"), F.explode(F.sequence(F.lit(0), met - 1)).alias("other"))
    held = texts.join(member, "doc_id")
    held = held.select("doc_id", "text", "family", "core", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    held = held.repartition(partitions, "family", "i", "j").sortWithinPartitions("family", "i", "j", "own", "doc_id")

    def confirming(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def decide(group: list[tuple]) -> pa.RecordBatch | None:
            (_, i, j), sides = group[0][0], ([], [])
            for key, own, doc_id, core, s in group:
                sides[own != key[1]].append((doc_id, core, s))
            if len(group) < 2 or (i != j and not (sides[0] and sides[1])):
                return None
            found = _links([s for *_, s in sides[0]], [s for *_, s in sides[1]] if i != j else None, percent, 100, [c for side in sides for _, c, _ in side])
            ids = [d for side in sides for d, *_ in side]
            return pa.RecordBatch.from_arrays([pa.array([ids[a] for a, _ in found], pa.int64()), pa.array([ids[b] for _, b in found], pa.int64())], names=["a", "b"])

        group: list[tuple] = []
        for batch in batches:
            for piece in slices(batch, 1):
                columns = [piece.column(c).to_pylist() for c in range(7)]
                sets = shingle_sets(columns[1], width)
                for doc_id, family, core, own, i, j, s in zip(columns[0], *columns[2:], sets, strict=True):
                    if group and group[0][0] != (family, i, j):
                        if (out := decide(group)) is not None:
                            yield out
                        group = []
                    if len(s):
                        group.append(((family, i, j), own, doc_id, core, s))
        if group and (out := decide(group)) is not None:
            yield out
        pa.default_memory_pool().release_unused()

    more = held.mapInArrow(confirming, "a long, b long")
    components = connected_components(links.unionByName(more))
    drop_tables([edges, texts, least, checked, cores, families, known])
    judged = classes.select("h1", "h2", "doc_id").join(components, F.col("doc_id") == F.col("id"), "left")
    judged = judged.select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), F.coalesce("component", "doc_id").alias("component_id"))
    rest = signed.select("doc_id", "n_shingles", "h1", "h2")
    out = rest.join(judged, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")) & F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), "left")
    own = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))
