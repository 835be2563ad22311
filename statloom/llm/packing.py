"""Bounded-space online packing of token ids into windows.

Each partition keeps at most `open_windows` windows open. A document's full windows are emitted as they are; its rest
goes into the open window that it fits best. If none fits, a new window is opened while there is room for one,
otherwise the fullest one is topped up with the head of the rest, emitted full, and the tail opens a window. Windows
still open at a partition's end travel with their ids and meet in groups of `merge_width` partitions, where the same
packer runs again, until one group is left; only that last group closes windows that are not full, at most one in all.
Memory is one batch of documents and the open windows; a merge level gets at most
merge_width * open_windows * window ids in a task.

Ids come from an encoder built from the tokenizers JSON file; very long texts go through `bpe.Bpe`, which holds a long
text in runs. Each document is followed by the id `end_id`.

Defined results: a null or empty text is the one id end_id; repeated rows are packed each; an empty table gives no
rows; null ids are carried; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm import bpe
from statloom.llm.common import shared_table, slices, small_batches

#: One batch of output rows.
ROWS = 20_000
#: sequence_id holds the merge level, the partition and a running number.
LEVEL_BIT, PART_BIT = 58, 34

_encoders: dict[int, tuple] = {}


def encoder(spec: bytes) -> tuple:
    """(fast encoder, encoder for very long texts) of a worker process."""
    key = zlib.crc32(spec)
    if key not in _encoders:
        exact = bpe.load(spec)
        ranks = {b: i for i, b in enumerate(exact.pieces) if b and i not in set(exact.special.values())}
        _encoders[key] = tiktoken.Encoding("own", pat_str=bpe.SPLIT, mergeable_ranks=ranks, special_tokens=exact.special), exact
    return _encoders[key]


def encode(encoders: tuple, text: str | None) -> np.ndarray:
    fast, exact = encoders
    if not text:
        return np.empty(0, "<u4")
    if len(text) > bpe.LONG_TEXT:
        return np.frombuffer(exact.encode_batch([text])[0], "<u4")
    return fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)


class Packer:
    """Bounded-space best fit over pieces (doc_id, start, ids, doc_tokens)."""

    def __init__(self, window: int, open_windows: int, first_id: int):
        self.window, self.most, self.next_id = window, open_windows, first_id
        self.open: list[tuple[int, list]] = []
        self.out: list[tuple] = []

    def add(self, doc_id, start: int, ids: np.ndarray, doc_tokens: int) -> None:
        at, n, w = 0, len(ids), self.window
        while n - at >= w:
            self._emit([(doc_id, start + at, ids[at : at + w], doc_tokens)])
            at += w
        if at == n:
            return
        rest = n - at
        fits = [i for i, (fill, _) in enumerate(self.open) if fill + rest <= w]
        if fits:
            i = max(fits, key=lambda k: self.open[k][0])
        elif len(self.open) < self.most:
            self.open.append((0, []))
            i = len(self.open) - 1
        else:
            i = max(range(len(self.open)), key=lambda k: self.open[k][0])
            fill, pieces = self.open.pop(i)
            cut = w - fill
            self._emit([*pieces, (doc_id, start + at, ids[at : at + cut], doc_tokens)])
            at += cut
            self.open.append((0, []))
            i = len(self.open) - 1
        fill, pieces = self.open[i]
        pieces.append((doc_id, start + at, ids[at:], doc_tokens))
        fill += n - at
        if fill == w:
            self.open.pop(i)
            self._emit(pieces)
        else:
            self.open[i] = fill, pieces

    def _emit(self, pieces: list) -> None:
        offset = 0
        for doc_id, start, ids, doc_tokens in pieces:
            self.out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), doc_tokens, self.next_id, offset, None))
            offset += len(ids)
        self.next_id += 1

    def leftovers(self) -> list[tuple]:
        """Pieces of the open windows, with their ids, for a merge."""
        rows = [(d, s, len(ids), None, n, k, j, ids.astype("<u4").tobytes()) for k, (_, pieces) in enumerate(self.open) for j, (d, s, ids, n) in enumerate(pieces)]
        self.open = []
        return rows

    def close(self) -> None:
        """The last merge: fill windows one after the other; only the last one may stay short."""
        pieces = [p for _, each in sorted(self.open, key=lambda o: -o[0]) for p in each]
        self.open = []
        held, fill = [], 0
        for doc_id, start, ids, doc_tokens in pieces:
            while len(ids):
                take = min(len(ids), self.window - fill)
                held.append((doc_id, start, ids[:take], doc_tokens))
                start, ids, fill = start + take, ids[take:], fill + take
                if fill == self.window:
                    self._emit(held)
                    held, fill = [], 0
        if held:
            self._emit(held)


def pack(
    df: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 1024,
    open_windows: int = 8,
    end_id: int = 0,
    merge_width: int = 64,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    with open(tokenizer, "rb") as f:
        raw = f.read()
    small_batches(df.sparkSession)
    spec = df.sparkSession.sparkContext.broadcast(raw)
    id_type = df.select(F.col(id_col)).schema[0].dataType.simpleString()
    schema = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"

    def rows(found: list[tuple], types: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) if found else [[] for _ in types]
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, types, strict=True)], schema=types)

    def arrow_types() -> pa.Schema:
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import _parse_datatype_string

        return to_arrow_schema(_parse_datatype_string(schema))

    types = arrow_types()
    end = np.array([end_id], "<u4")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(window, open_windows, TaskContext.get().partitionId() << PART_BIT)
        encoders = encoder(spec.value)
        for batch in batches:
            for part in slices(batch):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.concatenate([encode(encoders, text), end])
                    packer.add(doc_id, 0, ids, len(ids))
                    if len(packer.out) >= ROWS:
                        yield rows(packer.out, types)
                        packer.out = []
        part_id = TaskContext.get().partitionId()
        yield rows(packer.out + [(*r[:5], part_id, *r[6:]) for r in packer.leftovers()], types)

    def merge(level: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part_id = TaskContext.get().partitionId()
            packer = Packer(window, open_windows, (level << LEVEL_BIT) + (part_id << PART_BIT))
            for batch in batches:
                for d, s, n, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")), strict=True):
                    packer.add(d, s, np.frombuffer(ids, "<u4"), n)
            if last:
                packer.close()
            yield rows(packer.out + [(*r[:5], part_id, *r[6:]) for r in packer.leftovers()], types)

        return run

    table = shared_table(df.select(F.col(id_col), F.col(text_col)).mapInArrow(first, schema), "packed")
    done, level = [], 0
    while True:
        done.append(table.where(F.col("ids").isNull()))
        left = table.where(F.col("ids").isNotNull())
        highest = left.agg(F.max("sequence_id")).first()[0]
        if highest is None:
            break
        level += 1
        groups = -(-(highest + 1) // merge_width)
        # Here sequence_id is the partition that left the piece and offset its place in a window.
        meet = left.withColumn("grp", F.floor(F.col("sequence_id") / merge_width)).repartition(groups, "grp")
        meet = meet.sortWithinPartitions("sequence_id", F.desc(F.octet_length("ids")), "doc_id", "start").drop("grp")
        table = shared_table(meet.mapInArrow(merge(level, groups == 1), schema), "packed")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("ids")
