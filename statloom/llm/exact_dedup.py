"""Exact deduplication with skew-safe combining, in DataFrame operations only.

Three levels, each keyed by the SHA-256 digest and the full text, so texts are compared whole at every stage:

1. local: partial aggregation inside each input partition folds its copies into one row of ids;
2. salted: rows of equal text meet per (digest, text, salt, chunk), the salt being the input partition modulo `salts` and the
   chunk a run of CHUNK_ROWS rows of a partition; a text that makes up a third of all rows is spread over many tasks, and a
   list of ids holds CHUNK_ROWS of each partition that shares its salt at the most;
3. global: only one winner per salted group travels on, so of a text that is everywhere one row in thousands does.

The winners' verdict returns to the ids by a narrow join on (digest, salt, chunk, winner), which holds one row per salted
group and so is even whatever the number of copies.

Defined results: a null text counts as empty; null ids lose to any other id; of rows that repeat both id and text
exactly one is kept; texts of any length are compared whole; an empty table gives an empty result; further columns are
ignored by `exact_dedup` and carried along by `distinct_rows`, maps included; of rows that tie in id and text the one with
the greatest further columns is kept (maps as JSON).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Rows of an input partition whose ids may meet in one list.
CHUNK_ROWS = 1 << 16


def _salt(salts: int) -> Column:
    """Salt and chunk in one number; the row number is partition * 2 ** 33 + position."""
    row = F.monotonically_increasing_id()
    return F.pmod(F.shiftright(row, 33), F.lit(salts)) * (1 << 33) + F.shiftright(row.bitwiseAND(F.lit((1 << 33) - 1)), CHUNK_ROWS.bit_length() - 1)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 4096) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256. The largest id of equal texts stays."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("t", 256))).withColumn("salt", _salt(salts))
    merged = rows.groupBy("sha", "t", "salt").agg(F.collect_list(F.struct("id")).alias("ids"))
    merged = merged.withColumn("ids", F.sort_array("ids", asc=False)).withColumn("w", F.col("ids")[0]["id"])
    same = Window.partitionBy("sha", "t")
    winners = merged.select("sha", "t", "salt", "w", F.size("ids").cast("long").alias("n"))
    verdict = winners.select(
        F.col("sha").alias("v_sha"),
        F.col("salt").alias("v_salt"),
        F.col("w").alias("v_w"),
        F.max("w").over(same).alias("keep_id"),
        F.sum("n").over(same).alias("group_size"),
        (F.row_number().over(same.orderBy(F.desc_nulls_last("w"), "salt")) == 1).alias("best"),
    )
    groups = merged.select("sha", "salt", "w", "ids")
    # Null-safe keys: an inferred IS NOT NULL would differ between the two branches and keep Spark from reusing the text shuffle.
    keys = F.col("sha").eqNullSafe(F.col("v_sha")) & F.col("salt").eqNullSafe(F.col("v_salt")) & F.col("w").eqNullSafe(F.col("v_w"))
    joined = groups.join(verdict, keys)
    each = joined.select("sha", "keep_id", "group_size", "best", F.posexplode("ids").alias("pos", "row"))
    return each.select(
        F.col("row.id").alias("doc_id"),
        "keep_id",
        "group_size",
        (F.col("best") & (F.col("pos") == 0)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind)
    return _holds_map(kind.elementType) if isinstance(kind, T.ArrayType) else isinstance(kind, T.MapType | T.VariantType)


def distinct_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 4096) -> DataFrame:
    """The kept rows with all their columns, combined by the same three levels without the ids of dropped rows."""
    others = [c for c in df.columns if c not in (id_col, text_col)]
    named = {c: f"c{i}" for i, c in enumerate(others)}
    row = F.struct(F.col(id_col).alias("id"), F.col(text_col).isNotNull().alias("has"), *(F.col(f"`{c}`").alias(a) for c, a in named.items()))
    rows = df.select(row.alias("r"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("t", 256))).withColumn("salt", _salt(salts))
    best = F.max("r")
    if any(_holds_map(df.schema[c].dataType) for c in others):  # maps have no order
        best = F.max_by("r", F.struct("r.id", "r.has", F.to_json(F.struct("r"))))
    kept = rows.groupBy("sha", "t", "salt").agg(best.alias("r")).groupBy("sha", "t").agg(best.alias("r"))
    back = {id_col: F.col("r.id"), text_col: F.when(F.col("r.has"), F.col("t"))} | {c: F.col(f"r.{a}") for c, a in named.items()}
    return kept.select(*(back[c].alias(c) for c in df.columns))
