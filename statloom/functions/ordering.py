"""Row positions and neighbours in key order without a global sort in one task.

The order is cut into ranges at keys of a small random sample, whatever the types of the keys: a row's range is found by
binary search over the cuts, on all keys together, so ties of the first key don't gather. Each range is numbered by a window
of its own and shifted by the rows before it; range sizes are the only figures that reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

BUCKET = "__bucket"
#: Sampled keys to a range.
SAMPLED = 50

Keys = list[tuple[str, bool]]


def _order(keys: Keys) -> list[Column]:
    return [F.col(f"`{c}`").asc() if up else F.col(f"`{c}`").desc() for c, up in keys]


def _cuts(df: DataFrame, keys: Keys, n: int) -> list[Row]:
    """At most n - 1 rows of the keys that cut the order into ranges."""
    rows = df.count() if n > 1 else 0
    if rows < 2:
        return []
    fields = [F.col(f"`{c}`").alias(f"k{i}") for i, (c, _) in enumerate(keys)]
    drawn = df.select(*fields).sample(min(1.0, SAMPLED * n / rows), seed=1)
    ranked = [(f"k{i}", up) for i, (_, up) in enumerate(keys)]
    found = drawn.orderBy(*_order(ranked)).collect()
    return found[len(found) // n :: max(1, len(found) // n)][: n - 1]


def bucketed(df: DataFrame, key: str | Keys, buckets: int | None = None) -> DataFrame:
    """df with BUCKET, the number of the row's range in the order of the key or the (column, ascending) pairs.

    Nulls come first ascending and last descending, NaN the other way round.
    """
    keys = [(key, True)] if isinstance(key, str) else key
    n = buckets or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    cuts = _cuts(df, keys, n)
    if not cuts:
        return df.withColumn(BUCKET, F.lit(0))
    kinds = [df.schema[c].dataType for c, _ in keys]
    listed = F.array(*(F.struct(*(F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(r, kinds, strict=True)))) for r in cuts))
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))))

    def reached(cut: Column) -> Column:
        """The row comes after the cut, or at it."""
        out = F.lit(True)
        for i, (c, up) in reversed(list(enumerate(keys))):
            mine, theirs = F.struct(F.col(f"`{c}`").alias("v")), F.struct(cut[f"k{i}"].alias("v"))
            out = (mine > theirs if up else mine < theirs) | ((mine == theirs) & out)
        return out

    def step(at: Column, by: Column) -> Column:
        to = at + by
        return F.when(to > len(cuts), at).when(reached(F.element_at(listed, F.least(to, F.lit(len(cuts))))), to).otherwise(at)

    return df.withColumn(BUCKET, F.aggregate(steps, F.lit(0), step))


def with_position(df: DataFrame, key: str | Keys, name: str, buckets: int | None = None) -> DataFrame:
    """Adds name, the 0-based position (long) in the order of the key, or of (column, ascending) pairs.

    Sizes of the ranges are counted when the plan is built.
    """
    keys = [(key, True)] if isinstance(key, str) else key
    parts = bucketed(df, keys, buckets)
    sizes = dict(parts.groupBy(BUCKET).count().collect())
    starts, before = [], 0
    for b in range(max(sizes, default=0) + 1):
        starts.append(F.lit(before).cast("long"))
        before += sizes.get(b, 0)
    inside = F.row_number().over(Window.partitionBy(BUCKET).orderBy(*_order(keys))) - 1
    return parts.withColumn(name, inside + F.element_at(F.array(*starts), F.col(BUCKET) + 1)).drop(BUCKET)


def squared_steps(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row: n, sum of squares and sum of squared differences of neighbours in key order."""
    parts = bucketed(df.select(key, value), key)
    lag = F.lag(value).over(Window.partitionBy(BUCKET).orderBy(key))
    inner = parts.withColumn("__step", F.col(value) - lag).groupBy(BUCKET).agg(
        F.count("*").alias("n"),
        F.sum(F.col(value) * F.col(value)).alias("ss"),
        F.coalesce(F.sum(F.col("__step") * F.col("__step")), F.lit(0.0)).alias("sd"),
        F.min_by(value, key).alias("__first"),
        F.max_by(value, key).alias("__last"),
    )
    edge = F.col("__first") - F.lag("__last").over(Window.orderBy(BUCKET))
    ends = inner.withColumn("__edge", F.coalesce(edge, F.lit(0.0)))  # one row a range
    return ends.agg(F.sum("n").alias("n"), F.sum("ss").alias("ss"), F.sum(F.col("sd") + F.col("__edge") * F.col("__edge")).alias("sd"))
