"""Cross products of design columns, in one pass over the data.

Up to SUM_COLUMNS columns every product is a sum in one hash aggregate inside whole-stage codegen. Wider designs sum
blocks in numpy per partition (mapInArrow) and add the partial matrices by cell. Ill-conditioned designs go through a
tall-skinny QR: each partition gives the R factor of its rows, the driver stacks and factors them again, so the
condition number isn't squared. Only matrices of p + 1 rows and columns reach the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUM_COLUMNS = 40
#: R factors are merged in groups of this many partitions before the driver sees them.
MERGE = 64


def cross_products(df: DataFrame, z: list[Column], weight: Column | None = None) -> np.ndarray:
    """Sums of weight * z_i * z_j as a symmetric matrix."""
    k = len(z)
    if k <= SUM_COLUMNS:
        w = F.lit(1.0) if weight is None else weight
        cells = [(i, j) for i in range(k) for j in range(i, k)]
        row = df.agg(*(F.sum(w * z[i] * z[j]).alias(f"s{i}_{j}") for i, j in cells)).first()
        out = np.zeros((k, k))
        for (i, j), v in zip(cells, row, strict=True):
            out[i, j] = out[j, i] = np.nan if v is None else v
        return out
    wide = df.select(*(c.alias(f"z{i}") for i, c in enumerate(z)), (F.lit(1.0) if weight is None else weight).alias("w"))

    def partial(batches):
        total = np.zeros((k, k))
        for b in batches:
            m = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(k + 1)])
            total += (m[:, :k] * m[:, k:]).T @ m[:, :k]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.ravel())], names=["cell", "v"])

    summed = wide.mapInArrow(partial, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(k * k)
    out[summed["cell"]] = summed["v"]
    return out.reshape(k, k)


def r_factor(df: DataFrame, z: list[Column]) -> np.ndarray:
    """The R factor of the rows of z, by tall-skinny QR."""
    k = len(z)
    wide = df.select(*(c.alias(f"z{i}") for i, c in enumerate(z)))

    def factor(batches):
        r = np.zeros((0, k))
        for b in batches:
            m = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(k)])
            r = np.linalg.qr(np.vstack([r, m]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array(r[:, i]) for i in range(k)], names=[f"z{i}" for i in range(k)])

    schema = ", ".join(f"z{i} double" for i in range(k))
    parts = wide.mapInArrow(factor, schema)
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")) // MERGE)
    parts = parts.repartition(n).mapInArrow(factor, schema)
    rows = parts.toPandas().to_numpy()
    return np.linalg.qr(rows, mode="r") if len(rows) else np.zeros((0, k))
