"""Moments and cross products of a stream.

Each micro-batch adds one row of its count, means and centred cross products to a Parquet log, written under its batch
id: a batch that is replayed after a failure overwrites its own row. Reading combines the rows around the common mean, so
large means cost no digits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


class StreamingMoments:
    """Counts, means, standard deviations and covariances of numeric columns of an unbounded table."""

    def __init__(self, columns: list[str], path: str):
        self.columns, self.path = columns, path.rstrip("/")

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch; rows with a missing value in any column are left out."""
        x = [F.col(f"`{c}`").cast("double") for c in self.columns]
        whole = batch
        for c in x:
            whole = whole.where(c.isNotNull() & ~F.isnan(c))
        k = len(x)
        part = [F.count("*").alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(x))]
        part += [(F.covar_pop(x[i], x[j]) * F.count("*")).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]
        whole.agg(*part).where(F.col("n") > 0).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def start(self, stream: DataFrame, checkpoint: str, **options: str) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).outputMode("append")
        return writer.trigger(availableNow=True).start() if options.get("once") else writer.start()

    def read(self, spark: SparkSession) -> tuple[int, np.ndarray, np.ndarray]:
        """(rows, means, covariance matrix with ddof 1)."""
        k = len(self.columns)
        log = spark.read.parquet(self.path)
        n, *weighted = log.agg(F.sum("n"), *(F.sum(F.col(f"m{i}") * F.col("n")) for i in range(k))).first()
        n = n or 0
        means = np.array([w or 0.0 for w in weighted], float) / max(n, 1)
        off = [F.col(f"m{i}") - F.lit(float(means[i])) for i in range(k)]
        sums = [F.sum(F.col(f"c{i}_{j}") + F.col("n") * off[i] * off[j]) for i in range(k) for j in range(i, k)]
        cov = np.full((k, k), np.nan)
        if n > 1:
            found = iter(log.agg(*(c.alias(f"s{i}") for i, c in enumerate(sums))).first())
            for i in range(k):
                for j in range(i, k):
                    cov[i, j] = cov[j, i] = next(found) / (n - 1)
        return n, means, cov
