"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import drop_tables, shared_table


#: A node has to have more edges than this to be a hub.
HUB = 100_000


def _with_lowest(pairs: DataFrame, edges: int, hub: int) -> DataFrame:
    """(u, v, m): m is the lowest v of each u.

    The rows of a node with more than `hub` edges stay where they are: there are at most edges / hub such nodes, so they are
    broadcast. Fewer edges have no hub.
    """
    lowest = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    if edges <= hub:
        return pairs.join(lowest.drop("n"), "u")
    hubs = lowest.where(F.col("n") > hub).select(F.col("u").alias("hub"), "m")
    marked = pairs.join(F.broadcast(hubs), F.col("u") == F.col("hub"), "left")
    others = marked.where(F.col("hub").isNull()).select("u", "v").join(lowest.drop("n"), "u")
    return others.unionByName(marked.where(F.col("hub").isNotNull()).select("u", "v", "m"))


def connected_components(edges: DataFrame, hub: int | None = None) -> DataFrame:
    """(id, component) for every id in edges (a, b); component is the smallest id that it reaches.

    Each step hangs neighbours under the smallest one, so hubs lose edges instead of gathering them; the number of
    steps grows with the logarithm of the graph's size. Only two sums reach the driver. Null ids take no part. Nodes with
    more edges than `hub` are broadcast: by default so many that there are at most four of them to a shuffle partition.
    """
    spread = 4 * max(1, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    pairs = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, mark = shared_table(pairs, "edges"), None
    while True:
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if tuple(found) == mark or not found[0]:
            break
        mark, last = tuple(found), now
        most = hub or max(HUB, 2 * found[0] // spread)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = _with_lowest(both, 2 * found[0], most).withColumn("m", F.least("u", "m"))
        large = lowest.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _with_lowest(large, 2 * found[0], most)
        hung = small.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = shared_table(hung.unionByName(large.groupBy("u").agg(F.min("v").alias("v"))).distinct(), "edges")
        drop_tables([last])
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
