"""Connected components of a table of links, by alternating large and small stars.

Each round is joins and aggregations on node ids; hubs are joined as skewed keys and aggregated before the shuffle. No
links, nodes or components pass through the driver; only a count and a checksum do, to see when nothing changes.

Defined results: links of a node with itself and those with a null end are ignored; repeated links count once; without
links there are no rows; further columns are ignored. The rounds grow with the logarithm of the longest chain; where
`max_rounds` are not enough the result would be wrong, and an error is raised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, written


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) for every node that has a link; component is the smallest node reached. edges: u, v bigint."""
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = _mark(edges)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        around = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = written(both.join(around, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        old, edges = edges, written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        discard(old, around, large, least)
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components are not found after {max_rounds} rounds")
    pairs = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
