"""Connected components of a graph in tables, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import staged

MAX_ROUNDS = 60


def _links(edges: DataFrame, label: str, rows: int | None) -> tuple[DataFrame, tuple]:
    out = staged(edges.where("u <> v").distinct(), label, rows)
    mark = out.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
    return out, tuple(mark)


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root) for each node of ``edges`` (u, v; any one orderable type): root is the smallest node of its component.

    Each round joins edges with minima that are staged tables, so a hub's edges can be split among tasks, and its result
    is staged: a lost executor costs one round's tasks at most. Nothing but a count and a checksum goes to the driver. The
    count, and ``rows`` for the first table (about how many edges there are at most), say how many tasks write a table.
    """
    links, mark = _links(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "links", rows)
    for _ in range(MAX_ROUNDS):
        if not mark[0]:
            break
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "lowest", 2 * mark[0])
        large, (n, _) = _links(both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large-star", mark[0])
        lowest = staged(large.groupBy("u").agg(F.min("v").alias("m")), "lowest", n)
        pairs = large.join(lowest, "u")
        small = pairs.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v")))
        links, new = _links(small, "small-star", 2 * n)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = links.groupBy(F.col("v").alias("node")).agg(F.col("v").alias("root"))
    return links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(roots)
