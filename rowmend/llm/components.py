"""Connected components of a link table by alternating large and small stars.

Kiveris et al., "Connected Components in MapReduce and Beyond". A round is a few joins and
aggregates over the links; the smallest neighbour of a node is pre-aggregated in the map
tasks, and a hub's links are only ever the large side of a join, which Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmend.sources.workspace import remove, written


def fingerprint(links: DataFrame) -> tuple:
    """Equal for equal sets of links."""
    key = F.xxhash64("node", "root")
    return tuple(links.agg(F.count("*"), F.bit_xor(key), F.sum((key % 1_000_003).cast("long"))).first())


def large_star(links: DataFrame) -> DataFrame:
    """Connect every larger neighbour of a node to the smallest in its neighbourhood."""
    both = links.unionByName(links.select(F.col("root").alias("node"), F.col("node").alias("root")))
    least = both.groupBy("node").agg(F.least(F.min("root"), F.col("node")).alias("least"))
    larger = links.select(F.col("node").alias("far"), F.col("root").alias("node"))
    return larger.join(least, "node").select(F.col("far").alias("node"), F.col("least").alias("root"))


def small_star(links: DataFrame) -> DataFrame:
    """Connect a node and its smaller neighbours to the smallest of them."""
    least = links.groupBy("node").agg(F.min("root").alias("least"))
    joined = links.join(least, "node")
    near = joined.select(F.col("root").alias("node"), F.col("least").alias("root"))
    return near.unionByName(least.select("node", F.col("least").alias("root")))


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with a link; root is the smallest node it reaches.

    Rows with a null end and links of a node with itself are ignored; repeated links and
    either direction are the same; no link gives no row. The node type must be ordered.
    Intermediate tables are written to the shared folder, and deleted once replaced.
    """
    tidy = links.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root"))
    tidy = tidy.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("node") > F.col("root")))
    current = written(tidy.distinct(), "links")
    before, after = None, fingerprint(current)
    while after[0] and before != after:
        starred = small_star(large_star(current).where("node > root").distinct())
        following = written(starred.where("node > root").distinct(), "links")
        remove(current.sparkSession, folder_of(current))
        current = following
        before, after = after, fingerprint(current)
    return current


def folder_of(table: DataFrame) -> str:
    return table.inputFiles()[0].rsplit("/", 1)[0] if table.inputFiles() else ""
