"""Connected components of a graph held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexward.llm.common import cut


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges (u, v) with m, the value that least has for u. A node with very many edges is one row of least, so its
    edges may be split among tasks; a window would keep them in one."""
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    up = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return _with_least(up, least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    met = _with_least(down, down.groupBy("u").agg(F.min("v").alias("m")))
    links = met.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
    return links.select("e.u", "e.v").where("u <> v").distinct()


def components(edges: DataFrame) -> tuple[DataFrame, int]:
    """(node, root), root being the least node of its component, for all nodes but the roots; and its rows.

    edges has two BIGINT columns u and v. Alternating stars take a number of rounds that grows with the
    logarithm of the size; each round's edges are written to the checkpoint folder.
    """
    now = cut(edges.where("u <> v").select("u", "v").distinct())
    seen = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if mark == seen or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")), mark[0]
        seen, now = mark, cut(_small_star(_large_star(now)))
