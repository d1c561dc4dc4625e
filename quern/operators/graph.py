"""Connected components of an undirected graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.skew import lookup_join
from quern.session import cut


def islands(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, island): each node with the least id it is connected to.

    nodes: (id); pairs: (a, b) in any direction, repeats and loops allowed.
    Alternating star operations: edges are rewired towards the least
    neighbour, first from the greater side, then from the lesser, until
    nothing changes; the number of rounds grows with the logarithm of the
    nodes, whatever the diameter. A node with very many neighbours is
    aggregated before its minimum is joined back, and that join sets such
    nodes apart. Nodes without edges are islands of their own.
    """
    pairs = pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = cut(pairs)
    before, n = None, edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = lookup_join(both.where("b > a"), least, "a", "inner", 2 * n).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = lookup_join(large, least, "a", "inner", 2 * n)
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        edges = cut(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            break
        before, n = now, now[0]
    labels = edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("_island"))
    return nodes.select("id").distinct().join(labels, "id", "left").select("id", F.coalesce("_island", "id").alias("island"))
