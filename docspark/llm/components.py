"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.session import stored


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root) for every node of a link, root = least node reachable.

    Each round, every node points at its least neighbour, pointers are
    followed twice, and links are rewritten between the nodes pointed at. A
    round keeps the least node of each component in place and at least halves
    the other nodes, so rounds grow with the logarithm of a component's
    size. Pointers are plain minima, combined before the shuffle, and every
    join has one row per node on one side, so a node with very many links is
    split by adaptive execution. Each round is written to the shared folder.
    """
    edges = stored(
        links.select(F.col(left).alias("u"), F.col(right).alias("v"))
        .filter("u <> v").distinct(), "links")
    labels: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        nearest = stored(
            both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("p")), "pointers")
        second = nearest.select(F.col("u").alias("p"), F.col("p").alias("q"))
        jumped = stored(nearest.join(second, "p").select("u", F.col("q").alias("p")), "pointers")
        if labels is None:
            labels = jumped.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            step = jumped.select(F.col("u").alias("root"), "p")
            labels = stored(
                labels.join(step, "root", "left")
                .select("node", F.coalesce("p", "root").alias("root")), "labels")
        left_end = jumped.select("u", F.col("p").alias("pu"))
        right_end = jumped.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        edges = stored(
            edges.join(left_end, "u").join(right_end, "v")
            .filter("pu <> pv")
            .select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v"))
            .distinct(), "links")
    if labels is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return labels
