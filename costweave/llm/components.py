"""Connected components of a link table, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from costweave.llm.shared import removed, written


def _to_smallest(links: DataFrame, smaller: bool) -> DataFrame:
    """Moves each node's neighbours (the larger ones, or with ``smaller`` itself and the smaller
    ones) to the smallest node it knows."""
    if smaller:
        near = links.select(F.greatest("a", "b").alias("n"), F.least("a", "b").alias("v"))
    else:
        near = links.select(F.col("a").alias("n"), F.col("b").alias("v")).union(
            links.select(F.col("b").alias("n"), F.col("a").alias("v")))
    least = near.groupBy("n").agg(F.least(F.min("v"), F.first("n")).alias("m"))
    moved = near.join(least, "n")
    if smaller:
        out = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    else:
        out = moved.where("v > n").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def connected(links: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for every node of links (a, b).

    Alternates two star operations (Kiveris et al., 2014): the links of a component turn into a
    star around its smallest node in a number of rounds that grows with the logarithm of its
    size. Each round is written, so lineage stays short, and the one before it removed. Links of a
    node to itself and repeats do no harm; an empty table gives no rows.
    """
    spark = links.sparkSession
    state = written(links.where("a <> b").distinct(), "round")
    mark = None
    while True:
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark, before = now, state.inputFiles()
        state = written(_to_smallest(_to_smallest(state, smaller=False), smaller=True), "round")
        if before:
            removed(spark, before[0].rsplit("/", 1)[0])
    roots = state.select(F.col("b").alias("node")).distinct()
    return (state.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .union(roots.select("node", F.col("node").alias("root"))))
