"""Connected components of an undirected graph by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rowtide.session import materialize

SALTS = 16


def _point_down(edges: DataFrame, wide: bool) -> DataFrame:
    """One star step over rows (a, b).

    Every node takes the least member of its neighbourhood as centre. The wide step links its larger
    neighbours to the centre, the narrow step its smaller neighbours and itself.
    """
    if wide:
        around = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    centre = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("c"))
    # A node with very many neighbours is served by SALTS tasks.
    salted = around.withColumn("s", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    copies = centre.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = salted.join(copies, ["a", "s"])
    linked = joined.filter("b > a" if wide else "b <> c").select(F.col("c").alias("a"), "b")
    if not wide:
        linked = linked.union(centre.filter("a <> c").select(F.col("c").alias("a"), F.col("a").alias("b")))
    return linked.filter("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node with an edge; the root is the least node of the component.

    ``edges`` holds columns a and b in any direction; loops and repeats do no harm, an empty table gives an
    empty result. Each round is written to the shared folder, so lost executors cost one round at most.
    """
    edges = materialize(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    if edges.isEmpty():
        return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    before = None
    for _ in range(max_rounds):
        edges = materialize(_point_down(materialize(_point_down(edges, True), "wide"), False), "narrow")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("bigint"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
        edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )
