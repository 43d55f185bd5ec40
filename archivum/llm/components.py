"""Connected components of an edge table, by repeated contraction.

Vertices are integers. Repeated edges and edges in both directions count once; an edge from a vertex to
itself and one with a null end link nothing, and a vertex that has no other edge isn't in the result. Other
columns are not read, ties of hashes go to the smaller vertex, and no edges give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, written

#: Times that pointers are doubled in a round.
HOPS = 2
#: Rounds whose labels are put together in one plan.
TOGETHER = 4


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` has columns a and b. Returns (v, c): every vertex that has an edge, and a vertex
    that stands for its component.

    In each round every vertex joins the vertex with the smallest hash among those at most two edges away (itself
    included), under another hash each round, and pointers are followed four steps; the edges between what remains go
    to the next round. On a path a fifth of the vertices remains, elsewhere fewer, so rounds grow
    with the logarithm of the input. Each round writes its labels and what remains, and the labels of all
    rounds are followed at the end; nothing but whether edges are left reaches the driver."""
    cur = written(edges.where("a <> b").select("a", "b").distinct())
    steps: list[DataFrame] = []
    while not cur.isEmpty():
        both = cur.select("a", "b").union(cur.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(len(steps))).alias("h"), F.col(c).alias("x"))
        near = both.groupBy("a").agg(F.min(rank("b")).alias("best")).select(F.col("a").alias("b"), F.least(rank("a"), "best").alias("best"))
        step = written(both.join(near, "b").groupBy("a").agg(F.min("best").alias("best")).select(F.col("a").alias("v"), F.col("best.x").alias("c")))
        direct = step
        for _ in range(HOPS):  # follow the vertices chosen, so that chains fall together at once
            step = step.join(step.select(F.col("v").alias("c"), F.col("c").alias("c2")), "c").select("v", F.col("c2").alias("c"))
        steps.append(written(step))
        ends = lambda k: steps[-1].select(F.col("v").alias(k), F.col("c").alias(f"c{k}"))
        left = cur.join(ends("a"), "a").join(ends("b"), "b").where("ca <> cb")
        spent, cur = cur, written(left.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct())
        removed(spent, direct)
    if not steps:
        return cur.select(F.col("a").alias("v"), F.col("b").alias("c"))
    label = steps[0]
    for i, step in enumerate(steps[1:], 1):
        label = label.join(step.select(F.col("v").alias("c"), F.col("c").alias("c2")), "c", "left").select("v", F.coalesce("c2", "c").alias("c"))
        if i % TOGETHER == 0 or i == len(steps) - 1:
            label = written(label)
    removed(*steps[1:])
    return label
