"""Connected components of an edge table by alternating large-star and small-star rounds.

Only (long, long) rows move, and nothing but a count and a sum comes to the driver. A node's smallest neighbour is an
aggregation with partial sums, so the many edges of a large component's root meet in a join only, whose skewed side adaptive
execution splits. A round is five exchanges and is cut with a checkpoint; the exchanges of rounds past are let go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segspark.llm.common import cut, release


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges with m, the least of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def _both(a: list, b: list) -> list:
    return F.explode(F.array(*[F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in (a, b)])).alias("e")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) links to (node, root): every node of a link, and the smallest node it reaches.

    Links with a null end are ignored; loops give their node as its own root; repeats and both directions
    are fine. No rows give no rows.
    """
    e = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u is not null and v is not null")
    nodes = e.select(_both(["u", "u"], ["v", "v"])).select(F.col("e.u").alias("node")).distinct()
    # Done when nothing changed: equal counts and sums of hashes, so no join of the two sides is needed.
    mark = [F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
    e = cut(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    last = tuple(e.agg(*mark).first())
    for _ in range(max_rounds):
        # Larger neighbours to the least; then of these edges, whose u is the larger end, both ends to the least of u.
        large = _with_least(e.select(_both(["u", "v"], ["v", "u"])).select("e.*")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _with_least(large).select(_both(["v", "m"], ["u", "m"])).select("e.*").where("u <> v").distinct()
        e = cut(small)
        del large, small
        release(e.sparkSession)
        now = tuple(e.agg(*mark).first())
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
