"""Connected components by alternating large-star and small-star rounds on DataFrames (Kiveris et al., 2014).

Every round keeps at most one row per edge, a vertex's neighbours are only ever reduced to their minimum (so map-side
aggregation flattens hubs), a hub's edges are dealt over many tasks where they meet that minimum, and each round's edges
are written to the shared folder, which ends their lineage. The rounds end when one aggregate tells that only stars are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from brindle.llm.skew import hot_above, hot_keys, salted_join
from brindle.session import discard, materialize


def _shape(edges: DataFrame) -> tuple[int, int, int]:
    """Rows of edges (u > v), vertices that are not yet the root or a leaf of a star, and the most edges of a vertex: one pre-aggregated exchange."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("below"), F.lit(0).alias("above"))
    ends = ends.unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    each = ends.groupBy("id").agg(F.sum("below").alias("below"), F.sum("above").alias("above"))
    knot = (F.col("below") > 1) | ((F.col("below") > 0) & (F.col("above") > 0))
    r = each.agg(F.sum("below"), F.count_if(knot), F.max(F.col("below") + F.col("above"))).first()
    return r[0] or 0, r[1] or 0, r[2] or 0


def _to_least(edges: DataFrame, low: DataFrame, rows: int, hubs: bool) -> DataFrame:
    """(u, v, m): edges with the least neighbour of u; low (u, m, n) has it, and with n > rows / 500 edges u is a hub."""
    if not hubs:
        return edges.hint("merge").join(low.select("u", "m").hint("merge"), "u")
    return salted_join(edges, low.select("u", "m"), ["u"], spread=["v"], hot=hot_keys(low, ["u"], rows, "n"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (u, v) in any direction -> (id, component_id): the smallest id reachable, for every vertex with an edge to another.

    Loops, repeated edges and nulls are dropped; no edges give an empty result. Vertices without edges are not returned."""
    now = materialize(
        edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).distinct(), "cc"
    )
    rows, knots, most = _shape(now)
    rounds = 0
    while knots:
        if rounds == max_rounds:
            raise RuntimeError("connected components did not settle")
        rounds += 1
        # neither step gives a vertex more edges that are dealt out than it has now
        hubs = most > hot_above(rows)
        # large star: every larger neighbour of u is tied to the smallest of u and its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = _to_least(both.where("v > u"), low, 2 * rows, hubs).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "cc")
        # small star: u and its smaller neighbours are tied to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _to_least(large, low, rows, hubs).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "cc")
        discard(now, large)
        now = after
        rows, knots, most = _shape(now)
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    return stars.unionByName(roots)
