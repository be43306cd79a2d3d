"""Consolidating pairwise matches into groups: hash-to-min.

Every vertex v keeps a cluster set C(v), stored as rows (v, u) and never as one
array.  In each round v sends its whole set to the smallest member and that
member to all others:

    m = min C(v);   (m, u) and (u, m) for every u in C(v)

until nothing changes.  Then each smallest member holds its whole component and
every other vertex holds only that member.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.session import Cut, cut


def star_edges(sets: DataFrame, set_id: str, member: str) -> DataFrame:
    """Edges (a, b) from each member to the smallest member of its set: linear in the members, no pairs."""
    ok = sets.filter(F.col(set_id).isNotNull() & F.col(member).isNotNull()).select(F.col(set_id).alias("_set"), F.col(member).alias("b")).distinct()
    hub = ok.groupBy("_set").agg(F.min("b").alias("a"))
    return ok.join(hub, "_set").filter("a <> b").select("a", "b")


def _mark(c: DataFrame) -> tuple[int, int]:
    r = c.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
    return int(r[0]), int(r[1] or 0)


def hash_to_min(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``member``, ``group_id`` (the smallest member) of every vertex with an edge to another one.

    Edges may be repeated, mirrored, loops or hold nulls (loops and nulls link
    nothing).  Vertices may be of any ordered type.  A hot vertex is never
    gathered: minima are aggregated partially and the join of a set with its
    minimum has one narrow row for each vertex, so skewed sets can be split.
    Each round is written to the shared folder, so a lost executor costs one round.
    """
    e = edges.select(F.col(a).alias("v"), F.col(b).alias("u")).filter("v is not null and u is not null and v <> u")
    # both directions and both loops in one pass, so that the edges are computed once
    four = F.array(F.struct("v", "u"), F.struct(F.col("u").alias("v"), F.col("v").alias("u")), F.struct("v", F.col("v").alias("u")), F.struct(F.col("u").alias("v"), "u"))
    now: Cut = cut(e.select(F.inline(four)).distinct(), "clusters")
    mark = _mark(now.df)
    for _ in range(max_rounds):
        low = now.df.groupBy("v").agg(F.min("u").alias("m"))
        sent = F.array(F.struct(F.col("m").alias("v"), "u"), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))
        nxt = cut(now.df.join(low, "v").select(F.inline(sent)).distinct(), "clusters")
        new = _mark(nxt.df)
        now.drop()
        now = nxt
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"groups not stable after {max_rounds} rounds")
    return now.df.groupBy(F.col("v").alias("member")).agg(F.min("u").alias("group_id"))
