"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir


#: Edges (16 bytes each, 1 MB in all) that are kept in one partition, where the same steps need no shuffle.
ONE_TASK = 1 << 16


def _pairs(edges: DataFrame, *ends: tuple[str, str]) -> DataFrame:
    """For each edge, one row (u, v) for each pair of its columns; unlike a union it keeps the partitioning."""
    rows = F.array(*(F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in ends))
    return edges.select(F.explode(rows).alias("e")).select("e.*")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v) with u > v.

    Large-star joins every larger neighbour of a node to the node's least neighbour (or itself); small-star
    joins the node and its smaller neighbours to the least of them. The least neighbour is a partial
    aggregate and comes back by a join on the node, so a node of any degree is spread over tasks.
    """
    if large:
        both = _pairs(edges, ("u", "v"), ("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = _pairs(edges.join(least, "u"), ("v", "m"), ("u", "m"))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(u, v) for every node u of edges(u, v) that isn't the least of its component; v is the least.

    Edges may come in either order, repeated, or as loops; null ends are dropped. Each round is
    checkpointed to the shared folder; the loop ends when a round changes no edge. Up to `one_task` edges are kept in
    one partition (as a broadcast, but for joins and sums alike); the steps and their results are the same.
    """
    shared_dir(edges.sparkSession)
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    few = edges.count() <= one_task
    kept = (lambda df: df.coalesce(1)) if few else (lambda df: df)

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = kept(edges)
    now, before = state(edges), None
    while now != before:
        edges = kept(_star(_star(edges, large=True), large=False).checkpoint())
        now, before = state(edges), now
    return edges
