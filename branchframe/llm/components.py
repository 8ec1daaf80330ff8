"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round groups the edges by node (a partial minimum, then a join that AQE can split), so
neither a hub nor a large component is ever gathered in one task or on the driver. The driver
sees three numbers a round, to tell whether the edges still change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from branchframe.llm.common import discard, materialise


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of u to the least of u and its neighbours."""
    around = _both_ways(edges)
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return around.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link u and its smaller neighbours to the least of them. Edges come as u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.min("v")).first()
    return tuple(row)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges(u, v)``: root is the least node of its component.

    Self loops and repeated edges are allowed; null ends are dropped; an empty table gives an
    empty table. Raises RuntimeError if the rounds don't suffice (they grow with the logarithm
    of the longest path).
    """
    kind = edges.schema["u"].dataType.simpleString()
    tidy = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    now = materialise(tidy, "edges")
    state = _state(now)
    for _ in range(rounds):
        if state[0] == 0:
            break
        nxt = materialise(_small_star(_large_star(now).filter("u <> v").distinct()).filter("u <> v").distinct(), "edges")
        new = _state(nxt)
        discard(now)
        now = nxt
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("connected components need more rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    out = now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots).select(F.col("node").cast(kind), F.col("root").cast(kind))
    out.shared_path = now.shared_path  # what discard() deletes when the roots have been read
    return out
