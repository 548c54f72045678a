"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("child", "parent").cast("decimal(38,0)"))).first()
    return int(row[0]), int(row[1] or 0)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The component of every node that has an edge, as (node, root); the root is the smallest node.

    Alternates two steps until nothing changes: every node links its larger neighbours, then its
    smaller ones, to the smallest node it knows (Kiveris et al., 2014). No task sees a whole component:
    the smallest neighbour is an aggregate with partial sums, and a node with very many neighbours
    meets them in a join that adaptive execution splits. Edges from a node to itself and repeated edges
    are harmless; edges with a null end are left out; without edges the result is empty.
    """
    known = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    links = known.select(F.greatest(a, b).alias("child"), F.least(a, b).alias("parent")).distinct()
    links = durable(links)
    state = _state(links)
    while True:
        both = links.unionByName(links.select(F.col("parent").alias("child"), F.col("child").alias("parent")))
        least = both.groupBy("child").agg(F.min("parent").alias("least"))
        least = least.select("child", F.least("child", "least").alias("least"))
        large = both.where("parent > child").join(least, "child")
        large = large.select(F.col("parent").alias("child"), F.col("least").alias("parent")).distinct()
        least = large.groupBy("child").agg(F.min("parent").alias("least"))
        small = large.join(least, "child").select(
            F.explode(
                F.array(
                    F.struct(F.col("parent").alias("child"), F.col("least").alias("parent")),
                    F.struct(F.col("child"), F.col("least").alias("parent")),
                )
            ).alias("link")
        )
        links = durable(small.select("link.*").where("child <> parent").distinct())
        before, state = state, _state(links)
        if state == before:
            break
    roots = links.select(F.col("parent").alias("node"), F.col("parent").alias("root")).distinct()
    return links.select(F.col("child").alias("node"), F.col("parent").alias("root")).unionByName(roots)
