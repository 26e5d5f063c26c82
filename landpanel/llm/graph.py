"""Connected components of a table of links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, cut


def undirected(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of `edges` (a, b), the component being its smallest id.

    Each round maps every id to the one of itself and its neighbours that comes first in a scattered order, and that in
    turn to where it is mapped, and links what the ends of the remaining links were mapped to. An id chosen by none of
    its neighbours disappears, so the links run out after a number of rounds about the logarithm of the largest
    component. Hubs of stars are grouped with map-side combining; each round is cut to the shared folder.
    """
    left, maps = cut(undirected(edges)), []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(F.xxhash64("b")).alias("h"), F.min_by("b", F.xxhash64("b")).alias("b"))
        first = first.select(F.col("a").alias("id"), F.when(F.col("h") < F.xxhash64("a"), F.col("b")).otherwise(F.col("a")).alias("to"))
        to = cut(first.join(first.select(F.col("id").alias("to"), F.col("to").alias("next")), "to").select("id", F.col("next").alias("to")))
        maps.append(to)
        ends = left.join(to.select(F.col("id").alias("a"), F.col("to").alias("ta")), "a").join(to.select(F.col("id").alias("b"), F.col("to").alias("tb")), "b")
        left = cut(undirected(ends.select(F.col("ta").alias("a"), F.col("tb").alias("b"))))
    if not maps:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    found = maps[0]
    for later in maps[1:]:
        found = found.join(later.select(F.col("id").alias("to"), F.col("to").alias("next")), "to", "left").select("id", F.coalesce("next", "to").alias("to"))
    found = cut(found)
    names = cut(found.groupBy("to").agg(F.min("id").alias("component")))
    return attach(found, names, ["to"]).select("id", "component")
