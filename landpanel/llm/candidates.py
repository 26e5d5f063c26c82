"""What shares a key, compared without pairs of all: hubs first, then blocks of what the hubs leave open.

Near duplicates and near lines both give keys (key, id) such that ids that are linked share a key. `connect` finds the
components of the true links.

1. Keys held by the same ids are one set of ids, named by its size, smallest id and two digests; it is looked at once.
2. Every id is checked against the smallest id of each of its sets, its hub. These are at most as many pairs as rows.
3. A set whose ids now stand in one component is finished: more links would change nothing. In the others, what is not in
   the hub's component is compared with all of the set. Both parts are cut into blocks; two blocks of one set, at least
   one of them of ids apart from the hub, are a task's unit of work. Blocks of ids that the hub connects never meet.

So no chain of sets is ever put together before its links are verified, a set is never in one task, and no set is too
large. Results are links only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, cut
from .graph import components

BLOCK, BLOCKS = 96, 32


def sets(keys: DataFrame) -> DataFrame:
    """(key, hub): one key for each different set of two or more ids, and the set's smallest; sums combine before the shuffle."""
    digests = [F.bit_xor(F.xxhash64(F.lit(k), "id")).alias(f"s{k}") for k in (1, 2)]
    same = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("hub"), *digests).where(F.col("n") > 1)
    return same.groupBy("n", "hub", "s1", "s2").agg(F.min("key").alias("key")).select("key", "hub")


def blocks(members: DataFrame, weights: DataFrame, block: int, heavy: int) -> DataFrame:
    """(grp, blk, apart, nb, id, component): members (key, id, component, hub) of open sets, dealt to blocks.

    Blocks 0 to apart - 1 hold the ids that are not in the hub's component, those up to nb - 1 the others.
    """
    m = cut(attach(members, weights, ["id"]).withColumn("apart", F.col("component") != F.col("hub")))
    sizes = m.groupBy("key", "apart").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    each = F.greatest(F.lit(block), F.least(F.ceil(F.col("n") / BLOCKS), F.lit(20 * block)))
    need = F.greatest(F.ceil(F.col("n") / each), F.ceil(F.col("w") / heavy)).cast("int")
    sizes = sizes.withColumn("nb", need).groupBy("key").agg(F.max(F.when(F.col("apart"), F.col("nb"))).alias("r"), F.max(F.when(~F.col("apart"), F.col("nb"))).alias("l"))
    m = attach(m, cut(sizes), ["key"])
    at = F.xxhash64("id")
    blk = F.when(F.col("apart"), F.pmod(at, F.col("r"))).otherwise(F.col("r") + F.pmod(at, F.col("l")))
    return m.select(F.col("key").alias("grp"), blk.cast("int").alias("blk"), F.col("r").alias("apart"), (F.col("r") + F.col("l")).alias("nb"), "id", "component")


def tiles(packed: DataFrame) -> DataFrame:
    """Each packed block once for every block that it has to meet, with the numbers i < j of the two."""
    last = F.when(F.col("blk") < F.col("apart"), F.col("nb")).otherwise(F.col("apart")) - 1
    t = packed.withColumn("other", F.explode(F.sequence(F.lit(0), last))).where(F.col("other") != F.col("blk"))
    return t.withColumns({"i": F.least("blk", "other"), "j": F.greatest("blk", "other")})


def connect(keys: DataFrame, weights: DataFrame, check: Callable[[DataFrame], DataFrame], search: Callable[[DataFrame], DataFrame], heavy: int, block: int = BLOCK, more: DataFrame | None = None) -> DataFrame:
    """(id, component) of all ids with a link.

    `check` keeps the true links of pairs (a, b); `search` finds links (a, b) in tiles of members as `blocks` gives
    them; `weights` has (id, weight), a block weighs `heavy` at most; `more` has links known before.
    """
    held = cut(attach(keys, cut(sets(keys)), ["key"]))
    pairs = held.where(F.col("id") != F.col("hub")).select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    found = cut(check(pairs))
    found = found if more is None else found.unionByName(more)
    known = cut(components(found))
    named = attach(held, known, ["id"], how="left").select("key", "id", F.coalesce("component", "id").alias("component"))
    # the hub is the smallest id, but its component may be a smaller one
    open_ = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min_by("component", "id").alias("hub")).where(F.col("lo") < F.col("hi"))
    open_ = cut(open_.select("key", "hub"))
    if open_.isEmpty():
        return known
    again = cut(search(blocks(attach(named, open_, ["key"]), weights, block, heavy)))
    return components(known.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(again))
