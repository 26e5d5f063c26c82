"""Operator 11: ranked lexical search by pipelined term partitioning.

1. Index. A block of documents (a shard, at most `SHARD` rows) is read at once and gives, for each of its terms, the slots
   of the documents that hold it and how often. Nothing is shuffled.
2. Owners. Terms are owned by the stage of their rarity, the rarest by the first. An owner's postings are dealt to bundles
   of items and to shards; each cell carries the weights that the bundle's items give to its term.
3. Pipeline. For each bundle and shard a carrier holds sparse accumulators (item, slot, score so far). It meets the
   postings of one owner after another by cogroup, and each owner adds its integer contributions. Frequent terms, which
   reach nearly all documents, are owned by the last stage, so the accumulators are small while they travel. They are
   never cut.
4. Selection. The last owner gives the k best of its shard for each item; a window takes the k best of these.

No task holds more than a shard's accumulators of a bundle (`ITEMS` x `SHARD` integers) and one owner's postings in it.

Defined results: null texts have no terms; documents without terms count neither in N nor in L and are never found; rows with
equal doc_id are documents of their own, a null doc_id comes after all others at equal scores; rows with equal item_id are one
item with the terms of all; items without known terms have no rows; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, by_blocks, cut, row_bytes, text_or_empty

SHARD, ITEMS, OWNERS = 4096, 128, 4

#: A-Z become a-z; ASCII characters that are neither letters nor digits become spaces; other bytes stay.
_TERM = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))

_CARRIER = "bundle bigint, shard bigint, items array<bigint>, docs array<bigint>, m array<bigint>, at binary, score binary"
_HIT = "item_id bigint, doc_id bigint, score bigint"


def terms(text: str) -> list[bytes]:
    """The terms of a text in UTF-8: no byte of a character beyond ASCII is an ASCII byte."""
    return text.encode().translate(_TERM).split()


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, term, q): how often an item holds a term."""

    def block(rows):
        return [(i, t.decode(), q) for i, text in rows for t, q in Counter(terms(text)).items()]

    rows = items.select(F.col(id_col).cast("bigint").alias("item_id"), text_or_empty(text_col).alias("text"))
    return by_blocks(rows, ["item_id", "text"], "item_id bigint, term string, q bigint", block).groupBy("item_id", "term").agg(F.sum("q").alias("q"))


def postings(docs: DataFrame, asked: DataFrame, id_col: str, text_col: str, most: int = 2_000_000) -> DataFrame:
    """(shard, term, slots, tfs) of the terms `asked`, and a row without term for each shard: docs, the ids, and ns, their terms.

    If the terms asked take at most `most` bytes they go to the tasks; else all postings are joined to them.
    """
    n, held = asked.select(row_bytes(asked).alias("b")).limit(most // 8 + 1).agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0))).first()
    few = n <= most // 8 and held <= most
    sc = docs.sparkSession.sparkContext
    wanted = sc.broadcast(frozenset(r.term.encode() for r in asked.collect())) if few else None
    made: dict = {}

    def block(rows):
        from pyspark import TaskContext

        task = TaskContext.get()
        made[task.taskAttemptId()] = k = made.get(task.taskAttemptId(), -1) + 1
        shard, lists, ns = (task.partitionId() << 33) + k, {}, []
        keep = wanted.value.__contains__ if wanted else None
        for slot, (_, text) in enumerate(rows):
            found = terms(text)
            ns.append(len(found))
            for t, tf in Counter(filter(keep, found) if keep else found).items():
                at = lists.setdefault(t, ([], []))
                at[0].append(slot)
                at[1].append(tf)
        out = [(shard, None, None, None, [d for d, _ in rows], ns)]
        return out + [(shard, t.decode(), np.array(a, "<u2").tobytes(), np.array(b, "<u4").tobytes(), None, None) for t, (a, b) in lists.items()]

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
    found = by_blocks(rows, ["doc_id", "text"], "shard bigint, term string, slots binary, tfs binary, docs array<bigint>, ns array<bigint>", block, rows=SHARD, chars=32_000_000)
    return cut(found if few else found.join(asked.withColumn("_asked", F.lit(True)), "term", "left").where("term IS NULL OR _asked").drop("_asked").select(found.columns))


def _add(last: bool, k: int):
    """One owner's stage for one bundle and shard: the carrier (left) and the owner's cells (right)."""

    def run(left, right):
        import pyarrow as pa

        row = left.slice(0, 1).to_pylist()[0]
        m = np.array(row["m"], np.int64)
        acc = np.zeros((len(row["items"]), len(m)), np.int64)
        acc.reshape(-1)[np.frombuffer(row["at"], "<u4")] = np.frombuffer(row["score"], "<i8")
        for slots, tfs, uses in zip(*(right.column(c).to_pylist() for c in ("slots", "tfs", "uses")), strict=True):
            slot, tf = np.frombuffer(slots, "<u2"), np.frombuffer(tfs, "<u4").astype(np.int64)
            add = (1_000_000_000 * tf) // (1000 * tf + 12 * m[slot])
            for use in uses:
                acc[use["item"], slot] += use["weight"] * add
        if not last:
            at = np.flatnonzero(acc)
            out = row | {"at": at.astype("<u4").tobytes(), "score": acc.reshape(-1)[at].tobytes()}
            return pa.Table.from_pylist([out], schema=left.schema)
        ids = row["docs"]
        order = np.empty(len(ids), np.int64)  # by id, null last
        order[sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))] = np.arange(len(ids))
        items, docs, scores = [], [], []
        for item, line in zip(row["items"], acc, strict=True):
            at = np.flatnonzero(line)
            if len(at) > k:
                at = at[line[at] >= np.partition(line[at], len(at) - k)[len(at) - k]]
            for i in at[np.lexsort((order[at], -line[at]))][:k].tolist():
                items.append(item)
                docs.append(ids[i])
                scores.append(int(line[i]))
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in (items, docs, scores)], names=["item_id", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", most: int = 2_000_000) -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best documents of every item."""
    asks = cut(item_terms(items, item_col, text_col))
    index = postings(docs, cut(asks.select("term").distinct()), id_col, text_col, most)
    total = F.aggregate("ns", F.lit(0).cast("bigint"), lambda s, x: s + x)
    n_docs, n_terms = index.where("term IS NULL").agg(F.coalesce(F.sum(F.size(F.filter("ns", lambda x: x > 0))), F.lit(0)), F.coalesce(F.sum(total), F.lit(0))).first()
    bundles = max(1, -(-asks.select("item_id").distinct().count() // ITEMS))

    df = index.where("term IS NOT NULL").groupBy("term").agg(F.sum(F.octet_length("slots") / 2).cast("bigint").alias("df"))
    weight = F.floor(1000 * F.ln((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("bigint")
    owner = F.least(F.lit(OWNERS - 1), F.floor(OWNERS * F.ln(F.col("df").cast("double")) / F.ln(F.lit(float(n_docs + 1)))).cast("int"))
    used = asks.withColumn("bundle", F.pmod(F.xxhash64("item_id"), F.lit(bundles)))
    members = used.groupBy("bundle").agg(F.sort_array(F.collect_set(F.struct("item_id"))).alias("_items"))  # a null id comes first
    members = cut(members.select("bundle", F.transform("_items", lambda x: x["item_id"]).alias("items")))
    # what the items of a bundle give to a term, and who owns it
    placed = attach(attach(used, df.withColumns({"w": weight, "owner": owner}), ["term"]).where("w > 0"), members, ["bundle"])
    place = F.when(F.col("item_id").isNull(), F.lit(0)).otherwise(F.array_position("items", F.col("item_id")) - 1).cast("int")
    uses = cut(placed.groupBy("bundle", "term", "owner").agg(F.collect_list(F.struct(place.alias("item"), (F.col("w") * F.col("q")).alias("weight"))).alias("uses")))

    cells = attach(index.where("term IS NOT NULL").select("shard", "term", "slots", "tfs"), uses, ["term"]).select("bundle", "shard", "owner", "slots", "tfs", "uses")
    m = F.expr(f"transform(ns, n -> 75L + (25L * n * {n_docs}L) div {max(n_terms, 1)}L)")
    shards = index.where("term IS NULL").select("shard", "docs", m.alias("m"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bundles - 1).cast("bigint"))).alias("bundle"))
    carriers = attach(shards, members, ["bundle"]).select("bundle", "shard", "items", "docs", "m", F.lit(b"").alias("at"), F.lit(b"").alias("score"))
    for s in range(OWNERS):
        mine = cells.where(F.col("owner") == s).select(*(F.col(c).alias(c) for c in ("bundle", "shard", "slots", "tfs", "uses")))  # names of its own beside the carriers'
        last = s == OWNERS - 1
        carriers = carriers.groupBy("bundle", "shard").cogroup(mine.groupBy("bundle", "shard")).applyInArrow(_add(last, k), _HIT if last else _CARRIER)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return carriers.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
