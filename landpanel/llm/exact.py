"""Operator 12: exact duplicates by a cuckoo-filter index of live digests.

The index is two tables. `live` is the bucketed content: one row for each live document with its digest (SHA-256 of the
normalised text), in a shard told by the digest. `filters` holds one cuckoo filter a shard: buckets of four 16-bit
fingerprints, each at home in two buckets of which either follows from the other and the fingerprint, so a fingerprint
can be moved, and deleted, without its digest.

- Insertion: a digest that its shard's filter does not know is new; its fingerprint is put in, moving others to their
  second bucket. A hit may be a chance hit of 16 bits, so it is verified against the shard's stored digests. If no free
  place is found the filter overflows: it gets twice the buckets and is filled again from the stored digests.
- Deletion: rows leave `live`; a digest of which no live row is left leaves its filter.
- Lookup: a digest that the filter does not know is absent, and its content is not read. Hits alone are joined to `live`.

Copies are counted in each part of the table before the shuffle, so a text that a third of all rows share is a few rows in
its shard. Rows learn their group by a join that broadcasts small sides and else leaves hot digests to adaptive execution.
A shard holds about 32,768 digests at any size of the corpus; an index that has outgrown its shards is dealt anew.

Defined results: null texts count as empty, and equal each other; rows without doc_id come last in their group, so they stay
only where no row has one; rows with equal doc_id and text are one group like others, the first of them stays; an empty table
gives an empty result; the index leaves out other columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, cut, text_or_empty

SLOTS, KICKS, SHARD = 4, 200, 32_768


def normalised(text: str = "text") -> Column:
    """The text with each run of white space as one space."""
    return F.regexp_replace(text_or_empty(text), r"[\x20\x09-\x0D]+", " ")


def digest(text: str = "text") -> Column:
    return F.sha2(normalised(text), 256)


class Cuckoo:
    """A cuckoo filter of 256-bit digests (64 hexadecimal digits): fingerprints of 16 bits, four to a bucket."""

    def __init__(self, buckets: int = 64, table: bytes | None = None):
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else np.frombuffer(table, np.uint16).reshape(-1, SLOTS).copy()
        self.turn = 0

    @property
    def buckets(self) -> int:
        return len(self.table)

    def homes(self, key: str) -> tuple[int, int, int]:
        """(fingerprint, first bucket, second bucket)."""
        mark = int(key[:4], 16) or 1
        at = int(key[4:16], 16) % self.buckets
        return mark, at, self.other(at, mark)

    def other(self, at: int, mark: int) -> int:
        # buckets are a power of two, so the same step leads back
        return at ^ (mark * 0x5BD1E995 % self.buckets)

    def __contains__(self, key: str) -> bool:
        mark, a, b = self.homes(key)
        return bool((self.table[a] == mark).any() or (self.table[b] == mark).any())

    def add(self, key: str) -> bool:
        """False if the filter overflows; what it held before is then still in it, but for one moved fingerprint."""
        mark, a, b = self.homes(key)
        at = a
        for k in range(KICKS):
            for x in (a, b) if not k else (at,):
                free = np.flatnonzero(self.table[x] == 0)
                if len(free):
                    self.table[x, free[0]] = mark
                    return True
            self.turn = (self.turn + 1) % SLOTS
            self.table[at, self.turn], mark = mark, int(self.table[at, self.turn])
            at = self.other(at, mark)
        return False

    def remove(self, key: str) -> None:
        """Takes one fingerprint of a digest that is in the filter."""
        mark, a, b = self.homes(key)
        for x in (a, b):
            held = np.flatnonzero(self.table[x] == mark)
            if len(held):
                self.table[x, held[0]] = 0
                return
        raise KeyError(key)

    def grown(self, stored) -> Cuckoo:
        """A filter of twice the buckets, or more until all fit, filled from the stored digests."""
        size = self.buckets * 2
        while True:
            new = Cuckoo(size)
            if all(new.add(key) for key in stored):
                return new
            size *= 2


@dataclass(frozen=True)
class Index:
    """live (shard, digest, doc_id), filters (shard, table), and the number of shards."""

    live: DataFrame
    filters: DataFrame
    shards: int


def in_shard(shards: int, key: str = "digest") -> Column:
    return (F.conv(F.right(key, F.lit(8)), 16, 10).cast("bigint") % shards).alias("shard")


def _inserted(left, right):
    """One shard: its filter and stored digests (left), and the digests that come (right), to digests told new or known."""
    import pyarrow as pa

    table, stored = None, set()
    for t, key in zip(*(left.column(c).to_pylist() for c in ("table", "digest")), strict=True):
        if key is None:
            table = t
        else:
            stored.add(key)
    index, fresh, hits, chance = Cuckoo(table=table) if table else Cuckoo(), [], 0, 0
    for key in right.column("digest").to_pylist():
        if key in index:
            if key in stored:  # verified: the content is there
                hits += 1
                continue
            chance += 1
        stored.add(key)
        fresh.append(key)
        if not index.add(key):
            index = index.grown(stored)
    shard = (right if right.num_rows else left).column("shard")[0].as_py()
    rows = [(shard, None, index.table.tobytes(), hits, chance)] + [(shard, key, None, None, None) for key in fresh]
    a, b, c, d, e = zip(*rows, strict=True)
    return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.string()), pa.array(c, pa.binary()), pa.array(d, pa.int64()), pa.array(e, pa.int64())], names=["shard", "digest", "table", "hits", "chance"])


_STATE = "shard bigint, digest string, table binary, hits bigint, chance bigint"


def _with_digests(live: DataFrame, filters: DataFrame) -> DataFrame:
    """A shard's filter as a row without digest, and its different stored digests."""
    keys = live.groupBy("shard", "digest").agg(F.lit(None).cast("binary").alias("table"))
    return filters.select("shard", F.lit(None).cast("string").alias("digest"), "table").unionByName(keys)


def _insert_keys(index: Index | None, keys: DataFrame) -> DataFrame:
    """_STATE rows: one for each shard's filter, with the verified and the chance hits, and one for each new digest."""
    spark = keys.sparkSession
    held = _with_digests(index.live, index.filters) if index else spark.createDataFrame([], "shard bigint, digest string, table binary")
    return cut(held.groupBy("shard").cogroup(keys.select("shard", "digest").groupBy("shard")).applyInArrow(_inserted, _STATE))


def _rows(docs: DataFrame, shards: int, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), digest(text_col).alias("digest")).select(in_shard(shards), "digest", "doc_id")


def _partial(rows: DataFrame) -> DataFrame:
    """(shard, digest, first, n): copies of a part of the table put together, without a shuffle.

    `first` is the row that stays of them: (no_id, doc_id, at), the smallest id, and of equal ids the first row.
    """

    def run(batches):
        import pyarrow as pa

        kind = pa.struct([("no_id", pa.bool_()), ("doc_id", pa.int64()), ("at", pa.int64())])
        held: dict = {}

        def out():
            shards, keys = zip(*held, strict=True)
            first = [{"no_id": none, "doc_id": None if none else doc, "at": at} for (none, doc, at), _ in held.values()]
            return pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(keys, pa.string()), pa.array(first, kind), pa.array([n for _, n in held.values()], pa.int64())], names=["shard", "digest", "first", "n"])

        for batch in batches:
            for shard, key, doc, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                this = (doc is None, doc or 0, at)
                first, n = held.get((shard, key), (this, 0))
                held[shard, key] = (min(first, this), n + 1)
            if len(held) >= 100_000:
                yield out()
                held.clear()
        if held:
            yield out()

    at = F.col("_at") if "_at" in rows.columns else F.lit(0).cast("bigint")
    named = rows.select("shard", "digest", F.col("doc_id").cast("bigint").alias("doc_id"), at.alias("at"))
    return named.mapInArrow(run, "shard bigint, digest string, first struct<no_id: boolean, doc_id: bigint, at: bigint>, n bigint")


def _shards(rows: int) -> int:
    return max(1, -(-rows // SHARD))


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> Index:
    """The index of all rows of `docs`."""
    shards = shards or _shards(docs.count())
    live = cut(_rows(docs, shards, id_col, text_col))
    state = _insert_keys(None, _partial(live))
    return Index(live, state.where("digest IS NULL").select("shard", "table"), shards)


def insert(index: Index, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Index, DataFrame]:
    """The index with the rows of `docs`, and (doc_id, digest, new): new if no live row before them had their text."""
    coming = cut(_rows(docs, index.shards, id_col, text_col))
    state = _insert_keys(index, _partial(coming))
    fresh = state.where("digest IS NOT NULL").select("digest", F.lit(True).alias("new"))
    told = attach(coming, fresh, ["digest"], how="left").select("doc_id", "digest", F.coalesce("new", F.lit(False)).alias("new"))
    live = cut(index.live.unionByName(coming))
    after = Index(live, state.where("digest IS NULL").select("shard", "table"), index.shards)
    return (redealt(after) if live.count() > 4 * SHARD * index.shards else after), told


def redealt(index: Index) -> Index:
    """An index that has outgrown its shards, dealt to more of them from the stored digests."""
    shards = _shards(index.live.count())
    live = cut(index.live.select(in_shard(shards), "digest", "doc_id"))
    state = _insert_keys(None, _partial(live))
    return Index(live, state.where("digest IS NULL").select("shard", "table"), shards)


def delete(index: Index, ids: DataFrame, id_col: str = "doc_id") -> Index:
    """The index without the rows of these ids; ids that are not live change nothing."""
    gone = attach(index.live, ids.select(F.col(id_col).alias("doc_id"), F.lit(True).alias("_gone")).distinct(), ["doc_id"], how="left")
    gone = cut(gone)
    live = gone.where(F.col("_gone").isNull()).select("shard", "digest", "doc_id")
    keys = gone.groupBy("shard", "digest").agg(F.count_if(F.col("_gone").isNull()).alias("stay")).where(F.col("stay") == 0).select("shard", "digest")

    def removed(left, right):
        import pyarrow as pa

        if not left.num_rows:
            return pa.table({"shard": pa.array([], pa.int64()), "table": pa.array([], pa.binary())})
        held = Cuckoo(table=left.column("table")[0].as_py())
        for key in right.column("digest").to_pylist():
            held.remove(key)
        return pa.table({"shard": left.column("shard"), "table": pa.array([held.table.tobytes()], pa.binary())})

    filters = cut(index.filters.groupBy("shard").cogroup(keys.groupBy("shard")).applyInArrow(removed, "shard bigint, table binary"))
    return Index(cut(live), filters, index.shards)


def lookup(index: Index, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, keep_id): the smallest live id with the same text, null without one."""
    asked = _rows(docs, index.shards, id_col, text_col)

    def passed(left, right):
        import pyarrow as pa

        rows = right.select(["shard", "digest"])
        if not left.num_rows:
            return rows.slice(0, 0)
        held = Cuckoo(table=left.column("table")[0].as_py())
        return rows.filter(pa.array([key in held for key in rows.column("digest").to_pylist()], pa.bool_()))

    asked = cut(asked)
    hits = index.filters.groupBy("shard").cogroup(_partial(asked).select("shard", "digest").groupBy("shard")).applyInArrow(passed, "shard bigint, digest string").distinct()
    hits = index.live.join(hits, ["shard", "digest"]).groupBy("digest").agg(F.min("doc_id").alias("keep_id"))
    return attach(asked, cut(hits), ["digest"], how="left").select("doc_id", "digest", "keep_id")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row: its group of equal texts in an index of all rows.

    The parts of the table come to the index as batches do: the first part that brings a digest inserts it, later ones
    hit and are verified; what each part knows of its copies adds up to the group.
    """
    shards = shards or _shards(docs.count())
    rows = cut(_rows(docs, shards, id_col, text_col).withColumn("_at", F.monotonically_increasing_id()))
    parts = cut(_partial(rows))
    fresh = _insert_keys(None, parts).where("digest IS NOT NULL").select("shard", "digest")
    groups = fresh.join(parts, ["shard", "digest"]).groupBy("digest").agg(F.min("first").alias("first"), F.sum("n").alias("group_size"))
    many = cut(groups.where("group_size > 1"))  # a digest alone in the table needs no join
    told, alone = attach(rows, many, ["digest"], how="left"), F.col("group_size").isNull()
    return told.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id").cast(rows.schema["doc_id"].dataType)).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        (alone | (F.col("_at") == F.col("first.at"))).alias("kept"), F.col("digest").alias("text_sha256"),
    )
