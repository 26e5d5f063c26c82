"""Operator 2: near-duplicate documents by fast similarity sketching, banding and exact verification.

1. One pass over the texts gives each document's set of word shingles as 64-bit numbers, its size, a 128-bit digest and
   the keys of 48 bands of 6 coordinates of a fast similarity sketch. Documents with equal sets become one class.
2. Classes that share a band are candidates; every pair of similarity 0.8 or more shares one but for a chance of
   (1 - 0.8^6)^48, below one in a million, and less above 0.8. Candidates are compared as `candidates.connect` says:
   each with the hub of its band, then, where a band is not connected by that, by blocks of the band.
3. Every pair is verified on full sets, which are read and numbered once for the classes that have a candidate. Two blocks
   are compared with one matrix product over bit matrices, and a spanning forest of the true links is given back.
4. The components of the links are the groups of near duplicates; the smallest doc_id stands for each.

Defined results: null, empty and blank texts have no shingles and are linked with nothing; a text with fewer words than
the width has its whole word sequence as its only shingle; rows that share a doc_id are one document: those with words
get the same component, whatever their texts, and a link of one is a link of all; rows without a doc_id take no part, and are kept; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .candidates import connect, tiles
from .common import attach, by_blocks, cut, only, text_or_empty
from .sketch import WordHash, band_keys, fast_sketch, shingle_sets

BANDS, ROWS = 48, 6
BLOCK_DOCS, BLOCK_SHINGLES = 96, 250_000


@lru_cache(maxsize=1)
def words() -> WordHash:
    return WordHash()


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, bands); digest and bands are null for an empty set."""

    def block(rows):
        only("shingles", words().clear)
        sets = shingle_sets([r[1] for r in rows], words(), width)
        full = [i for i, s in enumerate(sets) if len(s)]
        keys = band_keys(fast_sketch([sets[i] for i in full], BANDS * ROWS), ROWS).view(np.int64).tolist() if full else []
        bands = dict(zip(full, keys, strict=True))
        out = []
        for i, (doc, _) in enumerate(rows):
            h = np.frombuffer(hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), "<i8").tolist() if i in bands else (None, None)
            out.append((doc, len(sets[i]), *h, bands.get(i)))
        return out

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    return by_blocks(rows, ["doc_id", "text"], "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, bands array<bigint>", block)


def full_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, shingles): the sorted shingles of the documents named in `ids`, as little-endian 64-bit numbers."""

    def block(rows):
        only("shingles", words().clear)
        return [(doc, s.astype("<u8").tobytes()) for (doc, _), s in zip(rows, shingle_sets([r[1] for r in rows], words(), width), strict=True)]

    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), text_or_empty().alias("text"))
    return by_blocks(attach(rows, ids, ["id"]), ["id", "text"], "id bigint, shingles binary", block)


def check(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * common >= percent * union."""

    def run(batches):
        import pyarrow as pa

        only("shingles", words().clear)
        hub, one = None, np.empty(0, "<u8")
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                found = []
                for a, b, x, y in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                    if x != hub:
                        hub, one = x, np.frombuffer(x, "<u8")
                    other = np.frombuffer(y, "<u8")
                    place = np.minimum(np.searchsorted(one, other), len(one) - 1)
                    common = int((one[place] == other).sum()) if len(one) else 0
                    if common and 100 * common >= percent * (len(one) + len(other) - common):
                        found.append((a, b))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    j = attach(pairs, sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), ["b"])
    j = attach(j, sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), ["a"])
    return j.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def packed(members: DataFrame) -> DataFrame:
    """(grp, blk, apart, nb, ids, vocabulary, bits) from (grp, blk, apart, nb, id, shingles), one row a block."""
    schema = "grp bigint, blk int, apart int, nb int, ids binary, vocabulary binary, bits binary"

    def run(batches):
        import pyarrow as pa

        held: list = []

        def out():
            sets = [np.frombuffer(r[5], "<u8") for r in held]
            vocabulary, at = np.unique(np.concatenate(sets), return_inverse=True)
            bits = np.zeros((len(held), len(vocabulary)), bool)
            bits[np.repeat(np.arange(len(held)), [len(s) for s in sets]), at] = True
            ids = np.array([r[4] for r in held], "<i8")
            cols = (*([x] for x in held[0][:4]), [ids.tobytes()], [vocabulary.astype("<u8").tobytes()], [np.packbits(bits, axis=1).tobytes()])
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["grp", "blk", "apart", "nb", "ids", "vocabulary", "bits"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:2] != held[0][:2]:
                    yield out()
                    held = []
                held.append(row)
        if held:
            yield out()

    rows = members.repartition("grp", "blk").sortWithinPartitions("grp", "blk", "id").select("grp", "blk", "apart", "nb", "id", "shingles")
    return rows.mapInArrow(run, schema)


def unpack(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, vocabulary = np.frombuffer(row[0], "<i8"), np.frombuffer(row[1], "<u8")
    bits = np.unpackbits(np.frombuffer(row[2], np.uint8).reshape(len(ids), -1), axis=1, count=len(vocabulary))
    return ids, vocabulary, bits


def forest(adjacent: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what `adjacent` connects: a tree for each component."""
    left, out = np.ones(len(adjacent), bool), []
    for i in range(len(adjacent)):
        if left[i]:
            left[i], todo = False, [i]
            while todo:
                x = todo.pop()
                new = np.flatnonzero(adjacent[x] & left)
                left[new] = False
                out += [(x, int(y)) for y in new]
                todo += new.tolist()
    return out


def linked(blocks: list, percent: int) -> list[tuple[int, int]]:
    """Pairs of ids that connect all documents of one or two blocks with 100 * common >= percent * union."""
    parts = [unpack(b) for b in blocks]
    vocabulary = np.unique(np.concatenate([p[1] for p in parts]))
    ids = np.concatenate([p[0] for p in parts])
    sizes = np.concatenate([p[2].sum(axis=1, dtype=np.int64) for p in parts])
    common = np.zeros((len(ids), len(ids)), np.float32)
    for a in range(0, len(vocabulary), 8192):  # counts stay below 2^24, so they are exact
        some = vocabulary[a : a + 8192]
        m, at = np.zeros((len(ids), len(some)), np.float32), 0
        for own, v, bits in parts:
            lo, hi = np.searchsorted(v, some[0]), np.searchsorted(v, some[-1], "right")
            m[at : at + len(own), np.searchsorted(some, v[lo:hi])] = bits[:, lo:hi]
            at += len(own)
        common += m @ m.T
    common = common.astype(np.int64)
    adjacent = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    np.fill_diagonal(adjacent, False)
    return [(int(ids[x]), int(ids[y])) for x, y in forest(adjacent)]


def links(blocks: DataFrame, percent: int) -> DataFrame:
    """(a, b): links inside and between the blocks that meet."""

    def run(batches):
        import pyarrow as pa

        key, held = None, []

        def out():
            found = linked(held, percent)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for grp, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (grp, i, j) != key:
                    yield out()
                    held = []
                key = (grp, i, j)
                held.append(row)
        if held:
            yield out()

    cols = ["grp", "i", "j", "ids", "vocabulary", "bits"]
    return tiles(blocks).repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j").select(*cols).mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row."""
    base = cut(sketches(docs, width))
    some = base.where(F.col("h1").isNotNull() & F.col("doc_id").isNotNull())
    classes = cut(some.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("bands").alias("bands")))
    # a doc_id that stands for several texts links their classes
    several = some.groupBy("doc_id").agg(F.min("h1").alias("a"), F.max("h1").alias("b"), F.min("h2").alias("c"), F.max("h2").alias("d"))
    several = cut(several.where((F.col("a") < F.col("b")) | (F.col("c") < F.col("d"))).select("doc_id"))
    more = None if several.isEmpty() else attach(attach(some, several, ["doc_id"]).select("doc_id", "h1", "h2"), classes.select("h1", "h2", "rep"), ["h1", "h2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    keys = classes.select(F.explode("bands").alias("key"), F.col("rep").alias("id"))
    weights = classes.groupBy(F.col("rep").alias("id")).agg(F.sum("n_shingles").alias("weight"))
    found = connect(keys, weights, *comparison(docs, width, percent), heavy=BLOCK_SHINGLES, block=BLOCK_DOCS, more=more)

    known = attach(classes.select("h1", "h2", "rep", "n"), cut(found).select(F.col("id").alias("rep"), "component"), ["rep"], how="left")
    known = known.where((F.col("n") > 1) | F.col("component").isNotNull()).select("h1", "h2", F.coalesce("component", "rep").alias("component"))
    out = attach(base.drop("bands"), cut(known), ["h1", "h2"], how="left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"))


def comparison(docs: DataFrame, width: int, percent: int):
    """check and search of `candidates.connect`; the sets of the ids that need them are written once."""
    sets: list = []

    def first(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs)
        ids = cut(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
        sets.append(cut(full_sets(docs, ids, width).dropDuplicates()))
        return check(pairs, sets[0], percent)

    def then(members: DataFrame) -> DataFrame:
        return links(cut(packed(attach(members, sets[0], ["id"]))), percent)

    return first, then


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stand for their group, all columns as they were; rows of one doc_id stay or go together."""
    gone = cut(near_duplicates(docs, width, percent).where(~F.col("kept")).select("doc_id").distinct())
    return attach(docs, gone, ["doc_id"], how="left_anti").select(*docs.columns)
