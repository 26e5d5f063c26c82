"""Operator 4: duplicate and nearly duplicate lines, by a segment-partition edit join.

Two lines within `edits` edits share one of the edits + 1 segments into which the shorter one is cut, at a place that
the lengths and the number of edits before it bound. Each different line gives the keys of its own segments and of the
substrings it has to look up for lengths from its own down to `edits` less: numbers from one running sum over its
characters. Lines that share a key are candidates, compared as `candidates.connect` says: each with the hub of its key,
then, where a key is not connected by that, by blocks of its lines, inside which the same index on segments proposes
pairs. A banded bit-parallel edit distance decides. No pairs are written out, and a key may be held by any number of lines.

The first occurrence of a line, by doc_id and line number, stays, and so does the first of each connected group of near
lines; all others are dropped from their texts.

How many edits two lines may be apart follows the length of the shorter one: all `edits` from `least` characters on, below
that one for every least / edits characters, so one from 12 characters and none under 12, where an edit makes another
word. With `short`, as in the query and the pipeline, exact repeats are dropped at any length, else those of lines below
12 characters stay.

Defined results: lines end at \\n; blank lines (white space alone, or nothing) always stay, whatever their length; null
text stays null; texts without a dropped line stay as they are; rows equal in doc_id and text are one document, so a
line's first occurrence stays in each of them; rows without a doc_id take no part and stay whole; an empty table gives
an empty result. Columns whose names begin with `_line` are not allowed, all others are carried along. Lines are told
apart by two independent 64-bit hashes; near lines are verified on their characters.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .candidates import connect, tiles
from .common import attach, cut, only
from .sketch import _STEP, U, mix

LEAST, EDITS = 24, 2
BLOCK_LINES, BLOCK_CHARS = 96, 500_000
#: Lines that a task remembers, lines that make a key hot, and one line in how many is looked at to find such keys.
SEEN, HOT, SAMPLE = 200_000, 262_144, 128
#: Base of the running sums and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, size) of the edits + 1 segments of a line; the last ones take what is left over."""
    base, more = divmod(length, edits + 1)
    out, at = [], 0
    for i in range(edits + 1):
        size = base + (i >= edits + 1 - more)
        out.append((at, size))
        at += size
    return out


def probes(edits: int) -> list[tuple[int, int, int]]:
    """(how much shorter the other line is, segment, shift) to look up."""
    return [(d, i, s) for d in range(edits + 1) for i in range(edits + 1) for s in range(max(-i, d - (edits - i)), min(i, d + (edits - i)) + 1)]


def allowed(length: int, edits: int, least: int) -> int:
    """How many edits a line of this length may be away from a line that is as long or longer."""
    return min(edits, length * edits // least)


def schemes(length: int, edits: int, least: int) -> set[int]:
    """The numbers of edits for which a line gives keys: its own, and those of the shorter lines that it may be near to."""
    return {e for d in range(edits + 1) if (e := allowed(length - d, edits, least)) and e >= d}


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    up, down = np.full(n, U(BASE)), np.full(n, U(INVERSE))
    up[:1] = down[:1] = U(1)
    return np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)


def line_keys(lines: list[str], edits: int) -> tuple[np.ndarray, np.ndarray]:
    """(which line, key) of all different keys of each line.

    A substring's hash is the difference of two running sums of scattered characters times powers of the base, moved to
    the beginning by a power of the inverse; so each key takes the same few steps whatever its length.
    """
    sizes = np.array([len(x) for x in lines], np.int64)
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.cumsum(sizes) - sizes
    up, down = powers(1 << int(sizes.max(initial=1) + 1).bit_length())
    place = np.arange(len(points)) - np.repeat(first, sizes)
    sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(points.astype(U) + _STEP) * up[place], dtype=U)])
    out, parts = np.zeros((len(lines), len(probes(edits))), U), edits + 1
    good = np.zeros(out.shape, bool)
    for k, (less, i, shift) in enumerate(probes(edits)):
        n = sizes - less
        base, more = n // parts, n % parts
        start = base * i + np.maximum(0, i - parts + more) + shift
        size = base + (i >= parts - more)
        good[:, k] = ok = (n > edits) & (start >= 0) & (start + size <= sizes)
        a = np.where(ok, first + start, 0)
        e = np.where(ok, a + size, 0)
        out[:, k] = mix((sums[e] - sums[a]) * down[np.where(ok, start, 0)] + np.array([i + 1], U) * _STEP + size.astype(U))
    row, col = np.nonzero(good)
    key = out[row, col].view(np.int64)
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return row[new], key[new]


def banded_keys(lines: list[str], edits: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(which line, key) of the keys of each line for every number of edits that its length asks for."""
    found = []
    for e in range(1, edits + 1):
        which = np.array([k for k, x in enumerate(lines) if e in schemes(len(x), edits, least)], np.int64)
        if len(which):
            owner, key = line_keys([lines[k] for k in which], e)
            found.append((which[owner], key))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def reach(a: str, i: int, b: str, j: int) -> int:
    """How many characters from a[i] and b[j] on are equal, by slices that double and then halve."""
    n, at, step = min(len(a) - i, len(b) - j), 0, 1
    while at < n and a[i + at : i + at + step] == b[j + at : j + at + step]:
        at, step = at + step, 2 * step
    if at >= n:
        return n
    while step > 1:
        step //= 2
        if a[i + at : i + at + step] == b[j + at : j + at + step]:
            at += step
    return min(at, n)


def edit_distance(a: str, b: str, most: int) -> int:
    """Edits between two lines if at most `most`, else most + 1: on each diagonal the furthest row that e edits reach.

    Each step compares slices, so a pair takes some most * most comparisons whatever the lines' length.
    """
    n, end = len(a), len(b) - len(a)
    if abs(end) > most:
        return most + 1
    far = {0: reach(a, 0, b, 0)}
    if far.get(end) == n:
        return 0
    for e in range(1, most + 1):
        new, left = {}, most - e  # diagonals from which the end is still within reach
        for k in range(max(-e, end - left), min(e, end + left) + 1):
            # a replaced character, one more in b, one more in a
            i = max(far.get(k, -2) + 1, far.get(k - 1, -2), far.get(k + 1, -2) + 1)
            i = min(i, n, len(b) - k)
            if i < 0 or i + k < 0:
                continue
            new[k] = i + reach(a, i, b, i + k)
        if new.get(end) == n:
            return e
        far = new
    return most + 1


def occurrences(docs: DataFrame, least: int, short: bool = False) -> DataFrame:
    """(_line_doc, _line_text, at, h1, h2, line): the lines of `least` characters or more that are not blank, by document.

    With `short` also the shorter ones.
    """
    d = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").alias("_line_doc"), F.xxhash64("text").alias("_line_text"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    told = F.regexp("line", F.lit(r"\S"))
    return d.where(told if short else told & (F.length("line") >= least)).withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})


def keyed(lines: DataFrame, edits: int, least: int) -> DataFrame:
    """(key, h1): all keys of the lines (h1, line). A task gives a line that it meets again no second time."""

    def run(batches):
        import pyarrow as pa

        only("lines", powers.cache_clear)
        seen: set[int] = set()
        for batch in batches:
            h1, at = batch.column(0).to_pylist(), 0
            while at < batch.num_rows:  # about a million characters at once
                part, names, chars = [], [], 0
                while at < batch.num_rows and len(part) < 4096 and chars < 1_000_000:
                    if h1[at] not in seen:
                        seen.add(h1[at])
                        names.append(h1[at])
                        part.append(batch.column(1)[at].as_py())
                        chars += len(part[-1])
                    at += 1
                owner, key = banded_keys(part, edits, least)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.array(names, np.int64)[owner])], names=["key", "h1"])
                if len(seen) > SEEN:
                    seen.clear()

    return lines.select("h1", "line").mapInArrow(run, "key bigint, h1 bigint")


def shared(keys: DataFrame) -> DataFrame:
    """The different rows (key, h1) of the keys that more than one h1 has: one shuffle, read as a sorted stream."""

    def run(batches):
        import pyarrow as pa

        held = None
        for batch in batches:
            key, h1 = (batch.column(k).to_numpy() for k in (0, 1))
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (h1[1:] != h1[:-1])
            if held is not None and len(key) and held[:2] == (key[0], h1[0]):
                new[0] = False
            key, h1 = key[new], h1[new]
            if not len(key):
                continue
            if held is not None:
                key, h1 = np.concatenate([[held[0]], key]), np.concatenate([[held[1]], h1])
            after = key[1:] == key[:-1]
            many = np.zeros(len(key), bool)
            many[1:] |= after
            many[:-1] |= after
            many[0] |= held is not None and held[2]
            held = (key[-1], h1[-1], bool(many[-1]))
            if many[:-1].any():
                yield pa.RecordBatch.from_arrays([pa.array(key[:-1][many[:-1]]), pa.array(h1[:-1][many[:-1]])], names=["key", "h1"])
        if held is not None and held[2]:
            yield pa.RecordBatch.from_arrays([pa.array(np.array([held[0]])), pa.array(np.array([held[1]]))], names=["key", "h1"])

    return keys.repartition("key").sortWithinPartitions("key", "h1").mapInArrow(run, "key bigint, h1 bigint")


def packed(members: DataFrame) -> DataFrame:
    """(grp, blk, apart, nb, ids, named, lines) from (grp, blk, apart, nb, id, component, line), one row a block."""
    schema = "grp bigint, blk int, apart int, nb int, ids binary, named binary, lines binary"

    def run(batches):
        import pyarrow as pa

        held: list = []

        def out():
            lines = zlib.compress("\n".join(r[6] for r in held).encode("utf-8", "surrogatepass"), 1)
            cols = (*([x] for x in held[0][:4]), *([np.array([r[k] for r in held], "<i8").tobytes()] for k in (4, 5)), [lines])
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["grp", "blk", "apart", "nb", "ids", "named", "lines"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:2] != held[0][:2]:
                    yield out()
                    held = []
                held.append(row)
        if held:
            yield out()

    rows = members.repartition("grp", "blk").sortWithinPartitions("grp", "blk", "id").select("grp", "blk", "apart", "nb", "id", "component", "line")
    return rows.mapInArrow(run, schema)


def linked(ids: list[int], lines: list[str], edits: int, least: int, named: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect all lines as near as the shorter one allows; lines of one name are connected already."""
    order = sorted(range(len(lines)), key=lambda x: (len(lines[x]), ids[x]))
    first: dict[int, int] = {}
    root = [first.setdefault(name, x) for x, name in enumerate(named)] if named else list(range(len(lines)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    index: dict[tuple[int, int, str], list[int]] = {}
    plan = {e: [[(i, s) for d, i, s in probes(e) if d == less] for less in range(edits + 1)] for e in range(1, edits + 1)}
    out = []
    for y in order:
        line, tried = lines[y], {y}
        n = len(line)
        for d in range(edits + 1):
            e = allowed(n - d, edits, least)  # what a line that is d shorter allows
            if e < d or not e or n - d <= e:
                continue
            cuts = segments(n - d, e)
            for i, shift in plan[e][d]:
                start, size = cuts[i]
                for x in index.get((n - d, i, line[start + shift : start + shift + size]), ()):
                    if x not in tried:
                        tried.add(x)
                        a, b = find(x), find(y)
                        if a != b and edit_distance(lines[x], line, e) <= e:
                            root[a] = b
                            out.append((ids[x], ids[y]))
        e = allowed(n, edits, least)
        for i, (start, size) in enumerate(segments(n, e) if e else ()):
            index.setdefault((n, i, line[start : start + size]), []).append(y)
    return out


def links(blocks: DataFrame, edits: int, least: int) -> DataFrame:
    """(a, b): links inside and between the blocks that meet."""

    def run(batches):
        import pyarrow as pa

        key, held = None, []

        def out():
            ids = [int(x) for b in held for x in np.frombuffer(b[0], "<i8")]
            named = [int(x) for b in held for x in np.frombuffer(b[1], "<i8")]
            lines = [x for b in held for x in zlib.decompress(b[2]).decode("utf-8", "surrogatepass").split("\n")]
            found = linked(ids, lines, edits, least, named)
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

    cols = ["grp", "i", "j", "ids", "named", "lines"]
    return tiles(blocks).repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j").select(*cols).mapInArrow(run, "a bigint, b bigint")


def check(pairs: DataFrame, texts: DataFrame, edits: int, least: int) -> DataFrame:
    """The pairs (a, b) within the edits that the shorter line allows."""

    def near(x: str, y: str) -> bool:
        e = allowed(min(len(x), len(y)), edits, least)
        return e > 0 and edit_distance(x, y, e) <= e

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = []
            for at in range(0, batch.num_rows, 512):
                found += [(a, b) for a, b, x, y in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns), strict=True) if near(x, y)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    j = attach(pairs, texts.select(F.col("id").alias("b"), F.col("line").alias("y")), ["b"])
    j = attach(j, texts.select(F.col("id").alias("a"), F.col("line").alias("x")), ["a"])
    return j.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def candidates(lines: DataFrame, edits: int, least: int) -> DataFrame:
    """(key, h1) of the lines that share a key with another.

    A key that many lines hold is not put in one task: a sample of lines, by their hash, names the keys that about
    `HOT` or more hold, and since these are surely shared their rows need no look at their neighbours.
    """
    keys = keyed(lines, edits, least)
    hot = keyed(lines.where(F.pmod("h1", F.lit(SAMPLE)) == 0), edits, least).distinct().groupBy("key").count().where(F.col("count") >= max(2, HOT // SAMPLE)).select("key")
    hot = cut(hot)
    if hot.isEmpty():
        return shared(keys)
    keys = cut(attach(keys, hot.withColumn("hot", F.lit(True)), ["key"], how="left"))
    return shared(keys.where(F.col("hot").isNull()).drop("hot")).unionByName(keys.where("hot").select("key", "h1").distinct())


def near_lines(docs: DataFrame, distinct: DataFrame, least: int, edits: int) -> DataFrame:
    """(h1, h2, component) of the lines that have a near line."""
    shortest = -(-least // edits)  # below it no edit is allowed
    found = cut(candidates(occurrences(docs, shortest), edits, least))
    # lines with equal h1 are told apart by h2; the numbers have no collisions, and are fixed once written
    some = attach(distinct, cut(found.select("h1").distinct()), ["h1"])
    places = cut(some.select("h1", "h2", "first", "chars").withColumn("id", F.monotonically_increasing_id()))
    keys = cut(attach(found, places.select("h1", "id"), ["h1"]).select("key", "id"))

    where = places.select("h1", "h2", "id", F.col("first.doc").alias("_line_doc"), F.col("first.at").alias("at"))
    some = attach(docs, cut(where.select(F.col("_line_doc").alias("doc_id")).distinct()), ["doc_id"], how="left_semi")
    texts = cut(attach(occurrences(some, shortest).select("h1", "h2", "_line_doc", "at", "line"), where, ["h1", "h2", "_line_doc", "at"]).select("id", "line").dropDuplicates(["id"]))
    linked_ = connect(
        keys, places.select("id", F.col("chars").alias("weight")), lambda pairs: check(pairs, texts, edits, least),
        lambda members: links(cut(packed(attach(members, texts, ["id"]))), edits, least), heavy=BLOCK_CHARS, block=BLOCK_LINES,
    )
    return attach(places.select("h1", "h2", "id"), cut(linked_), ["id"]).select("h1", "h2", "component")


def dropped(docs: DataFrame, least: int = LEAST, edits: int = EDITS, short: bool = False) -> DataFrame:
    """(_line_doc, _line_text, _line_drop): for each document that loses lines, their numbers from 0."""
    shortest = -(-least // edits)
    lines = occurrences(docs, shortest, short)
    distinct = cut(lines.groupBy("h1", "h2").agg(F.min(F.struct(F.col("_line_doc").alias("doc"), "at")).alias("first"), F.count("*").alias("n"), F.max(F.length("line")).alias("chars")))
    near = cut(near_lines(docs, distinct.where(F.col("chars") >= shortest), least, edits))
    firsts = attach(near, distinct.select("h1", "h2", "first"), ["h1", "h2"])
    stays = cut(firsts.groupBy("component").agg(F.min("first").alias("stays")))
    near = attach(near, stays, ["component"]).select("h1", "h2", "stays")
    verdict = distinct.where("n > 1").select("h1", "h2", "first").join(near, ["h1", "h2"], "full").select("h1", "h2", F.coalesce("stays", "first").alias("stays"))
    # both sides grow with the corpus, so they are always shuffled
    gone = lines.drop("line").join(verdict.hint("merge"), ["h1", "h2"])
    gone = gone.where((F.col("_line_doc") != F.col("stays.doc")) | (F.col("at") != F.col("stays.at")))
    return gone.groupBy("_line_doc", "_line_text").agg(F.collect_set("at").alias("_line_drop"))


def dedup_lines(docs: DataFrame, least: int = LEAST, edits: int = EDITS, short: bool = False) -> DataFrame:
    """The columns of `docs`, texts without their duplicate lines, and _line_count, _line_dropped and _line_chars (before)."""
    gone = dropped(docs, least, edits, short)
    d = docs.withColumns({"_line_doc": F.col("doc_id"), "_line_text": F.xxhash64("text")}).join(gone.hint("merge"), ["_line_doc", "_line_text"], "left")
    # the lines become a column of their own before they are picked from, so each text is split once
    d = d.select(*docs.columns, "_line_drop", F.explode(F.array(F.split("text", "\n"))).alias("_line_parts"))
    told, n = F.col("text").isNotNull(), F.size("_line_parts")
    stay = F.array_except(F.sequence(F.lit(0), n - 1), F.col("_line_drop"))
    left = F.array_join(F.transform(stay, lambda i: F.get("_line_parts", i)), "\n")
    count = lambda ok, c: F.when(ok, c).otherwise(F.lit(0)).cast("bigint")
    cut_off = told & F.col("_line_drop").isNotNull()
    return d.select(
        *(F.when(cut_off, left).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns),
        count(told, n).alias("_line_count"), count(cut_off, F.size("_line_drop")).alias("_line_dropped"), count(told, F.length("text")).alias("_line_chars"),
    )
