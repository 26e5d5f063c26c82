"""Operator 1: mixing sources to target weights with a time-varying curriculum, in DataFrame operations alone.

Each source has a weight, and a curve that says how its share of the training stream changes over time. Targets are
filled like vessels: the demand is shared by weight, no source gives more than `repeats` times its words, and what is
over goes to the others by weight. The integral of a source's curve, scaled to its target, is its cumulative demand;
inverting it at the cumulative words of the documents before a document gives that document's place in training, and a
range sort by place gives the order of the corpus.

The order inside a source is a fixed multiplicative hash of doc_id. Its running sum of words has two levels, so that a
source with a third of all rows is never in one task: sums of hash ranges for each source, added up along the ranges,
then running sums inside each range. There are at least 1,024 ranges, and as many more as leave about `PER_RANGE` rows to
each; their number changes no result.

Defined results: null text has 0 words; documents without words are not taken and have no place; a source without words
has target 0; null source is a source of its own and comes last; rows with equal doc_id stand next to each other, ordered
by size, and equal rows are interchangeable; a null doc_id counts as 0 in the order; an empty table gives an empty result. All columns of the input are carried along as
they are; those that are added have names that begin with `_mix_`, which columns of the input must not have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, attach, cut, text_or_empty

RANGES, PER_RANGE = 1024, 200_000
#: Curves by rank of the source, in rotation: (time, height) knots; only the shape counts, the target sets the area.
CURVES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (0.5, 1.5), (1.0, 0.5)))


def words(name: str = "text") -> Column:
    return F.regexp_count(text_or_empty(name), F.lit(WORD)).cast("bigint")


def order_key(name: str = "doc_id") -> Column:
    """A fixed scattering of ids over 0 to 2^31 - 2."""
    return (F.pmod(F.coalesce(F.col(name), F.lit(0)).cast("bigint"), F.lit(2147483647)) * F.lit(2654435761)) % F.lit(2147483647)


def targets(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2) -> DataFrame:
    """One row a source (_mix_key, source, source_size) -> also rank, weight and target.

    In the order of the ratio of limit to weight, a source is full if its limit is at most its weight's part of what
    the full ones before it leave.
    """
    everything = Window.partitionBy()
    named = Window.orderBy(F.col("source").asc_nulls_last())
    filled = Window.orderBy("_ratio", "rank")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    s = sources.withColumn("rank", F.row_number().over(named) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("bigint"))
    s = s.withColumn("_cap", F.col("source_size") * repeats).withColumn("_ratio", F.col("_cap").cast("double") / F.col("weight"))
    left = F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    s = s.withColumn("_level", left / weight).withColumn("_full", F.col("_ratio") <= F.col("_level"))
    level = F.max(F.when(~F.col("_full"), F.col("_level"))).over(everything)
    return s.withColumn("target", F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(F.col("weight") * level)).drop("_cap", "_ratio", "_level", "_full")


def place(part: Column, curve: tuple[tuple[float, float], ...]) -> Column:
    """The time at which a curve's integral, as a share of the whole, reaches `part`."""
    areas = [(t1 - t0) * (y0 + y1) / 2 for (t0, y0), (t1, y1) in zip(curve, curve[1:])]
    at, out = sum(areas), F.lit(float(curve[-1][0]))
    need = part * F.lit(float(sum(areas)))
    for ((t0, y0), (t1, y1)), area in reversed(list(zip(zip(curve, curve[1:]), areas, strict=True))):
        at -= area
        rest = F.greatest(need - F.lit(at), F.lit(0.0))
        slope = (y1 - y0) / (t1 - t0)
        root = F.sqrt(F.greatest(F.lit(y0 * y0) + F.lit(2 * slope) * rest, F.lit(0.0)))
        t = F.lit(float(t0)) + F.try_divide(F.lit(2.0) * rest, F.lit(float(y0)) + root)
        out = F.when(need < F.lit(at + area), F.least(F.coalesce(t, F.lit(float(t0))), F.lit(float(t1)))).otherwise(out)
    return out


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2, curves=CURVES, whole: bool = False, text_col: str = "text", size_col: str | None = None) -> DataFrame:
    """The columns of `docs` and _mix_size, _mix_source_size, _mix_target, _mix_taken and _mix_copies: an array of (epoch, taken, place).

    The stream takes a source's documents in order, again from the start in a second epoch, until its target is
    reached; the last document is taken in part. With whole=True a copy is taken whole if at least half of it lies
    below the target, else not at all.
    """
    size = F.col(size_col) if size_col else words(text_col)
    rows = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_mix_row")
    d = docs.select(rows, "doc_id", size.alias("_mix_size"), F.col("source"), F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source")).alias("_mix_key"), order_key().alias("_mix_order"))
    ranges = max(RANGES, -(-docs.count() // PER_RANGE))
    d = d.withColumn("_mix_range", F.floor(F.col("_mix_order") * ranges / 2147483648).cast("int"))
    sums = cut(d.groupBy("_mix_key", "_mix_range").agg(F.sum("_mix_size").alias("_mix_words"), F.any_value("source").alias("source")))
    along = Window.partitionBy("_mix_key").orderBy("_mix_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_mix_key", "_mix_range", F.coalesce(F.sum("_mix_words").over(along), F.lit(0)).alias("_mix_from"))
    sources = sums.groupBy("_mix_key").agg(F.sum("_mix_words").alias("source_size"), F.any_value("source").alias("source"))
    goals = targets(sources, weights, share, repeats).drop("source")
    starts = attach(starts, cut(goals), ["_mix_key"])
    d = d.drop("source").join(starts.hint("merge"), ["_mix_key", "_mix_range"])
    inside = Window.partitionBy("_mix_key", "_mix_range").orderBy("_mix_order", "doc_id", "_mix_size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_mix_from", F.col("_mix_from") + F.coalesce(F.sum("_mix_size").over(inside), F.lit(0)))
    copies = []
    for epoch in range(repeats):
        begin = F.col("_mix_from") + F.col("source_size") * epoch
        if whole:
            taken = F.when(begin + F.col("_mix_size") / 2 <= F.col("target"), F.col("_mix_size")).otherwise(F.lit(0))
        else:
            taken = F.least(F.col("_mix_size"), F.greatest(F.floor("target") - begin, F.lit(0)))
        part, chosen = F.try_divide(begin.cast("double"), F.col("target")), F.lit(None).cast("double")
        for k, curve in enumerate(curves):
            chosen = F.when(F.col("rank") % len(curves) == k, place(part, curve)).otherwise(chosen)
        copies.append(F.struct(F.lit(epoch).alias("epoch"), taken.cast("bigint").alias("taken"), chosen.alias("place")))
    d = d.withColumn("_mix_copies", F.filter(F.array(*copies), lambda c: c["taken"] > 0))
    taken = F.aggregate("_mix_copies", F.lit(0).cast("bigint"), lambda a, c: a + c["taken"])
    added = [F.col("source_size").alias("_mix_source_size"), F.col("target").alias("_mix_target"), taken.alias("_mix_taken"), "_mix_copies"]
    return d.select(*(F.col("_mix_row").getField(c).alias(c) for c in docs.columns), "_mix_size", *added)


def in_order(mixed: DataFrame) -> DataFrame:
    """One row for each copy that is taken, with _mix_epoch, _mix_place and the words of it that are _mix_taken, range-sorted by place."""
    d = mixed.drop("_mix_taken").withColumn("_mix_copy", F.explode("_mix_copies")).drop("_mix_copies")
    d = d.withColumns({f"_mix_{c}": F.col(f"_mix_copy.{c}") for c in ("epoch", "taken", "place")}).drop("_mix_copy")
    return d.orderBy("_mix_place", "doc_id", "_mix_epoch")
