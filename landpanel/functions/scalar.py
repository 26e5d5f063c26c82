"""Small column functions: lookups, guards and rule ladders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vec import finite

# fixed values: weights of label tiers
TIER_WEIGHTS = {"gold": 1.0, "silver": 0.8, "bronze": 0.6, "external": 0.7, "uncovered": 0.4}
# fixed values: weights of evidence tiers
EVIDENCE_WEIGHTS = {"A": 1.0, "B": 0.5, "C": 0.2}


def map_values(c: Column, table: Mapping, default=None) -> Column:
    """A small dictionary as a chain of comparisons; null and unknown values give the default."""
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def clean_weight(c: Column) -> Column:
    """NaN, infinite and missing weights become 1."""
    return F.when(finite(c), c).otherwise(F.lit(1.0))


def confidence_factor(src_conf: Column) -> Column:
    return F.lit(0.7) + F.lit(0.3) * F.coalesce(src_conf.cast("double"), F.lit(0.8))


def train_weight(tier: Column, qc_weight: Column, src_conf: Column, tiers: Mapping = TIER_WEIGHTS) -> Column:
    return map_values(tier, tiers, 0.5) * qc_weight * confidence_factor(src_conf)


def rare_weight(weight: Column, src_conf: Column) -> Column:
    return F.lit(0.7) * weight * confidence_factor(src_conf)


def downweight_offyear(weight: Column, in_family: Column, year: Column, ref_year: int, factor: float = 0.5) -> Column:
    """Points of one source family count less in years other than the one they were made for."""
    return F.when(in_family & (year != ref_year), weight * factor).otherwise(weight)


def ladder(rules: Sequence[tuple[Column, object]], default) -> Column:
    """First match wins; a condition that is null does not match."""
    out = F.lit(default)
    for condition, value in reversed(rules):
        out = F.when(condition, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def classify_text(c: Column, rules: Sequence[tuple[Sequence[str], str]], default: str) -> Column:
    """Ordered substring rules over the lower-cased text."""
    low = F.lower(c)
    found = []
    for words, name in rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w.lower())
        found.append((hit, name))
    return ladder(found, default)


def decode_scaled(c: Column, scale: float = 10.0, sentinel=None) -> Column:
    """Stored integers back to units; the sentinel means missing."""
    c = c if sentinel is None else F.when(c != sentinel, c)
    return c.cast("double") / scale


def type_by_amplitude(summer: Column, winter: Column, threshold: float = 328.0, grey: float = 150.0) -> Column:
    """Large seasonal change: deciduous; small: evergreen; within the grey band: undecided."""
    a = summer - winter
    return ladder([(a.isNull(), "undecided"), (a > threshold + grey, "deciduous"), (a < threshold - grey, "evergreen")], "undecided")


def band(score: Column, high: float = 0.7, low: float = 0.6) -> Column:
    return ladder([(score >= high, "P1"), (score >= low, "P2")], "none")


def layer_decision(precision: Column, keep: float = 0.7, drop: float = 0.4) -> Column:
    return ladder([(precision.isNull(), "unreviewed"), (precision >= keep, "keep"), (precision <= drop, "drop")], "middle")
