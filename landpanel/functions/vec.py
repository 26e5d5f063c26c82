"""Vector columns: array<double> in, native expressions out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(x: Column) -> Column:
    """False for null, NaN and infinities."""
    return F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < INF), F.lit(False))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(col(a), col(b), lambda x, y: x * y))


def l2norm(v: Column | str) -> Column:
    return F.sqrt(total(F.transform(col(v), lambda x: x * x)))


def unit(v: Column | str) -> Column:
    """v / (norm + 1e-12). The norm is bound once; inside the inner function it would be computed for every component."""
    return F.get(F.transform(F.array(l2norm(v) + F.lit(1e-12)), lambda n: F.transform(col(v), lambda x: x / n)), F.lit(0))


def l2distance(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(total(F.zip_with(col(a), col(b), lambda x, y: (x - y) * (x - y))))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Dot product of the unit vectors."""
    return dot(a, b) / ((l2norm(a) + 1e-12) * (l2norm(b) + 1e-12))


def emb_valid(v: Column | str) -> Column:
    """All components finite and a norm above 1e-6; a null vector is not valid."""
    return F.coalesce(F.forall(col(v), finite), F.lit(False)) & F.coalesce(F.nanvl(l2norm(v), F.lit(0.0)) > 1e-6, F.lit(False))


def nan_to_null(c: Column | str) -> Column:
    return F.nanvl(col(c), F.lit(None).cast("double"))
