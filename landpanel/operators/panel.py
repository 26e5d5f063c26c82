"""Point-year panels: validity, distance to class centres, yearly change, quality control and training weights."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar, vec
from ..sources.shared import cut
from .quantiles import MOST, estimated, quantiles, sketches

YEARS = (2017, 2024)


def in_window(year: Column, valid_from: Column = None, valid_to: Column = None) -> Column:
    a, b = valid_from if valid_from is not None else F.col("valid_from"), valid_to if valid_to is not None else F.col("valid_to")
    return (a <= year) & (year <= b)


def expand_years(points: DataFrame, first: int = YEARS[0], last: int = YEARS[1]) -> DataFrame:
    """One row for each year of a point's closed validity window inside first..last; no range join."""
    a, b = F.greatest("valid_from", F.lit(first)), F.least("valid_to", F.lit(last))
    return points.where(a <= b).withColumn("year", F.explode(F.sequence(a, b)))


def class_centres(panel: DataFrame, min_n: int = 30) -> DataFrame:
    """(class_new, year, n, centre): unit mean of the raw valid vectors of a class and year with enough of them."""
    mean = vector_to_array(Summarizer.mean(array_to_vector("v")))
    c = panel.where("emb_valid").groupBy("class_new", "year").agg(F.count("*").alias("n"), mean.alias("mean")).where(F.col("n") >= min_n)
    return c.select("class_new", "year", "n", vec.unit("mean").alias("centre"))


def with_validity(panel: DataFrame) -> DataFrame:
    return panel.withColumns({"emb_valid": vec.emb_valid("v"), "norm": vec.nan_to_null(vec.l2norm("v"))})


def cos_to_center(panel: DataFrame, min_n: int = 30) -> DataFrame:
    """Adds cos_center: cosine of a valid vector to its class-year centre, null below `min_n` members.

    There are as many centres as classes times years, so they are broadcast and the vectors stay where they are.
    """
    out = panel.join(F.broadcast(class_centres(panel, min_n).drop("n")), ["class_new", "year"], "left")
    return out.withColumn("cos_center", F.when(F.col("emb_valid"), vec.dot("v", "centre") / (F.col("norm") + 1e-12))).drop("centre")


def with_deltas(panel: DataFrame) -> DataFrame:
    """Adds delta_prev and delta_next: distances to the same point's vectors of exactly the year before and after."""
    w = Window.partitionBy("row_id").orderBy("year")
    before = F.when(F.lag("year").over(w) == F.col("year") - 1, F.lag("v").over(w))
    out = panel.withColumn("delta_prev", vec.nan_to_null(vec.l2distance("v", before)))
    return out.withColumn("delta_next", F.when(F.lead("year").over(w) == F.col("year") + 1, F.lead("delta_prev").over(w)))


def yearly_delta(panel: DataFrame) -> DataFrame:
    """(row_id, year, delta) as a self-join on the point and the year before."""
    a = panel.select("row_id", (F.col("year") + 1).alias("year"), F.col("v").alias("u"))
    return panel.select("row_id", "year", "v").join(a, ["row_id", "year"]).select("row_id", "year", vec.nan_to_null(vec.l2distance("v", "u")).alias("delta"))


def robust_z(df: DataFrame, columns: dict[str, str], by: list[str], min_n: int = 100, most: int = MOST) -> DataFrame:
    """Adds (x - median) / (1.4826 * MAD + 1e-9) of each group with at least `min_n` values, for {column: name} in two passes.

    Groups are few (classes by years), so their figures are broadcast and the rows stay where they are.
    """
    half = lambda value: {c: (value(c), [0.5]) for c in columns}
    mid = quantiles(df, by, half(F.col), most)
    mid = mid.select(*by, *(F.get(f"p_{c}", F.lit(0)).alias(f"_med_{c}") for c in columns), *(F.col(f"n_{c}").alias(f"_n_{c}") for c in columns))
    d = df.join(F.broadcast(mid), by, "left")
    mad = quantiles(d, by, half(lambda c: F.abs(F.col(c) - F.col(f"_med_{c}"))), most)
    mad = mad.select(*by, *(F.get(f"p_{c}", F.lit(0)).alias(f"_mad_{c}") for c in columns))
    z = {out: F.when(F.col(f"_n_{c}") >= min_n, (F.col(c) - F.col(f"_med_{c}")) / (F.lit(1.4826) * F.col(f"_mad_{c}") + 1e-9)) for c, out in columns.items()}
    return d.join(F.broadcast(mad), by, "left").withColumns(z).drop(*(f"{k}_{c}" for k in ("_med", "_n", "_mad") for c in columns))


def class_percentiles(df: DataFrame, c: str = "cos_center", by=("class_new", "year"), min_n: int = 100, approx: bool = False, most: int = MOST) -> DataFrame:
    """(by, n, p01, p05) by linear interpolation; approx=True reads them from mergeable sketches."""
    shares = (0.01, 0.05)
    if approx:
        p = estimated(sketches(df, by, c), shares)
    else:
        p = quantiles(df, by, {"c": (c, shares)}, most).select(*by, F.col("n_c").alias("n"), F.col("p_c").alias("p"))
    return p.where(F.col("n") >= min_n).select(*by, "n", F.get("p", F.lit(0)).alias("p01"), F.get("p", F.lit(1)).alias("p05"))


def qc_ladder(df: DataFrame) -> DataFrame:
    """Adds qc_status, qc_reason and qc_weight from emb_valid, cos_center, p01, p05 and the two z values (null: unknown)."""
    cos, zp, zn = (vec.nan_to_null(c) for c in ("cos_center", "delta_prev_z", "delta_next_z"))
    spike = ((zp > 5) & (zn.isNull() | (zn <= 3))) | ((zn > 5) & (zp.isNull() | (zp <= 3)))
    rules = [
        (~F.col("emb_valid"), ("exclude_year", "embedding_invalid", 0.0)),
        (cos < F.col("p01"), ("exclude_year", "class_center_outlier", 0.0)),
        ((cos >= F.col("p01")) & (cos < F.col("p05")), ("downweight", "class_center_low", 0.5)),
        (spike, ("exclude_year", "single_year_anomaly", 0.0)),
        ((zp > 5) & (zn > 5), ("persistent_change", "persistent_change", 0.3)),
    ]
    default = ("keep", "", 1.0)
    return df.withColumns({name: scalar.ladder([(c, v[k]) for c, v in rules], default[k]) for k, name in enumerate(("qc_status", "qc_reason", "qc_weight"))})


def quality(panel: DataFrame, points: DataFrame, apply_window: bool = True, min_n: int = 30, min_n_stats: int = 100, scope: str = "loaded") -> DataFrame:
    """Every point-year with its checks, status, reason and training weight.

    Centres are taken over all loaded points of a year, or with scope='window' over those inside their validity window;
    yearly change always looks at all vectors; medians, percentiles and the ladder see the rows inside the window.

    The vectors are read twice, for the centres and to compare with them. What is known then, without vectors, is written
    to the shared folder; everything after reads only that.
    """
    d = with_validity(panel)
    meta = points.select("row_id", "lon", "lat", "tier", "src", "src_conf", "valid_from", "valid_to")
    if scope == "window":
        d = with_deltas(d).join(meta, "row_id")
        d = cos_to_center(d.where(in_window(F.col("year"))) if apply_window else d, min_n).drop("v")
    else:
        d = with_deltas(cos_to_center(d, min_n)).drop("v").join(meta, "row_id")
        d = d.where(in_window(F.col("year"))) if apply_window else d
    d = cut(d)
    d = robust_z(d, {c: f"{c}_z" for c in ("delta_prev", "delta_next")}, ["class_new", "year"], min_n_stats)
    p = class_percentiles(d, min_n=min_n_stats).drop("n")
    d = qc_ladder(d.join(F.broadcast(p), ["class_new", "year"], "left")).drop("p01", "p05", "valid_from", "valid_to")
    return d.withColumn("train_weight", scalar.train_weight(F.col("tier"), F.col("qc_weight"), F.col("src_conf")))


def qc_summary(qc: DataFrame, by=("class_new", "year")) -> DataFrame:
    """Counts by status and the training weight that is left."""
    n = lambda s: F.count_if(F.col("qc_status") == s)
    return qc.groupBy(*by).agg(
        F.count("*").alias("n"), n("keep").alias("n_keep"), n("downweight").alias("n_downweight"), n("exclude_year").alias("n_exclude"), n("persistent_change").alias("n_persistent"),
        F.sum(F.when(F.col("qc_status") != "exclude_year", F.col("train_weight")).otherwise(0.0)).alias("weight"),
    )


def yearly_set(panel: DataFrame, qc: DataFrame, year: int | None = None) -> DataFrame:
    """Training rows with their vectors: point-years that are not excluded."""
    keep = qc.where(F.col("qc_status") != "exclude_year").select("row_id", "year", "lon", "lat", "tier", "src", "src_conf", "train_weight", "qc_status")
    keep = keep if year is None else keep.where(F.col("year") == year)
    return panel.join(keep, ["row_id", "year"])


def align(df: DataFrame, base: DataFrame) -> DataFrame:
    """The columns of `base` in its order; what `df` lacks is null, what `base` lacks goes."""
    have = {c.lower() for c in df.columns}
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name.lower() in have else F.lit(None).cast(f.dataType).alias(f.name) for f in base.schema))


def rare_topup(base: DataFrame, rare: DataFrame) -> DataFrame:
    """base and the rare rows valid in their year, weighted down and marked, in the columns of base."""
    r = rare.where(in_window(F.col("year"))).withColumns({"train_weight": scalar.rare_weight(F.col("weight"), F.col("src_conf")), "tier": F.coalesce("tier", F.lit("external")), "qc_status": F.lit("rare_topup")})
    return base.unionByName(align(r, base))


def topup_counts(base: DataFrame, rare: DataFrame) -> DataFrame:
    """(year, n_base, n_added, n_total)."""
    both = rare_topup(base, rare)
    added = F.count_if(F.col("qc_status") == "rare_topup")
    return both.groupBy("year").agg((F.count("*") - added).alias("n_base"), added.alias("n_added"), F.count("*").alias("n_total"))


def usable_years(qc: DataFrame) -> DataFrame:
    """(k, n): how many points are usable in exactly k years."""
    per = qc.groupBy("row_id").agg(F.count_if(F.col("qc_status") != "exclude_year").alias("k"))
    return per.groupBy("k").agg(F.count("*").alias("n"))


def usable_by_source(qc: DataFrame) -> DataFrame:
    per = qc.groupBy("src", "row_id").agg(F.bool_or(F.col("qc_status") != "exclude_year").alias("usable"))
    return per.groupBy("src").agg(F.count("*").alias("n"), F.count_if("usable").alias("n_usable"))


def relabel_year(df: DataFrame, strong: float = 0.8, weak: float = 0.6) -> DataFrame:
    """Adds label and label_conf: the anchor stays unless one-year evidence is decisive; wide-window evidence may only confirm.

    Input columns: anchor, ev_label, ev_conf, wide_label.
    """
    decisive = (F.col("ev_conf") >= strong) & (F.col("ev_label") != F.col("anchor"))
    blocked = F.coalesce(F.col("wide_label") == F.col("anchor"), F.lit(False)) & (F.col("ev_conf") < 0.5 * (1 + strong))
    flip = F.coalesce(decisive & ~blocked, F.lit(False))
    return df.withColumns({"label": F.when(flip, F.col("ev_label")).otherwise(F.col("anchor")), "label_conf": scalar.ladder([(flip, F.col("ev_conf")), (F.col("ev_label") == F.col("anchor"), F.lit(1.0)), (F.col("ev_conf") >= weak, 1.0 - F.col("ev_conf"))], 0.8)})


def gate_flips(df: DataFrame) -> DataFrame:
    """(n_pairs, n_flips, n_gated): label changes between adjacent years, and those whose evidence allows them."""
    w = Window.partitionBy("row_id").orderBy("year")
    d = df.withColumns({"_p": F.lag("label").over(w), "_y": F.lag("year").over(w)}).where(F.col("_y") == F.col("year") - 1)
    flip = F.col("label") != F.col("_p")
    return d.agg(F.count("*").alias("n_pairs"), F.count_if(flip).alias("n_flips"), F.count_if(flip & F.col("evidence")).alias("n_gated"))


def consistency_flip(df: DataFrame, least: int = 4) -> DataFrame:
    """(row_id, anchor, n_against, label): change only if at least `least` years agree against the anchor."""
    against = df.where(F.col("label") != F.col("anchor")).groupBy("row_id", "anchor", "label").agg(F.count("*").alias("n"))
    best = against.groupBy("row_id").agg(F.max(F.struct("n", (-F.col("label")).alias("m"))).alias("b"))
    d = df.groupBy("row_id").agg(F.min("anchor").alias("anchor")).join(best, "row_id", "left")
    n = F.coalesce("b.n", F.lit(0).cast("bigint"))
    return d.select("row_id", "anchor", n.alias("n_against"), F.when(n >= least, -F.col("b.m")).otherwise(F.col("anchor")).alias("label"))


def year_agreement(df: DataFrame) -> DataFrame:
    """(year_a, year_b, n, share): how often the labels of the same point agree."""
    a, b = df.select("row_id", F.col("year").alias("year_a"), F.col("label").alias("la")), df.select("row_id", F.col("year").alias("year_b"), F.col("label").alias("lb"))
    j = a.join(b, "row_id").where(F.col("year_a") < F.col("year_b"))
    return j.groupBy("year_a", "year_b").agg(F.count("*").alias("n"), F.avg((F.col("la") == F.col("lb")).cast("int")).alias("share"))


def yearly_cosine(panel: DataFrame, shift: int = 1) -> DataFrame:
    """(year, same, other): mean cosine of the same point across adjacent years, and of points paired with another id."""
    a = panel.select("row_id", (F.col("year") + 1).alias("year"), F.col("v").alias("u"))
    same = panel.join(a, ["row_id", "year"]).groupBy("year").agg(F.avg(vec.cosine("v", "u")).alias("same"))
    other = panel.join(a.withColumn("row_id", F.col("row_id") + shift), ["row_id", "year"]).groupBy("year").agg(F.avg(vec.cosine("v", "u")).alias("other"))
    return same.join(other, "year")
