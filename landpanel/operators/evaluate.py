"""Accuracy: confusion in long form (truth, pred, n), metrics, area estimates, effect sizes, votes and sweeps."""

from __future__ import annotations

import math
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clean import running


def confusion(df: DataFrame, by: list[str] | None = None, truth: str = "truth", pred: str = "pred") -> DataFrame:
    by = by or []
    return df.groupBy(*by, F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def confusion_wide(cm: DataFrame, labels: list) -> DataFrame:
    """For display: one row a truth class, one column a predicted class, zeros filled in."""
    wide = cm.groupBy("truth").pivot("pred", labels).agg(F.sum("n"))
    return wide.select("truth", *(F.coalesce(F.col(str(x)), F.lit(0)).alias(f"pred_{x}") for x in labels))


def merge_confusion(*parts: DataFrame) -> DataFrame:
    out = parts[0].select("truth", "pred", "n")
    for p in parts[1:]:
        out = out.unionByName(p.select("truth", "pred", "n"))
    return out.groupBy("truth", "pred").agg(F.sum("n").alias("n"))


def per_class(cm: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, class, n_ref, n_pred, tp, ua, pa, f1) over the union of labels; a ratio without cases is null."""
    by = by or []
    rows = cm.select(*by, F.col("truth").alias("class"), F.col("n").alias("r"), F.lit(0).cast("bigint").alias("p"), F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("t"))
    cols = cm.select(*by, F.col("pred").alias("class"), F.lit(0).cast("bigint").alias("r"), F.col("n").alias("p"), F.lit(0).cast("bigint").alias("t"))
    s = rows.unionByName(cols).groupBy(*by, "class").agg(F.sum("r").alias("n_ref"), F.sum("p").alias("n_pred"), F.sum("t").alias("tp"))
    return s.select("*", F.try_divide("tp", "n_pred").alias("ua"), F.try_divide("tp", "n_ref").alias("pa"), F.try_divide(2 * F.col("tp"), F.col("n_ref") + F.col("n_pred")).alias("f1"))


def metrics(cm: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, n, oa, macro_f1, bal_acc, macro_ua, n_classes_scored); macro means over classes with reference cases."""
    by = by or []
    scored = lambda c: F.avg(F.when(F.col("n_ref") > 0, F.col(c)))
    return per_class(cm, by).groupBy(*by).agg(
        F.sum("n_ref").alias("n"), (F.sum("tp") / F.sum("n_ref")).alias("oa"), scored("f1").alias("macro_f1"), scored("pa").alias("bal_acc"), scored("ua").alias("macro_ua"), F.count_if(F.col("n_ref") > 0).alias("n_classes_scored"),
    )


def metrics_sets(df: DataFrame) -> DataFrame:
    """Metrics by year, by year and zone, and overall, from one pass over (year, zone, truth, pred)."""
    cm = df.groupingSets([[F.col("year"), F.col("truth"), F.col("pred")], [F.col("year"), F.col("zone"), F.col("truth"), F.col("pred")], [F.col("truth"), F.col("pred")]], "year", "zone", "truth", "pred").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    level = F.when(F.col("g") == 0, "year_zone").when(F.col("g") == 4, "year").otherwise("overall")
    cm = cm.select(level.alias("level"), F.coalesce(F.col("year").cast("string"), F.lit("all")).alias("year"), F.coalesce("zone", F.lit("all")).alias("zone"), "truth", "pred", "n")
    return metrics(cm, ["level", "year", "zone"])


def metrics_levels(df: DataFrame, maps: dict[str, DataFrame], small: int = 30) -> DataFrame:
    """Metrics on the fine codes and on each coarser level; maps have (code, group). Fine classes below `small` cases do not count alone."""
    n = df.groupBy("truth").agg(F.count("*").alias("_n"))
    fine = df.join(F.broadcast(n.where(F.col("_n") >= small).select("truth")), "truth", "left_semi")
    out = metrics(confusion(fine)).withColumn("level", F.lit("fine"))
    for name, m in maps.items():
        g = df.join(F.broadcast(m.select(F.col("code").alias("truth"), F.col("group").alias("tg"))), "truth").join(F.broadcast(m.select(F.col("code").alias("pred"), F.col("group").alias("pg"))), "pred")
        out = out.unionByName(metrics(confusion(g, truth="tg", pred="pg")).withColumn("level", F.lit(name)))
    return out


def olofsson(cm: DataFrame, prior: DataFrame) -> DataFrame:
    """(class, est, se, lo, hi): area shares of the reference classes with strata = predicted classes.

    The prior (class, share) is restricted to labels present and scaled to 1; strata without cases add nothing; the
    lower end is cut at 0, the upper is not.
    """
    labels = cm.select(F.col("truth").alias("class")).union(cm.select("pred")).distinct()
    w = labels.join(prior, "class", "left").select(F.col("class").alias("pred"), F.coalesce("share", F.lit(0.0)).alias("w"))
    w = w.select("pred", (F.col("w") / F.sum("w").over(Window.partitionBy())).alias("w"))
    nh = cm.groupBy("pred").agg(F.sum("n").alias("nh")).where(F.col("nh") > 0)
    grid = labels.join(F.broadcast(nh.join(w, "pred")))  # labels x strata, both a few classes
    cells = grid.join(cm.select(F.col("truth").alias("class"), "pred", "n"), ["class", "pred"], "left")
    p = F.coalesce("n", F.lit(0)) / F.col("nh")
    d = cells.groupBy("class").agg(F.sum(F.col("w") * p).alias("est"), F.sqrt(F.sum(F.col("w") * F.col("w") * p * (1 - p) / F.greatest(F.col("nh") - 1, F.lit(1)))).alias("se"))
    return d.select("class", "est", "se", F.greatest(F.lit(0.0), F.col("est") - 1.96 * F.col("se")).alias("lo"), (F.col("est") + 1.96 * F.col("se")).alias("hi"))


def max_by_n(df: DataFrame, by: list[str], value: str, n: str = "n", weighted: bool = False) -> DataFrame:
    """A group's value from the row with the largest n, or its n-weighted mean."""
    v = F.sum(F.col(value) * F.col(n)) / F.sum(n) if weighted else F.max(F.struct(n, value))[value]
    return df.groupBy(*by).agg(v.alias(value), F.sum(n).alias("n_total"))


def kappa(cm: DataFrame) -> DataFrame:
    """(n, po, pe, kappa)."""
    s = per_class(cm).agg(F.sum("n_ref").alias("n"), F.sum("tp").alias("tp"), F.sum(F.col("n_ref") * F.col("n_pred")).alias("e"))
    po, pe = F.col("tp") / F.col("n"), F.col("e") / (F.col("n") * F.col("n"))
    return s.select("n", po.alias("po"), pe.alias("pe"), F.try_divide(po - pe, 1 - pe).alias("kappa"))


def auc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """(n_pos, n_neg, auc) by the rank-sum form with average ranks; running sums over distinct scores, in ranges of scores."""
    s = df.groupBy(F.col(score).alias("s")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("q"))
    s = running(s, ["s"], {"below": F.col("q")})
    t = s.withColumn("u", F.col("p") * (F.col("below") + F.col("q") / 2.0)).agg(F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"), F.sum("u").alias("u"))
    return t.select("n_pos", "n_neg", F.try_divide("u", F.col("n_pos") * F.col("n_neg")).alias("auc"))


def threshold_sweep(df: DataFrame, thetas: list[float], score: str = "score", label: str = "label") -> DataFrame:
    """(theta, n_kept, precision, recall) in one pass: each row counts for all thresholds it reaches."""
    d = df.select(label, F.explode(F.filter(F.array(*map(F.lit, thetas)), lambda t: t <= F.col(score))).alias("theta"))
    pos = F.sum(F.when(F.col(label) == 1, 1).otherwise(0))
    d = d.groupBy("theta").agg(F.count("*").alias("n_kept"), pos.alias("tp"))
    every = df.agg(pos.alias("all_pos"))
    return d.join(F.broadcast(every)).select("theta", "n_kept", (F.col("tp") / F.col("n_kept")).alias("precision"), F.try_divide("tp", "all_pos").alias("recall"))


def _table2(df: DataFrame, by: list[str], exposed: Column, case: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.count_if(exposed & case).alias("a"), F.count_if(exposed & ~case).alias("b"), F.count_if(~exposed & case).alias("c"), F.count_if(~exposed & ~case).alias("d"))


def odds_ratio(df: DataFrame, exposed: Column, case: Column) -> DataFrame:
    """(a, b, c, d, odds_ratio, lo, hi): with the 95 % interval on the log scale, 0.5 added to all cells if one is empty."""
    t = _table2(df, [], exposed, case)
    half = F.when(F.least("a", "b", "c", "d") == 0, 0.5).otherwise(0.0)
    a, b, c, d = (F.col(x) + half for x in "abcd")
    ratio, se = a * d / (b * c), F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return t.select("a", "b", "c", "d", ratio.alias("odds_ratio"), F.exp(F.log(ratio) - 1.96 * se).alias("lo"), F.exp(F.log(ratio) + 1.96 * se).alias("hi"))


def mh_odds_ratio(df: DataFrame, strata: list[str], exposed: Column, case: Column) -> DataFrame:
    """(n_strata, mh_odds_ratio) over strata (Mantel-Haenszel)."""
    t = _table2(df, strata, exposed, case).withColumn("n", F.col("a") + F.col("b") + F.col("c") + F.col("d"))
    return t.agg(F.count("*").alias("n_strata"), F.try_divide(F.sum(F.col("a") * F.col("d") / F.col("n")), F.sum(F.col("b") * F.col("c") / F.col("n"))).alias("mh_odds_ratio"))


def risk_ratio(df: DataFrame, strata: list[str], exposed: Column, case: Column) -> DataFrame:
    """(rr, mh_rr): crude and Mantel-Haenszel risk ratios."""
    t = _table2(df, strata, exposed, case).withColumn("n", F.col("a") + F.col("b") + F.col("c") + F.col("d"))
    a, b, c, d = (F.sum(x) for x in "abcd")
    mh = F.try_divide(F.sum(F.col("a") * (F.col("c") + F.col("d")) / F.col("n")), F.sum(F.col("c") * (F.col("a") + F.col("b")) / F.col("n")))
    return t.agg(F.try_divide(F.try_divide(a, a + b), F.try_divide(c, c + d)).alias("rr"), mh.alias("mh_rr"))


def permutation_p(df: DataFrame, strata: list[str], exposed: Column, case: Column, perms: int = 200, seed: int = 7) -> DataFrame:
    """(observed, p): share of within-stratum shuffles whose difference in risk is at least as large as the observed one.

    A shuffle keeps each stratum's numbers of exposed rows and of cases, so only the number of exposed cases is left to
    chance, and it is hypergeometric. It is drawn for each stratum from its four counts, the same for the same seed and
    stratum; rows are counted once and never shuffled. A stratum may have 10^9 rows of one kind, the draw's limit.
    """
    t = _table2(df, strata, exposed, case).select(F.xxhash64(F.lit(seed), *strata).alias("h"), *"abcd")
    risk = lambda x, n: F.try_divide(x, n)
    whole = t.agg(*(F.sum(x).alias(x) for x in "abcd"))
    seen = whole.select(F.abs(risk(F.col("a"), F.col("a") + F.col("b")) - risk(F.col("c"), F.col("c") + F.col("d"))).alias("observed"), (F.col("a") + F.col("b")).alias("n1"), (F.col("c") + F.col("d")).alias("n0"), (F.col("a") + F.col("c")).alias("cases"))

    def draw(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            for h, a, b, c, d in batch.itertuples(index=False):
                x = np.random.default_rng([h & 0xFFFFFFFF, h >> 32 & 0xFFFFFFFF]).hypergeometric(a + c, b + d, a + b, perms) if a + b else np.zeros(perms, int)
                yield pd.DataFrame({"r": np.arange(perms), "x": x})

    null = t.mapInPandas(draw, "r int, x bigint").groupBy("r").agg(F.sum("x").alias("x")).join(F.broadcast(seen))
    stat = F.abs(risk(F.col("x"), F.col("n1")) - risk(F.col("cases") - F.col("x"), F.col("n0")))
    return null.groupBy("observed").agg(((F.count_if(F.round(stat - F.col("observed"), 12) >= 0) + 1) / (F.count("*") + 1)).alias("p"))


def paired_t(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(n, mean, sd, t) of the differences of paired folds."""
    d = df.agg(F.count(F.col(a) - F.col(b)).alias("n"), F.avg(F.col(a) - F.col(b)).alias("mean"), F.stddev_samp(F.col(a) - F.col(b)).alias("sd"))
    return d.select("*", F.try_divide(F.col("mean"), F.col("sd") / F.sqrt("n")).alias("t"))


def bootstrap_ci(df: DataFrame, value: str, reps: int = 1000, seed: int = 7, key: str = "row_id") -> DataFrame:
    """(mean, lo, hi): Poisson bootstrap of a mean over rows.

    Each row draws a Poisson(1) weight for each replicate from a scattering of its key (a whole number) that any engine
    can compute. A task keeps two sums for each replicate, so no row is multiplied; `reps` rows a task are added up.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        prime = np.int64(2147483647)
        k = np.int64(seed) + np.arange(1, reps + 1, dtype=np.int64) * np.int64(104729)
        total, weight = np.zeros(reps), np.zeros(reps, np.int64)
        steps = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(8)])
        for batch in batches:
            n, x = batch.column(0).to_numpy() % prime, batch.column(1).to_numpy(zero_copy_only=False)
            for at in range(0, len(n), 1024):
                a = (n[at : at + 1024, None] + k) * np.int64(2654435761) % prime
                b = (a * a + k) % prime
                w = np.searchsorted(steps, ((b * b + a) % prime + 0.5) / 2147483647.0)
                total += x[at : at + 1024] @ w
                weight += w.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, reps + 1, dtype=np.int32)), pa.array(total), pa.array(weight)], names=["r", "x", "w"])

    rows = df.select(F.col(key).cast("bigint").alias("k"), F.col(value).cast("double").alias("x")).where("k IS NOT NULL AND x IS NOT NULL")
    each = rows.mapInArrow(run, "r int, x double, w bigint").groupBy("r").agg(F.try_divide(F.sum("x"), F.sum("w")).alias("m"))
    return each.agg(F.avg("m").alias("mean"), F.expr("percentile(m, 0.025)").alias("lo"), F.expr("percentile(m, 0.975)").alias("hi"))


def normal_draw(n: Column, seed: int = 7) -> Column:
    """A standard normal number for a whole number, from two fixed scatterings of it, as any engine can compute it.

    A scattering is a product and two squares modulo a prime: products alone would leave neighbours in step.
    """
    u = []
    for k in (seed, seed + 104729):
        x = (n % 2147483647 + k) * 2654435761 % 2147483647
        y = (x * x + k) % 2147483647
        u.append(((y * y + x) % 2147483647 + 0.5) / 2147483647.0)
    return F.sqrt(-2.0 * F.log(u[0])) * F.cos(2.0 * F.lit(3.141592653589793) * u[1])


def parametric_ci(df: DataFrame, a: str = "a", b: str = "b", draws: int = 20_000, seed: int = 7) -> DataFrame:
    """(n, mean, lo, hi): parametric bootstrap of the mean difference of paired folds.

    Each draw takes as many normal differences as there are folds, with their mean and deviation; lo and hi are the 2.5
    and 97.5 % points of the draws' means.
    """
    t = paired_t(df, a, b).where(F.col("n") > 0)
    d = t.select("n", "mean", F.coalesce("sd", F.lit(0.0)).alias("sd"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(draws - 1).cast("bigint"))).alias("r"))
    d = d.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    each = d.groupBy("r", "n", "mean").agg(F.avg(F.col("mean") + F.col("sd") * normal_draw(F.col("r") * F.col("n") + F.col("i"), seed)).alias("m"))
    return each.groupBy("n", "mean").agg(F.expr("percentile(m, 0.025)").alias("lo"), F.expr("percentile(m, 0.975)").alias("hi"))


def weighted_oa(df: DataFrame, weights: DataFrame, strata: list[str], hit: Column) -> DataFrame:
    """(oa, se, lo, hi): overall accuracy weighted by the area of strata; `weights` has (strata, w)."""
    s = df.groupBy(*strata).agg(F.count("*").alias("n"), F.avg(hit.cast("int")).alias("p")).join(weights, strata)
    w = F.col("w") / F.sum("w").over(Window.partitionBy())
    d = s.withColumn("w", w).agg(F.sum(F.col("w") * F.col("p")).alias("oa"), F.sqrt(F.sum(F.col("w") * F.col("w") * F.col("p") * (1 - F.col("p")) / F.greatest(F.col("n") - 1, F.lit(1)))).alias("se"))
    return d.select("oa", "se", F.greatest(F.lit(0.0), F.col("oa") - 1.96 * F.col("se")).alias("lo"), F.least(F.lit(1.0), F.col("oa") + 1.96 * F.col("se")).alias("hi"))


def vote(cols: list[str]) -> Column:
    """The most frequent of several predictions; ties go to the smallest code, nulls do not vote."""
    a = F.array_compact(F.array(*map(F.col, cols)))
    counted = F.transform(F.array_distinct(a), lambda x: F.struct(F.size(F.filter(a, lambda y: y == x)).alias("n"), (-x).alias("m")))
    return -F.array_max(counted)["m"]


def vote_min(flags: list[str], least: int = 2) -> Column:
    return sum((F.coalesce(F.col(f).cast("int"), F.lit(0)) for f in flags[1:]), F.coalesce(F.col(flags[0]).cast("int"), F.lit(0))) >= least


def smd(df: DataFrame, group: Column, value: str) -> DataFrame:
    """(mean_1, mean_0, smd): standardised mean difference with the pooled deviation."""
    one = lambda f, g: f(F.when(g, F.col(value)))
    d = df.agg(one(F.avg, group).alias("mean_1"), one(F.avg, ~group).alias("mean_0"), one(F.var_samp, group).alias("v1"), one(F.var_samp, ~group).alias("v0"))
    return d.select("mean_1", "mean_0", F.try_divide(F.col("mean_1") - F.col("mean_0"), F.sqrt((F.col("v1") + F.col("v0")) / 2)).alias("smd"))


def confused_pairs(cm: DataFrame) -> DataFrame:
    """(a, b, n): how often two classes are taken for each other, either way round."""
    return cm.where(F.col("truth") != F.col("pred")).groupBy(F.least("truth", "pred").alias("a"), F.greatest("truth", "pred").alias("b")).agg(F.sum("n").alias("n"))


def layer_precision(df: DataFrame, by: list[str], answer: str = "answer") -> DataFrame:
    """(by, n_reviewed, precision): share of yes among yes and no; other answers do not count."""
    p = F.when(F.col(answer) == "yes", 1).when(F.col(answer) == "no", 0)
    return df.groupBy(*by).agg(F.count(p).alias("n_reviewed"), F.avg(p).alias("precision"))


def review_qc(first: DataFrame, second: DataFrame, key: str, gate: float = 0.9) -> DataFrame:
    """(n, agree3, no_audit, fine_agree, passed): two review passes (answer, fine) compared."""
    j = first.select(key, F.col("answer").alias("a1"), F.col("fine").alias("f1")).join(second.select(key, F.col("answer").alias("a2"), F.col("fine").alias("f2")), key)
    d = j.agg(F.count("*").alias("n"), F.avg((F.col("a1") == F.col("a2")).cast("int")).alias("agree3"), F.avg(F.when(F.col("a1") == "no", (F.col("a2") == "no").cast("int"))).alias("no_audit"), F.avg(F.when((F.col("a1") == "yes") & (F.col("a2") == "yes"), (F.col("f1") == F.col("f2")).cast("int"))).alias("fine_agree"))
    return d.withColumn("passed", (F.col("agree3") >= gate) & (F.col("no_audit") >= gate))


def agreement(df: DataFrame, map_a: DataFrame, map_b: DataFrame) -> DataFrame:
    """(ga, gb, n, share_a, share_b): two products' codes (a, b) mapped to groups and crossed; codes without a group are left out."""
    j = df.join(F.broadcast(map_a.select(F.col("code").alias("a"), F.col("group").alias("ga"))), "a").join(F.broadcast(map_b.select(F.col("code").alias("b"), F.col("group").alias("gb"))), "b")
    c = j.groupBy("ga", "gb").agg(F.count("*").alias("n"))
    return c.select("ga", "gb", "n", (F.col("n") / F.sum("n").over(Window.partitionBy("ga"))).alias("share_a"), (F.col("n") / F.sum("n").over(Window.partitionBy("gb"))).alias("share_b"))


def remap_crosstab(cm: DataFrame, mapping: DataFrame) -> DataFrame:
    """A crosstab under a corrected code table (old, new); raises if two old codes share a new one."""
    if not mapping.groupBy("new").agg(F.count_distinct("old").alias("k")).where("k > 1").isEmpty():
        raise ValueError("the mapping is not one to one, the crosstab cannot be relabelled")
    m = F.broadcast(mapping.select(F.col("old").alias("truth"), F.col("new").alias("_t")))
    k = F.broadcast(mapping.select(F.col("old").alias("pred"), F.col("new").alias("_p")))
    return cm.join(m, "truth", "left").join(k, "pred", "left").select(F.coalesce("_t", "truth").alias("truth"), F.coalesce("_p", "pred").alias("pred"), "n")


def tier_monotone(df: DataFrame, tier: str, hit: Column, order: list[str]) -> DataFrame:
    """(tier, n, rate, fine): hit rate by evidence tier, fine if not above the tier before."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("tier"))
    d = df.groupBy(F.col(tier).alias("tier")).agg(F.count("*").alias("n"), F.avg(hit.cast("int")).alias("rate")).where(rank > 0)
    return d.select("tier", "n", "rate", F.coalesce(F.col("rate") <= F.lag("rate").over(Window.orderBy(rank)), F.lit(True)).alias("fine"))


def compare_arms(df: DataFrame, base: str, gain: float = 0.02) -> DataFrame:
    """(arm, mean_gain, n_seeds, same_sign, passed): arms against a base by seed; passes with the gain and one sign in all seeds."""
    b = df.where(F.col("arm") == base).select("seed", F.col("metric").alias("m0"))
    d = df.where(F.col("arm") != base).join(b, "seed").withColumn("g", F.col("metric") - F.col("m0"))
    d = d.groupBy("arm").agg(F.avg("g").alias("mean_gain"), F.count("*").alias("n_seeds"), ((F.min("g") > 0) | (F.max("g") < 0)).alias("same_sign"))
    return d.withColumn("passed", (F.col("mean_gain") >= gain) & F.col("same_sign"))
