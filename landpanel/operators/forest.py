"""Random forests of many groups (tiles) grown together: all nodes of one depth, in all trees of all groups, in one pass.

A depth is one aggregation of histograms keyed (group, tree, node, feature, bin, class), running sums over the bins of each
feature, a choice of the best split of each node, and a join that routes the rows to the nodes below. The number of jobs
follows the depth, not the number of groups or trees. Sums are integers, so a forest does not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ByteType, StructField, StructType

from ..sources.shared import cut
from .subtrees import SHARE, bins_of, work

#: Weights are counted in parts of this size.
UNIT = 1024
#: Rows of a node that one task may grow further.
MOST = 600_000


def bin_edges(train: DataFrame, bins: int = 32, accuracy: int = 100_000) -> DataFrame:
    """One row: edges, for each component of v the inner edges of its bins, by quantiles."""
    share = F.array(*(F.lit(k / bins) for k in range(1, bins)))
    parts = train.select(F.posexplode("v").alias("f", "x")).groupBy("f").agg(F.array_distinct(F.percentile_approx("x", share, F.lit(accuracy))).alias("e"))
    return parts.agg(F.transform(F.sort_array(F.collect_list(F.struct("f", "e"))), lambda x: x["e"]).alias("edges"))


def binned(df: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds b: the bin of each component, the number of edges below it. `edges` is one row of components x bins."""
    schema = StructType([*df.schema, StructField("b", ArrayType(ByteType()))])
    return df.mapInArrow(bins_of(edges.first()[0] or []), schema)


def drawn(seed: int, *keys: Column | str) -> Column:
    """How often a bootstrap takes a row: a Poisson draw of mean 1 from the keys' hash, at most 7."""
    u = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)) / F.lit(float(1 << 40))
    total, steps = 0.0, []
    for k in range(7):
        total += 1 / factorial(k)
        steps.append((u >= total / 2.718281828459045).cast("int"))
    return sum(steps[1:], steps[0])


def chosen_features(d: int, m: int, seed: int, *keys: Column | str) -> Column:
    """m different features of d for a node: a start and a stride from the keys' hash, strides without a factor of d."""
    from math import gcd

    strides = [s for s in range(1, d + 1) if gcd(s, d) == 1]
    h = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40))
    start, stride = F.pmod(h, F.lit(d)), F.element_at(F.array(*map(F.lit, strides)), (F.pmod(F.floor(h / d), F.lit(len(strides))) + 1).cast("int"))
    return F.transform(F.array(*map(F.lit, range(m))), lambda k: F.pmod(start + k * stride, F.lit(d)).cast("int"))


def best_splits(nodes: DataFrame, by: list[str], d: int, m: int, least: int, seed: int) -> DataFrame:
    """(by, tree, node, pred, f, bin) for rows (by, tree, node, y, n, w, b): the class with most weight, and the split.

    A split sends bins up to `bin` to the left. It is the one that lowers the Gini impurity most, the first feature and bin
    at a tie, with at least `least` draws on both sides; f is null if none lowers it.
    """
    node, feature = [*by, "tree", "node"], [*by, "tree", "node", "f"]
    rows = nodes.withColumn("f", F.explode(chosen_features(d, m, seed, *by, "tree", "node"))).withColumn("bin", F.get("b", F.col("f")))
    cells = rows.groupBy(*feature, "bin", "y").agg(F.sum("n").alias("n"), F.sum("w").alias("s")).repartition(*feature)
    of_class = Window.partitionBy(*feature, "y")
    up_to = of_class.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumns({"l": F.coalesce(F.sum("s").over(up_to), F.lit(0)).cast("double"), "t": F.sum("s").over(of_class).cast("double")})
    # a cell changes the sum of squares on the left by 2 l s + s s, and the product with the totals by t s
    s = F.col("s").cast("double")
    per_bin = cells.groupBy(*feature, "bin").agg(
        F.sum("n").alias("n"), F.sum(s).alias("s"), F.sum(2 * F.col("l") * s + s * s).alias("ll"), F.sum(F.col("t") * s).alias("lt"),
        F.max_by(F.struct(F.col("t"), (-F.col("y")).alias("y")), F.struct(F.col("t"), -F.col("y"))).alias("top"),
    )
    whole, to = Window.partitionBy(*feature), Window.partitionBy(*feature).orderBy("bin")
    run = per_bin.select(*feature, "bin", "top", *(F.sum(c).over(to).alias(c) for c in ("n", "s", "ll", "lt")), *(F.sum(c).over(whole).alias(f"all_{c}") for c in ("n", "s", "lt")))
    right = F.col("all_s") - F.col("s")
    purity = F.col("ll") / F.col("s") + (F.col("all_lt") - 2 * F.col("lt") + F.col("ll")) / right
    ok = (F.col("n") >= least) & (F.col("all_n") - F.col("n") >= least) & (right > 0) & (purity > F.col("all_lt") / F.col("all_s") * (1 + 1e-9))
    split = F.when(ok, F.struct((-purity).alias("p"), F.col("f"), F.col("bin")))
    best = run.groupBy(*node).agg(F.max("top").alias("top"), F.min(split).alias("best"))
    return best.select(*node, (-F.col("top.y")).alias("pred"), F.col("best.f").alias("f"), F.col("best.bin").alias("bin"))


def grow(train: DataFrame, by: list[str], trees: int = 100, depth: int = 20, least: int = 2, seed: int = 42, features: int | None = None, weight: str | None = None) -> DataFrame:
    """The forests of all groups: (by, tree, node, pred, f, bin), node 0 at the top and 2 n + 1, 2 n + 2 below n.

    `train` has the columns `by`, row_id, class_new, and b from `binned`. Each tree sees a bootstrap of its group's rows,
    times `weight`; a node looks at `features` of them, by default the root of their number. Rows are held once for
    each tree that drew them, and are written once a depth.
    """
    first = train.select(F.size("b")).first()
    if first is None:
        return train.sparkSession.createDataFrame([], ", ".join([f"{c} {dict(train.dtypes)[c]}" for c in by] + ["tree int", "node bigint", "pred int", "f int", "bin tinyint"]))
    d = first[0]
    m = features or max(1, round(d**0.5))
    rows = train.withColumn("tree", F.explode(F.array(*map(F.lit, range(trees))))).withColumn("n", drawn(seed, *by, "row_id", "tree")).where("n > 0")
    w = F.col("n") * (F.round(F.col(weight) * UNIT).cast("bigint") if weight else F.lit(UNIT))
    at = cut(rows.select(*by, "tree", F.lit(0).cast("bigint").alias("node"), F.col("class_new").cast("int").alias("y"), F.col("n").cast("bigint").alias("n"), w.cast("bigint").alias("w"), "b").where("w > 0"))
    made = []
    for level in range(depth + 1):
        here = cut(best_splits(at, by, d, m, least if level < depth else 1 << 60, seed))
        made.append(here)
        if here.where("f IS NOT NULL").isEmpty():
            break
        at = cut(routed(at, here, by))
    model = made[0]
    for more in made[1:]:
        model = model.unionByName(more)
    return model


def routed(at: DataFrame, splits: DataFrame, by: list[str]) -> DataFrame:
    """Rows at nodes that split, at the node below."""
    keys, columns = [*by, "tree", "node"], at.columns
    below = at.join(splits.where("f IS NOT NULL").select(*keys, "f", "bin"), keys)
    return below.withColumn("node", 2 * F.col("node") + 1 + (F.get("b", F.col("f")) > F.col("bin")).cast("int")).select(columns)


def votes(model: DataFrame, test: DataFrame, by: list[str], key: list[str], trees: int) -> DataFrame:
    """(by, key, pred, share): the class that most trees of the group give a row of `test`, the smaller class at a tie.

    Rows of groups without a forest are missing. All rows go down one depth at a time.
    """
    keys = [*by, "tree", "node"]
    model, told = cut(model), None
    at = cut(test.select(*by, *key, "b", F.explode(F.array(*map(F.lit, range(trees)))).alias("tree"), F.lit(0).cast("bigint").alias("node")))
    while True:
        met = cut(at.join(model, keys))
        leaf = met.where("f IS NULL").select(*by, *key, "pred")
        told = leaf if told is None else told.unionByName(leaf)
        on = met.where("f IS NOT NULL")
        if on.isEmpty():
            break
        at = on.select(*by, *key, "b", "tree", (2 * F.col("node") + 1 + (F.get("b", F.col("f")) > F.col("bin")).cast("int")).alias("node"))
    n = told.groupBy(*by, *key, "pred").count()
    best = n.groupBy(*by, *key).agg(F.max(F.struct("count", (-F.col("pred")).alias("p"))).alias("b"), F.sum("count").alias("_all"))
    return best.select(*by, *key, (-F.col("b.p")).alias("pred"), (F.col("b.count") / F.col("_all")).alias("share"))


def vote_forests(train: DataFrame, test: DataFrame, by: Sequence[str], key: Sequence[str], trees: int = 100, depth: int = 20, least: int = 2, seed: int = 42, features: int | None = None, weight: str | None = None, most: int = MOST, soft: bool = False) -> DataFrame:
    """(by, key, pred, share): as `votes` of the forests of `grow`, without a table of their nodes; `soft` adds up the leaves' shares of classes.

    Nodes of more than `most` rows are split by `best_splits`, all at one depth in one pass. What lies below a node of fewer
    rows is grown by the task that gets its rows, and the rows to classify follow them. No tree reaches the driver.
    """
    by, key = list(by), list(key)
    w = F.round(F.col(weight) * UNIT).cast("bigint") if weight else F.lit(UNIT).cast("bigint")
    train = cut(train.select(*by, "row_id", F.col("class_new").cast("int").alias("y"), w.alias("w"), "b"))
    most_rows, groups, d = train.groupBy(*by).agg(F.count("*").alias("n"), F.max(F.size("b")).alias("d")).agg(F.max("n"), F.count("*"), F.max("d")).first()
    test = cut(test.select(*by, *key, "b"))
    if not most_rows:
        return test.select(*by, *key, F.lit(0).alias("pred"), F.lit(0.0).alias("share")).limit(0)
    m = features or max(1, round(d**0.5))
    tasks = 4 * train.sparkSession.sparkContext.defaultParallelism
    told = None
    if most_rows <= most:
        per = -(-trees // min(trees, max(1, -(-tasks // groups))))
        starts = F.explode(F.array(*(F.struct(F.lit(a).alias("t0"), F.lit(min(a + per, trees)).alias("t1")) for a in range(0, trees, per)))).alias("_s")
        spread = lambda x: x.select("*", starts).select(*x.columns, "_s.t0", "_s.t1", F.lit(0).cast("bigint").alias("node"))
        train, test = spread(train), spread(test)
    else:
        each = F.explode(F.array(*map(F.lit, range(trees))))
        at = train.withColumn("tree", each).withColumn("n", drawn(seed, *by, "row_id", "tree").cast("bigint")).where("n > 0 AND w > 0")
        at, down = at.withColumn("node", F.lit(0).cast("bigint")), test.withColumn("tree", each).withColumn("node", F.lit(0).cast("bigint"))
        keys, small, few = [*by, "tree", "node"], None, None
        for level in range(depth + 1):
            at, down = cut(at), cut(down)
            big = cut(at.groupBy(*keys).count().where(F.col("count") > most).select(*keys))
            done, rest = at.join(big, keys, "left_anti"), down.join(big, keys, "left_anti")
            small, few = (done, rest) if small is None else (small.unionByName(done), few.unionByName(rest))
            if big.isEmpty():
                break
            at, down = at.join(big, keys), down.join(big, keys)
            splits = cut(best_splits(at.withColumn("w", F.col("n") * F.col("w")), by, d, m, least if level < depth else 1 << 60, seed))
            leaves = splits.where("f IS NULL").select(*keys, "pred")
            if soft:
                whole = at.join(leaves.drop("pred"), keys).groupBy(*keys, F.col("y").alias("pred")).agg(F.sum(F.col("n") * F.col("w")).alias("s"))
                leaves = whole.withColumn("n", F.rint(F.col("s") / F.sum("s").over(Window.partitionBy(*keys)) * SHARE).cast("bigint")).drop("s")
            else:
                leaves = leaves.withColumn("n", F.lit(1).cast("bigint"))
            here = cut(down.join(leaves, keys).select(*by, *key, "pred", "n"))
            told = here if told is None else told.unionByName(here)
            at, down = routed(at, splits, by), routed(down, splits, by)
        one = lambda x: x.withColumnsRenamed({"tree": "t0"}).withColumn("t1", F.col("t0") + 1)
        train, test = one(small.drop("n")), one(few)
    unit = F.to_json(F.struct(*by, "t0", "node"), {"ignoreNullFields": "false"}).alias("unit")
    same = ["t0", "t1", "node", F.xxhash64(F.lit(seed), *by).alias("h0")]
    k = F.struct(*by, *key).alias("k")
    kind, none = dict(test.select(k).dtypes)["k"], F.lit(0)
    rows = train.select(unit, *same, none.alias("kind"), F.xxhash64(F.lit(seed), *by, "row_id").alias("h"), "y", "w", "b", F.lit(None).cast(kind).alias("k"))
    rows = rows.unionByName(test.select(unit, *same, F.lit(1).alias("kind"), none.cast("bigint").alias("h"), none.alias("y"), none.cast("bigint").alias("w"), "b", k))
    # more parts than units, so that few tasks get more than one
    out = rows.repartition(4 * tasks, "unit").sortWithinPartitions("unit", "kind").mapInArrow(work(depth, least, m, soft), f"k {kind}, pred int, n bigint").select("k.*", "pred", "n")
    n = (out if told is None else out.unionByName(told)).groupBy(*by, *key, "pred").agg(F.sum("n").alias("n"))
    best = n.groupBy(*by, *key).agg(F.max(F.struct("n", (-F.col("pred")).alias("p"))).alias("b"), F.sum("n").alias("_all"))
    return best.select(*by, *key, (-F.col("b.p")).alias("pred"), (F.col("b.n") / F.col("_all")).alias("share"))


def local_forests(test: DataFrame, samples: DataFrame, by: Sequence[str], trees: int = 100, depth: int = 20, least: int = 2, bins: int = 32, seed: int = 42) -> DataFrame:
    """(by, row_id, pred, share): each group's rows are classified by a forest of that group's own sample."""
    samples = cut(samples.select(*by, "row_id", "class_new", "v"))
    edges = cut(bin_edges(samples.select("row_id", "v").dropDuplicates(["row_id"]), bins))
    return vote_forests(binned(samples, edges), binned(test, edges), by, ["row_id"], trees, depth, least, seed)
