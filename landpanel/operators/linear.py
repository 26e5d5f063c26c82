"""Linear discriminants and within-class covariance from sums: one pass over the rows, whatever the folds and classes.

Each task adds up, for each fold and class, how many vectors it saw and their sum, and for each fold the products of all pairs
of components; these blocks are added natively. No row is multiplied. What reaches the driver is (folds x (classes +
width)) rows of `width` numbers.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vec

_BLOCK = "fold int, cls int, i int, n bigint, s array<double>"


def moments(df: DataFrame, label: str, fold: Column | None = None) -> DataFrame:
    """(fold, cls, i, n, s): a class's count and sum (i is null), and row i of the fold's products (cls is null).

    Rows without label or with a component that is not finite take no part.
    """

    def run(batches):
        import pyarrow as pa

        count: dict = {}
        total: dict = {}
        gram: dict = {}
        for batch in batches:
            v = batch.column(2)
            if not batch.num_rows:
                continue
            x = v.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            folds, classes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for f in np.unique(folds):
                mine = folds == f
                gram[f] = gram.get(f, 0) + x[mine].T @ x[mine]
                for c in np.unique(classes[mine]):
                    rows = x[mine & (classes == c)]
                    count[f, c] = count.get((f, c), 0) + len(rows)
                    total[f, c] = total.get((f, c), 0) + rows.sum(0)
        out = [(f, c, None, n, total[f, c]) for (f, c), n in count.items()] + [(f, None, i, 0, g) for f, block in gram.items() for i, g in enumerate(block)]
        if out:
            cols = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64())), strict=True)], names=["fold", "cls", "i", "n", "s"])

    ok = F.forall("v", lambda x: x.isNotNull() & vec.finite(x)) & F.col(label).isNotNull() & (F.size("v") > 0)
    rows = df.where(ok).select((fold if fold is not None else F.lit(0)).cast("int").alias("fold"), F.col(label).cast("int").alias("cls"), F.transform("v", lambda x: x.cast("double")).alias("v"))
    parts = rows.mapInArrow(run, _BLOCK)
    return parts.groupBy("fold", "cls", "i").agg(F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s"))


class Sums:
    """The moments on the driver: by fold and class, and by fold."""

    def __init__(self, rows: list):
        self.n, self.s, gram = {}, {}, {}
        for r in rows:
            if r.cls is not None:
                self.n[r.fold, r.cls], self.s[r.fold, r.cls] = r.n, np.array(r.s)
            else:
                gram.setdefault(r.fold, {})[r.i] = np.array(r.s)
        self.gram = {f: np.stack([g[i] for i in range(len(g))]) for f, g in gram.items()}
        self.folds = sorted(self.gram)

    def fitted(self, without: int | None = None) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
        """(classes, counts, means, pooled covariance) of all folds but one."""
        folds = [f for f in self.folds if f != without]
        n, s = {}, {}
        for (f, c), k in self.n.items():
            if f in folds:
                n[c], s[c] = n.get(c, 0) + k, s.get(c, 0) + self.s[f, c]
        classes = sorted(n)
        count = np.array([n[c] for c in classes], float)
        means = np.stack([s[c] / n[c] for c in classes])
        within = sum(self.gram[f] for f in folds) - (means.T * count) @ means
        return classes, count, means, within / max(1.0, count.sum() - len(classes))


def pooled_covariance(df: DataFrame, label: str = "class_new") -> DataFrame:
    """(i, j, cov): within-class covariance of the vectors, from one pass."""
    rows = moments(df, label).collect()
    if not rows:
        return df.sparkSession.createDataFrame([], "i int, j int, cov double")
    cov = Sums(rows).fitted()[3]
    return df.sparkSession.createDataFrame([(i, j, float(x)) for i, row in enumerate(cov) for j, x in enumerate(row)], "i int, j int, cov double")


def discriminants(sums: Sums, without: int | None, ridge: float = 1e-6) -> list[tuple[int, list[float], float]]:
    """(class, weights, offset) of the linear discriminant functions: the pooled covariance, priors by frequency."""
    classes, count, means, cov = sums.fitted(without)
    cov = cov + ridge * np.trace(cov) / len(cov) * np.eye(len(cov))
    weights = np.linalg.solve(cov, means.T).T
    offsets = np.log(count / count.sum()) - 0.5 * (weights * means).sum(1)
    return [(c, w.tolist(), float(b)) for c, w, b in zip(classes, weights, offsets, strict=True)]


def cross_predicted(df: DataFrame, label: str, fold: Column, ridge: float = 1e-6) -> DataFrame:
    """df with fold and pred, the class of the largest discriminant fitted without the row's fold; the smaller class at a tie."""
    sums = Sums(moments(df, label, fold).collect())
    spark = df.sparkSession
    made = [(f, discriminants(sums, f, ridge)) for f in sums.folds if len(sums.folds) > 1]
    table = spark.createDataFrame(made, "_f int, _all array<struct<c: int, w: array<double>, b: double>>")  # one row a fold: its classes
    scored = F.transform("_all", lambda d: F.struct(F.round(vec.dot("v", d["w"]) + d["b"], 9).alias("s"), (-d["c"]).alias("c")))
    j = df.withColumn("fold", fold.cast("int")).join(F.broadcast(table), F.col("fold") == F.col("_f"))
    return j.withColumn("pred", -F.array_max(scored)["c"]).drop("_f", "_all")


def separability(df: DataFrame, label: str = "class_new", folds: int = 5, fold: Column | None = None, ridge: float = 1e-6) -> DataFrame:
    """(fold, n, bal_acc): balanced accuracy of linear discriminants between all classes, on each fold by the others."""
    p = cross_predicted(df, label, fold if fold is not None else F.pmod(F.xxhash64("row_id"), F.lit(folds)), ridge)
    recall = p.groupBy("fold", label).agg(F.count("*").alias("n"), F.avg((F.col("pred") == F.col(label)).cast("int")).alias("r"))
    return recall.groupBy("fold").agg(F.sum("n").alias("n"), F.avg("r").alias("bal_acc"))
