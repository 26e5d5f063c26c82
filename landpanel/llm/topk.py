"""Operator 8: exact top-k inner products by a three-phase uniform threshold.

A score is a sum over nodes: each node holds one slice of the components of every vector and can score by its slice
alone.

1. Every node gives its k best local scores for each query and block of rows. The totals of the candidates on these lists
   are looked up; the k-th best of them is a safe cutoff: the answer's totals are not below it.
2. A total that reaches the cutoff has a local score of at least the cutoff over the number of nodes in some node. Every
   node gives all entries that reach this uniform threshold; all other candidates are out.
3. The scores that the other nodes hold of these candidates are computed, and the k best totals stand.

Queries and rows are packed into blocks, and each pair of a block of queries with a block of rows is one task's unit of
work: two matrix products. Packed blocks meet by an equi-join on the query block's number, to which the row blocks are
dealt; cutoffs travel in the same way, by query block. No step gathers a query's candidates anywhere.

Of candidates with the same vector only the k + 1 with the smallest ids are searched: they have one score for each query,
ties go to the smaller id, and a query leaves out itself at most. So a vector that a third of all rows share gives a
query k + 1 candidates, not a third of the rows; the k + 1 are found before the shuffle, in each part of the table.

Defined results: vectors that are null, hold a null or a non-finite component, or have another number of components
than most, and rows with null id, take no part; components are floor(256 x) as integers, exact in double arithmetic up to 2^53; ties go to the smaller
id; of rows with equal id the least vector counts; with fewer
than k candidates all are returned; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, cut

ROWS, QUERIES, NODES = 4096, 1024, 2


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    ok = F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.coalesce(ok, F.lit(False))).select(F.col(id_col).cast("bigint").alias("id"), F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("v"))


def packed(df: DataFrame, number: str) -> DataFrame:
    """Blocks (number, ids, m): the ids and the matrix of a block as little-endian 64-bit integers and doubles."""
    kind = dict(df.dtypes)[number]

    def run(batches):
        import pyarrow as pa

        last, ids, rows = None, [], []

        def out():
            return pa.RecordBatch.from_pydict({number: pa.array([last], pa.int64()), "ids": pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), "m": pa.array([np.array(rows, "<f8").tobytes()], pa.binary())})

        for batch in batches:
            for n, i, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n != last and ids:
                    yield out()
                    ids, rows = [], []
                last = n
                ids.append(i)
                rows.append(v)
        if ids:
            yield out()

    assert kind == "bigint"
    return df.repartition(number).sortWithinPartitions(number, "id").select(number, "id", "v").mapInArrow(run, f"{number} bigint, ids binary, m binary")


def local_scores(qm: bytes, rm: bytes, nq: int, nr: int):
    """The local scores of a block pair, node by node, queries by rows."""
    q, r = np.frombuffer(qm, "<f8").reshape(nq, -1), np.frombuffer(rm, "<f8").reshape(nr, -1)
    edges = np.linspace(0, q.shape[1], NODES + 1).astype(int)
    for a, b in zip(edges, edges[1:], strict=False):
        yield q[:, a:b] @ r[:, a:b].T


def phase1(k: int):
    """(qb, query, totals): the k best totals among the candidates on a block pair's local lists."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for qb, qids, qm, rids, rm in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                qi, ri = np.frombuffer(qids, "<i8"), np.frombuffer(rids, "<i8")
                parts = list(local_scores(qm, rm, len(qi), len(ri)))
                own = qi[:, None] == ri[None, :]
                for p in parts:
                    p[own] = -np.inf
                n = min(k, len(ri))
                lists = np.concatenate([np.argpartition(-p, n - 1, axis=1)[:, :n] for p in parts], axis=1)
                lists.sort(axis=1)
                total = sum(np.take_along_axis(p, lists, 1) for p in parts)
                total[:, 1:][lists[:, 1:] == lists[:, :-1]] = -np.inf  # a candidate on several lists counts once
                best = -np.sort(-total, axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array([qb] * len(qi), pa.int64()), pa.array(qi), pa.array([[int(x) for x in row if x > -np.inf] for row in best], pa.list_(pa.int64()))], names=["qb", "query", "totals"])

    return run


def phase2(batches):
    """(query, id): candidates with a local score that reaches the query's uniform threshold in at least one node."""
    import pyarrow as pa

    for batch in batches:
        for _, qids, qm, rids, rm, cuts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            qi, ri = np.frombuffer(qids, "<i8"), np.frombuffer(rids, "<i8")
            cuts = dict(cuts)
            least = np.array([cuts[q] for q in qi.tolist()], float)[:, None]
            hit = np.zeros((len(qi), len(ri)), bool)
            for p in local_scores(qm, rm, len(qi), len(ri)):
                hit |= p * NODES >= least
            a, b = np.nonzero(hit & (qi[:, None] != ri[None, :]))
            yield pa.RecordBatch.from_arrays([pa.array(qi[a]), pa.array(ri[b])], names=["query", "id"])


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of every row whose id is divisible by `every`."""
    v = quantised(vectors, id_col, vec_col, scale)
    width = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    v = cut(v.where(F.size("v") == (width[0][0] if width else 0)).groupBy("id").agg(F.min("v").alias("v")))
    alike = Window.partitionBy(F.xxhash64("v"), "v").orderBy("id")
    rows = cut(v.withColumn("_nth", F.row_number().over(alike)).where(F.col("_nth") <= k + 1).drop("_nth"))
    n = rows.count()
    nq = v.where(F.col("id") % every == 0).count()
    query_blocks, row_blocks = max(1, -(-nq // QUERIES)), max(1, -(-n // ROWS))
    spread = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 20))
    q = v.where(F.col("id") % every == 0)
    q = cut(packed(q.withColumn("qb", spread(F.col("id")) % query_blocks), "qb").withColumnsRenamed({"ids": "qids", "m": "qm"}))
    r = cut(packed(rows.withColumn("rb", F.pmod(F.monotonically_increasing_id(), F.lit(row_blocks))), "rb"))
    # every block of rows goes to every block of queries: the stated query set against all rows, in blocks
    dealt = r.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(query_blocks - 1).cast("bigint"))).alias("qb"), "rb", F.col("ids").alias("rids"), F.col("m").alias("rm"))
    dealt = attach(dealt, q, ["qb"]).repartition(F.col("qb"), F.col("rb"))
    cells = ["qb", "qids", "qm", "rids", "rm"]

    lists = dealt.select(*cells).mapInArrow(phase1(k), "qb bigint, query bigint, totals array<bigint>")
    best = Window.partitionBy("query").orderBy(F.desc("total"))
    kth = lists.select("qb", "query", F.explode_outer("totals").alias("total")).withColumn("place", F.row_number().over(best))
    # with fewer than k candidates every one is part of the answer
    cuts = kth.groupBy("qb", "query").agg(F.coalesce(F.max(F.when(F.col("place") == k, F.col("total"))), F.lit(-(1 << 62))).alias("cut"))
    # a block's cutoffs are at most its queries; they travel with the block
    by_block = cut(cuts.groupBy("qb").agg(F.map_from_entries(F.collect_list(F.struct("query", "cut"))).alias("cuts")))
    second = attach(dealt, by_block, ["qb"]).select(*cells, "cuts")
    left = second.mapInArrow(phase2, "query bigint, id bigint")
    dot = F.aggregate(F.zip_with("qv", "v", lambda a, b: a * b), F.lit(0).cast("bigint"), lambda a, x: a + x)
    asked = v.where(F.col("id") % every == 0).select(F.col("id").alias("query"), F.col("v").alias("qv"))
    full = attach(left.join(rows.hint("merge"), "id"), asked, ["query"]).select("query", "id", dot.alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return full.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")

