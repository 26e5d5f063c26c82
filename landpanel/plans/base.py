"""Bindings of the test tables to points, panels, grids and predictions, in Spark and in SQL, and the registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in cols})


def lon(k: Column) -> Column:
    return F.lit(73.0) + F.pmod(k * 7919, F.lit(62000)) / F.lit(1000.0)


def lat(k: Column) -> Column:
    return F.lit(18.0) + F.pmod(k * 104729, F.lit(35000)) / F.lit(1000.0)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("vec_id")
    tier = F.get(F.array(*map(F.lit, ("gold", "silver", "bronze", "external", "uncovered"))), (k % 6).cast("int"))
    return table(spark, sf_dir, "embeddings").select(
        k.alias("row_id"), lon(k).alias("lon"), lat(k).alias("lat"), F.col("label").alias("class_new"), F.when(k % 31 != 0, F.concat(F.lit("p"), k % 7)).alias("province"),
        F.concat(F.lit("s"), k % 5).alias("src"), tier.alias("tier"), F.when(k % 10 != 0, F.lit(0.3) + (k % 7) / F.lit(10.0)).alias("src_conf"),
        (F.lit(2017) + k % 3).cast("int").alias("valid_from"), (F.lit(2024) - k % 2).cast("int").alias("valid_to"), F.transform("embedding", lambda x: x.cast("double")).alias("v"),
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point-years with a gap, a spike and a zero vector here and there."""
    k, y = F.col("vec_id"), F.col("year")
    e = table(spark, sf_dir, "embeddings").withColumn("year", F.explode(F.sequence(F.lit(2017), F.lit(2024)))).where((k + y) % 11 != 0)
    scale = (F.lit(1.0) + (k * (y - 2016)) % 7 / F.lit(100.0)) * F.when((k * 31 + y) % 97 == 0, 3.0).otherwise(1.0) * F.when((k % 83 == 1) & (y == 2020), 0.0).otherwise(1.0)
    return e.withColumn("_s", scale).select(k.alias("row_id"), y.alias("year"), F.col("label").alias("class_new"), F.transform("embedding", lambda x: x.cast("double") * F.col("_s")).alias("v"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, year, truth, pred, zone, src, score, w): three in four rows are right."""
    k, y = F.col("row_id"), F.col("year")
    d = points(spark, sf_dir).drop("v").withColumn("year", F.explode(F.sequence(F.lit(2017), F.lit(2024))))
    pred = F.when((k * 7 + y) % 4 == 0, (F.col("class_new") + 1 + k % 3) % 11).otherwise(F.col("class_new")).cast("int")
    return d.select("row_id", "year", F.col("class_new").alias("truth"), pred.alias("pred"), F.coalesce("province", F.lit("other")).alias("zone"), "src", "tier", ((k * 37 + y * 11) % 101 / F.lit(100.0)).alias("score"), "lon", "lat")


def whole_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class grid with a cell for each order: columns grow with the table, the code is that of the order's first line."""
    first = F.min_by(F.col("l_suppkey") % 4, F.struct("l_linenumber", "l_partkey", "l_suppkey")).cast("int")
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 90).alias("row"), F.floor(F.col("l_orderkey") / 90).cast("bigint").alias("col")).agg(first.alias("code"))


def order_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("row_id"), lon(k).alias("lon"), lat(k).alias("lat"), F.col("o_custkey").alias("cust"), "o_orderstatus", F.col("o_totalprice").alias("price"))


def lonlat(k: str) -> str:
    return f"73.0::DOUBLE + (({k} * 7919) % 62000) / 1000.0::DOUBLE AS lon, 18.0::DOUBLE + (({k} * 104729) % 35000) / 1000.0::DOUBLE AS lat"


POINTS = f"""points AS (
  SELECT vec_id AS row_id, {lonlat("vec_id")}, label AS class_new, CASE WHEN vec_id % 31 <> 0 THEN 'p' || (vec_id % 7) END AS province,
         's' || (vec_id % 5) AS src, ['gold', 'silver', 'bronze', 'external', 'uncovered'][vec_id % 6 + 1] AS tier,
         CASE WHEN vec_id % 10 <> 0 THEN 0.3::DOUBLE + (vec_id % 7) / 10.0::DOUBLE END AS src_conf,
         (2017 + vec_id % 3)::INTEGER AS valid_from, (2024 - vec_id % 2)::INTEGER AS valid_to, embedding::DOUBLE[] AS v FROM embeddings)"""

PANEL = """panel0 AS (
  SELECT vec_id AS row_id, y.year::INTEGER AS year, label AS class_new, embedding,
         (1.0::DOUBLE + ((vec_id * (y.year - 2016)) % 7) / 100.0::DOUBLE) * (CASE WHEN (vec_id * 31 + y.year) % 97 = 0 THEN 3.0 ELSE 1.0 END)::DOUBLE
         * (CASE WHEN vec_id % 83 = 1 AND y.year = 2020 THEN 0.0 ELSE 1.0 END)::DOUBLE AS s
  FROM embeddings, range(2017, 2025) y(year) WHERE (vec_id + y.year) % 11 <> 0),
panel AS (SELECT row_id, year, class_new, list_transform(embedding, lambda x: x::DOUBLE * s) AS v FROM panel0)"""

PREDICTIONS = f"""{POINTS},
predictions AS (
  SELECT row_id, y.year::INTEGER AS year, class_new AS truth,
         (CASE WHEN (row_id * 7 + y.year) % 4 = 0 THEN (class_new + 1 + row_id % 3) % 11 ELSE class_new END)::INTEGER AS pred,
         coalesce(province, 'other') AS zone, src, tier, ((row_id * 37 + y.year * 11) % 101) / 100.0::DOUBLE AS score, lon, lat
  FROM points, range(2017, 2025) y(year))"""

WHOLE_GRID = "grid AS (SELECT l_orderkey % 90 AS row, l_orderkey // 90 AS col, arg_min(l_suppkey % 4, (l_linenumber, l_partkey, l_suppkey))::INTEGER AS code FROM lineitem GROUP BY ALL)"

ORDER_POINTS = f"order_points AS (SELECT o_orderkey AS row_id, {lonlat('o_orderkey')}, o_custkey AS cust, o_orderstatus, o_totalprice AS price FROM orders)"

#: The vector helpers of functions.vec as DuckDB expressions.
NORM = "sqrt(list_dot_product({0}, {0}))"

SEEDED = "(({0} % 2147483647) + {1}) * 2654435761 % 2147483647"

HAVERSINE = "2 * 6371.0088::DOUBLE * asin(least(sqrt(pow(sin(radians({3} - {1}) / 2), 2) + cos(radians({1})) * cos(radians({3})) * pow(sin(radians({2} - {0}) / 2), 2)), 1))"
