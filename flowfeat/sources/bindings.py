"""Observation, weather, grid and catalog tables made from the test tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, d: str) -> DataFrame:
    """Orders as observations of sites (customers) in groups (nations) and supergroups (regions)."""
    c, n = table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    p = F.col("o_orderpriority")
    return (
        table(spark, d, "orders")
        .join(c, F.col("o_custkey") == F.col("c_custkey"))
        .join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # the nations of the schema: a fixed few rows
        .select(
            F.col("o_orderkey").alias("observation_id"),
            F.col("o_custkey").alias("site"),
            F.to_date("o_orderdate").alias("date"),
            F.col("c_nationkey").alias("grp"),
            F.col("n_regionkey").alias("sup"),
            p.alias("level"),
            F.when(p.isin("1-URGENT", "2-HIGH"), "HIGH").when(p == "3-MEDIUM", "MEDIUM").when(p == "5-LOW", "LOW").alias("bucket"),
            F.when(p == "5-LOW", 1).when(p == "3-MEDIUM", 2).when(p == "2-HIGH", 3).when(p == "1-URGENT", 4).alias("rank"),
            F.col("o_totalprice").alias("price"),
            F.col("o_orderstatus").alias("status"),
        )
    )


OBS = """obs AS (
  SELECT o_orderkey AS observation_id, o_custkey AS site, CAST(o_orderdate AS DATE) AS date, c_nationkey AS grp, n_regionkey AS sup, o_orderpriority AS level,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'HIGH' WHEN o_orderpriority = '3-MEDIUM' THEN 'MEDIUM' WHEN o_orderpriority = '5-LOW' THEN 'LOW' END AS bucket,
         CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '2-HIGH' THEN 3 WHEN '1-URGENT' THEN 4 END AS rank,
         o_totalprice AS price, o_orderstatus AS status
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def wx(spark: SparkSession, d: str) -> DataFrame:
    """Line items as daily series of targets (suppliers); days without items are missing."""
    return (
        table(spark, d, "lineitem")
        .groupBy(F.col("l_suppkey").alias("target"), F.to_date("l_shipdate").alias("date"))
        .agg(F.sum("l_quantity").alias("precipitation"), F.round(F.sum("l_tax") * 100, 4).alias("rain"), F.round(F.sum("l_discount") * 100, 4).alias("snow"), F.round(F.avg("l_discount") * 100 - 5, 4).alias("temp"))
    )


WX = """wx AS (
  SELECT l_suppkey AS target, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS precipitation, round(sum(l_tax) * 100, 4) AS rain,
         round(sum(l_discount) * 100, 4) AS snow, round(avg(l_discount) * 100 - 5, 4) AS temp
  FROM lineitem GROUP BY 1, 2)"""


def grid(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as grid cells of basins (nations), weighted by their share of the basin's balances."""
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("basin"), F.col("s_suppkey").alias("cell"), F.abs("s_acctbal").alias("w"))
    total = s.groupBy("basin").agg(F.sum("w").alias("t"))
    return s.join(total, "basin").select("basin", "cell", (F.col("w") / F.col("t")).alias("weight"))


GRID = """grid AS (
  SELECT s_nationkey AS basin, s_suppkey AS cell, abs(s_acctbal) / sum(abs(s_acctbal)) OVER (PARTITION BY s_nationkey) AS weight FROM supplier)"""


def _place(k) -> list:
    return [((k * 7919 % 18000) / 100 - 90).alias("lat"), ((k * 104729 % 36000) / 100 - 180).alias("lon")]


def cat(spark: SparkSession, d: str) -> DataFrame:
    """Parts as a catalog with positions."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        k.alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"),
        (k % 25).cast("int").alias("region"), F.when(k % 7 == 0, None).otherwise((k % 41) / 10).alias("interest"), (k * 31 % 97).cast("int").alias("votes"), (k % 5 == 0).alias("forbidden"), *_place(k),
    )


CAT = """cat AS (
  SELECT p_partkey AS id, p_name AS name, p_brand AS brand, p_type AS type, p_size AS size, p_retailprice AS price, CAST(p_partkey % 25 AS INT) AS region,
         CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE (p_partkey % 41) / 10.0::DOUBLE END AS interest, CAST(p_partkey * 31 % 97 AS INT) AS votes, p_partkey % 5 = 0 AS forbidden,
         (p_partkey * 7919 % 18000) / 100.0::DOUBLE - 90 AS lat, (p_partkey * 104729 % 36000) / 100.0::DOUBLE - 180 AS lon
  FROM part)"""


def pred(spark: SparkSession, d: str) -> DataFrame:
    """Observations with a bucket and made-up predictions of it."""
    cents = F.round(F.col("price") * 100).cast("long")
    return obs(spark, d).filter("bucket IS NOT NULL").withColumns({"score": (cents % 500000) / 100000.0, "p_high": (cents % 100000) / 100000.0})


PRED = (
    OBS
    + """, pred AS (
  SELECT *, (CAST(round(price * 100) AS BIGINT) % 500000) / 100000.0::DOUBLE AS score, (CAST(round(price * 100) AS BIGINT) % 100000) / 100000.0::DOUBLE AS p_high
  FROM obs WHERE bucket IS NOT NULL)"""
)


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Line items as cells of basins (suppliers): class codes, elevations, validity."""
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("basin"), F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col"), (F.col("l_quantity") % 10).cast("int").alias("code"), (F.col("l_extendedprice") / 20).alias("elevation"),
        (F.col("l_returnflag") != "N").alias("valid"), (F.col("l_discount") * 300).alias("slope"), ((F.col("l_partkey") * 37) % 360).cast("double").alias("aspect"), (F.col("l_tax") * 1000).alias("clay"), (F.col("l_discount") * 900).alias("sand"),
    )


CELLS = """cells AS (
  SELECT l_suppkey AS basin, l_orderkey AS row, l_linenumber AS col, CAST(l_quantity % 10 AS INT) AS code, l_extendedprice / 20 AS elevation, l_returnflag <> 'N' AS valid,
         l_discount * 300 AS slope, CAST((l_partkey * 37) % 360 AS DOUBLE) AS aspect, l_tax * 1000 AS clay, l_discount * 900 AS sand
  FROM lineitem)"""


def ev(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")
