"""Grids and series derived from the driver's tables, as DataFrames and as standard SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

N = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros() -> F.Column:
    """Microseconds of an event since 2024-01-01, whatever the session's time zone."""
    return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")


def cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, j, n, b, h, hu, hv) on a 64 x 64 grid; sums are of integers, so order is no matter."""
    agg = (
        table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % N).cast("int").alias("i"), (F.col("l_partkey") % N).cast("int").alias("j"))
        .agg(F.sum(F.col("l_quantity").cast("long")).alias("s"), F.count("*").alias("n"))
    )
    grid = spark.range(N * N).select((F.col("id") / N).cast("int").alias("i"), (F.col("id") % N).cast("int").alias("j"))
    n = F.coalesce(F.col("n"), F.lit(0)).cast("long")
    b = F.coalesce(F.col("s") % 97, F.lit(0)) / F.lit(64.0)
    h = F.greatest(F.lit(0.0), F.lit(0.75) - F.col("b"))
    return (
        grid.join(F.broadcast(agg), ["i", "j"], "left")  # at most N * N groups
        .select("i", "j", n.alias("n"), b.alias("b")).withColumn("h", h)
        .withColumn("hu", F.col("h") * ((F.col("n") % 17 - 8) / F.lit(32.0))).withColumn("hv", F.col("h") * ((F.lit(5) - F.col("n") % 17) / F.lit(64.0)))
    )


CELL = f"""agg AS (SELECT CAST(l_orderkey % {N} AS INT) AS i, CAST(l_partkey % {N} AS INT) AS j, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS s, count(*) AS n FROM lineitem GROUP BY 1, 2),
grid AS (SELECT CAST(x.range // {N} AS INT) AS i, CAST(x.range % {N} AS INT) AS j FROM range({N * N}) AS x),
base AS (SELECT grid.i, grid.j, CAST(coalesce(n, 0) AS BIGINT) AS n, coalesce(s % 97, 0) / CAST(64 AS DOUBLE) AS b FROM grid LEFT JOIN agg ON grid.i = agg.i AND grid.j = agg.j),
depth AS (SELECT *, greatest(CAST(0 AS DOUBLE), CAST(0.75 AS DOUBLE) - b) AS h FROM base),
cell AS (SELECT *, h * ((n % 17 - 8) / CAST(32 AS DOUBLE)) AS hu, h * ((5 - n % 17) / CAST(64 AS DOUBLE)) AS hv FROM depth)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, v): hourly rain rates in mm/h by seconds since 2024-01-01."""
    hour = F.floor(micros() / F.lit(3600000000)).cast("long")
    return table(spark, sf_dir, "events").groupBy(hour.alias("hr")).agg(F.count("*").alias("n")).select((F.col("hr") * F.lit(3600.0)).alias("t"), (F.col("n") % 50).cast("double").alias("v"))


SERIES = """hourly AS (SELECT CAST(floor((epoch_us(ts) - 1704067200000000) / CAST(3600000000 AS DOUBLE)) AS BIGINT) AS hr, count(*) AS n FROM events GROUP BY 1),
series AS (SELECT hr * CAST(3600 AS DOUBLE) AS t, CAST(n % 50 AS DOUBLE) AS v FROM hourly)"""


def stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, v): first event of each six hours, t in whole microseconds, v a stage in metres."""
    us = micros()
    e = table(spark, sf_dir, "events").select(us.alias("us"), "event_id", "value")
    one = e.groupBy(F.floor(F.col("us") / F.lit(21600000000)).cast("long").alias("w")).agg(F.min(F.struct("us", "event_id", "value")).alias("f"))
    return one.select((F.col("f.us") / F.lit(1000000.0)).alias("t"), (F.col("f.value") / F.lit(100.0)).alias("v"))


STAGE = """ev AS (SELECT epoch_us(ts) - 1704067200000000 AS us, event_id, value FROM events),
stage AS (SELECT us / CAST(1000000 AS DOUBLE) AS t, value / CAST(100 AS DOUBLE) AS v FROM ev
  QUALIFY row_number() OVER (PARTITION BY CAST(floor(us / CAST(21600000000 AS DOUBLE)) AS BIGINT) ORDER BY us, event_id) = 1)"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q, tq): times to look up, from before the first to past the last."""
    return spark.range(400).select(F.col("id").alias("q"), (F.col("id") * F.lit(7333.0) - F.lit(20000.0)).alias("tq"))


ASKED = "asked AS (SELECT range AS q, range * CAST(7333 AS DOUBLE) - CAST(20000 AS DOUBLE) AS tq FROM range(400))"


def gauge_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(g, x, y): places of the first eight suppliers, some off the grid."""
    s = table(spark, sf_dir, "supplier").where("s_suppkey <= 8")
    return s.select(F.col("s_suppkey").cast("long").alias("g"), ((F.col("s_suppkey") * 13) % 70 - F.lit(2.5)).cast("double").alias("x"), ((F.col("s_suppkey") * 29) % 70 - F.lit(2.5)).cast("double").alias("y"))


GAUGES = "gauges AS (SELECT CAST(s_suppkey AS BIGINT) AS g, CAST((s_suppkey * 13) % 70 - 2.5 AS DOUBLE) AS x, CAST((s_suppkey * 29) % 70 - 2.5 AS DOUBLE) AS y FROM supplier WHERE s_suppkey <= 8)"


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, j, b, ha, hb): two depth fields from the halves of the orders."""
    li = table(spark, sf_dir, "lineitem")
    qty = F.col("l_quantity").cast("long")
    agg = li.groupBy((F.col("l_orderkey") % N).cast("int").alias("i"), (F.col("l_partkey") % N).cast("int").alias("j")).agg(
        F.sum(F.when(F.col("l_linenumber") % 2 == 0, qty).otherwise(0)).alias("sa"), F.sum(F.when(F.col("l_linenumber") % 2 == 1, qty).otherwise(0)).alias("sb")
    )
    c = cell(spark, sf_dir).select("i", "j", "b")
    return c.join(F.broadcast(agg), ["i", "j"], "left").select("i", "j", "b", (F.coalesce(F.col("sa") % 53, F.lit(0)) / F.lit(32.0)).alias("ha"), (F.coalesce(F.col("sb") % 53, F.lit(0)) / F.lit(32.0)).alias("hb"))


FIELDS = CELL + f""", halves AS (SELECT CAST(l_orderkey % {N} AS INT) AS i, CAST(l_partkey % {N} AS INT) AS j,
  CAST(sum(CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS sa, CAST(sum(CASE WHEN l_linenumber % 2 = 1 THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS sb FROM lineitem GROUP BY 1, 2),
fields AS (SELECT c.i, c.j, c.b, coalesce(sa % 53, 0) / CAST(32 AS DOUBLE) AS ha, coalesce(sb % 53, 0) / CAST(32 AS DOUBLE) AS hb FROM cell c LEFT JOIN halves x ON c.i = x.i AND c.j = x.j)"""
