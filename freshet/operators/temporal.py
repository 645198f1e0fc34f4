"""Lookups in time series: step and linear as-of joins, order checks, regridding.

Queries meet knots through buckets of time: each interval between knots is listed under
the buckets it covers, so the lookup is an equality join that spreads over tasks for any
number of queries, and no single window sorts a whole series of queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stable_sort(series: DataFrame, *keys: str, seq: str = "seq") -> DataFrame:
    """Rows by time, equal times in the order of seq."""
    return series.orderBy(*keys, "t", seq)


def intervals(series: DataFrame, seq: str | None = None, width: float = 21600.0) -> DataFrame:
    """(t0, v0, t1, v1): knots with the next one (null after the last), equal times in order of seq.

    Knots are ordered within buckets of time; the last of a bucket takes the first of the
    next bucket that has any, from a list with one row for each bucket.
    """
    tie = [seq] if seq else []
    knots = series.withColumn("_k", F.floor(F.col("t") / width))
    w = Window.partitionBy("_k").orderBy("t", *tie)
    first = knots.groupBy("_k").agg(F.min(F.struct("t", *tie, "v")).alias("f"))
    after = first.select("_k", F.lead("f").over(Window.orderBy("_k")).alias("f"))  # a row for each bucket
    x = knots.select("_k", F.col("t").alias("t0"), F.col("v").alias("v0"), F.lead("t").over(w).alias("_t"), F.lead("v").over(w).alias("_v")).join(after, "_k")
    inside = F.col("_t").isNotNull()
    return x.select("t0", "v0", F.when(inside, F.col("_t")).otherwise(F.col("f.t")).alias("t1"), F.when(inside, F.col("_v")).otherwise(F.col("f.v")).alias("v1"))


def _ends(series: DataFrame, seq: str | None) -> DataFrame:
    """One row: first and last knot."""
    tie = [seq] if seq else []
    return series.agg(F.min(F.struct("t", *tie, "v")).alias("a"), F.max(F.struct("t", *tie, "v")).alias("b")).select(
        F.col("a.t").alias("ta"), F.col("a.v").alias("va"), F.col("b.t").alias("tb"), F.col("b.v").alias("vb")
    )


def _bucketed(queries: DataFrame, series: DataFrame, width: float, inside: Column, seq: str | None) -> DataFrame:
    knots = intervals(series, seq, width).where("t1 > t0")
    listed = knots.withColumn("_k", F.explode(F.sequence(F.floor(F.col("t0") / width), F.floor(F.col("t1") / width))))
    return queries.withColumn("_k", F.floor(F.col("tq") / width)).join(listed, "_k").where(inside).drop("_k")


def asof_step(queries: DataFrame, series: DataFrame, width: float = 21600.0, seq: str | None = None) -> DataFrame:
    """queries (…, tq) with v of the last knot at or before tq; the first knot's value before it."""
    keys = queries.columns
    ends = F.broadcast(_ends(series, seq))  # one row
    q = queries.crossJoin(ends)
    outer = q.where((F.col("tq") < F.col("ta")) | (F.col("tq") >= F.col("tb"))).select(*keys, F.when(F.col("tq") < F.col("ta"), F.col("va")).otherwise(F.col("vb")).alias("v"))
    inner = _bucketed(q.where((F.col("tq") >= F.col("ta")) & (F.col("tq") < F.col("tb"))).select(*keys), series, width, (F.col("tq") >= F.col("t0")) & (F.col("tq") < F.col("t1")), seq)
    return outer.unionByName(inner.select(*keys, F.col("v0").alias("v")))


def asof_linear(queries: DataFrame, series: DataFrame, width: float = 21600.0, seq: str | None = None) -> DataFrame:
    """queries with v interpolated between the knots around tq, held flat outside them."""
    keys = queries.columns
    q = queries.crossJoin(F.broadcast(_ends(series, seq)))
    outer = q.where((F.col("tq") <= F.col("ta")) | (F.col("tq") > F.col("tb"))).select(*keys, F.when(F.col("tq") <= F.col("ta"), F.col("va")).otherwise(F.col("vb")).alias("v"))
    inner = _bucketed(q.where((F.col("tq") > F.col("ta")) & (F.col("tq") <= F.col("tb"))).select(*keys), series, width, (F.col("tq") > F.col("t0")) & (F.col("tq") <= F.col("t1")), seq)
    w = (F.col("tq") - F.col("t0")) / (F.col("t1") - F.col("t0"))
    return outer.unionByName(inner.select(*keys, (F.col("v0") + w * (F.col("v1") - F.col("v0"))).alias("v")))


def regrid(series: DataFrame, start: float, stop: float, step: float) -> DataFrame:
    """(k, tq, v) on the grid start, start + step, ... below stop."""
    n = max(0, int(-(-(stop - start) // step)))
    grid = series.sparkSession.range(n).select(F.col("id").alias("k"), (F.lit(start) + F.col("id") * F.lit(step)).alias("tq"))
    return asof_linear(grid, series)


def out_of_order(series: DataFrame, seq: str = "seq", width: int = 100_000) -> DataFrame:
    """Rows whose time lies before that of the row ahead of them; equal times are in order."""
    x = series.withColumn("_k", F.floor(F.col(seq) / width))
    last = x.groupBy("_k").agg(F.max_by("t", seq).alias("t"))
    before = last.select("_k", F.lag("t").over(Window.orderBy("_k")).alias("_b"))  # a row for each run of seq
    own = F.lag("t").over(Window.partitionBy("_k").orderBy(seq))
    return x.withColumn("_p", own).join(before, "_k").where(F.coalesce("_p", "_b") > F.col("t")).select(*series.columns)


def require_order(series: DataFrame, seq: str = "seq") -> DataFrame:
    if out_of_order(series, seq).limit(1).count():
        raise ValueError("time must not decrease")
    return series


def keep_last(series: DataFrame, seq: str = "seq") -> DataFrame:
    """One row for each time, the last of equals."""
    return series.groupBy("t").agg(F.max_by("v", seq).alias("v"))


def constant_series(spark, rate: float, start: float = 0.0, stop: float = 86400.0) -> DataFrame:
    return spark.createDataFrame([(start, rate), (stop, rate)], "t double, v double")


def datum_guard(series: DataFrame, limit: float = 15.0) -> DataFrame:
    """The series, if no stage lies further than ``limit`` from the datum."""
    if series.where((F.abs("v") > limit) | F.isnan("v")).limit(1).count():
        raise ValueError(f"a stage exceeds {limit} m: check the datum")
    return series


def gather_rain(cells: DataFrame, lookup: DataFrame, rain: DataFrame, t: float) -> DataFrame:
    """(i, j, rate) at time t from native rows (t, pix, rate): the frame as of t, then an equality join."""
    first = rain.agg(F.min("t").alias("t")).first().t
    frame = rain.where(F.col("t") <= t).agg(F.max("t").alias("t")).first().t
    now = rain.where(F.col("t") == F.lit(first if frame is None else frame)).select("pix", "rate")
    return cells.join(lookup, ["i", "j"]).join(now, "pix", "left").select("i", "j", F.coalesce("rate", F.lit(0.0)).alias("rate"))
