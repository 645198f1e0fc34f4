"""Reductions, sampling and scoring of flood fields."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions import flow
from freshet.functions.program import Program

G = 9.81


def wave_speeds(cells: DataFrame, norm: str = "linf", h_min: float = 1e-6) -> DataFrame:
    """cells with the wave speed lam in the norm given (1d, linf, l2)."""
    made = {"1d": flow.wave_speed_1d, "linf": flow.wave_speed_2d, "l2": flow.wave_speed_l2}[norm]
    return Program(made("lam", repr(float(h_min)))).apply(cells)


def _step(top, cfl: float, dx: float, floor: float):
    # a speed that isn't a number is the largest and gives a step that isn't one: guarded by the caller
    return F.lit(cfl * dx) / (F.greatest(F.coalesce(top, F.lit(0.0)), F.lit(floor)) + F.lit(1e-12))


def cfl_step(cells: DataFrame, dx: float, cfl: float = 0.5, h_min: float = 1e-6, norm: str = "linf", skip_dry: bool = False, percentile: float | None = None) -> DataFrame:
    """One row (lam, dt). skip_dry leaves out cells below h_min and those marked cfl_skip."""
    x = wave_speeds(cells, norm, 1e-10 if norm == "1d" else h_min)
    if skip_dry:
        x = x.where(F.col("h") >= h_min)
        if "cfl_skip" in cells.columns:
            x = x.where(~F.col("cfl_skip"))
        if "inv_sigma" in cells.columns:
            x = x.withColumn("lam", F.col("lam") * F.col("inv_sigma"))
    top = F.max("lam") if percentile is None else F.percentile("lam", F.lit(percentile / 100))
    return x.agg(top.alias("lam")).select("lam", _step(F.col("lam"), cfl, dx, math.sqrt(G * h_min)).alias("dt"))


def rain_limit(dt: float, rate: float, cfl: float, dx: float) -> float:
    """A step that lays down no more rain (m/s) than its own CFL condition allows."""
    return dt if rate <= 0 else min(dt, (cfl * dx) ** (2 / 3) / (G * rate) ** (1 / 3))


def held_step(dt: float, k: int) -> float:
    """The step that is kept for k steps: with a margin if it isn't looked at again at once."""
    return dt if k <= 1 else 0.95 * dt


def finite(dt: float | None, t: float = 0.0) -> float:
    """dt, if it is a finite number."""
    if dt is None or not math.isfinite(dt):
        raise FloatingPointError(f"the wave speed at t = {t} isn't finite")
    return dt


#: No step is longer than this, whatever the speeds.
LONGEST = 1800.0


def next_step(dt: float, t: float, t_end: float, dt_min: float = 0.0, dt_max: float = math.inf) -> float:
    """The step used: capped, not below dt_min, and ending at t_end."""
    return min(max(min(finite(dt, t), dt_max, LONGEST), dt_min), t_end - t)


def masked_peak(cells: DataFrame) -> DataFrame:
    return cells.where("active").agg(F.max("h").alias("h_max"))


def volume(cells: DataFrame, dx: float) -> DataFrame:
    return cells.agg((F.sum("h") * F.lit(dx * dx)).alias("volume"))


def gauge_cells(gauges: DataFrame, nx: int, ny: int, dx: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """gauges (g, x, y) with their cell and whether it lies on the grid."""
    i, j = F.floor((F.col("x") - x0) / dx).cast("int"), F.floor((F.col("y") - y0) / dx).cast("int")
    return gauges.select("g", i.alias("i"), j.alias("j"), (i.between(0, nx - 1) & j.between(0, ny - 1)).alias("inside"))


def sample(cells: DataFrame, places: DataFrame, dry: float = 1e-12) -> DataFrame:
    """(g, h, u, v, eta) at gauge cells (g, i, j)."""
    x = cells.join(places.select("g", "i", "j"), ["i", "j"])
    wet = F.col("h") > dry
    safe = F.when(wet, F.col("h")).otherwise(1.0)
    return x.select("g", "h", *[F.when(wet, F.col(m) / safe).otherwise(0.0).alias(u) for m, u in (("hu", "u"), ("hv", "v"))], (F.col("h") + F.col("b")).alias("eta"))


def cadence(steps: DataFrame, every: float) -> DataFrame:
    """Rows of steps (t, …) at which a sampler with a fixed grid of times fires: the first of each interval."""
    w = Window.partitionBy(F.floor((F.col("t") + 1e-12) / every)).orderBy("t")
    return steps.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def cross_sections(cells: DataFrame, pixels: DataFrame, dx: float) -> DataFrame:
    """(g, h_max, h_mean, wse, q, n) over pixels (g, i, j, bed_mean)."""
    x = cells.join(pixels, ["i", "j"])
    speed = F.sqrt(F.col("hu") * F.col("hu") + F.col("hv") * F.col("hv"))
    s = x.groupBy("g").agg(F.max("h").alias("h_max"), F.avg("h").alias("h_mean"), F.first("bed_mean").alias("_b"), (F.sum(speed) * F.lit(dx)).alias("q"), F.count("*").alias("n"))
    return s.select("g", "h_max", "h_mean", (F.col("h_max") + F.col("_b")).alias("wse"), "q", "n")


def envelope(frames: DataFrame) -> DataFrame:
    """(i, j, peak): the greatest depth of each cell over frames (i, j, h)."""
    return frames.groupBy("i", "j").agg(F.max("h").alias("peak"))


THRESHOLDS = (0.1, 0.3, 0.5, 1.0)


def agreement(pair: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """(threshold, csi, rmse_union, rmse_both, n_a, n_b) of depths ha, hb."""
    t = F.col("threshold")
    x = pair.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    a, b = F.col("ha") > t, F.col("hb") > t
    d2 = (F.col("ha") - F.col("hb")) * (F.col("ha") - F.col("hb"))
    return x.groupBy("threshold").agg(
        (F.count_if(a & b) / F.nullif(F.count_if(a | b), F.lit(0))).alias("csi"), F.sqrt(F.avg(F.when(a | b, d2))).alias("rmse_union"), F.sqrt(F.avg(F.when(a & b, d2))).alias("rmse_both"),
        F.count_if(a).alias("n_a"), F.count_if(b).alias("n_b"),
    )


def class_scores(pair: DataFrame) -> DataFrame:
    """RMSE and bias by bed class: sea below 0.25, nearshore to 0.75, land above (limits of the case)."""
    kind = F.when(F.col("b") < 0.25, "sea").when(F.col("b") < 0.75, "nearshore").otherwise("land")
    d = F.col("ha") - F.col("hb")
    return pair.groupBy(kind.alias("kind")).agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(d).alias("bias"), F.count("*").alias("n"))


def extent(pair: DataFrame, dx: float, threshold: float) -> DataFrame:
    km2 = F.lit(dx * dx / 1e6)
    return pair.agg((F.count_if(F.col("ha") > threshold) * km2).alias("km2_a"), (F.count_if(F.col("hb") > threshold) * km2).alias("km2_b"))


def surface_statistics(pair: DataFrame, threshold: float) -> DataFrame:
    eta = F.when(F.col("ha") > threshold, F.col("ha") + F.col("b"))
    return pair.agg(F.avg(eta).alias("mean"), F.stddev_pop(eta).alias("std"))


def orientation(pair: DataFrame, n: int) -> DataFrame:
    """(flip, corr) of ha with hb under the eight symmetries of the square."""
    i, j, k = F.col("i"), F.col("j"), n - 1
    turned = {"id": (i, j), "fx": (k - i, j), "fy": (i, k - j), "r180": (k - i, k - j), "t": (j, i), "tfx": (k - j, i), "tfy": (j, k - i), "t180": (k - j, k - i)}
    one = pair.select(F.explode(F.array(*[F.struct(F.lit(f).alias("flip"), a.cast("int").alias("i"), b.cast("int").alias("j")) for f, (a, b) in turned.items()])).alias("p"), "hb").select("p.*", "hb")
    return one.join(pair.select("i", "j", "ha"), ["i", "j"]).groupBy("flip").agg(F.corr("ha", "hb").alias("corr"))
