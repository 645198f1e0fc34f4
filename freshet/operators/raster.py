"""Raster preparation: mosaics, cleaning, infill, land cover, conditioning, rain frames."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions.program import Program
from freshet.operators import ghosts
from freshet.sources import store

NODATA = -9999.0
#: Roughness by land-cover code.
MANNING = {
    11: 0.025, 12: 0.022, 21: 0.060, 22: 0.100, 23: 0.120, 24: 0.150, 31: 0.022, 41: 0.120, 42: 0.140, 43: 0.130,
    51: 0.080, 52: 0.080, 71: 0.040, 72: 0.040, 73: 0.040, 74: 0.040, 81: 0.035, 82: 0.040, 90: 0.110, 95: 0.080,
}
DEFAULT_MANNING = 0.035


def valid(z) -> F.Column:
    return z.isNotNull() & ~F.isnan(z) & (z != NODATA)


def mosaic(tiles: DataFrame) -> DataFrame:
    """(i, j, z): the value of the first tile (by seq) that is valid in each cell."""
    return tiles.where(valid(F.col("z"))).groupBy("i", "j").agg(F.min_by("z", "seq").alias("z"))


def merge_layers(bathy: DataFrame, topo: DataFrame) -> DataFrame:
    """Bathymetry, with land (z > 0) where the other layer has it, and that layer in gaps."""
    b, t = mosaic(bathy).withColumnRenamed("z", "zb"), mosaic(topo).withColumnRenamed("z", "zt")
    z = F.when(F.col("zt") > 0, F.col("zt")).otherwise(F.coalesce("zb", "zt"))
    return b.join(t, ["i", "j"], "full").select("i", "j", z.alias("z"))


def demote_near_zero(dem: DataFrame, least: float = 1e-3) -> DataFrame:
    tiny = (F.abs("z") < least) & (F.col("z") != 0)
    return dem.withColumns({"demoted": F.coalesce(tiny, F.lit(False)), "z": F.when(tiny, NODATA).otherwise(F.col("z"))})


def median_3x3(dem: DataFrame, nx: int, ny: int) -> DataFrame:
    """dem with the median of the 3 by 3 cells around each; edge cells stand in for what is outside."""
    out = dem
    for along, across, n in (("i", "j", nx), ("j", "i", ny)):
        w = Window.partitionBy(across).orderBy(along)
        c = "z" if along == "i" else "_a"
        three = [F.coalesce(F.lag(c).over(w), F.col(c)), F.col(c), F.coalesce(F.lead(c).over(w), F.col(c))]
        out = out.withColumn("_a", F.array(*three)) if along == "i" else out.withColumn("_m", F.element_at(F.array_sort(F.flatten(F.array(*three))), 5))
    return out.withColumn("med", F.col("_m")).drop("_a", "_m")


def despike(dem: DataFrame, nx: int, ny: int, spike: float = 8.0) -> DataFrame:
    """One pass: cells further than ``spike`` from their median take it."""
    m = median_3x3(dem, nx, ny)
    return m.withColumn("z", F.when(F.abs(F.col("z") - F.col("med")) > spike, F.col("med")).otherwise(F.col("z"))).drop("med")


def clip(dem: DataFrame, low: float, high: float) -> DataFrame:
    if high < low:
        raise ValueError("the upper limit is below the lower")
    return dem.withColumns({"clipped": (F.col("z") < low) | (F.col("z") > high), "z": F.least(F.greatest("z", F.lit(low)), F.lit(high))})


def infill_nearest(dem: DataFrame) -> DataFrame:
    """Gaps take the value of the nearest valid cell; ties go to the smaller (i, j); no valid cell gives 0.

    Rings of doubling size are searched: gaps meet valid cells through buckets as wide as
    the ring, so a gap sees a bounded neighbourhood and most are filled by the first ring.
    What a ring leaves is written before the next one, so plans don't grow with the rounds.
    """
    dem = store.kept(dem.select("i", "j", F.col("z").cast("double").alias("z")))
    good = dem.where(valid(F.col("z"))).select("i", "j", "z")
    gaps = dem.where(~F.coalesce(valid(F.col("z")), F.lit(False))).select("i", "j")
    out, reach = good, 2
    if good.isEmpty():
        return dem.select("i", "j", F.lit(0.0).alias("z"))
    while not gaps.isEmpty():
        near = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
        asked = gaps.select("i", "j", near.alias("n")).select("i", "j", (F.floor(F.col("i") / reach) + F.col("n.a")).alias("bi"), (F.floor(F.col("j") / reach) + F.col("n.b")).alias("bj"))
        held = good.select(F.col("i").alias("gi"), F.col("j").alias("gj"), "z", F.floor(F.col("i") / reach).alias("bi"), F.floor(F.col("j") / reach).alias("bj"))
        d2 = (F.col("i") - F.col("gi")) * (F.col("i") - F.col("gi")) + (F.col("j") - F.col("gj")) * (F.col("j") - F.col("gj"))
        # a hit within the reach can't be beaten by a cell outside the buckets
        hit = asked.join(held, ["bi", "bj"]).withColumn("d2", d2).where(F.col("d2") <= reach * reach).groupBy("i", "j").agg(F.min(F.struct("d2", "gi", "gj", "z")).alias("x")).select("i", "j", "x.z")
        hit = store.kept(hit)
        out = out.unionByName(hit)
        gaps = store.kept(gaps.join(hit, ["i", "j"], "left_anti"))
        reach *= 4
    return out


def clean_dem(dem: DataFrame, nx: int, ny: int, least: float = 1e-3, spike: float = 8.0, passes: int = 3, bounds: tuple[float, float] | None = None) -> tuple[DataFrame, dict]:
    """A merged DEM without values near zero, gaps and spikes, and counts of what was done.

    Demoted cells and gaps are filled from their nearest neighbour first; then up to
    ``passes`` times cells far from their median take it, until none is; then the bounds.
    """
    if bounds is not None and bounds[1] < bounds[0]:
        raise ValueError("the upper limit is below the lower")
    marked = demote_near_zero(dem, least)
    stats = {"n_near_zero": marked.where("demoted").count(), "n_spikes": 0, "n_clipped": 0}
    out = infill_nearest(marked.select("i", "j", "z"))
    for _ in range(passes):
        m = store.kept(median_3x3(out, nx, ny))
        n = m.where(F.abs(F.col("z") - F.col("med")) > spike).count()
        if not n:
            break
        stats["n_spikes"] += n
        out = m.select("i", "j", F.when(F.abs(F.col("z") - F.col("med")) > spike, F.col("med")).otherwise(F.col("z")).alias("z"))
    if bounds is not None:
        out = clip(out, *bounds)
        stats["n_clipped"] = out.where("clipped").count()
        if stats["n_clipped"]:
            warnings.warn(f"{stats['n_clipped']} of {nx * ny} cells lay outside {bounds} and are on the bound now", stacklevel=2)
        out = out.select("i", "j", "z")
    return out, stats


def landcover_bands(cells: DataFrame, spark, half: float = 0.5) -> DataFrame:
    """(i, j, nm, mapped) of cells (i, j, code double): codes match within half a unit, the later code wins."""
    rows = [(n, float(c), m) for n, (c, m) in enumerate(sorted(MANNING.items()))]
    table = spark.createDataFrame(rows, "seq int, c double, m double")
    # a value can match only the codes on either side of it
    near = table.select("seq", "c", "m", F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1)).alias("k"))
    hit = cells.join(F.broadcast(near), F.floor(F.col("code") + 0.5) == F.col("k"), "left").where(F.col("c").isNull() | (F.abs(F.col("code") - F.col("c")) <= half))
    best = hit.groupBy("i", "j").agg(F.max_by("m", "seq").alias("m"))
    return cells.select("i", "j").join(best, ["i", "j"], "left").select("i", "j", F.coalesce("m", F.lit(DEFAULT_MANNING)).alias("nm"), F.col("m").isNotNull().alias("mapped"))


def landcover_exact(cells: DataFrame, spark) -> DataFrame:
    table = spark.createDataFrame(list(MANNING.items()), "code int, m double")
    return cells.join(F.broadcast(table), "code", "left").select("i", "j", F.coalesce("m", F.lit(DEFAULT_MANNING)).alias("nm"))


def commonest_unmapped(cells: DataFrame, spark, top: int = 6) -> DataFrame:
    """The most frequent codes without a roughness (a report of ``top`` rows)."""
    table = spark.createDataFrame([(c,) for c in MANNING], "code int")
    return cells.join(F.broadcast(table), "code", "left_anti").groupBy("code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code").limit(top)


def coastline(dem: DataFrame, nx: int, ny: int, dx: float, band: float, min_depth: float, sides=("w",)) -> DataFrame:
    """(i, j) of cells within the band along the sides given that lie deeper than min_depth."""
    k = max(1, int(band // dx))
    edge = {"w": F.col("i") < k, "e": F.col("i") >= nx - k, "s": F.col("j") < k, "n": F.col("j") >= ny - k}
    on = F.lit(False)
    for s in sides:
        on = on | edge[s]
    return dem.where(on & (F.col("z") < -min_depth)).select("i", "j")


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def smooth(dem: DataFrame, nx: int, ny: int, sigma: float = 2.0, low: float = -2.0, high: float = 2.0) -> DataFrame:
    """Gaussian smoothing (edges reflected) of cells with low < z < high; others keep z."""
    w = gaussian_weights(sigma)
    r = len(w) // 2
    if r > min(nx, ny):
        raise ValueError(f"sigma = {sigma} reaches {r} cells, more than the grid has")
    # a wall's ghosts are the reflection; sums of neighbours need one exchange for each axis
    padded = ghosts.fill(dem.withColumns({"_z": F.col("z"), "_u": F.lit(0.0), "_v": F.lit(0.0)}), nx, ny, r, *["wall"] * 4, state=("_z", "_u", "_v"))
    sums = [f"{to} = " + " + ".join(f"{x!r} * n{a}({c}, {k - r})" for k, x in enumerate(w)) for a, c, to in (("x", "_z", "_a"), ("y", "_a", "_s"))]
    out = Program(sums).apply(padded).where(F.col("i").between(0, nx - 1) & F.col("j").between(0, ny - 1))
    return out.withColumn("z", F.when((F.col("z") > low) & (F.col("z") < high), F.col("_s")).otherwise(F.col("z"))).select(*dem.columns)


def condition(dem: DataFrame, nx: int, ny: int) -> DataFrame:
    """A case's bed: gaps filled, clipped to [-10, 50], smoothed near the datum."""
    return smooth(clip(infill_nearest(dem), -10.0, 50.0).drop("clipped"), nx, ny)


def burn_channels(dem: DataFrame, mask: DataFrame, drop: float, target: float, cutoff: float) -> DataFrame:
    """dem lowered along a channel mask (i, j, fine nullable) below the cutoff; finer beds win if lower."""
    x = dem.join(mask.withColumn("_on", F.lit(True)), ["i", "j"], "left")
    on = F.col("_on").isNotNull() & (F.col("z") < cutoff)
    z = F.when(on, F.least("z", F.greatest(F.col("z") - drop, F.lit(target)))).otherwise(F.col("z"))
    return x.withColumns({"eligible": on, "z": F.when(F.col("fine").isNotNull(), F.least(z, F.col("fine"))).otherwise(z)}).select("i", "j", "z", "eligible")


def upsample(coarse: DataFrame, fine: DataFrame, ratio: float) -> DataFrame:
    """fine (i, j) with the value of the coarse cell that holds its centre."""
    x = fine.select("i", "j", F.floor((F.col("i") + 0.5) * ratio).cast("int").alias("ci"), F.floor((F.col("j") + 0.5) * ratio).cast("int").alias("cj"))
    return x.join(coarse.select(F.col("i").alias("ci"), F.col("j").alias("cj"), "z"), ["ci", "cj"]).select("i", "j", "z")


def frame_statistics(frames: DataFrame, area: DataFrame) -> DataFrame:
    """(frame, wet, mean, peak, volume) of rain (frame, pix, rate mm/h), pixels weighted by (pix, cells)."""
    x = frames.join(area, "pix")
    wet = F.col("rate") > 0
    return x.groupBy("frame").agg(
        F.sum(F.when(wet, F.col("cells")).otherwise(0)).alias("wet"), F.sum(F.when(wet, F.col("rate") * F.col("cells")).otherwise(0.0)).alias("_v"), F.max("rate").alias("peak")
    ).select("frame", "wet", (F.col("_v") / F.when(F.col("wet") > 0, F.col("wet"))).alias("mean"), "peak", F.col("_v").alias("volume"))


def best_frame(stats: DataFrame, mean: float, peak: float) -> DataFrame:
    """The frame closest to a wanted mean and peak (one row)."""
    score = F.abs(F.col("mean") - mean) / mean + F.abs(F.col("peak") - peak) / peak
    return stats.withColumn("score", score).where("score is not null").orderBy("score", "frame").limit(1)


def _kernel(kind: str, x):
    """Weight of a cell centre at distance x (in cells) by resampling kind."""
    x = F.abs(x)
    if kind == "nearest":
        return F.lit(1.0)
    if kind == "bilinear":
        return F.greatest(1 - x, F.lit(0.0))
    near = 1.5 * x * x * x - 2.5 * x * x + 1  # cubic convolution with a = -1/2
    far = -0.5 * x * x * x + 2.5 * x * x - 4 * x + 2
    return F.when(x <= 1, near).when(x < 2, far).otherwise(0.0)


def resample(coarse: DataFrame, fine: DataFrame, ratio: float, nx: int, ny: int, kind: str = "bilinear") -> DataFrame:
    """fine (i, j) with z from the coarse centres around its own: nearest, bilinear or cubic; edges are held."""
    if kind not in ("nearest", "bilinear", "cubic"):
        raise ValueError(f"unknown resampling {kind!r}")
    u, v = (F.col("i") + 0.5) * ratio - 0.5, (F.col("j") + 0.5) * ratio - 0.5
    a, c = (F.floor(u + 0.5), F.floor(v + 0.5)) if kind == "nearest" else (F.floor(u), F.floor(v))
    steps = {"nearest": (0,), "bilinear": (0, 1), "cubic": (-1, 0, 1, 2)}[kind]
    corners = F.array(*[
        F.struct(
            F.least(F.greatest(a + d, F.lit(0)), F.lit(nx - 1)).cast("int").alias("ci"), F.least(F.greatest(c + e, F.lit(0)), F.lit(ny - 1)).cast("int").alias("cj"),
            (_kernel(kind, u - a - d) * _kernel(kind, v - c - e)).alias("w"),
        )
        for d in steps for e in steps
    ])
    x = fine.select("i", "j", F.explode(corners).alias("c")).select("i", "j", "c.ci", "c.cj", "c.w")
    return x.join(coarse.select(F.col("i").alias("ci"), F.col("j").alias("cj"), "z"), ["ci", "cj"]).groupBy("i", "j").agg(F.sum(F.col("z") * F.col("w")).alias("z"))
