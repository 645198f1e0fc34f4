"""Series and gauges in CSV, rasters in GeoTIFF and GRIB where their libraries exist."""

from __future__ import annotations

import urllib.parse
import urllib.request
import warnings

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from freshet.operators import temporal


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header, names trimmed, with the order of its lines in _seq."""
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    return raw.toDF(*[c.strip() for c in raw.columns]).withColumn("_seq", F.monotonically_increasing_id())


def _number(c):
    return F.trim(c).try_cast("double")


def rain_csv(spark: SparkSession, path: str, time: str = "time_s", rate: str = "rate_mm_h") -> DataFrame:
    """(t, v, seq) by time; warns if the file wasn't in order."""
    out = _rows(spark, path).select(_number(F.col(f"`{time}`")).alias("t"), _number(F.col(f"`{rate}`")).alias("v"), F.col("_seq").alias("seq"))
    if not temporal.out_of_order(out).isEmpty():
        warnings.warn(f"{path}: times were out of order and are sorted", stacklevel=2)
    return out.orderBy("t", "seq")


def tide_csv(spark: SparkSession, path: str, t0: str, time: str | None = None, level: str | None = None) -> DataFrame:
    """(t, v): seconds after t0 (UTC) and water levels; rows that hold no number or time go.

    Columns are found by what their names contain, if they aren't named.
    """
    raw = _rows(spark, path)
    pick = lambda want, words: want or next((c for c in raw.columns if any(w in c.lower() for w in words)), None)
    time, level = pick(time, ("date", "time")), pick(level, ("water level", "level", "stage"))
    if not time or not level:
        raise ValueError(f"{path} has no time or level column")
    when = F.try_to_timestamp(F.trim(F.col(f"`{time}`")))
    out = raw.select(((F.unix_micros(when) - F.unix_micros(F.lit(t0).cast("timestamp"))) / F.lit(1e6)).alias("t"), _number(F.col(f"`{level}`")).alias("v"), F.col("_seq").alias("seq"))
    out = out.where("t is not null and v is not null and not isnan(v)").orderBy("t", "seq").select("t", "v")
    if not out.limit(1).count():
        raise ValueError(f"{path} holds no usable level")
    return out


def gauge_csv(spark: SparkSession, path: str, t0: str) -> DataFrame:
    """(t, v) with one row for each time, the last of equals."""
    raw = _rows(spark, path)
    a, b = raw.columns[0], raw.columns[1]
    x = raw.select(((F.unix_micros(F.try_to_timestamp(F.trim(F.col(f"`{a}`")))) - F.unix_micros(F.lit(t0).cast("timestamp"))) / F.lit(1e6)).alias("t"), _number(F.col(f"`{b}`")).alias("v"), "_seq")
    return x.where("t is not null and v is not null and not isnan(v)").groupBy("t").agg(F.max_by("v", "_seq").alias("v")).orderBy("t")


def write_gauges(records: DataFrame, path: str) -> None:
    """Gauge records (g, t, h, u, v, eta) as CSV, six significant digits, a folder for each gauge."""
    six = lambda c: F.format_string("%.6g", F.col(c))
    records.select("g", six("t").alias("t_s"), six("h").alias("h_m"), six("u").alias("u_ms"), six("v").alias("v_ms"), six("eta").alias("eta_m")).write.mode("overwrite").partitionBy("g").option("header", True).csv(path)


def write_cross_sections(records: DataFrame, path: str) -> None:
    six = lambda c: F.format_string("%.6f", F.col(c))
    names = {"t": "t_s", "wse": "wse_cs_m", "q": "Q_cs_m3s", "h_max": "h_max_cs_m", "h_mean": "h_mean_cs_m"}
    records.select("g", *[six(k).alias(v) for k, v in names.items()], F.col("n").alias("n_pix")).write.mode("overwrite").partitionBy("g").option("header", True).csv(path)


def download_tide(url: str, target: str, **query: str) -> None:
    """Fetch a tide CSV on the driver; a reply that starts with an error raises."""
    with urllib.request.urlopen(f"{url}?{urllib.parse.urlencode(query)}", timeout=60) as reply:
        body = reply.read().decode()
    if "error" in body[:200].lower():
        raise ValueError(body[:200])
    with open(target, "w") as f:
        f.write(body)


def geotiff(spark: SparkSession, path: str, band: int = 1) -> DataFrame:
    """(i, j, z) of a north-up raster, j from the south (needs rasterio; untested here)."""
    try:
        import rasterio  # noqa: F401
    except ImportError as e:
        raise ImportError("reading GeoTIFF needs rasterio") from e

    def run(batches):
        import numpy as np
        import pandas as pd
        from rasterio.io import MemoryFile

        for pdf in batches:
            for content in pdf["content"]:
                with MemoryFile(content) as m, m.open() as src:
                    if src.transform.e > 0:
                        raise ValueError("south-up rasters are refused")
                    z = src.read(band).astype(float)
                    if src.nodata is not None:
                        z[z == src.nodata] = np.nan
                rows, cols = z.shape
                j, i = np.meshgrid(np.arange(rows - 1, -1, -1), np.arange(cols), indexing="ij")
                yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "z": z.ravel()})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "i int, j int, z double")


def rain_means(frames: DataFrame, west: float, east: float, south: float, north: float) -> DataFrame:
    """(t, v mm/h) of decoded accumulations (t, lon, lat, mm): the mean in a box, by spacing.

    Longitudes from 0 to 360 are understood; spacings that differ by over 5 % raise.
    """
    lon = F.when(F.col("lon") > 180, F.col("lon") - 360).otherwise(F.col("lon"))
    mean = frames.where(lon.between(west, east) & F.col("lat").between(south, north)).groupBy("t").agg(F.avg("mm").alias("mm"))
    gap = mean.withColumn("gap", F.col("t") - F.lag("t").over(Window.orderBy("t")))
    told = gap.agg(F.min("gap").alias("a"), F.max("gap").alias("b"), F.avg("gap").alias("m")).first()
    if told.m and (told.b > 1.05 * told.m or told.a < 0.95 * told.m):
        raise ValueError("the frames aren't evenly spaced")
    return mean.select("t", (F.col("mm") / F.lit((told.m or 3600.0) / 3600.0)).alias("v"))
