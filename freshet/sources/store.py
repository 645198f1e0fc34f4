"""Shared folders, checkpoints, frames and manifests on any file system that Spark reads."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one only where that is unset."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or tempfile.mkdtemp(prefix="freshet-")).rstrip("/")


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def kept(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: later plans start from files."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """One small JSON file, renamed into place."""
    aside, fs = _path(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    place, _ = _path(spark, path)
    fs.delete(place, False)
    fs.rename(aside, place)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r.value for r in spark.read.text(path).collect()))  # one small file


def write_checkpoint(cells: DataFrame, path: str, meta: dict) -> None:
    """State first, its description last: a folder without meta.json is no checkpoint."""
    spark = cells.sparkSession
    p, fs = _path(spark, f"{path}/meta.json")
    fs.delete(p, False)
    name = f"state-{uuid.uuid4().hex}"
    cells.write.parquet(f"{path}/{name}")
    write_json(spark, f"{path}/meta.json", meta | {"state": name})


def read_checkpoint(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    if not exists(spark, f"{path}/meta.json"):
        raise FileNotFoundError(f"{path} holds no complete checkpoint")
    meta = read_json(spark, f"{path}/meta.json")
    return spark.read.parquet(f"{path}/{meta['state']}"), meta


def write_manifest(spark: SparkSession, path: str, options: dict, **more) -> str:
    """What a run was started with, as the next numbered JSON file in a folder; returns its path.

    options are any values that print; versions and the session's settings that shape
    plans go along.
    """
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.master", "spark.checkpoint.dir")
    p, fs = _path(spark, path)
    fs.mkdirs(p)
    n = sum(s.getPath().getName().startswith("run_manifest_") for s in fs.listStatus(p))
    place = f"{path}/run_manifest_{n:02d}.json"
    value = {"options": {k: v if isinstance(v, (int, float, str, bool, list, type(None))) else str(v) for k, v in options.items()}, "spark": spark.version, "settings": {k: spark.conf.get(k, None) for k in keys}}
    write_json(spark, place, value | more)
    return place


def append_frame(cells: DataFrame, path: str, frame: int, t: float, *values: str) -> None:
    """A depth frame or snapshot, in a partition of its own; writing it again replaces it."""
    cells.select("i", "j", *values).withColumn("t", F.lit(t)).write.mode("overwrite").parquet(f"{path}/frame={frame}")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(f"{path}/frame=*")


def write_product(field: DataFrame, path: str, value: str = "h") -> None:
    """A final or peak field; one that holds a value that isn't finite is refused."""
    if field.where(F.isnan(value) | (F.abs(value) == float("inf")) | F.col(value).isNull()).limit(1).count():
        raise ValueError(f"{value} isn't finite everywhere; not written")
    field.write.mode("overwrite").parquet(path)


def write_case(path: str, **tables: DataFrame) -> None:
    """The tables of a prepared case: cells, gauges, rain, stage, ..."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_case(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    missing = [n for n in names if not exists(spark, f"{path}/{n}")]
    if missing:
        raise FileNotFoundError(f"the case has no {', '.join(missing)}")
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def same_cells(a: DataFrame, b: DataFrame) -> None:
    """Raise unless both tables cover the same cells."""
    x, y = a.select("i", "j"), b.select("i", "j")
    if x.exceptAll(y).limit(1).count() or y.exceptAll(x).limit(1).count():
        raise ValueError("the tables don't cover the same cells")
