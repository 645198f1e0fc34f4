"""Prepared cases from NumPy archives, as tables: spatial rain and fields by cell."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def archive(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    """The arrays of one archive file on any file system that Spark reads (under 2 GB)."""
    row = spark.read.format("binaryFile").load(path).select("content").first()
    with np.load(io.BytesIO(row.content), allow_pickle=False) as z:
        return {k: z[k] for k in z.files}


def _cells(spark: SparkSession, values: np.ndarray, name: str) -> DataFrame:
    i, j = np.meshgrid(np.arange(values.shape[0], dtype=np.int32), np.arange(values.shape[1], dtype=np.int32), indexing="ij")
    return spark.createDataFrame(pd.DataFrame({"i": i.ravel(), "j": j.ravel(), name: values.ravel()}))


def field(spark: SparkSession, path: str, name: str, shape: tuple[int, int]) -> DataFrame:
    """(i, j, name): one array that must have the bed's shape."""
    arrays = archive(spark, path)
    if name not in arrays:
        raise ValueError(f"{path} has no {name}")
    if arrays[name].shape != tuple(shape):
        raise ValueError(f"{name} has shape {arrays[name].shape}, the bed {tuple(shape)}")
    return _cells(spark, arrays[name], name)


def sparse_field(spark: SparkSession, path: str, shape: tuple[int, int], value: str = "h_max") -> DataFrame:
    """(i, j, value) of an archive with rows, cols and a value for each; cells off the grid raise."""
    a = archive(spark, path)
    i, j = a["rows"].astype(np.int32), a["cols"].astype(np.int32)
    if len(i) and not ((i >= 0) & (i < shape[0]) & (j >= 0) & (j < shape[1])).all():
        raise ValueError(f"{path} names cells beyond the grid of {tuple(shape)}")
    return spark.createDataFrame(pd.DataFrame({"i": i, "j": j, value: a[value].astype(float)}), f"i int, j int, {value} double")


def spatial_rain(spark: SparkSession, path: str, shape: tuple[int, int], offset: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(t, pix, rate m/s) and (i, j, pix) of a rain archive, native or on the grid.

    Frame times must not be empty nor decrease; equal times are allowed.
    """
    a = archive(spark, path)
    t = a["t_s"].astype(float)
    if not len(t):
        raise ValueError(f"{path} holds no frame times")
    if (np.diff(t) < 0).any():
        raise ValueError(f"frame times of {path} decrease at {int(np.argmax(np.diff(t) < 0)) + 1}")
    if "native_rate_ms" in a:
        rate, lookup = a["native_rate_ms"], a["lookup_native_ij"]
        if lookup.shape != tuple(shape):
            raise ValueError(f"the lookup has shape {lookup.shape}, the bed {tuple(shape)}")
    else:
        rate = a["rate_ms"]
        if rate.shape[1:] != tuple(shape):
            raise ValueError(f"the rain has shape {rate.shape[1:]}, the bed {tuple(shape)}")
        lookup = np.arange(shape[0] * shape[1]).reshape(shape)
    flat = rate.reshape(len(t), -1).astype(float)
    rows = pd.DataFrame({"t": np.repeat(t + offset, flat.shape[1]), "pix": np.tile(np.arange(flat.shape[1], dtype=np.int32), len(t)), "rate": flat.ravel()})
    return spark.createDataFrame(rows), _cells(spark, lookup.astype(np.int32), "pix").withColumn("pix", F.col("pix").cast("int"))
