"""Parameters by class: small tables that cells meet by a class number, and infiltration derived from roughness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Entries of a class table; more are refused, so a table may be broadcast.
MOST = 256
#: Roughness from, below; conductivity mm/h, suction m, moisture deficit.
BANDS = ((0.026, 0.0455, 5.0, 0.10, 0.30), (0.0455, 0.0805, 3.0, 0.15, 0.30))


def checked(table: DataFrame, key: str = "cls") -> DataFrame:
    """The table, if it has at most MOST rows and each class once."""
    n = table.limit(MOST + 1).count()
    if n > MOST:
        raise ValueError(f"a class table has at most {MOST} entries")
    if table.select(key).distinct().count() < n:
        raise ValueError(f"a {key} is there twice")
    return table


def guard(cells: DataFrame, table: DataFrame, key: str = "cls") -> DataFrame:
    """One row (missing, top): cells whose class the table lacks, and the largest class."""
    return cells.join(F.broadcast(checked(table, key).withColumn("_known", F.lit(True))), key, "left").agg(F.count_if(F.col("_known").isNull()).alias("missing"), F.max(key).alias("top"))


def by_class(cells: DataFrame, table: DataFrame, key: str = "cls") -> DataFrame:
    """cells with the table's columns; a class that the table lacks raises."""
    told = guard(cells, table, key).first()
    if told.missing:
        raise ValueError(f"{told.missing} cells have a {key} that the table lacks")
    return cells.join(F.broadcast(table), key)


def parameter_classes(table: DataFrame, *params: str, key: str = "cls") -> DataFrame:
    """The table with ``pc``, a number for each different tuple of the parameters, in their order."""
    return checked(table, key).withColumn("pc", F.dense_rank().over(Window.orderBy(*params)) - 1)  # at most MOST rows


def infiltration(cells: DataFrame, water: float, deepest: float, porosity: float, ks_scale: float = 1.0, dth_scale: float = 1.0) -> DataFrame:
    """cells (nm, b) with ks (mm/h), psi, dth and f_max: bands of roughness, and the store above a water table."""
    out = {}
    for at, name in enumerate(("ks", "psi", "dth"), 2):
        value = F.lit(0.0)
        for band in reversed(BANDS):
            value = F.when((F.col("nm") >= band[0]) & (F.col("nm") < band[1]), F.lit(band[at])).otherwise(value)
        out[name] = value * {"ks": ks_scale, "dth": dth_scale}.get(name, 1.0)
    return cells.withColumns(out).withColumn("f_max", F.least(F.greatest(F.col("b") - water, F.lit(0.0)), F.lit(deepest)) * porosity)


def soil_units(cells: DataFrame, units: DataFrame) -> DataFrame:
    """cells with ks, psi, dth of their map unit (units: unit, ks, psi, dth), their own where it is unknown."""
    u = checked(units, "unit").select("unit", *[F.col(c).alias(f"_{c}") for c in ("ks", "psi", "dth")])
    x = cells.join(F.broadcast(u), "unit", "left")
    return x.withColumns({c: F.coalesce(f"_{c}", c) for c in ("ks", "psi", "dth")}).select(*cells.columns)
