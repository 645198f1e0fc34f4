"""Ghost cells: boundary kinds as small equality joins that add rows around a grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("extrapolate", "periodic", "wall", "fall")


def ghost_map(n: int, ngh: int, low: str, high: str) -> list[tuple[int, int, float, float]]:
    """(ghost, source, sign of normal momentum, share of depth kept) of one axis' 2 * ngh ghosts."""
    out = []
    for kind, ghosts in ((low, [(-k, k) for k in range(1, ngh + 1)]), (high, [(n - 1 + k, k) for k in range(1, ngh + 1)])):
        if kind not in KINDS:
            raise ValueError(f"unknown boundary {kind!r}")
        for g, k in ghosts:
            edge = 0 if g < 0 else n - 1
            source = {"extrapolate": edge, "fall": edge, "periodic": g % n, "wall": k - 1 if g < 0 else n - k}[kind]
            out.append((g, source, -1.0 if kind == "wall" else 1.0, 0.0 if kind == "fall" else 1.0))
    return out


def fill(df: DataFrame, nx: int, ny: int, ngh: int, west="extrapolate", east="extrapolate", south="extrapolate", north="extrapolate", state=("h", "hu", "hv")) -> DataFrame:
    """Rows of df plus ghosts along i, then along j over the full extent.

    A wall flips the momentum across it; fall empties the ghost but keeps its bed. Each
    edge row is listed with the ghosts that copy it and exploded, so df is read once,
    however many steps are chained. The lists have 2 * ngh entries whatever the grid, so
    they are broadcast.
    """
    h, hu, hv = state
    for key, n, low, high, normal, other in (("i", nx, west, east, hu, hv), ("j", ny, south, north, hv, hu)):
        copies: dict[int, list[tuple[int, float, float]]] = {}
        for g, source, flip, keep in ghost_map(n, ngh, low, high):
            copies.setdefault(source, []).append((g, flip, keep))
        lists = df.sparkSession.createDataFrame(sorted(copies.items()), "_s int, _l array<struct<g:int,f:double,k:double>>")
        own = F.array(F.struct(F.col(key).cast("int").alias("g"), F.lit(1.0).alias("f"), F.lit(1.0).alias("k")))
        rows = df.join(F.broadcast(lists), F.col(key) == F.col("_s"), "left").withColumn("_e", F.explode(F.when(F.col("_l").isNull(), own).otherwise(F.concat(own, F.col("_l")))))
        f, k = F.col("_e.f"), F.col("_e.k")
        df = rows.withColumns({key: F.col("_e.g").cast(dict(df.dtypes)[key]), h: F.col(h) * k, normal: F.col(normal) * f * k, other: F.col(other) * k}).select(*df.columns)
    return df


def fill_sql(source: str, nx: int, ny: int, ngh: int, west="extrapolate", east="extrapolate", south="extrapolate", north="extrapolate") -> str:
    """The same rows as standard SQL over (i, j, b, h, hu, hv)."""
    out = f"SELECT i, j, b, h, hu, hv FROM {source}"
    for key, other, n, low, high, m, t in (("i", "j", nx, west, east, "hu", "hv"), ("j", "i", ny, south, north, "hv", "hu")):
        values = ", ".join(f"({g}, {s}, CAST('{f}' AS DOUBLE), CAST('{k}' AS DOUBLE))" for g, s, f, k in ghost_map(n, ngh, low, high))
        cols = {key: "g", other: f"q.{other}", "b": "q.b", "h": "q.h * k", m: f"q.{m} * f * k", t: f"q.{t} * k"}
        picked = ", ".join(f"{cols[c]} AS {c}" for c in ("i", "j", "b", "h", "hu", "hv"))
        out = f"SELECT * FROM ({out}) AS a{key} UNION ALL SELECT {picked} FROM ({out}) AS q JOIN (VALUES {values}) AS gm(g, s, f, k) ON q.{key} = gm.s"
    return out
