"""Entropic pressure: Jacobi sweeps of its elliptic equation until they settle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.functions import stencil
from freshet.functions.program import Program
from freshet.operators import ghosts
from freshet.sources import store

_KIND = {"neumann": "extrapolate", "periodic": "periodic"}


def solve_sigma(cells: DataFrame, nx: int, ny: int, dx: float, dy: float, alpha: float, edge: str = "neumann", tol: float = 1e-6, max_iter: int = 200, h_min: float = 1e-10) -> tuple[DataFrame, int]:
    """(i, j, sigma) over cells (i, j, h, hu, hv) and the number of sweeps.

    Cells beyond the grid follow the edge kind. A sweep is one exchange for each axis; its
    result is written, and only the largest value and change reach the driver.
    """
    if edge not in _KIND:
        raise ValueError(f"unknown edge {edge!r}")
    kinds = dict.fromkeys(("west", "east", "south", "north"), _KIND[edge])
    grid = F.col("i").between(0, nx - 1) & F.col("j").between(0, ny - 1)
    d = (repr(float(dx)), repr(float(dy)))
    kin = Program(stencil.velocity_invariants(*d)).apply(ghosts.fill(cells.select("i", "j", "h", "hu", "hv"), nx, ny, 1, **kinds)).where(grid)
    now = store.kept(kin.select("i", "j", "h", "kin", F.lit(0.0).alias("sigma"), F.lit(0.0).alias("_t")))
    sweep = Program(stencil.sigma_sweep(repr(float(alpha)), *d, repr(float(h_min))))
    for n in range(1, max_iter + 1):
        padded = ghosts.fill(now, nx, ny, 1, **kinds, state=("sigma", "_t", "_t"))
        made = store.kept(sweep.apply(padded).where(grid).select("i", "j", "h", "kin", F.col("sigma1").alias("sigma"), F.lit(0.0).alias("_t"), F.abs(F.col("sigma1") - F.col("sigma")).alias("change")))
        told = made.agg(F.max(F.abs("sigma")).alias("top"), F.max("change").alias("change")).first()
        now = made.drop("change")
        if told.change < tol * max(told.top, 1e-30):
            break
    return now.select("i", "j", "sigma"), n
