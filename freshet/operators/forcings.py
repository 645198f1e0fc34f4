"""Steps with all that acts on a run: rain, inlets, stages, rings, sinks, sponges and limits.

What varies from cell to cell is a column of the cells table and used if it is there:
``nm`` (roughness), ``infil`` (m/s), ``ks psi dth f_max`` with the state ``f0``
(Green-Ampt), ``tau`` (drain, s), ``h_clamp`` and ``h_target`` (m, null: none), ``sigma``
(share of a cell that stores water). Columns go along with their cells, so a step shuffles
the grid once for each axis and joins it only for rain rows, inlets, stage and ring cells.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.functions import flow, stencil
from freshet.functions.program import Program
from freshet.model import Config
from freshet.operators import boundary, ghosts, temporal

FLOW = ("h", "hu", "hv")
#: Shares of the start and of an Euler step of the last stage, by integrator.
STAGES = {"euler": ((0.0, 1.0),), "ssprk3": ((0.0, 1.0), (0.75, 0.25), (1.0 / 3.0, 2.0 / 3.0))}


@dataclass(frozen=True)
class Forcings:
    """Tables that drive a run; times are seconds.

    rain (t, v mm/h) is held from each row to the next. rain_rows (t, pix, rate m/s) with
    rain_cells (i, j, pix) take its place where they are given. inlets (inlet, q, ds, nx,
    ny) act outward of inlet_cells (inlet, i, j). stage (t, v) sets still water on
    stage_cells (i, j). gauges (gauge, t, v) are blended onto ring cells by ring_weights
    (i, j, gauge, w). sponge is (width, still level), sponge_bands lets its bands act one
    after the other; cap limits the depth everywhere.
    """

    rain: DataFrame | None = None
    rain_rows: DataFrame | None = None
    rain_cells: DataFrame | None = None
    inlets: DataFrame | None = None
    inlet_cells: DataFrame | None = None
    stage: DataFrame | None = None
    stage_cells: DataFrame | None = None
    gauges: DataFrame | None = None
    ring_weights: DataFrame | None = None
    sponge: tuple[int, float] | None = None
    sponge_bands: bool = False
    cap: float | None = None

    def __post_init__(self):
        for a, b in (("rain_rows", "rain_cells"), ("inlets", "inlet_cells"), ("stage", "stage_cells"), ("gauges", "ring_weights")):
            if (getattr(self, a) is None) != (getattr(self, b) is None):
                raise ValueError(f"{a} and {b} go together")

    def rain_rate(self, t: float) -> float:
        """The uniform rate or the largest of the rows at t, in m/s."""
        if self.rain_rows is not None:
            return frame_at(self.rain_rows, t).agg(F.max("rate").alias("r")).first().r or 0.0
        return 0.0 if self.rain is None else value_at(self.rain, t, False) / 3.6e6


def value_at(series: DataFrame, t: float, linear: bool = True) -> float:
    """The value of a series (t, v) at one time."""
    one = series.sparkSession.createDataFrame([(float(t),)], "tq double")
    return (temporal.asof_linear if linear else temporal.asof_step)(one, series).first().v


def frame_at(rain: DataFrame, t: float) -> DataFrame:
    """(pix, rate) of the frame as of t, the first one before it."""
    last = rain.where(F.col("t") <= t).agg(F.max("t").alias("t")).first().t
    last = rain.agg(F.min("t").alias("t")).first().t if last is None else last
    return rain.where(F.col("t") == F.lit(last)).select("pix", "rate")


def blended(gauges: DataFrame, weights: DataFrame, t: float) -> DataFrame:
    """(i, j, eta): stages at t, interpolated for each gauge and weighted onto ring cells."""
    a = gauges.where(F.col("t") <= t).groupBy("gauge").agg(F.max("t").alias("t0"), F.max_by("v", "t").alias("v0"))
    b = gauges.where(F.col("t") > t).groupBy("gauge").agg(F.min("t").alias("t1"), F.min_by("v", "t").alias("v1"))
    both = a.join(b, "gauge", "full")
    part = (F.lit(float(t)) - F.col("t0")) / (F.col("t1") - F.col("t0"))
    eta = F.when(F.col("t0").isNull(), F.col("v1")).when(F.col("t1").isNull(), F.col("v0")).otherwise(F.col("v0") + part * (F.col("v1") - F.col("v0")))
    now = both.select("gauge", eta.alias("_eta"))
    return weights.join(now, "gauge").groupBy("i", "j").agg(F.sum(F.col("w") * F.col("_eta")).alias("eta"))


def still_water(cells: DataFrame, level: DataFrame) -> DataFrame:
    """cells with still water at eta on the cells of level (i, j, eta)."""
    on = F.col("_eta").isNotNull()
    out = {"h": F.when(on, F.greatest(F.col("_eta") - F.col("b"), F.lit(0.0))).otherwise(F.col("h"))} | {c: F.when(on, F.lit(0.0)).otherwise(F.col(c)) for c in ("hu", "hv")}
    return cells.join(level.select("i", "j", F.col("eta").alias("_eta")), ["i", "j"], "left").withColumns(out).select(*cells.columns)


def changed(cells: DataFrame, lines: list[str], **names: str) -> DataFrame:
    """cells after a program whose results take the place of columns."""
    out = Program(lines).apply(cells)
    return out.select(*[F.col(names.get(c, c)).alias(c) for c in cells.columns])


def flow_step(cells: DataFrame, nx: int, ny: int, dx: float, dt: float, cfg: Config, override: DataFrame | None = None) -> DataFrame:
    """The flow's share of a step: ghosts, residual and rain, stage by stage; drying at the end.

    A column ``rain`` (m/s) is added to the mass equation, ``sigma`` divides it. override
    (i, j, h, hu, hv) replaces ghosts.
    """
    d = repr(float(dx))
    program = Program(stencil.residual(d, d, scheme=cfg.recon, riemann=cfg.riemann, bed=cfg.bed, h_min=repr(cfg.h_min)))
    q = cells.withColumns({f"_{c}": F.col(c) for c in FLOW})
    mass = F.col("rh") + F.col("rain") if "rain" in cells.columns else F.col("rh")
    if "sigma" in cells.columns:
        mass = mass / F.least(F.greatest("sigma", F.lit(0.001)), F.lit(1.0))
    for a, b in STAGES[cfg.integrator]:
        columns = q.columns
        padded = ghosts.fill(q, nx, ny, cfg.width, **cfg.boundary)
        if override is not None:
            o = override.select("i", "j", *[F.col(c).alias(f"_o{c}") for c in FLOW])
            padded = padded.join(o, ["i", "j"], "left").withColumns({c: F.coalesce(f"_o{c}", c) for c in FLOW}).select(*columns)
        r = program.apply(padded).where(F.col("i").between(0, nx - 1) & F.col("j").between(0, ny - 1))
        new = {c: F.lit(a) * F.col(f"_{c}") + F.lit(b) * (F.col(c) + F.lit(float(dt)) * m) for c, m in zip(FLOW, (mass, F.col("rhu"), F.col("rhv")))}
        q = r.withColumns(new).select(*columns)
    return changed(q, flow.wet_dry(repr(cfg.h_min)), h="h1", hu="hu1", hv="hv1").select(*cells.columns)


def forced_step(cells: DataFrame, nx: int, ny: int, dx: float, dt: float, t: float, cfg: Config, f: Forcings) -> DataFrame:
    """One step from t to t + dt in the order of the drivers.

    Ring, inlets, flow with rain, friction, peak; then stage, infiltration, sponge, ring,
    Green-Ampt and drain, clamp, target depth, cap.
    """
    own, step = cells.columns, repr(float(dt))
    spark = cells.sparkSession
    q = cells
    if f.gauges is not None:
        q = still_water(q, blended(f.gauges, f.ring_weights, t))
    override = None
    if f.inlets is not None:
        override = boundary.inlet_ghosts(q, f.inlet_cells, f.inlets, cfg.width).select("i", "j", *FLOW)
    if f.rain_rows is not None:
        pix = f.rain_cells.join(frame_at(f.rain_rows, t), "pix").select("i", "j", F.col("rate").alias("rain"))
        q = q.join(pix, ["i", "j"], "left").select(*own, (F.coalesce("rain", F.lit(0.0)) + F.lit(cfg.rainfall)).alias("rain"))
    else:
        q = q.withColumn("rain", F.lit(f.rain_rate(t) + cfg.rainfall))
    q = flow_step(q, nx, ny, dx, dt, cfg, override).select(*own)
    if "nm" in own or cfg.manning is not None:
        n = "nm" if "nm" in own else repr(float(cfg.manning))
        cap = repr(float(cfg.velocity_cap)) if math.isfinite(cfg.velocity_cap) else None
        q = changed(q, flow.friction_step(n, step, cfg.quadratic_friction, cap, repr(cfg.h_min)), hu="hu1", hv="hv1")
    q = q.withColumn("peak", F.greatest("peak", "h"))
    if f.stage is not None:
        level = f.stage_cells.select("i", "j").distinct().withColumn("eta", F.lit(value_at(f.stage, t + dt)))
        q = still_water(q, level)
    sunk = dict(h="h1", hu="hu1", hv="hv1")
    if "infil" in own:
        q = changed(q, flow.infiltration("infil", step), **sunk)
    if f.sponge:
        if f.sponge[0] > min(nx, ny):
            raise ValueError(f"a sponge of {f.sponge[0]} cells is wider than the grid")
        q = changed(q, (flow.sponge_bands if f.sponge_bands else flow.sponge)(f.sponge[0], nx, ny, repr(float(f.sponge[1]))), **sunk)
    if f.gauges is not None:
        q = still_water(q, blended(f.gauges, f.ring_weights, t + dt))
    if "ks" in own:
        q = changed(q, flow.green_ampt_drain(step) if "tau" in own else flow.green_ampt(step), f0="f1", **sunk)
    elif "tau" in own:
        q = changed(q, flow.reservoir(step), **sunk)
    for limit in ("h_clamp", "h_target"):
        if limit in own:
            q = changed(q, flow.depth_limit(limit), **sunk)
    if f.cap is not None:
        q = changed(q, flow.depth_cap(repr(float(f.cap))), **sunk)
    return q.select(*own)
