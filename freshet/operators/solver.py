"""Runs: a window stepper for single steps and a block stepper for many.

The window stepper is one declarative plan for each step and checks the block stepper.
The block stepper advances K steps for one shuffle: the grid is cut into blocks with a
halo as wide as K steps reach, each block is stepped in numpy with the boundary kinds
filled inside, and the halo is dropped. A step's dt is fixed for K steps from the wave
speeds before them (times 0.95, and K = 1 is exact); if the speeds after them no longer
allow it, the superstep is undone and taken again with half of it.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.functions import flow, stencil
from freshet.functions.program import Program
from freshet.model import Config
from freshet.operators import ghosts, measure
from freshet.operators.forcings import Forcings, flow_step, forced_step

G = 9.81
STATE = "i int, j int, b double, h double, hu double, hv double, peak double"


def window_step(cells: DataFrame, nx: int, ny: int, dx: float, dt: float, cfg: Config) -> DataFrame:
    """One step of (i, j, b, h, hu, hv[, peak]) as a declarative plan, by either integrator."""
    keep = cells if "peak" in cells.columns else cells.withColumn("peak", F.col("h"))
    return forced_step(keep.select("i", "j", "b", "h", "hu", "hv", "peak"), nx, ny, dx, dt, 0.0, cfg, Forcings())


# ---- numpy twin of the same scheme, for blocks ----


def _hllc(L, R, h_min):
    (hL, mL, tL), (hR, mR, tR) = L, R
    vel = lambda h, m, f: np.where(h <= f, 0.0, m / np.maximum(h, f))
    uL, uR, vL, vR = vel(hL, mL, h_min), vel(hR, mR, h_min), vel(hL, tL, h_min), vel(hR, tR, h_min)
    cL, cR = np.sqrt(G * np.maximum(hL, 0)), np.sqrt(G * np.maximum(hR, 0))
    mid, root = 0.5 * (uL + uR) + cL - cR, 0.5 * (cL + cR) + 0.25 * (uL - uR)
    c = np.sqrt(G * np.where(root > 0, root * root / G, 0.0))
    dryL, dryR = hL <= h_min, hR <= h_min
    SL = np.where(dryL & dryR, 0.0, np.where(dryL, uR - 2 * cR, np.minimum(uL - cL, mid - c)))
    SR = np.where(dryL & dryR, 0.0, np.where(dryR, uL + 2 * cL, np.maximum(uR + cR, mid + c)))
    den = hR * (uR - SR) - hL * (uL - SL)
    big = np.abs(den) > 1e-14
    SM = np.where(big, (SL * hR * (uR - SR) - SR * hL * (uL - SL)) / np.where(big, den, 1.0), 0.5 * (uL + uR))
    SM = np.minimum(np.maximum(SM, SL), SR)

    def side(h, m, t, u, v, S):
        pu, pv = vel(h, m, 1e-10), vel(h, t, 1e-10)
        f = (m, m * pu + 0.5 * G * h * h, m * pv)
        hs = h * ((S - u) / (S - SM + 1e-30))
        return f, (f[0] + S * (hs - h), f[1] + S * (hs * SM - m), f[2] + S * (hs * v - t))

    fL, sL = side(hL, mL, tL, uL, vL, SL)
    fR, sR = side(hR, mR, tR, uR, vR, SR)
    return [np.where(SL >= 0, a, np.where(SM >= 0, b, np.where(SR >= 0, d, e))) for a, b, d, e in zip(fL, sL, sR, fR)]


def _lf(L, R, h_min):
    def side(h, m, t):
        u, v = (np.where(h <= 1e-10, 0.0, x / np.maximum(h, 1e-10)) for x in (m, t))
        w = np.where(h <= h_min, 0.0, m / np.maximum(h, h_min))
        return (m, m * u + 0.5 * G * h * h, m * v), np.abs(w) + np.sqrt(G * np.maximum(h, 0))

    (fL, a), (fR, b) = side(*L), side(*R)
    s = np.maximum(a, b)
    return [0.5 * (x + y) - 0.5 * s * (r - q) for x, y, q, r in zip(fL, fR, L, R)]


def _axis(h, m, t, b, g, dx, cfg: Config):
    """Tendencies along axis 0 of cells with both neighbours; g is the central bed slope."""
    hm = cfg.h_min
    u, v = (np.where(h > hm, x / np.maximum(h, hm), 0.0) for x in (m, t))
    e = h + b
    hl, hr_, bl, br, el, er = h[:-1], h[1:], b[:-1], b[1:], e[:-1], e[1:]
    if cfg.bed == "srm":
        zl, zr = bl + 0.5 * dx * g[:-1], br - 0.5 * dx * g[1:]
        zf, zc = np.maximum(bl, br), zr - zl
        dz = (br - bl) - zc
        fl = np.maximum(0, el + np.maximum(0, np.minimum(dz, er - el)) - zf)
        fr = np.maximum(0, er + np.maximum(0, np.minimum(-dz, el - er)) - zf)
    else:
        zf = np.maximum(bl, br)
        fl, fr = np.maximum(0, el - zf), np.maximum(0, er - zf)
    F_ = (_hllc if cfg.riemann == "hllc" else _lf)((fl, fl * u[:-1], fl * v[:-1]), (fr, fr * u[1:], fr * v[1:]), hm)
    out = [-(f[1:] - f[:-1]) / dx for f in F_]
    if cfg.bed == "srm":
        wet = ~((hl < hm) & (hr_ < hm))

        def own(face, depth, eta, bed, other, dzc):
            head = zf - eta
            d = np.where(other < hm, np.maximum(0, head), np.maximum(0, np.minimum(dzc, head)))
            return np.where(wet, 0.5 * G * (face + depth) * (zf - d - bed), 0.0)

        so, sn = own(fl, hl, el, bl, hr_, zc), own(fr, hr_, er, br, hl, -zc)
        out[1] = out[1] - so[1:] / dx + sn[:-1] / dx
    else:
        out[1] = out[1] + 0.5 * G / dx * (fl[1:] * fl[1:] - fr[:-1] * fr[:-1])
    return out


def _fill_block(q, x0, y0, nx, ny, kinds):
    """Set cells of a block that lie off the grid from those on it (q: b, h, hu, hv)."""
    for axis, start, n, low, high, normal in ((0, x0, nx, kinds["west"], kinds["east"], 2), (1, y0, ny, kinds["south"], kinds["north"], 3)):
        size = q.shape[1 + axis]
        for g, src, sign, keep in ghosts.ghost_map(n, max(0, -start) + max(0, start + size - n), low, high):
            to, fr = g - start, src - start
            if 0 <= to < size and 0 <= fr < size and (low if g < 0 else high) != "periodic":
                a, b = [slice(None)] * 3, [slice(None)] * 3
                a[1 + axis], b[1 + axis] = to, fr
                new = q[tuple(b)].copy()
                new[1:] *= keep
                new[normal] *= sign
                q[tuple(a)] = new


def _advance(q, peak, steps, dt, dx, x0, y0, nx, ny, cfg: Config):
    """steps Euler steps of a block with halo; cells near its rim become stale and are dropped."""
    for _ in range(steps):
        _fill_block(q, x0, y0, nx, ny, cfg.boundary)
        b, h, hu, hv = q
        gx, gy = np.zeros_like(b), np.zeros_like(b)
        gx[1:-1] = 0.5 * (b[2:] - b[:-2]) / dx
        gy[:, 1:-1] = 0.5 * (b[:, 2:] - b[:, :-2]) / dx
        ax = _axis(h, hu, hv, b, gx, dx, cfg)
        ay = [r.T for r in _axis(h.T, hv.T, hu.T, b.T, gy.T, dx, cfg)]
        inner = (slice(1, -1), slice(1, -1))
        r = [ax[0][:, 1:-1] + ay[0][1:-1], ax[1][:, 1:-1] + ay[2][1:-1], ax[2][:, 1:-1] + ay[1][1:-1]]
        if cfg.rainfall:
            r[0] = r[0] + cfg.rainfall
        nh, nu, nv = h[inner] + dt * r[0], hu[inner] + dt * r[1], hv[inner] + dt * r[2]
        dry = nh < cfg.h_min
        nh, nu, nv = np.maximum(nh, 0), np.where(dry, 0.0, nu), np.where(dry, 0.0, nv)
        if cfg.manning is not None:
            d = np.maximum(nh, cfg.h_min)
            mod = np.sqrt((nu / d) ** 2 + (nv / d) ** 2)
            p = d ** (-4.0 / 3.0)
            n = np.full_like(d, cfg.manning)
            if math.isfinite(cfg.velocity_cap):
                n = np.where(mod > cfg.velocity_cap, np.maximum(n, np.sqrt(1 / ((1e-10 + dt) * G * p * (mod + 1e-30)))), n)
            c = G * n * n * p
            a = 2 / (1 + np.sqrt(1 + 4 * dt * c * mod)) if cfg.quadratic_friction else 1 / (1 + dt * c * mod)
            nu, nv = np.where(nh < cfg.h_min, 0.0, nu * a), np.where(nh < cfg.h_min, 0.0, nv * a)
        q = q.copy()
        q[1][inner], q[2][inner], q[3][inner] = nh, nu, nv
        peak = np.maximum(peak, q[1])
    return q, peak


def block_steps(cells: DataFrame, nx: int, ny: int, dx: float, dt: float, steps: int, cfg: Config, side: int = 256) -> DataFrame:
    """``steps`` Euler steps for one shuffle: blocks of side cells with a halo of 2 * steps + 2."""
    if cfg.integrator != "euler" or cfg.bed not in ("srm", "audusse"):
        raise ValueError("block_steps is for the euler integrator and a well-balanced bed")
    halo = 2 * steps + 2
    wrap = {"i": "periodic" in (cfg.boundary["west"], cfg.boundary["east"]), "j": "periodic" in (cfg.boundary["south"], cfg.boundary["north"])}

    def reach(key: str, n: int):
        """Blocks that read a cell, and the place at which they see it (beyond the grid if it wraps)."""
        seen = [F.struct(F.col(key).cast("int").alias("at"))]
        if wrap[key]:
            seen += [F.struct((F.col(key) + k * n).cast("int").alias("at")) for k in (-1, 1)]
        at = F.filter(F.array(*seen), lambda s: (s["at"] >= -halo) & (s["at"] < n + halo))
        last = -(-n // side) - 1
        low = lambda s: F.greatest(F.floor((s["at"] - halo) / side).cast("int"), F.lit(0))
        high = lambda s: F.least(F.floor((s["at"] + halo) / side).cast("int"), F.lit(last))
        return F.flatten(F.transform(at, lambda s: F.transform(F.sequence(low(s), high(s)), lambda k: F.struct(k.alias("k"), s["at"].alias("at")))))

    keep = cells if "peak" in cells.columns else cells.withColumn("peak", F.col("h"))
    sent = keep.select("i", "j", "b", "h", "hu", "hv", "peak").withColumn("x", F.explode(reach("i", nx))).withColumn("y", F.explode(reach("j", ny)))
    sent = sent.select(F.col("x.k").alias("bi"), F.col("y.k").alias("bj"), F.col("x.at").alias("ai"), F.col("y.at").alias("aj"), "b", "h", "hu", "hv", "peak")

    def run(key, pdf):
        bi, bj = key
        i0, i1, j0, j1 = bi * side, min(nx, (bi + 1) * side), bj * side, min(ny, (bj + 1) * side)
        # off the grid two cells are enough: they are filled anew each step
        x0, x1 = (i0 - halo, i1 + halo) if wrap["i"] else (max(i0 - halo, -2), min(i1 + halo, nx + 2))
        y0, y1 = (j0 - halo, j1 + halo) if wrap["j"] else (max(j0 - halo, -2), min(j1 + halo, ny + 2))
        q = np.zeros((5, x1 - x0, y1 - y0))
        a, b = pdf["ai"].to_numpy() - x0, pdf["aj"].to_numpy() - y0
        ok = (a >= 0) & (a < x1 - x0) & (b >= 0) & (b < y1 - y0)
        for k, c in enumerate(("b", "h", "hu", "hv", "peak")):
            q[k, a[ok], b[ok]] = pdf[c].to_numpy()[ok]
        s, peak = _advance(q[:4], q[4], steps, dt, dx, x0, y0, nx, ny, cfg)
        own = (slice(i0 - x0, i1 - x0), slice(j0 - y0, j1 - y0))
        i, j = np.meshgrid(np.arange(i0, i1), np.arange(j0, j1), indexing="ij")
        return pd.DataFrame({"i": i.ravel(), "j": j.ravel()} | {c: s[k][own].ravel() for k, c in enumerate(("b", "h", "hu", "hv"))} | {"peak": peak[own].ravel()})

    return sent.groupBy("bi", "bj").applyInPandas(run, STATE)


class ShallowWater:
    """A run over a table of cells (i, j, b, h, hu, hv).

    State is written to the shared checkpoint folder after every superstep, so a lost
    executor rereads files. The driver holds t, the step count and one row of reductions.
    """

    def __init__(
        self, spark: SparkSession, cells: DataFrame, nx: int, ny: int, dx: float, cfg: Config | None = None, inner: int = 1, side: int = 256, folder: str | None = None,
        forcings: Forcings | None = None, sampler: tuple[DataFrame, float] | None = None, frame_every: float | None = None,
    ):
        """sampler is (places (g, i, j), seconds): samples() has a row for each place and interval.
        frame_every writes depth frames, as store.read_frames(spark, run.folder + "/frames") reads them.
        """
        from freshet.sources.store import shared_folder

        self.spark, self.nx, self.ny, self.dx, self.cfg, self.inner, self.side = spark, nx, ny, dx, cfg or Config(), inner, side
        self.forcings, self.sampler, self.frame_every = forcings, sampler, frame_every
        self.t, self.steps, self.sampled, self.framed = 0.0, 0, -1, -1
        self.folder = folder or f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
        cells = cells.withColumn("peak", F.col("h")) if "peak" not in cells.columns else cells
        if "ks" in cells.columns and "f0" not in cells.columns:
            cells = cells.withColumn("f0", F.lit(0.0))
        self.columns = [f.split()[0] for f in STATE.split(", ")]
        self.columns += [c for c in cells.columns if c not in self.columns]
        self.cells = self._keep(cells)
        self._record()

    def _keep(self, cells: DataFrame) -> DataFrame:
        path = f"{self.folder}/state/{self.steps:09d}-{uuid.uuid4().hex[:8]}"  # a step that is taken again has its own
        cells = cells.select(*self.columns)
        cells.write.parquet(path)
        return self.spark.read.schema(cells.schema).parquet(path)

    def _record(self) -> None:
        """Samples and frames that are due: one for each interval that began."""
        from freshet.sources import store

        if self.sampler:
            places, every = self.sampler
            due = math.floor((self.t + 1e-9) / every)
            if due > self.sampled:
                measure.sample(self.cells, places).withColumn("t", F.lit(self.t)).write.mode("overwrite").parquet(f"{self.folder}/samples/interval={due}")
                self.sampled = due
        if self.frame_every:
            due = math.floor((self.t + 1e-9) / self.frame_every)
            if due > self.framed:
                store.append_frame(self.cells, f"{self.folder}/frames", due, self.t, "h")
                self.framed = due

    def samples(self) -> DataFrame:
        """(g, h, u, v, eta, t) at the places of the sampler."""
        return self.spark.read.parquet(f"{self.folder}/samples").drop("interval")

    def cfl_dt(self) -> float:
        row = measure.cfl_step(self.cells, self.dx, self.cfg.cfl, self.cfg.h_min, self.cfg.cfl_norm).first()
        measure.finite(row.lam, self.t)
        return row.dt

    def _by_blocks(self) -> bool:
        return self.cfg.bed in ("srm", "audusse") and self.cfg.integrator == "euler" and self.forcings is None and len(self.columns) == 7

    def step(self, dt: float, n: int = 1) -> None:
        """n steps of dt, by blocks where the scheme allows, else by windows."""
        if self._by_blocks():
            out = block_steps(self.cells, self.nx, self.ny, self.dx, dt, n, self.cfg, self.side)
        elif n == 1:
            out = forced_step(self.cells, self.nx, self.ny, self.dx, dt, self.t, self.cfg, self.forcings or Forcings())
        else:
            raise ValueError("several steps at once need a well-balanced euler scheme without forcings")
        self.t += n * dt
        self.steps += n
        self.cells = self._keep(out)

    def run(self, t_end: float, max_steps: int | None = None, callback: Callable | None = None) -> ShallowWater:
        """Advance to t_end; callback(run, steps) is called after each superstep."""
        most = self.inner if self._by_blocks() else 1
        allowed = None
        while self.t < t_end - 1e-12 and (max_steps is None or self.steps < max_steps):
            rate = self.cfg.rainfall + (self.forcings.rain_rate(self.t) if self.forcings else 0.0)
            dt = measure.rain_limit(allowed or self.cfl_dt(), rate, self.cfg.cfl, self.dx)
            n = most if max_steps is None else min(most, max_steps - self.steps)
            dt = measure.next_step(measure.held_step(dt, n), self.t, t_end, self.cfg.dt_min, self.cfg.dt_max)
            n = max(1, min(n, int((t_end - self.t) / dt)))
            before = (self.t, self.steps, self.cells)
            self.step(dt, n)
            allowed = self.cfl_dt()
            while n > 1 and dt > allowed and dt / 2 > self.cfg.dt_min:  # a front got faster on the way
                self.t, self.steps, self.cells = before
                dt /= 2
                self.step(dt, n)
                allowed = self.cfl_dt()
            self._record()
            if callback:
                callback(self, self.steps)
        return self

    def depth(self) -> DataFrame:
        return self.cells.select("i", "j", "h")

    def max_depth(self) -> DataFrame:
        return self.cells.select("i", "j", F.col("peak").alias("h"))

    def volume(self) -> float:
        return measure.volume(self.cells, self.dx).first().volume

    def checkpoint(self, path: str) -> None:
        from freshet.sources import store

        store.write_checkpoint(self.cells, path, {"t": self.t, "steps": self.steps, "nx": self.nx, "ny": self.ny, "dx": self.dx})

    @classmethod
    def resume(cls, spark: SparkSession, path: str, cfg: Config | None = None, **options) -> ShallowWater:
        from freshet.sources import store

        cells, meta = store.read_checkpoint(spark, path)
        out = cls(spark, cells, meta["nx"], meta["ny"], meta["dx"], cfg, **options)
        out.t, out.steps = meta["t"], meta["steps"]
        return out
