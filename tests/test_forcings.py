"""Runs with forcings against balances and values worked out by hand, and both integrators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.model import Config
from freshet.operators import forcings
from freshet.operators.forcings import Forcings
from freshet.operators.solver import ShallowWater, window_step
from freshet.sources import store
from test_solver import WALLS, array, grid


def test_rain_series_and_infiltration(spark):
    """A level lake between walls: only sources change it, cell by cell."""
    c = grid(spark, 6, 6, "0.5D").withColumn("infil", F.expr("if(i = 0, 1e-3D, 0.0D)"))
    rain = spark.createDataFrame([(0.0, 3600.0), (0.3, 7200.0)], "t double, v double")  # 1 and 2 mm/s
    run = ShallowWater(spark, c, 6, 6, 100.0, Config(boundary=WALLS), forcings=Forcings(rain=rain))
    for _ in range(2):
        run.step(0.3)
    h, hu = array(run.cells, 6, 6, "h", "hu")
    # away from the cells that lose water the surface only knows the rain
    assert h[4:].min() == pytest.approx(0.5 + 0.3 * 0.001 + 0.3 * 0.002, abs=1e-9)
    assert h.sum() == pytest.approx(36 * (0.5 + 0.0009) - 6 * 2 * 0.3 * 0.001, abs=1e-9)


def test_rain_rows_stage_ring_and_limits(spark):
    c = grid(spark, 8, 8, "0.2D", "0.01D * i").withColumn("h_clamp", F.expr("if(i = 7, 0.1D, null)"))
    rows = spark.createDataFrame([(0.0, 0, 1e-3), (0.0, 1, 2e-3), (50.0, 0, 9.0)], "t double, pix int, rate double")
    pix = c.where("j < 4").select("i", "j", F.expr("if(i < 4, 0, 1)").alias("pix"))
    stage = spark.createDataFrame([(0.0, 1.0), (1.0, 2.0)], "t double, v double")
    gauges = spark.createDataFrame([("a", 0.0, 1.0), ("a", 1.0, 3.0), ("b", 0.0, 2.0)], "gauge string, t double, v double")
    ring = c.where("i = 4 and j = 4").select("i", "j", F.explode(F.array(F.struct(F.lit("a").alias("gauge"), F.lit(0.25).alias("w")), F.struct(F.lit("b").alias("gauge"), F.lit(0.75).alias("w")))).alias("x")).select("i", "j", "x.*")
    f = Forcings(rain_rows=rows, rain_cells=pix, stage=stage, stage_cells=c.where("i = 0 and j = 0").select("i", "j"), gauges=gauges, ring_weights=ring, cap=1.6)
    assert f.rain_rate(10.0) == 2e-3
    run = ShallowWater(spark, c, 8, 8, 1000.0, Config(boundary=WALLS), forcings=f)
    run.step(0.5)
    h, hu, b = array(run.cells, 8, 8, "h", "hu", "b")
    assert h[0, 0] == pytest.approx(1.5 - b[0, 0]) and hu[0, 0] == 0
    assert h[4, 4] == 1.6 and h[7].max() == 0.1  # 0.25 * 2 + 0.75 * 2 = 2, above the cap
    assert h[2, 2] - 0.2 == pytest.approx(0.5e-3, abs=2e-5) and h[5, 2] - 0.2 == pytest.approx(1e-3, abs=2e-5) and h[2, 6] == pytest.approx(0.2, abs=2e-5)
    with pytest.raises(ValueError):
        Forcings(stage=stage)


def test_green_ampt_keeps_its_state(spark):
    c = grid(spark, 4, 4, "0.3D").withColumns({k: F.lit(v) for k, v in dict(ks=1e-3, psi=0.1, dth=0.3, f_max=0.002).items()})
    run = ShallowWater(spark, c, 4, 4, 50.0, Config(boundary=WALLS))
    h, f = 0.3, 0.0
    for _ in range(4):
        run.step(0.5)
        a = f + 1e-3 * 0.5
        df = max(0.0, min(0.5 * (a + math.sqrt(a * a + 4 * 1e-3 * 0.5 * (0.1 + h) * 0.3)) - f, h, 0.002 - f))
        h, f = h - df, f + df
    got_h, got_f = array(run.cells, 4, 4, "h", "f0")
    assert f == pytest.approx(0.002) and np.allclose(got_h, h, atol=1e-12) and np.allclose(got_f, f, atol=1e-12)


def test_inlet_brings_its_discharge(spark):
    c = grid(spark, 12, 6, "1.0D")
    inlets = spark.createDataFrame([("r", 3.0, 10.0, 1, 0)], "inlet string, q double, ds double, nx int, ny int")
    cells = c.where("i = 0 and j between 2 and 3").select(F.lit("r").alias("inlet"), "i", "j")
    run = ShallowWater(spark, c, 12, 6, 10.0, Config(boundary=WALLS), forcings=Forcings(inlets=inlets, inlet_cells=cells))
    v = run.volume()
    for _ in range(3):
        run.step(0.2)
    assert 0.4 * 3.0 * 0.6 < run.volume() - v <= 3.0 * 0.6  # water at rest takes up about half at first


def test_third_order_steps(spark):
    """SSP-RK3 by hand from Euler steps: u1 = E(u); u2 = 3/4 u + 1/4 E(u1); u = 1/3 u + 2/3 E(u2)."""
    c = grid(spark, 10, 10, "1.0D + 0.1D * sin(0.6D * i) * cos(0.6D * j)", hu="0.1D * cos(i)")
    euler, rk3 = (Config(bed="audusse", integrator=k, boundary=WALLS) for k in ("euler", "ssprk3"))
    u = c
    mixed = [array(c, 10, 10, "h", "hu", "hv")]
    for a, b in ((0.0, 1.0), (0.75, 0.25), (1 / 3, 2 / 3)):
        e = array(window_step(u, 10, 10, 1.0, 0.05, euler), 10, 10, "h", "hu", "hv")
        m = [a * x + b * y for x, y in zip(mixed[0], e)]
        i, j = np.meshgrid(np.arange(10), np.arange(10), indexing="ij")
        u = spark.createDataFrame([(int(p), int(q), 0.0, *map(float, r)) for p, q, *r in zip(i.ravel(), j.ravel(), *[x.ravel() for x in m])], "i int, j int, b double, h double, hu double, hv double")
    run = ShallowWater(spark, c, 10, 10, 1.0, rk3)
    run.step(0.05)
    for x, y in zip(array(run.cells, 10, 10, "h", "hu", "hv"), m):
        assert np.allclose(x, y, atol=1e-13)


def test_a_step_that_got_too_long_is_taken_again(spark):
    c = grid(spark, 40, 1, "if(i < 4, 4.0D, 0.001D)", "if(i < 12, 0.0D, -6.0D * (i - 12) / 28)")
    run = ShallowWater(spark, c, 40, 1, 1.0, Config(boundary=WALLS, cfl=0.9), inner=8)
    seen = []
    run.run(2.0, callback=lambda r, n: seen.append((r.t, r.cfl_dt())))
    # no superstep ended with speeds that its own step didn't allow
    starts = [0.0] + [t for t, _ in seen[:-1]]
    assert run.t == pytest.approx(2.0) and len(seen) < 40
    assert all((t - s) / 8 <= dt + 1e-12 for s, (t, dt) in zip(starts, seen))


def test_samples_and_frames(spark):
    c = grid(spark, 6, 6, "1.0D")
    places = spark.createDataFrame([("a", 2, 3)], "g string, i int, j int")
    run = ShallowWater(spark, c, 6, 6, 1.0, Config(boundary=WALLS), sampler=(places, 0.5), frame_every=1.0)
    run.run(1.2)
    t = sorted(r.t for r in run.samples().collect())
    assert len(t) == 3 and t[0] == 0 and 0.5 <= t[1] < 1.0 <= t[2] <= 1.2
    assert store.read_frames(spark, run.folder + "/frames").select("frame").distinct().count() == 2


def test_blended_gauges_hold_their_ends(spark):
    gauges = spark.createDataFrame([("a", 10.0, 1.0), ("a", 20.0, 3.0)], "gauge string, t double, v double")
    ring = spark.createDataFrame([(0, 0, "a", 1.0)], "i int, j int, gauge string, w double")
    assert [forcings.blended(gauges, ring, t).first().eta for t in (0.0, 10.0, 15.0, 30.0)] == [1.0, 1.0, 2.0, 3.0]
