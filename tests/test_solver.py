"""Invariants and exact solutions of runs, and agreement of the two steppers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.model import Config
from freshet.operators.solver import ShallowWater, block_steps, window_step

WALLS = dict.fromkeys(("west", "east", "south", "north"), "wall")


def grid(spark, nx, ny, h, b="0.0D", hu="0.0D", hv="0.0D"):
    d = spark.range(nx * ny).select(F.expr(f"cast(id div {ny} as int) i"), F.expr(f"cast(id % {ny} as int) j"))
    return d.withColumn("b", F.expr(b)).withColumn("h", F.expr(h)).withColumn("hu", F.expr(hu)).withColumn("hv", F.expr(hv))


BOWL = "exp(-((i - 8) * (i - 8) + (j - 8) * (j - 8)) / 12.0D)"


def array(df, nx, ny, *cols):
    p = df.toPandas().sort_values(["i", "j"])
    return [p[c].to_numpy().reshape(nx, ny) for c in cols]


@pytest.mark.parametrize("bed", ["srm", "audusse"])
@pytest.mark.parametrize("level", [1.5, 0.6])
@pytest.mark.parametrize("kinds", ["wall", "periodic"])
def test_lake_at_rest(spark, bed, level, kinds):
    c = grid(spark, 16, 16, f"greatest({level}D - {BOWL}, 0.0D)", BOWL)
    cfg = Config(bed=bed, boundary=dict.fromkeys(WALLS, kinds))
    out = block_steps(c, 16, 16, 1.0, 0.1, 10, cfg, side=8)
    h, hu, hv, b = array(out, 16, 16, "h", "hu", "hv", "b")
    assert max(abs(hu).max(), abs(hv).max()) < 1e-10
    wet = h > 1e-6
    assert abs((h + b)[wet] - level).max() < 1e-10


@pytest.mark.parametrize("cfg", [
    Config(boundary=WALLS, manning=0.03), Config(bed="audusse", riemann="lf", boundary=dict(WALLS, west="fall", east="extrapolate")),
    Config(boundary=dict.fromkeys(WALLS, "periodic"), rainfall=1e-5),
])
def test_blocks_match_windows(spark, cfg):
    c = grid(spark, 20, 14, "greatest(0.9D - b, 0.0D)", "0.5D + 0.4D * sin(0.7D * i) * cos(0.5D * j)", "0.05D * h * sin(i)", "0.04D * h * cos(j)")
    one, dt = c, 0.05
    for _ in range(2):
        one = window_step(one, 20, 14, 1.0, dt, cfg)
    ref = array(one, 20, 14, "h", "hu", "hv", "peak")
    for side in (32, 7):
        got = array(block_steps(c, 20, 14, 1.0, dt, 2, cfg, side), 20, 14, "h", "hu", "hv", "peak")
        for a, b in zip(ref, got):
            assert abs(a - b).max() < 1e-12


def test_block_count_does_not_matter(spark):
    c = grid(spark, 24, 24, "greatest(1.0D - b, 0.0D)", "0.6D * sin(0.3D * i) * cos(0.4D * j)")
    cfg = Config(boundary=WALLS, manning=0.05)
    all_ = [array(block_steps(c, 24, 24, 1.0, 0.05, 4, cfg, s), 24, 24, "h", "hu", "hv") for s in (24, 12, 5)]
    for other in all_[1:]:
        for a, b in zip(all_[0], other):
            assert np.array_equal(a, b)


def test_mass_between_walls(spark):
    c = grid(spark, 16, 16, "1.0D + 0.5D * exp(-((i - 8) * (i - 8) + (j - 8) * (j - 8)) / 18.0D)")
    run = ShallowWater(spark, c, 16, 16, 1.0, Config(cfl=0.4, boundary=WALLS), inner=4, side=8)
    before = run.volume()
    run.run(10.0, max_steps=12)
    assert run.steps == 12 and abs(run.volume() - before) < 1e-10
    top = run.max_depth().agg(F.max("h")).first()[0]
    assert top >= 1.49


def test_fall_drains(spark):
    c = grid(spark, 12, 12, "1.0D")
    run = ShallowWater(spark, c, 12, 12, 1.0, Config(boundary=dict.fromkeys(WALLS, "fall")))
    v = [run.volume()]
    run.run(100.0, max_steps=3, callback=lambda r, n: v.append(r.volume()))
    assert all(b < a for a, b in zip(v, v[1:]))


def test_dry_dam_break_front(spark):
    """Ritter: the front of a dam break over a dry bed runs at 2 sqrt(g h)."""
    n, dx, t = 400, 0.05, 0.8
    c = grid(spark, n, 1, f"if(i < {n // 2}, 1.0D, 0.0D)")
    out = block_steps(c, n, 1, dx, t / 400, 400, Config(h_min=1e-8, boundary=WALLS), side=512)
    h = array(out, n, 1, "h")[0][:, 0]
    front = (np.flatnonzero(h > 1e-7).max() + 1 - n / 2) * dx
    assert abs(front - 2 * math.sqrt(9.81) * t) < 0.12 * 2 * math.sqrt(9.81) * t
    assert abs(h.sum() - n / 2) < 1e-9 and h.min() >= 0


def test_rain_volume_and_time(spark):
    c = grid(spark, 8, 8, "0.5D")
    run = ShallowWater(spark, c, 8, 8, 2.0, Config(rainfall=1e-5, boundary=WALLS), inner=5)
    v = run.volume()
    run.run(3.0)
    assert run.t == pytest.approx(3.0) and run.volume() - v == pytest.approx(3.0 * 1e-5 * 8 * 8 * 4, rel=1e-9)


def test_resume_gives_the_same(spark, tmp_path):
    c = grid(spark, 10, 10, "1.0D + 0.1D * sin(i + j)")
    cfg = Config(boundary=WALLS)
    a = ShallowWater(spark, c, 10, 10, 1.0, cfg)
    a.run(100.0, max_steps=2)
    a.checkpoint(str(tmp_path / "ckpt"))
    b = ShallowWater.resume(spark, str(tmp_path / "ckpt"), cfg)
    assert (b.t, b.steps) == (a.t, a.steps)
    a.run(100.0, max_steps=4)
    b.run(100.0, max_steps=4)
    for x, y in zip(array(a.cells, 10, 10, "h", "hu", "hv", "peak"), array(b.cells, 10, 10, "h", "hu", "hv", "peak")):
        assert np.array_equal(x, y)
    with pytest.raises(FileNotFoundError):
        ShallowWater.resume(spark, str(tmp_path / "none"), cfg)


def test_dry_grid_has_a_bounded_step_and_nan_raises(spark):
    run = ShallowWater(spark, grid(spark, 4, 4, "0.0D"), 4, 4, 1.0)
    assert run.cfl_dt() < 0.5 / math.sqrt(9.81 * 1e-6) + 1
    bad = ShallowWater(spark, grid(spark, 4, 4, "1.0D", hu="double('nan')"), 4, 4, 1.0)
    with pytest.raises(FloatingPointError):
        bad.cfl_dt()


def test_window_step_of_plain_schemes(spark):
    c = grid(spark, 12, 12, "1.0D + 0.1D * sin(i)")
    for recon in ("first", "muscl", "weno5"):
        out = window_step(c, 12, 12, 1.0, 0.05, Config(bed="slope", recon=recon, boundary=WALLS))
        assert abs(out.agg(F.sum("h")).first()[0] - c.agg(F.sum("h")).first()[0]) < 1e-10


@pytest.mark.parametrize("bad", [dict(riemann="roe"), dict(cfl=0.0), dict(h_min=math.nan), dict(boundary={"west": "wall"}), dict(bed="slope", recon="weno5", ngh=1), dict(rainfall=-1.0)])
def test_config_refuses(bad):
    with pytest.raises(ValueError):
        Config(**bad)


def test_config_warns():
    with pytest.warns(UserWarning):
        Config(recon="weno5")
    with pytest.warns(UserWarning):
        Config(rainfall=12.0)
