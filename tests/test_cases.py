"""Case archives, manifests, conditioning of rasters, entropic pressure, strips and parts of a grid."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.operators import boundary, measure, mesh, pressure, raster
from freshet.sources import cases, store
from test_solver import array, grid


def test_spatial_rain(spark, tmp_path):
    rate = np.arange(12, dtype=np.float32).reshape(3, 2, 2)
    lookup = np.array([[0, 1, 1], [2, 3, 3]], dtype=np.int32)
    np.savez(tmp_path / "native.npz", t_s=[0.0, 60.0, 60.0], native_rate_ms=rate, lookup_native_ij=lookup)
    rows, pix = cases.spatial_rain(spark, str(tmp_path / "native.npz"), (2, 3), offset=10.0)
    assert {(r.t, r.pix): r.rate for r in rows.where("t = 10").collect()} == {(10.0, k): float(k) for k in range(4)} and rows.count() == 12
    assert {(r.i, r.j): r.pix for r in pix.collect()} == {(i, j): int(lookup[i, j]) for i in range(2) for j in range(3)}
    np.savez(tmp_path / "grid.npz", t_s=[0.0], rate_ms=np.ones((1, 2, 3)))
    rows, pix = cases.spatial_rain(spark, str(tmp_path / "grid.npz"), (2, 3))
    assert rows.count() == 6 and pix.select("pix").distinct().count() == 6
    for bad in (dict(t_s=[], rate_ms=np.ones((0, 2, 3))), dict(t_s=[5.0, 1.0], rate_ms=np.ones((2, 2, 3))), dict(t_s=[0.0], rate_ms=np.ones((1, 3, 3))), dict(t_s=[0.0], native_rate_ms=rate[:1], lookup_native_ij=lookup.T)):
        np.savez(tmp_path / "bad.npz", **bad)
        with pytest.raises(ValueError):
            cases.spatial_rain(spark, str(tmp_path / "bad.npz"), (2, 3))


def test_fields_must_fit_the_bed(spark, tmp_path):
    np.savez(tmp_path / "a.npz", tau_h=np.arange(6.0).reshape(2, 3), rows=[0, 1], cols=[2, 0], h_max=[0.5, 0.7])
    f = cases.field(spark, str(tmp_path / "a.npz"), "tau_h", (2, 3))
    assert {(r.i, r.j): r.tau_h for r in f.collect()}[1, 2] == 5.0
    assert {(r.i, r.j, r.h_max) for r in cases.sparse_field(spark, str(tmp_path / "a.npz"), (2, 3)).collect()} == {(0, 2, 0.5), (1, 0, 0.7)}
    for call in (lambda: cases.field(spark, str(tmp_path / "a.npz"), "tau_h", (3, 2)), lambda: cases.field(spark, str(tmp_path / "a.npz"), "none", (2, 3)), lambda: cases.sparse_field(spark, str(tmp_path / "a.npz"), (2, 2))):
        with pytest.raises(ValueError):
            call()


def test_manifests_are_numbered(spark, tmp_path):
    one, two = (store.write_manifest(spark, str(tmp_path), {"cfl": 0.5, "path": tmp_path}, steps=n) for n in (1, 2))
    assert one.endswith("run_manifest_00.json") and two.endswith("run_manifest_01.json")
    told = json.loads((tmp_path / "run_manifest_01.json").read_text())
    assert told["options"]["cfl"] == 0.5 and told["steps"] == 2 and told["spark"] == spark.version


def test_clean_dem_fills_before_it_looks_for_spikes(spark):
    d = grid(spark, 8, 8, "0.0D").select("i", "j", F.expr("case when i = 3 and j = 3 then -9999.0D when i = 5 and j = 5 then 90.0D when i = 1 and j = 1 then 0.0004D else 10.0D + i end").alias("z"))
    with pytest.warns(UserWarning):
        out, stats = raster.clean_dem(d, 8, 8, bounds=(0.0, 16.0))
    z = array(out, 8, 8, "z")[0]
    assert stats == {"n_near_zero": 1, "n_spikes": 1, "n_clipped": 8}
    assert z[3, 3] in (12.0, 13.0, 14.0) and abs(z[5, 5] - 15) <= 1 and abs(z[1, 1] - 11) <= 1 and z[7].max() == 16
    with pytest.raises(ValueError):
        raster.clean_dem(d, 8, 8, bounds=(5.0, 1.0))


def test_resampling_kinds(spark):
    coarse = grid(spark, 6, 6, "0.0D").select("i", "j", F.expr("cast(i * i + 2 * j as double)").alias("z"))
    fine = grid(spark, 12, 12, "0.0D").select("i", "j")
    near, line, cube = (array(raster.resample(coarse, fine, 0.5, 6, 6, k), 12, 12, "z")[0] for k in ("nearest", "bilinear", "cubic"))
    assert near[4, 6] == 4 + 6 and line[5, 5] == pytest.approx(2.25**2 + 0.25 * 0.75 + 2 * 2.25)
    assert cube[5, 5] == pytest.approx(2.25**2 + 2 * 2.25)  # exact for quadratics inside
    with pytest.raises(ValueError):
        raster.resample(coarse, fine, 0.5, 6, 6, "lanczos")


@pytest.mark.parametrize("edge", ["neumann", "periodic"])
def test_entropic_pressure_solves_its_equation(spark, edge):
    n, a = 8, 0.3
    c = grid(spark, n, n, "1.0D + 0.2D * sin(0.785398163397448D * i)", hu="0.3D * cos(0.785398163397448D * j) * h", hv="0.2D * sin(0.785398163397448D * i) * h")
    out, rounds = pressure.solve_sigma(c, n, n, 1.0, 1.0, a, edge, tol=1e-9)
    s = array(out, n, n, "sigma")[0]
    h, hu, hv = array(c, n, n, "h", "hu", "hv")
    mode = "edge" if edge == "neumann" else "wrap"
    H, U, V, S = (np.pad(x, 1, mode=mode) for x in (h, hu / h, hv / h, s))
    C = slice(1, -1)
    ux, vx = ((x[2:, C] - x[:-2, C]) / 2 for x in (U, V))
    uy, vy = ((x[C, 2:] - x[C, :-2]) / 2 for x in (U, V))
    left = S[C, C] / H[C, C]
    for other in ((slice(2, None), C), (slice(None, -2), C), (C, slice(2, None)), (C, slice(None, -2))):
        left = left + a / (0.5 * (H[C, C] + H[other])) * (S[C, C] - S[other])
    assert 1 < rounds < 200 and np.allclose(left, a * 2 * (ux * ux + vy * vy + ux * vy + uy * vx), atol=1e-6)


def test_strips_and_parts(spark):
    c = grid(spark, 8, 4, "1.0D * i")
    rows = {(r.to, r.i) for r in mesh.halo_rows(c, 8, 4).collect()}
    assert rows == {(1, 1), (0, 2), (2, 3), (1, 4), (3, 5), (2, 6)}
    assert mesh.stitch([c.where("i < 3"), c.where("i >= 3")], 8, 4).count() == 32
    for parts in ([c.where("i < 3")], [c, c.where("i = 0")]):
        with pytest.raises(ValueError):
            mesh.stitch(parts, 8, 4)
    mask = c.select("i", "j", (F.col("i") == 2).alias("on"))
    assert boundary.stage_from_mask(c, mask).count() == 4


def test_step_rules():
    assert measure.held_step(1.0, 1) == 1.0 and measure.held_step(1.0, 4) == 0.95
    assert measure.next_step(9000.0, 0.0, 1e6) == 1800.0 and measure.next_step(2.0, 9.0, 10.0) == 1.0
    for bad in (float("nan"), float("inf"), None):
        with pytest.raises(FloatingPointError):
            measure.finite(bad)


def test_class_tables(spark):
    from freshet.operators import classes

    c = spark.createDataFrame([(0, 0, 1, 0.03, 5.0), (0, 1, 2, 0.05, 0.1), (1, 0, 2, 0.3, 9.0)], "i int, j int, unit int, nm double, b double")
    t = spark.createDataFrame([(1, 0.5), (2, 0.7)], "unit int, v double")
    assert sorted(r.v for r in classes.by_class(c, t, "unit").collect()) == [0.5, 0.7, 0.7]
    for bad in (t.where("unit = 1"), t.unionByName(t), spark.range(300).select(F.col("id").cast("int").alias("unit"), F.lit(1.0).alias("v"))):
        with pytest.raises(ValueError):
            classes.by_class(c, bad, "unit")
    x = classes.infiltration(c, 0.2, 1.0, 0.3, ks_scale=2.0)
    assert [(r.ks, r.psi, round(r.f_max, 6)) for r in x.orderBy("i", "j").collect()] == [(10.0, 0.1, 0.3), (6.0, 0.15, 0.0), (0.0, 0.0, 0.3)]
    u = spark.createDataFrame([(2, 1.0, 2.0, 3.0)], "unit int, ks double, psi double, dth double")
    assert [r.ks for r in classes.soil_units(x, u).orderBy("i", "j").collect()] == [10.0, 1.0, 1.0]
