"""Series, meshes, rasters, boundaries, sources, sinks and streams on small tables."""

import pytest
from pyspark.sql import functions as F

from freshet.operators import boundary, measure, mesh, raster, temporal
from freshet.sources import store, text
from freshet.streaming import gauges


def series(spark, *rows):
    return spark.createDataFrame([(float(t), float(v), n) for n, (t, v) in enumerate(rows)], "t double, v double, seq int")


def at(spark, *times):
    return spark.createDataFrame([(float(t),) for t in times], "tq double")


def values(df, c="v"):
    return [r[c] for r in df.orderBy("tq").collect()]


def test_step_lookup_holds_values(spark):
    s = series(spark, (0, 5), (3600, 12.5), (3600, 13), (7200, 30))
    assert values(temporal.asof_step(at(spark, -5, 0, 3599, 3600, 7200, 1e6), s, seq="seq")) == [5, 5, 5, 13, 30, 30]


def test_linear_lookup_is_flat_outside(spark):
    s = series(spark, (0, 0), (10, 1), (30, 3))
    assert values(temporal.asof_linear(at(spark, -1, 0, 5, 10, 20, 99), s, width=4.0)) == pytest.approx([0, 0, 0.5, 1, 2, 3])


def test_order_of_time(spark):
    assert temporal.require_order(series(spark, (0, 1), (0, 2), (5, 1))).count() == 3
    with pytest.raises(ValueError):
        temporal.require_order(series(spark, (5, 1), (0, 2)))
    assert [r.v for r in temporal.stable_sort(series(spark, (5, 1), (0, 2), (0, 3))).collect()] == [2, 3, 1]
    with pytest.raises(ValueError):
        temporal.datum_guard(series(spark, (0, 99)))


def cells(spark, *ij):
    return spark.createDataFrame(list(ij), "i int, j int")


def test_mesh_roundtrip(spark):
    a = cells(spark, (0, 0), (0, 1), (2, 0), (1, 1))
    m = mesh.number(a, "i", "j")
    assert {(r.i, r.j): r.k for r in m.collect()} == {(0, 0): 0, (0, 1): 1, (1, 1): 2, (2, 0): 3}
    n = {r.k: (r.ke, r.kw, r.kn, r.ks) for r in mesh.neighbours(m).collect()}
    assert n[1] == (2, None, None, 0) and n[3] == (None, None, None, None)
    grid = spark.range(9).select(F.expr("cast(id div 3 as int) i"), F.expr("cast(id % 3 as int) j"), F.col("id").cast("double").alias("h"))
    back = mesh.unpack(mesh.pack(grid, m), grid, -1.0, "h")
    assert {(r.i, r.j): r.h for r in back.collect()}[(1, 1)] == 4 and back.where("h = -1").count() == 5


def test_mesh_guards(spark):
    ring = mesh.dilate(cells(spark, (3, 3)), 7, 7)
    assert ring.count() == 13 and mesh.uncovered(ring, 7, 7).count() == 0
    with pytest.raises(ValueError):
        mesh.encode(spark.range(10).select(F.col("id").alias("v")), "v", most=9)
    with pytest.raises(ValueError):
        mesh.check_classes(spark.createDataFrame([(7,)], "cls int"), spark.createDataFrame([(1, 0.03)], "cls int, nm double"))


def test_infill_reaches_far_and_handles_nothing(spark):
    d = spark.createDataFrame([(0, 0, 7.0)] + [(i, 40, raster.NODATA) for i in range(3)], "i int, j int, z double")
    assert {r.z for r in raster.infill_nearest(d).collect()} == {7.0}
    assert {r.z for r in raster.infill_nearest(d.where("j = 40")).collect()} == {0.0}
    with pytest.raises(ValueError):
        raster.clip(d, 1.0, 0.0)


def test_landcover_fractions(spark):
    """Codes of 60 x 60 cells, split where a resampled value falls between codes."""
    c = spark.createDataFrame([(0, 0, 11.4), (0, 1, 11.6), (0, 2, 41.0), (0, 3, 16.0), (0, 4, 11.5)], "i int, j int, code double")
    got = {r.j: (r.nm, r.mapped) for r in raster.landcover_bands(c, spark).collect()}
    assert got[0] == (0.025, True) and got[1] == (0.022, True) and got[3] == (0.035, False) and got[4] == (0.022, True)


def test_gauges_and_cadence(spark):
    g = spark.createDataFrame([(1, 10.5, 10.5), (2, -0.1, 3.0)], "g long, x double, y double")
    got = {r.g: (r.i, r.j, r.inside) for r in measure.gauge_cells(g, 20, 20, 1.0).collect()}
    assert got[1] == (10, 10, True) and got[2][2] is False
    steps = spark.createDataFrame([(7.0 * k,) for k in range(40)], "t double")
    assert [r.t for r in measure.cadence(steps, 60.0).orderBy("t").collect()] == [0, 63, 126, 182, 245]


def test_inlet_discharge_adds_up(spark):
    c = spark.createDataFrame([(0, j, 0.0, 0.5 + 0.1 * j) for j in range(5)], "i int, j int, b double, h double")
    inl = spark.createDataFrame([(0, 50.0, 10.0, 1, 0)], "inlet int, q double, ds double, nx int, ny int")
    out = boundary.inlet_ghosts(c, c.select(F.lit(0).alias("inlet"), "i", "j"), inl, 1)
    assert out.agg(F.sum("hu")).first()[0] * 10 == pytest.approx(50) and {r.i for r in out.collect()} == {-1}
    with pytest.raises(ValueError):
        boundary.ghost_state(c, c, "other")


def test_csv_sources(spark, tmp_path):
    (tmp_path / "rain.csv").write_text("time_s,rate_mm_h\n3600,12.5\n0,0.0\n7200,30.0\n")
    with pytest.warns(UserWarning):
        r = text.rain_csv(spark, str(tmp_path / "rain.csv"))
    assert [(x.t, x.v) for x in r.collect()] == [(0, 0), (3600, 12.5), (7200, 30)]
    (tmp_path / "tide.csv").write_text("Date Time, Water Level, Sigma\n2024-09-26 00:06, 0.4, x\n2024-09-26 00:00, 0.312, x\n2024-09-26 00:12, , x\n")
    t = text.tide_csv(spark, str(tmp_path / "tide.csv"), "2024-09-26 00:00:00")
    assert [(x.t, x.v) for x in t.collect()] == [(0, 0.312), (360, 0.4)]
    (tmp_path / "bad.csv").write_text("Date Time, Water Level\nx, y\n")
    with pytest.raises(ValueError):
        text.tide_csv(spark, str(tmp_path / "bad.csv"), "2024-09-26 00:00:00")
    (tmp_path / "g.csv").write_text("time,stage\n2024-01-01 00:00:10,1\n2024-01-01 00:00:10,2\n2024-01-01 00:00:00,0\n")
    assert [(x.t, x.v) for x in text.gauge_csv(spark, str(tmp_path / "g.csv"), "2024-01-01 00:00:00").collect()] == [(0, 0), (10, 2)]


def test_sinks(spark, tmp_path):
    rec = spark.createDataFrame([(1, 0.0, 1.23456789, 0.0, 0.0, 2.0)], "g int, t double, h double, u double, v double, eta double")
    text.write_gauges(rec, str(tmp_path / "g"))
    assert spark.read.option("header", True).csv(str(tmp_path / "g")).first().h_m == "1.23457"
    f = spark.createDataFrame([(0, 0, 1.0)], "i int, j int, h double")
    store.append_frame(f, str(tmp_path / "fr"), 3, 10.0, "h")
    store.append_frame(f, str(tmp_path / "fr"), 3, 10.0, "h")
    assert store.read_frames(spark, str(tmp_path / "fr")).count() == 1
    with pytest.raises(ValueError):
        store.write_product(f.withColumn("h", F.lit(float("nan"))), str(tmp_path / "p"))
    store.write_case(str(tmp_path / "case"), cells=f)
    assert store.read_case(spark, str(tmp_path / "case"), "cells")["cells"].count() == 1
    with pytest.raises(FileNotFoundError):
        store.read_case(spark, str(tmp_path / "case"), "rain")
    with pytest.raises(ValueError):
        store.same_cells(f, f.withColumn("i", F.lit(5)))


def test_rain_means_need_even_spacing(spark):
    rows = [(3600.0 * k, 277.0, 28.0, float(k)) for k in range(3)]
    d = spark.createDataFrame(rows, "t double, lon double, lat double, mm double")
    assert [r.v for r in text.rain_means(d, -84, -82, 27, 29).orderBy("t").collect()] == [0, 1, 2]
    with pytest.raises(ValueError):
        text.rain_means(d.unionByName(d.limit(1).withColumn("t", F.lit(20000.0))), -84, -82, 27, 29)


def test_streams(spark, tmp_path):
    rows = [(1, 0, 0.1), (1, 20, 0.9), (1, 70, 0.5), (2, 5, 0.3), (1, 4000, 0.0)]
    df = spark.createDataFrame(rows, "g int, s int, h double").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_040))
    df.select("g", "ts", "h").write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("g int, ts timestamp, h double").parquet(str(tmp_path / "in"))
    for name, made in (("cad", gauges.cadence(src, "60 seconds")), ("peak", gauges.peaks(src, "60 seconds"))):
        q = made.writeStream.format("memory").queryName(name).outputMode("complete").start()
        q.processAllAvailable()
        q.stop()
    assert {(r.g, r.h) for r in spark.table("cad").collect()} == {(1, 0.1), (1, 0.5), (2, 0.3), (1, 0.0)}
    assert spark.table("peak").where("g = 1").agg(F.max("peak")).first()[0] == 0.9
