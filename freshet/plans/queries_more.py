"""Round trips through sources and sinks, and rows of the inventory that combine others."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from freshet.functions import flow, stencil
from freshet.functions.program import Program, rounded, text
from freshet.operators import measure, mesh, raster
from freshet.plans import fixtures as fx
from freshet.plans.queries_grid import _FLOOR, _NUM, _RINGS
from freshet.plans.queries_tables import _PIX, D, disc, pixels, shown
from freshet.plans.registry import add
from freshet.sources import store
from freshet.sources import text as csv


def _folder(spark) -> str:
    return f"{store.shared_folder(spark)}/roundtrip-{uuid.uuid4().hex}"


# ---- sources and sinks: what is written comes back ----


def rain_csv(spark, sf_dir: str):
    path = _folder(spark)
    fx.series(spark, sf_dir).select(F.col("t").alias("time_s"), F.col("v").alias("rate_mm_h")).repartition(1).sortWithinPartitions("time_s").write.option("header", True).csv(path)  # one file, a row for each hour
    return csv.rain_csv(spark, path).select("t", "v")


add("s1_rain_csv", rain_csv, f"WITH {fx.SERIES} SELECT t, v FROM series")


def tide_csv(spark, sf_dir: str):
    path = _folder(spark)
    s = fx.stage(spark, sf_dir).withColumn("s", F.floor("t").cast("long"))
    when = F.date_format(F.timestamp_seconds(F.col("s") + 1704067200), "yyyy-MM-dd HH:mm:ss")
    s.select(when.alias("Date Time"), F.when(F.col("s") % 5 == 0, "").otherwise(F.format_string(" %.3f", "v")).alias(" Water Level")).repartition(1).write.option("header", True).csv(path)
    return shown(csv.tide_csv(spark, path, "2024-01-01 00:00:00"), "v", keys=("t",))


_TIDE = "k AS (SELECT floor(t) AS t, round(v, 3) AS v FROM stage WHERE CAST(floor(t) AS BIGINT) % 5 <> 0)"
add("s2_tide_csv", tide_csv, f"WITH {fx.STAGE}, {_TIDE} SELECT t, {rounded('v')[0]} FROM k")


def tide_by_name(spark, sf_dir: str):
    """Columns told apart by name: a preliminary level comes first and must not be taken."""
    path = _folder(spark)
    s = fx.stage(spark, sf_dir).withColumn("s", F.floor("t").cast("long"))
    when = F.date_format(F.timestamp_seconds(F.col("s") + 1704067200), "yyyy-MM-dd HH:mm:ss")
    s.select(when.alias("Time (GMT)"), F.lit("9.9").alias("Preliminary Level (m)"), F.format_string("%.2f", "v").alias("Verified (m)")).repartition(1).write.option("header", True).csv(path)
    return shown(csv.tide_csv(spark, path, "2024-01-01 00:00:00", level="Verified (m)"), "v", keys=("t",))


add("s3_tide_by_name", tide_by_name, f"WITH {fx.STAGE}, k AS (SELECT floor(t) AS t, round(v, 2) AS v FROM stage) SELECT t, {rounded('v')[0]} FROM k")


def case(spark, sf_dir: str):
    path = _folder(spark)
    store.write_case(path, cells=fx.cell(spark, sf_dir), gauges=fx.gauge_places(spark, sf_dir))
    got = store.read_case(spark, path, "cells", "gauges")
    return got["cells"].agg(F.count("*").alias("cells"), F.sum("n").alias("n")).crossJoin(got["gauges"].agg(F.count("*").alias("gauges")))


add("s8_case_tables", case, f"WITH {fx.CELL}, {fx.GAUGES} SELECT (SELECT count(*) FROM cell) AS cells, (SELECT CAST(sum(n) AS BIGINT) FROM cell) AS n, (SELECT count(*) FROM gauges) AS gauges")


def frames(spark, sf_dir: str):
    path = _folder(spark)
    for k in range(3):
        store.append_frame(fx.cell(spark, sf_dir).withColumn("h", F.col("h") * (k + 1)), path, k, 60.0 * k, "h")
    return shown(store.read_frames(spark, path).groupBy("frame", "t").agg(F.max("h").alias("top"), F.count("*").alias("n")), "top", keys=("frame", "t", "n"))


add("s12_depth_frames", frames, f"WITH {fx.CELL}, k AS (SELECT CAST(range AS INT) AS frame, range * {D(60)} AS t FROM range(3)), x AS (SELECT frame, t, count(*) AS n, max(h * (frame + 1)) AS top FROM cell, k GROUP BY 1, 2) SELECT frame, t, n, {rounded('top')[0]} FROM x")


def snapshots(spark, sf_dir: str):
    path = _folder(spark)
    store.append_frame(disc(spark, sf_dir), path, 0, 0.0, "h", "hu", "hv")
    return shown(store.read_frames(spark, path), "h", "hu", "hv", keys=("i", "j"), digits=12)


add("s13_snapshots", snapshots, f"WITH {fx.CELL} SELECT i, j, {', '.join(rounded('h', 'hu', 'hv', digits=12))} FROM cell WHERE (i - 32) * (i - 32) + (j - 32) * (j - 32) <= 676")


def gauge_files(spark, sf_dir: str):
    path = _folder(spark)
    g = measure.gauge_cells(fx.gauge_places(spark, sf_dir), 64, 64, 1.0).where("inside")
    csv.write_gauges(measure.sample(fx.cell(spark, sf_dir), g).withColumn("t", F.lit(60.0)), path)
    return spark.read.option("header", True).csv(path).select(F.col("g").cast("long").alias("g"), F.round(F.col("h_m").cast("double"), 4).alias("h"), F.round(F.col("eta_m").cast("double"), 4).alias("eta"))


_PLACED = "pl AS (SELECT g, CAST(floor(x) AS INT) AS i, CAST(floor(y) AS INT) AS j FROM gauges)"
add("s14_gauge_csv", gauge_files, f"WITH {fx.CELL}, {fx.GAUGES}, {_PLACED} SELECT g, round(CAST(printf('%.6g', h) AS DOUBLE), 4) AS h, round(CAST(printf('%.6g', h + b) AS DOUBLE), 4) AS eta FROM pl JOIN cell USING (i, j)")


def section_files(spark, sf_dir: str):
    path = _folder(spark)
    csv.write_cross_sections(measure.cross_sections(fx.cell(spark, sf_dir), pixels(spark), 2.0).withColumn("t", F.lit(0.0)), path)
    return spark.read.option("header", True).csv(path).select(F.col("g").cast("int").alias("g"), F.col("n_pix").cast("long").alias("n"), F.round(F.col("h_max_cs_m").cast("double"), 5).alias("h_max"))


add("s15_cross_section_csv", section_files, f"WITH {fx.CELL}, {_PIX} SELECT g, count(*) AS n, round(max(h), 5) AS h_max FROM cell JOIN pix USING (i, j) GROUP BY g")


def product(spark, sf_dir: str):
    path = _folder(spark)
    store.write_product(fx.cell(spark, sf_dir).select("i", "j", "h"), path)
    return spark.read.parquet(path).select("i", "j", "h")


add("s16_depth_product", product, f"WITH {fx.CELL} SELECT i, j, h FROM cell")


def checkpoint(spark, sf_dir: str):
    path = _folder(spark)
    store.write_checkpoint(fx.cell(spark, sf_dir).select("i", "j", "h"), path, {"t": 12.5, "steps": 3})
    cells, meta = store.read_checkpoint(spark, path)
    return cells.select("i", "j", "h", F.lit(meta["t"]).alias("t"), F.lit(meta["steps"]).alias("steps"))


add("s18_checkpoint", checkpoint, f"WITH {fx.CELL} SELECT i, j, h, {D(12.5)} AS t, CAST(3 AS INT) AS steps FROM cell")


def mesh_cache(spark, sf_dir: str):
    """Built once with its neighbours, then replayed from the store."""
    path = _folder(spark)
    store.write_case(path, mesh=mesh.neighbours(mesh.number(disc(spark, sf_dir).select("i", "j"), "i", "j")))
    return store.read_case(spark, path, "mesh")["mesh"].agg(F.count("*").alias("n"), F.count("ke").alias("east"), F.count("kn").alias("north"), F.max("k").alias("top"))


add("s17_mesh_cache", mesh_cache, f"WITH {fx.CELL}, {_NUM} SELECT count(*) AS n, (SELECT count(*) FROM mesh a JOIN mesh b ON b.i = a.i + 1 AND b.j = a.j) AS east, (SELECT count(*) FROM mesh a JOIN mesh b ON b.i = a.i AND b.j = a.j + 1) AS north, max(k) AS top FROM mesh")


def rain_means(spark, sf_dir: str):
    e = fx.table(spark, sf_dir, "orders")
    f = e.select(((F.col("o_custkey") % 24) * F.lit(3600.0)).alias("t"), (F.lit(270.0) + F.col("o_orderkey") % 20).alias("lon"), (F.lit(20.0) + F.col("o_orderkey") % 15).alias("lat"), (F.col("o_custkey") % 13).cast("double").alias("mm"))
    return shown(csv.rain_means(f, -88.0, -75.0, 22.0, 31.0), "v", keys=("t",))


add("s10_rain_means", rain_means, f"WITH f AS (SELECT (o_custkey % 24) * {D(3600)} AS t, 270 + o_orderkey % 20 AS lon, 20 + o_orderkey % 15 AS lat, CAST(o_custkey % 13 AS DOUBLE) AS mm FROM orders), m AS (SELECT t, avg(mm) AS v FROM f WHERE CASE WHEN lon > 180 THEN lon - 360 ELSE lon END BETWEEN -88 AND -75 AND lat BETWEEN 22 AND 31 GROUP BY t) SELECT t, {rounded('v')[0]} FROM m")

# ---- steps, gathers and meshes that combine other rows ----


def held_step(spark, sf_dir: str):
    """The step kept for K steps, and steps capped by limits and the end of the run."""
    dt = measure.cfl_step(fx.cell(spark, sf_dir), 2.0).first().dt
    row = (measure.held_step(dt, 8), measure.next_step(dt, 0.0, 60.0, dt_max=0.1), measure.next_step(dt, 57.0, 60.0, dt_min=5.0))
    return shown(spark.createDataFrame([row], "held double, capped double, last double"), "held", "capped", "last")


_DT = f"l AS ({Program(flow.wave_speed_2d('lam', '1e-06')).sql('cell')}), m AS (SELECT {text(f'1.0 / (greatest(max(lam), {_FLOOR}) + 1e-12)')} AS dt FROM l)"
add("c8_c9_step_rules", held_step, f"WITH {fx.CELL}, {_DT}, x AS (SELECT dt * {D(0.95)} AS held, least(dt, {D(0.1)}) AS capped, least(greatest(dt, {D(5)}), {D(3)}) AS last FROM m) SELECT {', '.join(rounded('held', 'capped', 'last'))} FROM x")
add(
    "c11_combined_parts", lambda s, d: shown(measure.wave_speeds(mesh.blocks(fx.cell(s, d), 64, 64, 4, 4)).groupBy("bi", "bj").agg(F.max("lam").alias("lam"), F.sum("n").alias("n")).agg(F.max("lam").alias("lam"), F.sum("n").alias("n")), "lam", keys=("n",)),
    f"WITH {fx.CELL}, l AS ({Program(flow.wave_speed_2d('lam', '1e-06')).sql('cell')}), x AS (SELECT CAST(sum(n) AS BIGINT) AS n, max(lam) AS lam FROM l) SELECT n, {rounded('lam')[0]} FROM x",
)
add("j7_flat_ids", lambda s, d: pixels(s).join(mesh.number(disc(s, d).select("i", "j"), "i", "j"), ["i", "j"]).select("g", "k"), f"WITH {fx.CELL}, {_NUM}, {_PIX} SELECT g, k FROM pix JOIN mesh USING (i, j)")
_BG = stencil.bed_gradient("x", "2.0", "gx") + stencil.bed_gradient("y", "2.0", "gy")
add("m7_stored_gradients", lambda s, d: shown(Program(_BG).apply(fx.cell(s, d)).join(mesh.dilate(disc(s, d), 64, 64), ["i", "j"]), "gx", "gy", keys=("i", "j")), f"WITH {fx.CELL}, {_RINGS}, gr AS ({Program(_BG).sql('cell')}) SELECT i, j, {', '.join(rounded('gx', 'gy'))} FROM gr JOIN stored USING (i, j)")


def stitched(spark, sf_dir: str):
    """Blocks written apart and put together again."""
    path = _folder(spark)
    mesh.blocks(fx.cell(spark, sf_dir), 64, 64, 3, 2).write.partitionBy("bi", "bj").parquet(path)
    parts = [spark.read.parquet(f"{path}/bi={a}/bj={b}") for a in range(3) for b in range(2)]
    return mesh.stitch(parts, 64, 64).select("i", "j", "b", "hu", "hv")


add("h5_stitched_parts", stitched, f"WITH {fx.CELL} SELECT i, j, b, hu, hv FROM cell")
add("d5_resampled_bilinear", lambda s, d: shown(raster.resample(fx.cell(s, d).select("i", "j", F.col("b").alias("z")), s.range(100 * 100).select((F.col("id") / 100).cast("int").alias("i"), (F.col("id") % 100).cast("int").alias("j")), 0.6, 64, 64), "z", keys=("i", "j")),
    f"""WITH {fx.CELL}, f AS (SELECT CAST(range // 100 AS INT) AS i, CAST(range % 100 AS INT) AS j, (range // 100 + {D(0.5)}) * {D(0.6)} - {D(0.5)} AS u, (range % 100 + {D(0.5)}) * {D(0.6)} - {D(0.5)} AS v FROM range(10000)),
g AS (SELECT *, CAST(floor(u) AS INT) AS a, CAST(floor(v) AS INT) AS c FROM f),
k AS (SELECT g.i, g.j, sum(cell.b * CASE WHEN p.d = 1 THEN u - a ELSE 1 - (u - a) END * CASE WHEN q.e = 1 THEN v - c ELSE 1 - (v - c) END) AS z FROM g, (VALUES (0), (1)) AS p(d), (VALUES (0), (1)) AS q(e) JOIN cell ON cell.i = least(greatest(a + d, 0), 63) AND cell.j = least(greatest(c + e, 0), 63) GROUP BY 1, 2) SELECT i, j, {rounded('z')[0]} FROM k""")
