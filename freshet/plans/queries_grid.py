"""Queries on grids: time steps, meshes, rasters, ghost modes, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.functions import flow
from freshet.functions.program import Program, rounded, text
from freshet.operators import boundary, classes, measure, mesh, raster
from freshet.plans import fixtures as fx
from freshet.plans.queries_tables import D, disc, shown, _DISC
from freshet.plans.registry import add

# Wave speeds reduced to time steps, peaks and volumes
_FLOOR = "sqrt(9.81 * 1e-6)"


def _cfl_sql(lines, agg: str = "max(lam)", where: str = "TRUE", view: str = "cell") -> str:
    return f"WITH {fx.CELL}, l AS ({Program(lines).sql(view)}), m AS (SELECT {agg} AS lam FROM l WHERE {text(where)}), x AS (SELECT lam, {text(f'1.0 / (greatest(coalesce(lam, 0.0), {_FLOOR}) + 1e-12)')} AS dt FROM m) SELECT {', '.join(rounded('lam', 'dt'))} FROM x"


add("c1_cfl_1d", lambda s, d: shown(measure.cfl_step(fx.cell(s, d).where("j = 0"), 2.0, norm="1d"), "lam", "dt"), _cfl_sql(flow.wave_speed_1d("lam", "1e-10"), where="j = 0"))
add("c2_cfl_2d", lambda s, d: shown(measure.cfl_step(fx.cell(s, d), 2.0), "lam", "dt"), _cfl_sql(flow.wave_speed_2d("lam", "1e-06")))
add("c3_cfl_wet", lambda s, d: shown(measure.cfl_step(fx.cell(s, d).withColumn("cfl_skip", F.col("i") == 0).withColumn("inv_sigma", F.lit(1.0) + F.col("n") % 2), 2.0, skip_dry=True), "lam", "dt"),
    _cfl_sql(flow.wave_speed_2d("raw", "1e-06") + ["lam = raw * (1.0 + n % 2)"], where="h >= 1e-6 AND i <> 0"))
add("c4_cfl_l2", lambda s, d: shown(measure.cfl_step(fx.cell(s, d), 2.0, norm="l2", skip_dry=True), "lam", "dt"), _cfl_sql(flow.wave_speed_l2("lam", "1e-06"), where="h >= 1e-6"))
add("c5_cfl_percentile", lambda s, d: shown(measure.cfl_step(fx.cell(s, d), 2.0, percentile=99.0), "lam", "dt"), _cfl_sql(flow.wave_speed_2d("lam", "1e-06"), agg="quantile_cont(lam, 0.99)"))
add("c6_rain_limit", lambda s, d: s.createDataFrame([(round(measure.rain_limit(60.0, fx.series(s, d).agg(F.max("v").alias("r")).first().r / 3.6e6, 0.5, 2.0), 9),)], "dt double"),
    f"WITH {fx.SERIES} SELECT round(least({D(60)}, power({D(1)}, {D(2)} / {D(3)}) / power({D(9.81)} * max(v) / {D(3.6e6)}, {D(1)} / {D(3)})), 9) AS dt FROM series")
add("c7_finite_guard", lambda s, d: measure.wave_speeds(fx.cell(s, d)).agg(F.count_if(F.isnan("lam") | (F.abs("lam") == float("inf"))).alias("n_bad"), F.max("lam").isNotNull().alias("known")),
    f"WITH {fx.CELL}, l AS ({Program(flow.wave_speed_2d('lam', '1e-06')).sql('cell')}) SELECT count(*) FILTER (isnan(lam) OR isinf(lam)) AS n_bad, max(lam) IS NOT NULL AS known FROM l")
add("c10_masked_peak", lambda s, d: shown(measure.masked_peak(fx.cell(s, d).withColumn("active", F.col("i") < 40)), "h_max"), f"WITH {fx.CELL} SELECT {rounded('h_max')[0]} FROM (SELECT max(h) AS h_max FROM cell WHERE i < 40)")
add("a4_volume", lambda s, d: shown(measure.volume(fx.cell(s, d), 2.0), "volume", digits=6), f"WITH {fx.CELL} SELECT {rounded('volume', digits=6)[0]} FROM (SELECT sum(h) * {D(4)} AS volume FROM cell)")
add("a5_peak_envelope", lambda s, d: shown(measure.envelope(fx.fields(s, d).select("i", "j", F.explode(F.array("ha", "hb", F.col("ha") - F.col("hb"))).alias("h"))), "peak", keys=("i", "j")), f"WITH {fx.FIELDS}, fr AS (SELECT i, j, ha AS h FROM fields UNION ALL SELECT i, j, hb FROM fields UNION ALL SELECT i, j, ha - hb FROM fields), y AS (SELECT i, j, max(h) AS peak FROM fr GROUP BY 1, 2) SELECT i, j, {rounded('peak')[0]} FROM y")

# Agreement of two depth fields
_AGREE = f"""WITH {fx.FIELDS}, x AS (SELECT *, (ha - hb) * (ha - hb) AS d2 FROM fields, (VALUES ({D(0.1)}), ({D(0.3)}), ({D(0.5)}), ({D(1.0)})) AS th(threshold)),
y AS (SELECT threshold, count(*) FILTER (ha > threshold AND hb > threshold) / nullif(CAST(count(*) FILTER (ha > threshold OR hb > threshold) AS DOUBLE), 0) AS csi,
  sqrt(avg(d2) FILTER (ha > threshold OR hb > threshold)) AS rmse_union, sqrt(avg(d2) FILTER (ha > threshold AND hb > threshold)) AS rmse_both,
  count(*) FILTER (ha > threshold) AS n_a, count(*) FILTER (hb > threshold) AS n_b FROM x GROUP BY threshold)"""
add("a6_csi", lambda s, d: shown(measure.agreement(fx.fields(s, d)), "csi", keys=("threshold", "n_a", "n_b")), f"{_AGREE} SELECT threshold, n_a, n_b, {rounded('csi')[0]} FROM y")
add("a7_rmse", lambda s, d: shown(measure.agreement(fx.fields(s, d)), "rmse_union", "rmse_both", keys=("threshold",)), f"{_AGREE} SELECT threshold, {', '.join(rounded('rmse_union', 'rmse_both'))} FROM y")
add("a8_class_scores", lambda s, d: shown(measure.class_scores(fx.fields(s, d)), "rmse", "bias", keys=("kind", "n")),
    f"WITH {fx.FIELDS}, y AS (SELECT CASE WHEN b < 0.25 THEN 'sea' WHEN b < 0.75 THEN 'nearshore' ELSE 'land' END AS kind, count(*) AS n, sqrt(avg((ha - hb) * (ha - hb))) AS rmse, avg(ha - hb) AS bias FROM fields GROUP BY 1) SELECT kind, n, {', '.join(rounded('rmse', 'bias'))} FROM y")
add("a9_extent", lambda s, d: shown(measure.extent(fx.fields(s, d), 30.0, 0.3), "km2_a", "km2_b"), f"WITH {fx.FIELDS}, y AS (SELECT count(*) FILTER (ha > 0.3) * {D(0.0009)} AS km2_a, count(*) FILTER (hb > 0.3) * {D(0.0009)} AS km2_b FROM fields) SELECT {', '.join(rounded('km2_a', 'km2_b'))} FROM y")
add("a10_surface_statistics", lambda s, d: shown(measure.surface_statistics(fx.fields(s, d), 0.3), "mean", "std"), f"WITH {fx.FIELDS}, y AS (SELECT avg(ha + b) AS mean, stddev_pop(ha + b) AS std FROM fields WHERE ha > 0.3) SELECT {', '.join(rounded('mean', 'std'))} FROM y")
_TURN = {"id": ("i", "j"), "fx": ("63 - i", "j"), "fy": ("i", "63 - j"), "r180": ("63 - i", "63 - j"), "t": ("j", "i"), "tfx": ("63 - j", "i"), "tfy": ("j", "63 - i"), "t180": ("63 - j", "63 - i")}
_TURNS = " UNION ALL ".join(f"SELECT '{f}' AS flip, {a} AS i, {b} AS j, hb FROM fields" for f, (a, b) in _TURN.items())
add("a11_orientation", lambda s, d: shown(measure.orientation(fx.fields(s, d), 64), "corr", keys=("flip",)), f"WITH {fx.FIELDS}, tu AS ({_TURNS}), y AS (SELECT flip, corr(ha, tu.hb) AS corr FROM tu JOIN fields f ON tu.i = f.i AND tu.j = f.j GROUP BY flip) SELECT flip, {rounded('corr')[0]} FROM y")
add("a13_velocity_cap_hits", lambda s, d: Program(flow.primitives("1e-6")).apply(fx.cell(s, d)).agg(F.count_if(F.expr(text("u * u + v * v > 0.04"))).alias("hits")), f"WITH {fx.CELL}, l AS ({Program(flow.primitives('1e-6')).sql('cell')}) SELECT count(*) FILTER ({text('u * u + v * v > 0.04')}) AS hits FROM l")

# Class tables
_CLS = f"cls AS (SELECT i, j, h, b, n, CAST((i * 7 + j * 3) % 5 AS INT) AS cls FROM cell), tab(cls, nm, ks, psi) AS (VALUES (0, {D(0.03)}, {D(5)}, {D(0.1)}), (1, {D(0.05)}, {D(3)}, {D(0.15)}), (2, {D(0.08)}, {D(3)}, {D(0.15)}), (3, {D(0.12)}, {D(0)}, {D(0)}), (4, {D(0.03)}, {D(5)}, {D(0.1)}))"


def classed(s, d):
    return fx.cell(s, d).withColumn("cls", ((F.col("i") * 7 + F.col("j") * 3) % 5).cast("int"))


def class_table(s):
    return s.createDataFrame([(0, 0.03, 5.0, 0.1), (1, 0.05, 3.0, 0.15), (2, 0.08, 3.0, 0.15), (3, 0.12, 0.0, 0.0), (4, 0.03, 5.0, 0.1)], "cls int, nm double, ks double, psi double")


add("j1_manning_by_class", lambda s, d: classes.by_class(classed(s, d), class_table(s)).select("i", "j", "nm"), f"WITH {fx.CELL}, {_CLS} SELECT i, j, nm FROM cls JOIN tab USING (cls)")
add("j2_parameter_classes", lambda s, d: classes.by_class(classed(s, d), classes.parameter_classes(class_table(s), "ks", "psi")).groupBy("pc", "ks", "psi").agg(F.count("*").alias("cells")),
    f"WITH {fx.CELL}, {_CLS}, r AS (SELECT *, CAST(dense_rank() OVER (ORDER BY ks, psi) - 1 AS INT) AS pc FROM tab) SELECT pc, ks, psi, count(*) AS cells FROM cls JOIN r USING (cls) GROUP BY ALL")
add("j3_dictionary", lambda s, d: mesh.encode(fx.cell(s, d).select("i", "j", (F.col("n") % 13).alias("v")), "v")[0].select("i", "j", "v", "cls"), f"WITH {fx.CELL}, v AS (SELECT i, j, n % 13 AS v FROM cell) SELECT i, j, v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INT) AS cls FROM v")
add("j11_class_guard", lambda s, d: classes.guard(classed(s, d), class_table(s).where("cls <> 3")), f"WITH {fx.CELL}, {_CLS} SELECT count(*) FILTER (cls = 3) AS missing, max(cls) AS top FROM cls")
_BANDS = "CASE WHEN nm >= 0.026 AND nm < 0.0455 THEN {a} WHEN nm >= 0.0455 AND nm < 0.0805 THEN {b} ELSE {z} END"
add("f18_infiltration_bands", lambda s, d: shown(classes.infiltration(classes.by_class(classed(s, d), class_table(s).select("cls", "nm")), 0.2, 1.0, 0.3), "ks", "psi", "dth", "f_max", keys=("i", "j"), digits=12),
    f"WITH {fx.CELL}, {_CLS}, x AS (SELECT i, j, " + ", ".join(text(_BANDS.format(a=a, b=b, z="0.0")) + f" AS {k}" for k, a, b in (("ks", "5.0", "3.0"), ("psi", "0.1", "0.15"), ("dth", "0.3", "0.3"))) + f", {text('least(greatest(b - 0.2, 0.0), 1.0) * 0.3')} AS f_max FROM cls JOIN tab USING (cls)) SELECT i, j, {', '.join(rounded('ks', 'psi', 'dth', 'f_max', digits=12))} FROM x")

# The active mesh
_NUM = "act AS (SELECT i, j FROM cell WHERE (i - 32) * (i - 32) + (j - 32) * (j - 32) <= 676), mesh AS (SELECT i, j, row_number() OVER (ORDER BY i, j) - 1 AS k FROM act)"
_NEAR = "nb AS (SELECT m.*, e.k AS ke, w.k AS kw, n.k AS kn, s.k AS ks FROM mesh m LEFT JOIN mesh e ON e.i = m.i + 1 AND e.j = m.j LEFT JOIN mesh w ON w.i = m.i - 1 AND w.j = m.j LEFT JOIN mesh n ON n.i = m.i AND n.j = m.j + 1 LEFT JOIN mesh s ON s.i = m.i AND s.j = m.j - 1)"


def numbered(s, d):
    return mesh.number(disc(s, d).select("i", "j"), "i", "j")


add("m1_active_ids", lambda s, d: numbered(s, d).select("i", "j", "k"), f"WITH {fx.CELL}, {_NUM} SELECT i, j, k FROM mesh")
add("m2_neighbours", lambda s, d: mesh.neighbours(numbered(s, d)).select("k", "ke", "kw", "kn", "ks"), f"WITH {fx.CELL}, {_NUM}, {_NEAR} SELECT k, ke, kw, kn, ks FROM nb")
add("j8_neighbour_lookup", lambda s, d: mesh.neighbours(numbered(s, d)).select("i", "j", *[F.expr(f"k{x} is null as edge_{x}") for x in "ewns"]), f"WITH {fx.CELL}, {_NUM}, {_NEAR} SELECT i, j, ke IS NULL AS edge_e, kw IS NULL AS edge_w, kn IS NULL AS edge_n, ks IS NULL AS edge_s FROM nb")
_RINGS = f"""{_DISC}, sh(a, b) AS (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)), r1 AS (SELECT DISTINCT i + sh.a AS i, j + sh.b AS j FROM disc, sh), r2 AS (SELECT DISTINCT i + a AS i, j + b AS j FROM r1, sh),
stored AS (SELECT CAST(r2.i AS INT) AS i, CAST(r2.j AS INT) AS j, d.i IS NOT NULL AS is_active FROM r2 LEFT JOIN disc d ON d.i = r2.i AND d.j = r2.j WHERE r2.i BETWEEN 0 AND 63 AND r2.j BETWEEN 0 AND 63)"""
add("m3_ring_dilation", lambda s, d: mesh.dilate(disc(s, d), 64, 64), f"WITH {fx.CELL}, {_RINGS} SELECT i, j, is_active FROM stored")
add("m4_delta_encoding", lambda s, d: mesh.deltas(mesh.neighbours(numbered(s, d))), f"WITH {fx.CELL}, {_NUM}, {_NEAR} SELECT k, {', '.join(f'CAST(coalesce(k{x} - k, -32768) AS INT) AS d{x}' for x in 'ewns')} FROM nb")
add("m5_coverage", lambda s, d: mesh.uncovered(mesh.dilate(disc(s, d), 64, 64, 1), 64, 64), f"WITH {fx.CELL}, {_RINGS} SELECT i, j FROM stored s WHERE NOT EXISTS (SELECT 1 FROM r1 WHERE r1.i = s.i AND r1.j = s.j)")
add("m6_regular_cells", lambda s, d: mesh.regular(mesh.neighbours(numbered(s, d))).groupBy("stride", "regular").agg(F.count("*").alias("n")),
    f"WITH {fx.CELL}, {_NUM}, {_NEAR}, st AS (SELECT ke - k AS stride FROM nb WHERE ke IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT stride, coalesce(ke - k = stride AND kn - k = 1, FALSE) AS regular, count(*) AS n FROM nb, st GROUP BY ALL")
add("m8_memory_summary", lambda s, d: mesh.memory_summary(mesh.dilate(disc(s, d), 64, 64), 64, 64), f"WITH {fx.CELL}, {_RINGS} SELECT count(*) AS n_stored, count(*) FILTER (is_active) AS n_active, count(*) * 80 AS bytes, CAST(327680 AS BIGINT) AS dense_bytes, count(*) / {D(4096)} AS share FROM stored")
add("m9_compressed_fields", lambda s, d: mesh.pack(fx.cell(s, d), mesh.number(mesh.dilate(disc(s, d), 64, 64), "i", "j")).select("k", "h", "b"), f"WITH {fx.CELL}, {_RINGS}, num AS (SELECT i, j, row_number() OVER (ORDER BY i, j) - 1 AS k FROM stored) SELECT k, h, b FROM num JOIN cell USING (i, j)")
add("j6_pack_unpack", lambda s, d: mesh.unpack(mesh.pack(fx.cell(s, d), numbered(s, d)), fx.cell(s, d), -1.0, "h"), f"WITH {fx.CELL}, {_DISC} SELECT c.i, c.j, coalesce(d.h, {D(-1)}) AS h FROM cell c LEFT JOIN disc d ON c.i = d.i AND c.j = d.j")
_CUM = "cnt AS (SELECT g.range AS i, count(d.i) AS n FROM range(64) g LEFT JOIN disc d ON d.i = g.range GROUP BY 1), cum AS (SELECT i, sum(n) OVER (ORDER BY i) AS c, sum(n) OVER () AS total FROM cnt)"
add("m10_balanced_columns", lambda s, d: mesh.balanced_columns(disc(s, d), 64, 4),
    f"WITH {fx.CELL}, {_DISC}, {_CUM}, hit AS (SELECT p.part, min(i) AS i0 FROM (VALUES (1), (2), (3)) AS p(part) JOIN cum ON c * 4 >= p.part * total GROUP BY 1) SELECT 0 AS part, 0 AS i_begin UNION ALL SELECT part, CAST(max(i0 + 1 - part) OVER (ORDER BY part) + part AS INT) FROM hit")
add("m11_blocks", lambda s, d: mesh.blocks(fx.cell(s, d), 64, 64, 3, 5).groupBy("bi", "bj").agg(F.count("*").alias("n"), F.min("i").alias("i0"), F.max("j").alias("j1")), f"WITH {fx.CELL} SELECT CAST(i // 22 AS INT) AS bi, CAST(j // 13 AS INT) AS bj, count(*) AS n, min(i) AS i0, max(j) AS j1 FROM cell GROUP BY 1, 2")
add("h1_halo_rows", lambda s, d: mesh.halo_rows(fx.cell(s, d), 64, 4),
    f"WITH {fx.CELL}, x AS (SELECT CASE WHEN i % 16 = 0 THEN i // 16 - 1 ELSE i // 16 + 1 END AS t, i, j, h FROM cell WHERE i % 16 IN (0, 15)) SELECT CAST(t AS INT) AS \"to\", i, j, h FROM x WHERE t BETWEEN 0 AND 3")

# Ghosts around an active set
_PAIRS = """prs AS (SELECT s.i, s.j, CAST(s.i + o.a AS INT) AS pi, CAST(s.j + o.b AS INT) AS pj FROM stored s, (VALUES (0, 1, 0), (1, -1, 0), (2, 0, 1), (3, 0, -1)) AS o(n, a, b) JOIN stored p ON p.i = s.i + o.a AND p.j = s.j + o.b AND p.is_active
  WHERE NOT s.is_active QUALIFY row_number() OVER (PARTITION BY s.i, s.j ORDER BY o.n) = 1)"""


def stored(s, d):
    return mesh.dilate(disc(s, d), 64, 64).join(fx.cell(s, d).select("i", "j", "h", "hu", "hv", "b"), ["i", "j"])


add("b13_ghost_pairs", lambda s, d: boundary.ghost_pairs(stored(s, d)), f"WITH {fx.CELL}, {_RINGS}, {_PAIRS} SELECT i, j, pi, pj FROM prs")
for _mode in ("off", "extrapolate", "stage", "stage_uv", "hybrid", "auto"):
    _st = f"greatest({D(0.6)} - b, {D(0)})"
    _sc = f"(CASE WHEN nh > 1e-10 THEN {_st} / nh ELSE {D(0)} END)"
    _h = {"off": D(0), "extrapolate": "nh", "stage": _st, "auto": _st, "stage_uv": _st, "hybrid": f"CASE WHEN nh + nb < 0.6 THEN {_st} ELSE nh END"}[_mode]
    _m = [{"off": D(0), "extrapolate": c, "stage": D(0), "auto": D(0), "stage_uv": f"{c} * {_sc}", "hybrid": f"CASE WHEN nh + nb < 0.6 THEN {D(0)} ELSE {c} END"}[_mode] for c in ("nu", "nv")]
    add(f"b{14 if _mode == 'stage_uv' else 12}_ring_{_mode}", lambda s, d, m=_mode: shown(boundary.ghost_state(stored(s, d), boundary.ghost_pairs(stored(s, d)), m, 0.6), "h", "hu", "hv", keys=("i", "j")),
        f"WITH {fx.CELL}, {_RINGS}, {_PAIRS}, x AS (SELECT prs.i, prs.j, g.b, c.h AS nh, c.hu AS nu, c.hv AS nv, c.b AS nb FROM prs JOIN cell g ON g.i = prs.i AND g.j = prs.j JOIN cell c ON c.i = prs.pi AND c.j = prs.pj), y AS (SELECT i, j, {_h} AS h, {_m[0]} AS hu, {_m[1]} AS hv FROM x) SELECT i, j, {', '.join(rounded('h', 'hu', 'hv'))} FROM y")


# rasters
def tiles(s, d, k: int):
    """Two overlapping tiles with gaps; layer 1 is land."""
    c = fx.cell(s, d).select("i", "j", "b")
    one = c.where("i < 40").select("i", "j", F.lit(0).alias("seq"), F.when((F.col("i") * F.col("j")) % 11 == 0, raster.NODATA).otherwise(F.col("b") - (2.0 if k == 0 else 0.5)).alias("z"))
    two = c.where("i >= 24").select("i", "j", F.lit(1).alias("seq"), F.when((F.col("i") + F.col("j")) % 13 == 0, raster.NODATA).otherwise(F.col("b") - (1.0 if k == 0 else 0.25)).alias("z"))
    return one.unionByName(two)


def _tiles(k: int) -> str:
    a, b = (2.0, 1.0) if k == 0 else (0.5, 0.25)
    return f"tl{k} AS (SELECT i, j, 0 AS seq, CASE WHEN (i * j) % 11 = 0 THEN {D(-9999)} ELSE b - {D(a)} END AS z FROM cell WHERE i < 40 UNION ALL SELECT i, j, 1, CASE WHEN (i + j) % 13 = 0 THEN {D(-9999)} ELSE b - {D(b)} END FROM cell WHERE i >= 24), ml{k} AS (SELECT i, j, min_by(z, seq) AS z FROM tl{k} WHERE z <> -9999 GROUP BY 1, 2)"


add("d1_merge_layers", lambda s, d: raster.merge_layers(tiles(s, d, 0), tiles(s, d, 1).where("i + j > 20")), f"WITH {fx.CELL}, {_tiles(0)}, {_tiles(1).replace('WHERE z <> -9999', 'WHERE z <> -9999 AND i + j > 20')} SELECT coalesce(a.i, b.i) AS i, coalesce(a.j, b.j) AS j, CASE WHEN b.z > 0 THEN b.z ELSE coalesce(a.z, b.z) END AS z FROM ml0 a FULL JOIN ml1 b ON a.i = b.i AND a.j = b.j")


def dem(s, d):
    return fx.cell(s, d).select("i", "j", F.when((F.col("i") * F.col("j")) % 11 == 0, raster.NODATA).when(F.col("n") % 9 == 0, F.col("b") + 20.0).when(F.col("n") % 9 == 1, 0.0005).otherwise(F.col("b")).alias("z"))


_DEM = f"dem AS (SELECT i, j, CASE WHEN (i * j) % 11 = 0 THEN {D(-9999)} WHEN n % 9 = 0 THEN b + {D(20)} WHEN n % 9 = 1 THEN {D(0.0005)} ELSE b END AS z FROM cell)"
add("d2_near_zero", lambda s, d: raster.demote_near_zero(dem(s, d)), f"WITH {fx.CELL}, {_DEM} SELECT i, j, coalesce(abs(z) < 0.001 AND z <> 0, FALSE) AS demoted, CASE WHEN abs(z) < 0.001 AND z <> 0 THEN {D(-9999)} ELSE z END AS z FROM dem")
add("d3_clean_dem", lambda s, d: raster.clean_dem(dem(s, d), 64, 64, passes=1, bounds=(-100.0, 1.0))[0],
    f"WITH {fx.CELL}, {_DEM}, ok AS (SELECT i, j, CASE WHEN abs(z) < 0.001 AND z <> 0 THEN {D(-9999)} ELSE z END AS z FROM dem), vd AS (SELECT * FROM ok WHERE z <> -9999), gp AS (SELECT i, j FROM ok WHERE z = -9999), "
    "nr AS (SELECT gp.i, gp.j, vd.z FROM gp JOIN vd ON abs(vd.i - gp.i) <= 9 AND abs(vd.j - gp.j) <= 9 QUALIFY row_number() OVER (PARTITION BY gp.i, gp.j ORDER BY (vd.i - gp.i) * (vd.i - gp.i) + (vd.j - gp.j) * (vd.j - gp.j), vd.i, vd.j) = 1), "
    "fl AS (SELECT * FROM vd UNION ALL SELECT * FROM nr), md AS (SELECT a.i, a.j, list_sort(list(z.z))[5] AS med, any_value(a.z) AS z FROM fl a, (VALUES (-1), (0), (1)) AS x(dx), (VALUES (-1), (0), (1)) AS y(dy) JOIN fl z ON z.i = least(greatest(a.i + dx, 0), 63) AND z.j = least(greatest(a.j + dy, 0), 63) GROUP BY 1, 2) "
    f"SELECT i, j, least(greatest(CASE WHEN abs(z - med) > 8 THEN med ELSE z END, {D(-100)}), {D(1)}) AS z FROM md")
_MED = "med AS (SELECT a.i, a.j, list_sort(list(z.z))[5] AS med, any_value(a.z) AS z FROM dem a, (VALUES (-1), (0), (1)) AS x(dx), (VALUES (-1), (0), (1)) AS y(dy) JOIN dem z ON z.i = least(greatest(a.i + dx, 0), 63) AND z.j = least(greatest(a.j + dy, 0), 63) GROUP BY 1, 2)"
add("d3_despike", lambda s, d: raster.clip(raster.despike(dem(s, d), 64, 64), -100.0, 10.0), f"WITH {fx.CELL}, {_DEM}, {_MED}, cl AS (SELECT i, j, CASE WHEN abs(z - med) > 8 THEN med ELSE z END AS z FROM med) SELECT i, j, z < -100 OR z > 10 AS clipped, least(greatest(z, {D(-100)}), {D(10)}) AS z FROM cl")
add("d4_infill_nearest", lambda s, d: raster.infill_nearest(dem(s, d)), f"WITH {fx.CELL}, {_DEM}, good AS (SELECT * FROM dem WHERE z <> -9999), gap AS (SELECT * FROM dem WHERE z = -9999), near AS (SELECT gap.i, gap.j, good.z FROM gap JOIN good ON abs(good.i - gap.i) <= 9 AND abs(good.j - gap.j) <= 9 QUALIFY row_number() OVER (PARTITION BY gap.i, gap.j ORDER BY (good.i - gap.i) * (good.i - gap.i) + (good.j - gap.j) * (good.j - gap.j), good.i, good.j) = 1) SELECT i, j, z FROM good UNION ALL SELECT i, j, z FROM near")


def landcover(s):
    """Known codes by place, with gaps 0 and 16, and values just off a code."""
    codes = F.array(*[F.lit(c) for c in [*sorted(raster.MANNING), 0, 16]])
    return s.range(4096).select((F.col("id") / 64).cast("int").alias("i"), (F.col("id") % 64).cast("int").alias("j"), F.element_at(codes, ((F.floor(F.col("id") / 64) * 3 + F.col("id") % 64 * 7) % 22 + 1).cast("int")).alias("code"))


#: Fixed values, written out for the twins: they must not follow the library's table.
_CODES = "11, 12, 21, 22, 23, 24, 31, 41, 42, 43, 51, 52, 71, 72, 73, 74, 81, 82, 90, 95"
_ROUGH = "(11, 0.025), (12, 0.022), (21, 0.06), (22, 0.1), (23, 0.12), (24, 0.15), (31, 0.022), (41, 0.12), (42, 0.14), (43, 0.13), (51, 0.08), (52, 0.08), (71, 0.04), (72, 0.04), (73, 0.04), (74, 0.04), (81, 0.035), (82, 0.04), (90, 0.11), (95, 0.08)"
_LC = f"lc AS (SELECT CAST(range // 64 AS INT) AS i, CAST(range % 64 AS INT) AS j, ([{_CODES}, 0, 16])[((range // 64) * 3 + (range % 64) * 7) % 22 + 1] AS code FROM range(4096)), mt AS (SELECT c, CAST(m AS DOUBLE) AS m FROM (VALUES {_ROUGH}) AS v(c, m))"
add("d6_manning_table", lambda s, d: s.createDataFrame(list(raster.MANNING.items()), "code int, m double"), f"WITH {_LC} SELECT c AS code, m FROM mt")
add("d7_landcover_bands", lambda s, d: raster.landcover_bands(landcover(s).select("i", "j", (F.col("code") + (F.col("i") % 5 - 2) * F.lit(0.25)).alias("code")), s),
    f"WITH {_LC}, x AS (SELECT i, j, code + (i % 5 - 2) * {D(0.25)} AS code FROM lc), b AS (SELECT i, j, max_by(m, c) AS m FROM x JOIN mt ON abs(code - c) <= 0.5 GROUP BY 1, 2) SELECT x.i, x.j, coalesce(m, {D(0.035)}) AS nm, m IS NOT NULL AS mapped FROM x LEFT JOIN b ON x.i = b.i AND x.j = b.j")
add("d7_commonest_unmapped", lambda s, d: raster.commonest_unmapped(landcover(s), s), f"WITH {_LC} SELECT code, count(*) AS n FROM lc WHERE code NOT IN (SELECT c FROM mt) GROUP BY 1 ORDER BY n DESC, code LIMIT 6")
add("d8_landcover_exact", lambda s, d: raster.landcover_exact(landcover(s), s), f"WITH {_LC} SELECT i, j, coalesce(m, {D(0.035)}) AS nm FROM lc LEFT JOIN mt ON code = c")
add("j10_set_manning", lambda s, d: mesh.encode(raster.landcover_exact(landcover(s), s), "nm")[0].select("i", "j", "nm", "cls"), f"WITH {_LC}, x AS (SELECT i, j, coalesce(m, {D(0.035)}) AS nm FROM lc LEFT JOIN mt ON code = c) SELECT i, j, nm, CAST(dense_rank() OVER (ORDER BY nm) - 1 AS INT) AS cls FROM x")
add("d9_coastline", lambda s, d: raster.coastline(dem(s, d).withColumn("z", F.col("z") - 1.0), 64, 64, 2.0, 7.0, 0.5, ("w", "n")), f"WITH {fx.CELL}, {_DEM} SELECT i, j FROM dem WHERE (i < 3 OR j >= 61) AND z - 1 < -0.5")
_GW = raster.gaussian_weights(2.0)
_REF = "CASE WHEN {t} < 0 THEN -1 - ({t}) WHEN {t} > 63 THEN 127 - ({t}) ELSE {t} END"
_GAUSS = f"gw(k, w) AS (VALUES {', '.join(f'({k}, {D(repr(w))})' for k, w in zip(range(-8, 9), _GW))}), gx AS (SELECT c.i, c.j, c.b, sum(s.b * w) AS s FROM cell c CROSS JOIN gw JOIN cell s ON s.j = c.j AND s.i = {_REF.format(t='c.i + gw.k')} GROUP BY 1, 2, 3), gy AS (SELECT c.i, c.j, c.b, sum(s.s * w) AS s FROM gx c CROSS JOIN gw JOIN gx s ON s.i = c.i AND s.j = {_REF.format(t='c.j + gw.k')} GROUP BY 1, 2, 3)"
add("d10_smooth", lambda s, d: shown(raster.smooth(fx.cell(s, d).select("i", "j", F.col("b").alias("z")), 64, 64, 2.0, 0.2, 1.0), "z", keys=("i", "j")), f"WITH {fx.CELL}, {_GAUSS}, x AS (SELECT i, j, CASE WHEN b > 0.2 AND b < 1.0 THEN s ELSE b END AS z FROM gy) SELECT i, j, {rounded('z')[0]} FROM x")
add("d11_burn_channels", lambda s, d: raster.burn_channels(fx.cell(s, d).select("i", "j", F.col("b").alias("z")), fx.cell(s, d).where("(i + j) % 4 = 0").select("i", "j", F.when(F.col("i") % 8 == 0, F.col("b") - 0.75).alias("fine")), 0.5, 0.1, 1.0),
    f"WITH {fx.CELL}, x AS (SELECT i, j, b, (i + j) % 4 = 0 AND b < 1.0 AS eligible, CASE WHEN (i + j) % 4 = 0 AND i % 8 = 0 THEN b - {D(0.75)} END AS fine FROM cell), y AS (SELECT *, CASE WHEN eligible THEN least(b, greatest(b - {D(0.5)}, {D(0.1)})) ELSE b END AS z0 FROM x) SELECT i, j, CASE WHEN fine IS NOT NULL THEN least(z0, fine) ELSE z0 END AS z, eligible FROM y")
add("d16_upsample", lambda s, d: raster.upsample(fx.cell(s, d).select("i", "j", F.col("b").alias("z")), s.range(192 * 192).select((F.col("id") / 192).cast("int").alias("i"), (F.col("id") % 192).cast("int").alias("j")), 0.3),
    f"WITH {fx.CELL}, f AS (SELECT CAST(range // 192 AS INT) AS i, CAST(range % 192 AS INT) AS j FROM range(36864)) SELECT f.i, f.j, c.b AS z FROM f JOIN cell c ON c.i = CAST(floor((f.i + {D(0.5)}) * {D(0.3)}) AS INT) AND c.j = CAST(floor((f.j + {D(0.5)}) * {D(0.3)}) AS INT)")
