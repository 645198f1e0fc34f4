"""Queries on series and case tables: lookups, gauges, inlets, rings, rain frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.functions.program import rounded
from freshet.operators import boundary, measure, raster, temporal
from freshet.plans import fixtures as fx
from freshet.plans.registry import add
from freshet.streaming import gauges

D = lambda x: f"CAST('{x}' AS DOUBLE)"


def shown(df, *names: str, keys=(), digits: int = 9):
    return df.select(*keys, *[F.expr(x) for x in rounded(*names, digits=digits)])


# Lookups as of a time, held and interpolated
_STEP_SQL = """SELECT q, tq, coalesce((SELECT max_by(v, t) FROM {s} WHERE t <= tq), (SELECT min_by(v, t) FROM {s})) AS v FROM asked"""
_LIN = """knots AS (SELECT t AS t0, v AS v0, lead(t) OVER (ORDER BY t) AS t1, lead(v) OVER (ORDER BY t) AS v1 FROM {s}),
ends AS (SELECT min(t) AS ta, min_by(v, t) AS va, max(t) AS tb, max_by(v, t) AS vb FROM {s}),
got AS (SELECT q.*, CASE WHEN tq <= ta THEN va WHEN tq > tb THEN vb ELSE v0 + (tq - t0) / (t1 - t0) * (v1 - v0) END AS v
  FROM {a} q CROSS JOIN ends LEFT JOIN knots ON tq > t0 AND tq <= t1)"""
add("t1_step_lookup", lambda s, d: shown(temporal.asof_step(fx.asked(s, d), fx.series(s, d)), "v", keys=("q", "tq")), f"WITH {fx.SERIES}, {fx.ASKED}, got AS ({_STEP_SQL.format(s='series')}) SELECT q, tq, {rounded('v')[0]} FROM got")
add("t2_linear_lookup", lambda s, d: shown(temporal.asof_linear(fx.asked(s, d), fx.stage(s, d)), "v", keys=("q", "tq")), f"WITH {fx.STAGE}, {fx.ASKED}, {_LIN.format(s='stage', a='asked')} SELECT q, tq, {rounded('v')[0]} FROM got")


def hydrograph(s, d):
    """Purchases a day as m3/s at midnight."""
    day = F.floor(fx.micros() / F.lit(86400000000))
    return fx.table(s, d, "events").where("event_type = 'purchase'").groupBy(day.alias("dd")).agg(F.count("*").alias("n")).select((F.col("dd") * F.lit(86400.0)).alias("t"), F.col("n").cast("double").alias("v"))


_HYDRO = f"hydro AS (SELECT floor((epoch_us(ts) - 1704067200000000) / {D(86400000000)}) * {D(86400)} AS t, CAST(count(*) AS DOUBLE) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1)"
add("t3_hydrograph", lambda s, d: shown(temporal.asof_linear(fx.asked(s, d), hydrograph(s, d), 86400.0), "v", keys=("q",)), f"WITH {_HYDRO}, {fx.ASKED}, {_LIN.format(s='hydro', a='asked')} SELECT q, {rounded('v')[0]} FROM got")
_GRID = f"grid AS (SELECT range AS k, {D(-86400.0)} + range * {D(360.0)} AS tq FROM range(1200))"
add("t4_common_grid", lambda s, d: shown(temporal.regrid(fx.stage(s, d), -86400.0, 345600.0, 360.0), "v", keys=("k", "tq")), f"WITH {fx.STAGE}, {_GRID}, {_LIN.format(s='stage', a='grid')} SELECT k, tq, {rounded('v')[0]} FROM got")


def shuffled(s, d):
    """Stage rows with a scattered order of arrival, so that time goes back and forth."""
    us = fx.micros()
    return fx.table(s, d, "events").select((F.col("event_id") * 1103515245 % 2147483647).alias("seq"), F.floor(us / F.lit(3600000000)).cast("double").alias("t"), F.col("value").alias("v"))


_SHUF = f"shuf AS (SELECT event_id * 1103515245 % 2147483647 AS seq, CAST(floor((epoch_us(ts) - 1704067200000000) / {D(3600000000)}) AS DOUBLE) AS t, value AS v FROM events)"
add("t5_out_of_order", lambda s, d: temporal.out_of_order(shuffled(s, d)).select("seq", "t"), f"WITH {_SHUF}, p AS (SELECT *, lag(t) OVER (ORDER BY seq) AS pt FROM shuf) SELECT seq, t FROM p WHERE pt > t")
add("t6_stable_sort", lambda s, d: temporal.stable_sort(shuffled(s, d)).select("seq", "t"), f"WITH {_SHUF} SELECT seq, t FROM shuf ORDER BY t, seq")
add("s4_keep_last", lambda s, d: shown(temporal.keep_last(shuffled(s, d)), "v", keys=("t",)), f"WITH {_SHUF}, k AS (SELECT t, max_by(v, seq) AS v FROM shuf GROUP BY t) SELECT t, {rounded('v')[0]} FROM k")


def native_rain(s, d):
    """(t, pix, rate): events by six hours and user."""
    us = fx.micros()
    return fx.table(s, d, "events").groupBy((F.floor(us / F.lit(21600000000)) * F.lit(21600.0)).alias("t"), (F.col("user_id") % 64).cast("int").alias("pix")).agg(F.count("*").cast("double").alias("rate"))


def lookup(s):
    return s.range(4096).select((F.col("id") / 64).cast("int").alias("i"), (F.col("id") % 64).cast("int").alias("j"), (F.floor(F.col("id") / 512) * 8 + F.floor(F.col("id") % 64 / 8)).cast("int").alias("pix"))


_RAIN = f"rain AS (SELECT floor((epoch_us(ts) - 1704067200000000) / {D(21600000000)}) * {D(21600)} AS t, CAST(user_id % 64 AS INT) AS pix, CAST(count(*) AS DOUBLE) AS rate FROM events GROUP BY 1, 2)"
_LOOK = "look AS (SELECT CAST(range // 64 AS INT) AS i, CAST(range % 64 AS INT) AS j, CAST((range // 512) * 8 + (range % 64) // 8 AS INT) AS pix FROM range(4096))"
add(
    "t7_native_rain", lambda s, d: temporal.gather_rain(lookup(s).select("i", "j"), lookup(s), native_rain(s, d), 100000.0),
    f"WITH {_RAIN}, {_LOOK}, fr AS (SELECT max(t) AS t FROM rain WHERE t <= 100000), now AS (SELECT rain.* FROM rain JOIN fr ON rain.t = fr.t) SELECT i, j, coalesce(rate, {D(0)}) AS rate FROM look LEFT JOIN now USING (pix)",
)
add("j4_rain_lookup", lambda s, d: lookup(s).join(native_rain(s, d).where("t = 0"), "pix").select("i", "j", "rate"), f"WITH {_RAIN}, {_LOOK} SELECT i, j, rate FROM look JOIN rain USING (pix) WHERE t = 0")
add("s20_rain_rows", lambda s, d: native_rain(s, d).where("t between 21600 and 43200").select("t", "pix", "rate"), f"WITH {_RAIN} SELECT t, pix, rate FROM rain WHERE t BETWEEN 21600 AND 43200")
add("t8_ring_blend", lambda s, d: shown(temporal.asof_linear(fx.asked(s, d).where("tq >= 0"), temporal.regrid(fx.stage(s, d), 0.0, 172800.0, 360.0).select(F.col("tq").alias("t"), "v"), 360.0), "v", keys=("q",)),
    f"WITH {fx.STAGE}, grid AS (SELECT range AS k, range * {D(360)} AS tq FROM range(480)), {_LIN.format(s='stage', a='grid')}, tab AS (SELECT tq AS t, v FROM got), {fx.ASKED}, late AS (SELECT * FROM asked WHERE tq >= 0), "
    + _LIN.format(s="tab", a="late").replace("knots AS", "knots2 AS").replace("ends AS", "ends2 AS").replace("got AS", "got2 AS").replace("JOIN ends ", "JOIN ends2 ").replace("JOIN knots ON", "JOIN knots2 ON") + f" SELECT q, {rounded('v')[0]} FROM got2")
add("t9_datum_guard", lambda s, d: fx.stage(s, d).agg(F.count_if(F.abs("v") > 15).alias("n_over"), F.max(F.abs("v")).alias("top")), f"WITH {fx.STAGE} SELECT count(*) FILTER (abs(v) > 15) AS n_over, max(abs(v)) AS top FROM stage")
add("t10_constant_series", lambda s, d: temporal.asof_step(fx.asked(s, d), temporal.constant_series(s, 12.5)).select("q", "v"), f"WITH {fx.ASKED} SELECT q, {D(12.5)} AS v FROM asked")

# gauges
_IN = "cells AS (SELECT g, CAST(floor(x / 1.0) AS INT) AS i, CAST(floor(y / 1.0) AS INT) AS j FROM gauges), placed AS (SELECT *, i BETWEEN 0 AND 63 AND j BETWEEN 0 AND 63 AS inside FROM cells)"
add("j5_gauge_cells", lambda s, d: measure.gauge_cells(fx.gauge_places(s, d), 64, 64, 1.0), f"WITH {fx.GAUGES}, {_IN} SELECT g, i, j, inside FROM placed")
add("a1_gauge_sample", lambda s, d: shown(measure.sample(fx.cell(s, d), measure.gauge_cells(fx.gauge_places(s, d), 64, 64, 1.0).where("inside")), "h", "u", "v", "eta", keys=("g",)),
    f"WITH {fx.CELL}, {fx.GAUGES}, {_IN}, x AS (SELECT g, h, CASE WHEN h > 1e-12 THEN hu / h ELSE {D(0)} END AS u, CASE WHEN h > 1e-12 THEN hv / h ELSE {D(0)} END AS v, h + b AS eta FROM placed p JOIN cell c ON p.i = c.i AND p.j = c.j WHERE inside) SELECT g, {', '.join(rounded('h', 'u', 'v', 'eta'))} FROM x")
add("a2_cadence", lambda s, d: measure.cadence(fx.stage(s, d), 86400.0).select("t"), f"WITH {fx.STAGE} SELECT t FROM stage QUALIFY row_number() OVER (PARTITION BY floor((t + 1e-12) / 86400.0) ORDER BY t) = 1")


def pixels(s):
    return s.range(44).select((F.col("id") / 11).cast("int").alias("g"), (F.floor(F.col("id") / 11) * 8).cast("int").alias("i"), (F.col("id") % 11 + 10).cast("int").alias("j"), (F.lit(0.25) * (F.floor(F.col("id") / 11))).alias("bed_mean"))


_PIX = f"pix AS (SELECT CAST(range // 11 AS INT) AS g, CAST((range // 11) * 8 AS INT) AS i, CAST(range % 11 + 10 AS INT) AS j, {D(0.25)} * (range // 11) AS bed_mean FROM range(44))"
add("a3_cross_sections", lambda s, d: shown(measure.cross_sections(fx.cell(s, d), pixels(s), 2.0), "h_max", "h_mean", "wse", "q", keys=("g", "n"), digits=8),
    f"WITH {fx.CELL}, {_PIX}, x AS (SELECT g, count(*) AS n, max(h) AS h_max, avg(h) AS h_mean, max(h) + max(bed_mean) AS wse, sum(sqrt(hu * hu + hv * hv)) * {D(2)} AS q FROM cell JOIN pix USING (i, j) GROUP BY g) SELECT g, n, {', '.join(rounded('h_max', 'h_mean', 'wse', 'q', digits=8))} FROM x")


# Inlets, stage cells, rings
def inlets(s):
    return s.createDataFrame([(0, 50.0, 10.0, 1, 0), (1, 30.0, 10.0, 0, 1), (2, 70.0, 10.0, -1, 0)], "inlet int, q double, ds double, nx int, ny int")


def inlet_cells(s):
    return s.range(30).select((F.col("id") / 10).cast("int").alias("inlet"), F.when(F.col("id") < 10, 0).when(F.col("id") < 20, F.col("id")).otherwise(63).cast("int").alias("i"), F.when(F.col("id") < 10, F.col("id") + 20).when(F.col("id") < 20, 0).otherwise(F.col("id") + 10).cast("int").alias("j"))


def inlet_grid(s, d):
    """The first inlet as it is, the second dry over relief, the third dry and flat."""
    c = fx.cell(s, d).select("i", "j", "b", "h", "hu", "hv")
    return c.withColumns({"h": F.when(F.col("j") == 0, 0.0).when(F.col("i") == 63, 0.0).otherwise(F.col("h")), "b": F.when(F.col("i") == 63, 0.5).otherwise(F.col("b"))})


_INLET = f"""ic AS (SELECT CAST(range // 10 AS INT) AS inlet, CAST(CASE WHEN range < 10 THEN 0 WHEN range < 20 THEN range ELSE 63 END AS INT) AS i, CAST(CASE WHEN range < 10 THEN range + 20 WHEN range < 20 THEN 0 ELSE range + 10 END AS INT) AS j FROM range(30)),
il(inlet, q, ds, nx, ny) AS (VALUES (0, {D(50)}, {D(10)}, 1, 0), (1, {D(30)}, {D(10)}, 0, 1), (2, {D(70)}, {D(10)}, -1, 0)),
g AS (SELECT i, j, CASE WHEN i = 63 THEN {D(0.5)} ELSE b END AS b, CASE WHEN j = 0 OR i = 63 THEN {D(0)} ELSE h END AS h FROM cell),
c AS (SELECT ic.inlet, ic.i, ic.j, h, b FROM ic JOIN g USING (i, j)),
st AS (SELECT inlet, sum(h) AS hs, min(b) AS z0, max(b) AS z1 FROM c GROUP BY inlet),
lo AS (SELECT inlet, count(*) AS nl FROM c JOIN st USING (inlet) WHERE b <= z0 GROUP BY inlet),
x AS (SELECT *, greatest(z0 + {D(0.1)} * (z1 - z0) - b, {D(0)}) AS seed, abs(q) / (nl * ds) AS qc FROM c JOIN st USING (inlet) JOIN lo USING (inlet) JOIN il USING (inlet)),
y AS (SELECT *, CASE WHEN hs > 0 THEN h WHEN {D(0.1)} * (z1 - z0) <= 0 THEN seed + power(qc * qc / {D(9.80665)}, {D(1)} / {D(3)}) ELSE seed END AS hf,
  CASE WHEN hs > 0 THEN h / hs WHEN b <= z0 THEN {D(1)} / nl ELSE {D(0)} END AS w FROM x),
z AS (SELECT inlet, CAST(i - k * nx AS INT) AS i, CAST(j - k * ny AS INT) AS j, hf AS h, q / ds * w * nx AS hu, q / ds * w * ny AS hv FROM y, (VALUES (1), (2)) AS gh(k))"""
add("b9_inlets", lambda s, d: shown(boundary.inlet_ghosts(inlet_grid(s, d), inlet_cells(s), inlets(s), 2), "h", "hu", "hv", keys=("inlet", "i", "j")), f"WITH {fx.CELL}, {_INLET} SELECT inlet, i, j, {', '.join(rounded('h', 'hu', 'hv'))} FROM z")
add("b10_stage_cells", lambda s, d: shown(boundary.apply_stage(fx.cell(s, d), s.range(64).select(F.lit(0).alias("i"), F.col("id").cast("int").alias("j")), 0.9), "h", "hu", "hv", keys=("i", "j")),
    f"WITH {fx.CELL}, x AS (SELECT i, j, CASE WHEN i = 0 THEN greatest({D(0.9)} - b, {D(0)}) ELSE h END AS h, CASE WHEN i = 0 THEN {D(0)} ELSE hu END AS hu, CASE WHEN i = 0 THEN {D(0)} ELSE hv END AS hv FROM cell) SELECT i, j, {', '.join(rounded('h', 'hu', 'hv'))} FROM x")


def disc(s, d):
    return fx.cell(s, d).where("(i - 32) * (i - 32) + (j - 32) * (j - 32) <= 676")


_DISC = "disc AS (SELECT * FROM cell WHERE (i - 32) * (i - 32) + (j - 32) * (j - 32) <= 676)"
_RING = """ring AS (SELECT i, j, b FROM disc a WHERE (SELECT count(*) FROM disc z WHERE (z.i = a.i AND abs(z.j - a.j) = 1) OR (z.j = a.j AND abs(z.i - a.i) = 1)) < 4)"""
_IDW = f"raww AS (SELECT r.i, r.j, g AS gauge, {D(1)} / greatest(power((r.i + {D(0.5)}) * {D(1)} - x, 2) + power((r.j + {D(0.5)}) * {D(1)} - y, 2), {D(1)}) AS raw FROM ring r CROSS JOIN gauges), wts AS (SELECT i, j, gauge, raw / sum(raw) OVER (PARTITION BY i, j) AS w FROM raww)"
add("d15_idw_weights", lambda s, d: shown(boundary.idw_weights(boundary.ring_cells(disc(s, d), 64, 64), fx.gauge_places(s, d), 1.0), "w", keys=("i", "j", "gauge")), f"WITH {fx.CELL}, {_DISC}, {_RING}, {fx.GAUGES}, {_IDW} SELECT i, j, gauge, {rounded('w')[0]} FROM wts")


def _ring_eta(s, d):
    ring = boundary.ring_cells(disc(s, d), 64, 64).join(fx.cell(s, d).select("i", "j", F.col("b").alias("bed")), ["i", "j"])
    stage = fx.gauge_places(s, d).select(F.col("g").alias("gauge"), (F.lit(0.5) + F.lit(0.05) * F.col("g")).alias("eta"))
    return shown(boundary.ring_stage(ring, boundary.idw_weights(ring, fx.gauge_places(s, d), 1.0), stage), "eta", "h", keys=("i", "j"))


add("b11_gauge_ring", _ring_eta, f"WITH {fx.CELL}, {_DISC}, {_RING}, {fx.GAUGES}, {_IDW}, e AS (SELECT i, j, sum(w * ({D(0.5)} + {D(0.05)} * gauge)) AS eta FROM wts GROUP BY i, j), x AS (SELECT i, j, eta, greatest({D(0)}, eta - b) AS h FROM e JOIN ring USING (i, j)) SELECT i, j, {', '.join(rounded('eta', 'h'))} FROM x")


# Rain frames
def frames(s, d):
    return native_rain(s, d).select(F.col("t").alias("frame"), "pix", "rate")


def area(s):
    return lookup(s).groupBy("pix").agg(F.count("*").alias("cells"))


_STATS = f"{_RAIN}, {_LOOK}, area AS (SELECT pix, count(*) AS cells FROM look GROUP BY pix), fs AS (SELECT t AS frame, CAST(sum(CASE WHEN rate > 0 THEN cells ELSE 0 END) AS BIGINT) AS wet, sum(CASE WHEN rate > 0 THEN rate * cells ELSE {D(0)} END) AS volume, max(rate) AS peak FROM rain JOIN area USING (pix) GROUP BY t), stats AS (SELECT frame, wet, volume / wet AS mean, peak, volume FROM fs)"
add("d17_rain_frames", lambda s, d: shown(raster.frame_statistics(frames(s, d), area(s)), "mean", "peak", "volume", keys=("frame", "wet")), f"WITH {_STATS} SELECT frame, wet, {', '.join(rounded('mean', 'peak', 'volume'))} FROM stats")
add("d18_best_frame", lambda s, d: shown(raster.best_frame(raster.frame_statistics(frames(s, d), area(s)), 1.5, 4.0), "score", keys=("frame",)),
    f"WITH {_STATS}, sc AS (SELECT frame, abs(mean - {D(1.5)}) / {D(1.5)} + abs(peak - {D(4)}) / {D(4)} AS score FROM stats ORDER BY score, frame LIMIT 1) SELECT frame, {rounded('score')[0]} FROM sc")


# Streams (an addition): first record and peaks of each gauge by day, over the events table as a stream
def _stream(spark, sf_dir: str, made):
    import uuid

    schema = fx.table(spark, sf_dir, "events").schema
    src = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    name = f"stream_{uuid.uuid4().hex}"
    src = src.select((F.col("user_id") % 8).alias("g"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") / 100).alias("h"))
    q = made(src).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


_EV = "g8 AS (SELECT user_id % 8 AS g, ts, value / 100 AS h, CAST(floor(epoch_us(ts) / CAST(86400000000 AS DOUBLE)) AS BIGINT) AS d FROM events)"
_DAY = "CAST(floor(unix_micros(start) / 86400000000D) AS BIGINT) AS d"
add("stream_cadence", lambda s, d: _stream(s, d, lambda x: gauges.cadence(x, "1 day")).select("g", F.expr(_DAY), *[F.expr(e) for e in rounded("h")]), f"WITH {_EV}, f AS (SELECT g, d, min_by(h, ts) AS h FROM g8 GROUP BY 1, 2) SELECT g, d, {rounded('h')[0]} FROM f")
add("stream_peaks", lambda s, d: _stream(s, d, lambda x: gauges.peaks(x, "1 day")).select("g", F.expr(_DAY), "n", *[F.expr(e) for e in rounded("peak", "mean")]), f"WITH {_EV}, f AS (SELECT g, d, count(*) AS n, max(h) AS peak, avg(h) AS mean FROM g8 GROUP BY 1, 2) SELECT g, d, n, {', '.join(rounded('peak', 'mean'))} FROM f")
