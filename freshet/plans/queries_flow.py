"""Pointwise and stencil queries: fluxes, reconstructions, bed sources, friction, steps."""

from __future__ import annotations

from freshet.functions import flow, stencil
from freshet.functions.program import Chain, Program, rounded, text
from freshet.model import Config
from freshet.operators import ghosts
from freshet.operators.forcings import Forcings, flow_step
from freshet.operators.solver import ShallowWater, window_step
from freshet.plans import fixtures as fx
from freshet.plans.registry import FLAGSHIP, add, pointwise
from pyspark.sql import functions as F

DX, DT, HM = "2.0", "0.0625", "1e-6"
INSIDE = "i BETWEEN 2 AND 61 AND j BETWEEN 2 AND 61"
ROW = "j = 0"

# Primitives, physical fluxes, wave speeds
pointwise("p1_primitives", flow.primitives(), ["u", "v"])
pointwise("p2_flux_x_1d", flow.flux("h", "hu", "hv", "f"), ["f0", "f1"], where=ROW)
pointwise("p3_flux_x_2d", flow.flux("h", "hu", "hv", "f"), ["f0", "f1", "f2"])
pointwise("p4_flux_y_2d", flow.flux("h", "hv", "hu", "f"), ["f0", "f1", "f2"])
pointwise("p5_max_wave_speed_1d", flow.wave_speed_1d(), ["lam"], where=ROW)
pointwise("p6_max_wave_speed_2d", flow.wave_speed_2d(), ["lam"])


def _pair(axis: str):
    m, t = ("hu", "hv") if axis == "x" else ("hv", "hu")
    lines = [f"{s}_{c} = n{axis}({c}, {k})" for s, k in (("L", 0), ("R", 1)) for c in ("h", "hu", "hv")]
    return lines, ("L_h", f"L_{m}", f"L_{t}"), ("R_h", f"R_{m}", f"R_{t}"), f"{'i' if axis == 'x' else 'j'} < 63"


# Riemann fluxes at the faces of each axis
for _axis in "xy":
    _lines, _L, _R, _inside = _pair(_axis)
    pointwise(f"p7_lf_{_axis}", _lines + flow.lax_friedrichs(_L, _R, "f", HM), ["f0", "f1", "f2"], where=_inside)
    pointwise(f"p{9 if _axis == 'x' else 10}_hllc_{_axis}", _lines + flow.hllc(_L, _R, "f", HM), ["f0", "f1", "f2"], where=_inside)
    if _axis == "x":
        pointwise("p8_wave_speeds", _lines + flow.speeds(_L, _R, "f", HM), ["f_SL", "f_SR"], where=_inside)

# Reconstructions on both axes
for _k, _scheme in enumerate(("first", "muscl", "linear2", "linear3", "linear5", "weno5"), 1):
    _w = stencil.WIDTH[_scheme]
    pointwise(
        f"r{_k}_{_scheme}", [x for a in "xy" for x in stencil.reconstruct("h", _scheme, a, f"{a}l", f"{a}r")], ["xl", "xr", "yl", "yr"],
        where=f"i BETWEEN {_w - 1} AND {63 - _w} AND j BETWEEN {_w - 1} AND {63 - _w}",
    )

# Well-balanced face states, sources and bed gradients
_ax, _axL, _axR = stencil.face_audusse("x", "x", HM)
_ay, _ayL, _ayR = stencil.face_audusse("y", "y", HM)
_sx, _sxL, _sxR = stencil.face_srm("x", "x", DX, HM)
_sy, _syL, _syR = stencil.face_srm("y", "y", DX, HM)


def _audusse_source(axis: str) -> list[str]:
    own, nxt = stencil.source_audusse(DX, axis)
    return [f"{axis}so = {own}", f"{axis}sn = {nxt}", f"s{axis} = n{axis}({axis}sn, -1) - {axis}so"]


def _srm_source(axis: str) -> list[str]:
    return [*stencil.source_srm(axis, HM), f"s{axis} = (n{axis}({axis}sn, -1) - {axis}so) / {DX}"]


pointwise("w1_audusse_faces_1d", _ax, [*_axL[:2], *_axR[:2], "xzf"], where=f"{ROW} AND i < 63")
pointwise("w2_audusse_source_1d", _ax + _audusse_source("x"), ["sx"], where=f"{ROW} AND i BETWEEN 1 AND 62")
pointwise("w3_audusse_faces_2d", _ax + _ay, [*_axL, *_axR, *_ayL, *_ayR], where="i < 63 AND j < 63")
pointwise("w4_audusse_source_2d", _ax + _ay + _audusse_source("x") + _audusse_source("y"), ["sx", "sy"], where=INSIDE)
pointwise("w5_bed_gradients", stencil.bed_gradient("x", DX, "gx") + stencil.bed_gradient("y", DX, "gy"), ["gx", "gy"])
pointwise("w6_srm_face_axis", _sx, ["xzf", "xzc", "xhl", "xhr"], where="i < 63")
pointwise("w7_srm_faces_2d", _sx + _sy, [*_sxL, *_sxR, *_syL, *_syR], where="i < 63 AND j < 63")
pointwise("w8_srm_cell_source", _sx + stencil.source_srm("x", HM), ["xso", "xsn"], where="i < 63")
pointwise("w9_srm_source_2d", _sx + _sy + _srm_source("x") + _srm_source("y"), ["sx", "sy"], where=INSIDE)
pointwise("w10_srm_1d", _sx + _srm_source("x"), ["xhl", "xlu", "xhr", "xru", "sx"], where=f"{ROW} AND i BETWEEN 1 AND 62")
pointwise("w11_bed_slope", [f"sx = 0.0 - 9.81 * h * (nx(b, 1) - nx(b, -1)) / (2.0 * {DX})", f"sy = 0.0 - 9.81 * h * (ny(b, 1) - ny(b, -1)) / (2.0 * {DX})"], ["sx", "sy"], where="i BETWEEN 1 AND 62 AND j BETWEEN 1 AND 62")
_d = [f"da = (b - nx(b, -1)) / {DX}", f"db = (nx(b, 1) - b) / {DX}"]
pointwise(
    "w12_limited_gradients",
    _d + ["g_minmod = if(da * db <= 0.0, 0.0, if(abs(da) < abs(db), da, db))", "g_vanleer = if(da * db <= 0.0, 0.0, 2.0 * da * db / (da + db))", "g_central = 0.5 * (da + db)"],
    ["g_central", "g_minmod", "g_vanleer"], where="i BETWEEN 1 AND 62",
)

# Ghost cells of each kind, on all sides and on one
_KINDS = {k: dict(west=k, east=k, south=k, north=k) for k in ghosts.KINDS} | {"mixed": dict(west="wall", east="fall", south="periodic", north="periodic"), "one_face": dict(east="wall")}


def _filled(ngh: int, kinds: dict):
    return lambda spark, sf_dir: ghosts.fill(fx.cell(spark, sf_dir).select("i", "j", "b", "h", "hu", "hv"), fx.N, fx.N, ngh, **kinds)


for _name, _kinds in _KINDS.items():
    _tag = {"extrapolate": "b1", "periodic": "b2", "wall": "b3", "fall": "b4", "mixed": "b7", "one_face": "b8"}[_name]
    _cte = f"{fx.CELL}, padded AS ({ghosts.fill_sql('cell', fx.N, fx.N, 2, **_kinds)})"
    pointwise(f"{_tag}_ghosts_{_name}", ["eta = h + b"], ["b", "h", "hu", "hv", "eta"], source=_filled(2, _kinds), cte=_cte, view="padded")

# Fixed states at the ends of a 1-D grid
_ends = [f"{c}_w = coalesce(nx({c}, -1), {v})" for c, v in (("h", "1.25"), ("hu", "0.5"))] + [f"{c}_e = coalesce(nx({c}, 1), {v})" for c, v in (("h", "0.25"), ("hu", "0.0"))]
pointwise("b5_dirichlet_1d", _ends, ["h_w", "hu_w", "h_e", "hu_e"], where=ROW)

# Friction, infiltration, drainage, limits
_N = ["nm = 0.02 + 0.01 * (n % 5)"]
pointwise("f1_manning_explicit_1d", _N + flow.friction_explicit_1d("nm", DT), ["hu1"], where=ROW)
pointwise("f2_manning_newton_1d", _N + flow.friction_newton("nm", DT, "0.01"), ["hu1"], where=ROW)
pointwise("f3_manning_newton_2d", _N + flow.friction_newton("nm", DT, "0.01", "0.02", cap="0.2"), ["hu1", "hv1"])
pointwise("f4_friction_quadratic", _N + flow.friction_step("nm", DT, cap=None), ["hu1", "hv1"])
pointwise("f5_friction_linearised", _N + flow.friction_step("nm", DT, quadratic=False, cap=None), ["hu1", "hv1"])
pointwise("f6_velocity_cap", _N + flow.friction_step("nm", DT, cap="0.15"), ["hu1", "hv1"])
pointwise("f7_wet_dry", flow.wet_dry("0.2"), ["h1", "hu1", "hv1"])
pointwise("f8_rain_source", ["rain = (n % 50) / 3600000.0", f"h1 = if((i - 32) * (i - 32) + (j - 32) * (j - 32) <= 676, h + {DT} * rain, h)"], ["h1"], digits=12)
_SIG = ["sigma = 0.0005 + 0.1 * (n % 12)", "r = 0.01 * (n % 7 - 3)"]
pointwise("f9_storage_fraction", _SIG + flow.storage_fraction("r", DT), ["h1"])
pointwise("f10_storage_curve", _SIG + flow.storage_curve("r", DT, "0.5", DX, "2.0"), ["h1"])
_GA = ["ks = 0.000001 * (1 + n % 5)", "psi = 0.05 + 0.05 * (n % 3)", "dth = 0.3", "f0 = 0.001 * (n % 4)", "f_max = 0.004 + 0.001 * (n % 2)", "tau = 3600.0 * (n % 3)"]
pointwise("f11_green_ampt", _GA + flow.green_ampt("60.0"), ["f1", "h1", "hu1", "hv1"], digits=12)
pointwise("f12_green_ampt_drain", _GA + flow.green_ampt_drain("60.0"), ["f1", "h1", "hu1", "hv1"], digits=12)
pointwise("f13_linear_reservoir", _GA + flow.reservoir("60.0", land="b > 0.3"), ["h1", "hu1", "hv1"])
pointwise("f14_infiltration", ["rate = 0.0001 * (n % 5)"] + flow.infiltration("rate", "60.0"), ["h1", "hu1", "hv1"], digits=12)
pointwise("f15_target_depth", ["ht = if(n % 3 = 0, 0.05 * (1 + n % 4), NULL)"] + flow.depth_limit("ht"), ["h1", "hu1", "hv1"])
pointwise("f16_stage_clamp", ["hm = if(i % 4 = 0, 0.1 + 0.05 * (j % 5), NULL)"] + flow.depth_limit("hm"), ["h1", "hu1", "hv1"])
pointwise("f17_depth_cap", flow.depth_cap("0.4"), ["h1", "hu1", "hv1"])
add("b15_sponge_bands", lambda spark, sf: Program(flow.sponge_bands(12, 64, 64, "0.8")).apply(fx.cell(spark, sf)).select("i", "j", *[F.expr(x) for x in rounded("h1", "hu1", "hv1", digits=15)]), f"""WITH {fx.CELL},
e AS (SELECT *, (i - 51) / CAST(12 AS DOUBLE) AS x, (j - 51) / CAST(12 AS DOUBLE) AS y, CAST('0.08' AS DOUBLE) AS a FROM cell),
d AS (SELECT *, (1 - CASE WHEN i >= 52 THEN a * x * x ELSE 0 END) * (1 - CASE WHEN j >= 52 THEN a * y * y ELSE 0 END) AS k FROM e),
x AS (SELECT i, j, b, k, CASE WHEN i >= 52 THEN h * k + greatest(CAST('0.8' AS DOUBLE) - b, 0) * (1 - k) ELSE h END AS h, CASE WHEN i >= 52 THEN hu * k ELSE hu END AS hu, CASE WHEN i >= 52 THEN hv * k ELSE hv END AS hv FROM d),
y AS (SELECT i, j, CASE WHEN j >= 52 THEN h * k + greatest(CAST('0.8' AS DOUBLE) - b, 0) * (1 - k) ELSE h END AS h1, CASE WHEN j >= 52 THEN hu * k ELSE hu END AS hu1, CASE WHEN j >= 52 THEN hv * k ELSE hv END AS hv1 FROM x)
SELECT i, j, {', '.join(rounded('h1', 'hu1', 'hv1', digits=15))} FROM y""")
pointwise("b15_sponge", flow.sponge(12, 64, 64, "0.8"), ["h1", "hu1", "hv1"], digits=15)
pointwise("d13_initial_condition", ["h0 = if(b > -0.5 AND b < 0.5, 0.0, if((i - 32) * (i - 32) + (j - 32) * (j - 32) > 676, 0.0, greatest(0.9 - b, 0.0)))"], ["h0"])
pointwise("d14_two_level_start", ["h0 = greatest(if(b < 0.5, 0.75, 1.25) - b, 0.0)"], ["h0"])
pointwise("d12_manning_sanitise", ["raw = if(n % 4 = 0, 0.0, if(n % 4 = 1, 0.0005, 0.01 * (n % 9)))", "nm = if(raw <= 0.001, 0.035, raw)"], ["nm"])
pointwise("a14_state_accessors", ["depth = greatest(h, 0.0)", "wet = h > 1e-6"], ["depth", "hu", "hv"], exact=("wet",))

# Residuals and steps by scheme
_OPTIONS = {
    "srm_hllc": dict(bed="srm"), "srm_lf": dict(bed="srm", riemann="lf"), "audusse_hllc": dict(bed="audusse"), "audusse_lf": dict(bed="audusse", riemann="lf"),
    **{f"{s}_{r}": dict(bed="slope", scheme=s, riemann=r) for s, r in (("first", "hllc"), ("first", "lf"), ("muscl", "hllc"), ("linear2", "lf"), ("linear3", "lf"), ("linear5", "lf"), ("weno5", "lf"))},
}
_PAD = dict(west="wall", east="extrapolate", south="periodic", north="periodic")
_PADDED = f"{fx.CELL}, padded AS ({ghosts.fill_sql('cell', fx.N, fx.N, 4, **_PAD)})"
_GRID = "i BETWEEN 0 AND 63 AND j BETWEEN 0 AND 63"
for _name, _opt in _OPTIONS.items():
    pointwise(f"x2_residual_{_name}", stencil.residual(DX, DX, h_min=HM, **_opt), ["rh", "rhu", "rhv"], where=_GRID, source=_filled(4, _PAD), cte=_PADDED, view="padded")
pointwise("x1_residual_1d_muscl_lf", stencil.residual(DX, None, scheme="muscl", riemann="lf", bed="slope", h_min=HM), ["rh", "rhu"], where="i BETWEEN 2 AND 61 AND j = 0")
pointwise("x3_euler_step", stencil.residual(DX, DX, h_min=HM) + stencil.euler(DT, HM, "0.00001"), ["h1", "hu1", "hv1"], where=_GRID, source=_filled(4, _PAD), cte=_PADDED, view="padded")
pointwise("x5_full_step", stencil.residual(DX, DX, h_min=HM) + stencil.euler(DT, HM) + ["nm = 0.035 + 0.0 * h"] + flow.friction_step("nm", DT, h_min=HM, h="h1", hu="hu1", hv="hv1", out=("hu2", "hv2")) + ["peak = greatest(h, h1)"], ["h1", "hu2", "hv2", "peak"], where=_GRID, source=_filled(4, _PAD), cte=_PADDED, view="padded")
pointwise("x12_velocity_invariants", stencil.velocity_invariants(DX, DX), ["kin"], where="i BETWEEN 1 AND 62 AND j BETWEEN 1 AND 62")
pointwise("x12_sigma_sweep", ["sigma = 0.01 * (n % 7)"] + stencil.velocity_invariants(DX, DX) + stencil.sigma_sweep("0.5", DX, DX, "0.05"), ["sigma1"], where="i BETWEEN 2 AND 61 AND j BETWEEN 2 AND 61")

# Three-stage step of third order, ghosts renewed at each stage
_STAGES = ((0.0, 1.0), (0.75, 0.25), (1.0 / 3.0, 2.0 / 3.0))  # written out for the twin


def _rk3_sql() -> str:
    out, last = fx.CELL, "cell"
    lines = Program(stencil.residual(DX, DX, h_min=HM, bed="audusse"))
    for k, (a, b) in enumerate(_STAGES):
        out += f", pad{k} AS ({ghosts.fill_sql(last, fx.N, fx.N, 4, **_PAD)}), res{k} AS (SELECT * FROM ({lines.sql(f'pad{k}')}) AS z WHERE {_GRID})"
        mix = ", ".join(f"CAST('{a!r}' AS DOUBLE) * s.{c} + CAST('{b!r}' AS DOUBLE) * (r.{c} + CAST('{DT}' AS DOUBLE) * r.{t}) AS {c}" for c, t in (("h", "rh"), ("hu", "rhu"), ("hv", "rhv")))
        out += f", st{k} AS (SELECT r.i, r.j, r.b, {mix} FROM res{k} r JOIN cell s ON r.i = s.i AND r.j = s.j)"
        last = f"st{k}"
    dried = Program(flow.wet_dry(HM)).sql("st2")
    return f"WITH {out}, dry AS (SELECT i, j, h1 AS h, hu1 AS hu, hv1 AS hv FROM ({dried}) AS z) SELECT i, j, {', '.join(rounded('h', 'hu', 'hv'))} FROM dry"


_RK3 = Config(bed="audusse", integrator="ssprk3", boundary=_PAD)
add("x4_ssp_rk3_step", lambda spark, sf: flow_step(fx.cell(spark, sf).select("i", "j", "b", "h", "hu", "hv"), fx.N, fx.N, float(DX), float(DT), _RK3).select("i", "j", *[F.expr(x) for x in rounded("h", "hu", "hv")]), _rk3_sql())

# Two steps, ghosts renewed between them
_TWO = Chain(["i", "j", "b", "h", "hu", "hv"], (stencil.residual(DX, DX, h_min=HM) + stencil.euler(DT, HM), {"h": "h1", "hu": "hu1", "hv": "hv1"}))


def _two_steps(spark, sf_dir: str):
    q = fx.cell(spark, sf_dir).select("i", "j", "b", "h", "hu", "hv")
    for _ in range(2):
        q = _TWO.apply(ghosts.fill(q, fx.N, fx.N, 2, **_PAD)).where(text(_GRID))
    return q.select("i", "j", *[F.expr(x) for x in rounded("h", "hu", "hv")])


def _two_sql() -> str:
    out, last = fx.CELL, "cell"
    for k in range(2):
        out += f", pad{k} AS ({ghosts.fill_sql(last, fx.N, fx.N, 2, **_PAD)}), st{k} AS (SELECT * FROM ({_TWO.sql(f'pad{k}')}) AS z WHERE {_GRID})"
        last = f"st{k}"
    return f"WITH {out} SELECT i, j, {', '.join(rounded('h', 'hu', 'hv'))} FROM st1"


add("x6_two_steps", _two_steps, _two_sql())


def running_peak(spark, sf_dir: str):
    """The largest depth over the start and two steps, carried along as a column."""
    q = fx.cell(spark, sf_dir)
    for _ in range(2):
        q = window_step(q, fx.N, fx.N, float(DX), float(DT), Config(boundary=_PAD))
    return q.select("i", "j", *[F.expr(x) for x in rounded("peak")])


add("x11_running_peak", running_peak, _two_sql().split(" SELECT i, j, round")[0] + f", tops AS (SELECT i, j, h FROM cell UNION ALL SELECT i, j, h FROM st0 UNION ALL SELECT i, j, h FROM st1), top AS (SELECT i, j, max(h) AS peak FROM tops GROUP BY 1, 2) SELECT i, j, {rounded('peak')[0]} FROM top")

# What follows the flow step, in the order of the drivers
_S = {"h": "h1", "hu": "hu1", "hv": "hv1"}
_AFTER = Chain(
    ["i", "j", "n", "b", "h", "hu", "hv", "peak"],
    (["nm = 0.02 + 0.01 * (n % 5)", *flow.friction_step("nm", DT)], {"hu": "hu1", "hv": "hv1"}),
    (["pk = greatest(peak, h)"], {"peak": "pk"}),
    (["rate = 0.0001 * (n % 5)", *flow.infiltration("rate", "60.0")], _S),
    (flow.sponge(12, 64, 64, "0.8"), _S),
    (_GA + flow.green_ampt_drain("60.0"), _S),
    (["hm = if(i % 4 = 0, 0.1 + 0.05 * (j % 5), NULL)", *flow.depth_limit("hm")], _S),
    (["ht = if(n % 3 = 0, 0.05 * (1 + n % 4), NULL)", *flow.depth_limit("ht")], _S),
    (flow.depth_cap("0.4"), _S),
)
add("x7_forcings_in_order", lambda spark, sf: _AFTER.apply(fx.cell(spark, sf).withColumn("peak", F.lit(0.1))).select("i", "j", *[F.expr(x) for x in rounded("h", "hu", "hv", "peak", digits=12)]),
    f"WITH {fx.CELL}, st AS (SELECT *, CAST('0.1' AS DOUBLE) AS peak FROM cell) SELECT i, j, {', '.join(rounded('h', 'hu', 'hv', 'peak', digits=12))} FROM ({_AFTER.sql('st')}) AS q")

# A run with forcings: two steps by the driver's loop, with rain, roughness, sinks and limits that differ by cell
_FORCED = Config(boundary=_PAD)
_COLUMNS = {
    "nm": "0.02 + 0.01 * (n % 5)", "infil": "0.0001 * (n % 5)", "ks": "0.000002 * (1 + n % 3)", "psi": "0.15 + 0.0 * n", "dth": "0.3 + 0.0 * n", "f_max": "0.05 * (n % 4)", "f0": "0.0 * n", "tau": "3600.0 * (n % 2)",
    "h_clamp": "if(i % 4 = 0, 0.1 + 0.05 * (j % 5), NULL)", "h_target": "if(n % 3 = 0, 0.05 * (1 + n % 4), NULL)",
}


def forced_run(spark, sf_dir: str):
    cells = fx.cell(spark, sf_dir)
    cells = cells.select("i", "j", "b", "h", "hu", "hv", *[F.expr(text(x)).alias(c) for c, x in _COLUMNS.items()])
    rain = spark.createDataFrame([(0.0, 36.0), (0.05, 72.0)], "t double, v double")
    stage = spark.createDataFrame([(0.0, 0.5), (1.0, 1.5)], "t double, v double")
    west = cells.where("i = 0").select("i", "j")
    f = Forcings(rain=rain, stage=stage, stage_cells=west, sponge=(12, 0.8), cap=0.6)
    run = ShallowWater(spark, cells, fx.N, fx.N, float(DX), _FORCED, forcings=f)
    for _ in range(2):
        run.step(float(DT))
    return run.cells.select("i", "j", *[F.expr(x) for x in rounded("h", "hu", "hv", "peak", "f0")])


def _forced_sql() -> str:
    """The same two steps in standard SQL, sinks and limits written out by hand."""
    d = "CAST('{}' AS DOUBLE)".format
    out = f"{fx.CELL}, par AS (SELECT i, j, {', '.join(f'{text(x)} AS {c}' for c, x in _COLUMNS.items())} FROM cell), st0 AS (SELECT c.i, c.j, c.b, c.h, c.hu, c.hv, c.h AS peak, p.f0 FROM cell c JOIN par p ON p.i = c.i AND p.j = c.j)"
    lines = Program(stencil.residual(DX, DX, h_min=HM))
    scale = lambda new: f"{new} AS h, CASE WHEN h > {d('1e-10')} THEN hu * ({new}) / h ELSE {d(0)} END AS hu, CASE WHEN h > {d('1e-10')} THEN hv * ({new}) / h ELSE {d(0)} END AS hv"
    for k, (rate, eta) in enumerate((("36", 0.5 + 0.0625), ("72", 0.5 + 0.125))):
        rest = "i, j, b, peak, f0"
        out += f""", pad{k} AS ({ghosts.fill_sql(f'st{k}', fx.N, fx.N, 2, **_PAD)}), res{k} AS (SELECT * FROM ({lines.sql(f'pad{k}')}) AS z WHERE {_GRID}),
eu{k} AS (SELECT r.i, r.j, r.b, s.peak, s.f0, r.h + {d(DT)} * (r.rh + {d(rate)} / {d(3600000)}) AS h, r.hu + {d(DT)} * r.rhu AS hu, r.hv + {d(DT)} * r.rhv AS hv FROM res{k} r JOIN st{k} s ON s.i = r.i AND s.j = r.j),
wd{k} AS (SELECT {rest}, greatest(h, {d(0)}) AS h, CASE WHEN h < {d(HM)} THEN {d(0)} ELSE hu END AS hu, CASE WHEN h < {d(HM)} THEN {d(0)} ELSE hv END AS hv FROM eu{k}),
sp{k} AS (SELECT w.*, p.nm, greatest(h, {d(HM)}) AS hd, sqrt(power(hu / greatest(h, {d(HM)}), 2) + power(hv / greatest(h, {d(HM)}), 2)) AS m FROM wd{k} w JOIN par p ON p.i = w.i AND p.j = w.j),
rn{k} AS (SELECT *, CASE WHEN m > 15 THEN greatest(nm, sqrt(1 / (({d('1e-10')} + {d(DT)}) * {d('9.81')} * power(hd, -{d(4)} / 3) * (m + {d('1e-30')})))) ELSE nm END AS ne FROM sp{k}),
fr{k} AS (SELECT *, 2 / (1 + sqrt(1 + 4 * {d(DT)} * {d('9.81')} * ne * ne * power(hd, -{d(4)} / 3) * m)) AS a FROM rn{k}),
pk{k} AS (SELECT i, j, b, f0, greatest(peak, h) AS peak, h, CASE WHEN h < {d(HM)} THEN {d(0)} ELSE hu * a END AS hu, CASE WHEN h < {d(HM)} THEN {d(0)} ELSE hv * a END AS hv FROM fr{k}),
sg{k} AS (SELECT {rest}, CASE WHEN i = 0 THEN greatest({d(eta)} - b, {d(0)}) ELSE h END AS h, CASE WHEN i = 0 THEN {d(0)} ELSE hu END AS hu, CASE WHEN i = 0 THEN {d(0)} ELSE hv END AS hv FROM pk{k}),
in{k} AS (SELECT s.i, s.j, s.b, s.peak, s.f0, {scale(f"greatest({d(0)}, h - infil * {d(DT)})")} FROM sg{k} s JOIN par p ON p.i = s.i AND p.j = s.j),
sk{k} AS (SELECT *, (1 - CASE WHEN i >= 52 THEN {d('0.08')} * power((i - 52 + 1) / {d(12)}, 2) ELSE {d(0)} END) * (1 - CASE WHEN j >= 52 THEN {d('0.08')} * power((j - 52 + 1) / {d(12)}, 2) ELSE {d(0)} END) AS keep FROM in{k}),
sw{k} AS (SELECT {rest}, h * keep + greatest({d('0.8')} - b, {d(0)}) * (1 - keep) AS h, hu * keep AS hu, hv * keep AS hv FROM sk{k}),
ga{k} AS (SELECT s.i, s.j, s.b, s.peak, s.h, s.hu, s.hv, s.f0, p.tau, p.h_clamp, p.h_target, p.f_max, {d('0.5')} * (s.f0 + ks * {d(DT)} + sqrt(greatest(power(s.f0 + ks * {d(DT)}, 2) + 4 * ks * {d(DT)} * (psi + h) * dth, {d(0)}))) AS f2 FROM sw{k} s JOIN par p ON p.i = s.i AND p.j = s.j),
df{k} AS (SELECT *, greatest({d(0)}, least(least(f2 - f0, h), f_max - f0)) AS df FROM ga{k}),
dr{k} AS (SELECT i, j, b, peak, f0 + df AS f0, h_clamp, h_target, {scale(f"(h - df) * CASE WHEN tau > 0 THEN exp(-{d(DT)} / CASE WHEN tau > 0 THEN tau ELSE 1 END) ELSE {d(1)} END")} FROM df{k}),
cl{k} AS (SELECT {rest}, h_target, {scale("CASE WHEN h_clamp IS NOT NULL AND h > h_clamp THEN h_clamp ELSE h END")} FROM dr{k}),
tg{k} AS (SELECT {rest}, {scale("CASE WHEN h_target IS NOT NULL AND h > h_target THEN h_target ELSE h END")} FROM cl{k}),
st{k + 1} AS (SELECT i, j, b, least(h, {d('0.6')}) AS h, CASE WHEN h > {d('0.6')} THEN {d(0)} ELSE hu END AS hu, CASE WHEN h > {d('0.6')} THEN {d(0)} ELSE hv END AS hv, peak, f0 FROM tg{k})"""
    return f"WITH {out} SELECT i, j, {', '.join(rounded('h', 'hu', 'hv', 'peak', 'f0'))} FROM st2"


add("x7_run", forced_run, _forced_sql())

# The flagship: time step from the wave speeds, then one SRM-HLLC Euler step
_FLAG = Program(stencil.residual(DX, DX, h_min=HM))
_STEP = Program(stencil.euler("dt", HM))
_LAM = Program(flow.wave_speed_2d("lam", HM))


def _flagship(spark, sf_dir: str):
    c = fx.cell(spark, sf_dir).select("i", "j", "b", "h", "hu", "hv")
    top = _LAM.apply(c).agg(F.expr(text("0.5 * 2.0 / (greatest(max(lam), sqrt(9.81 * 1e-6)) + 1e-12)")).alias("dt"))
    r = _FLAG.apply(ghosts.fill(c, fx.N, fx.N, 2)).where(text(_GRID))
    return _STEP.apply(r.crossJoin(F.broadcast(top))).select("i", "j", *[F.expr(x) for x in rounded("h1", "hu1", "hv1", "dt")])


add(
    FLAGSHIP, _flagship,
    f"WITH {fx.CELL}, padded AS ({ghosts.fill_sql('cell', fx.N, fx.N, 2)}), top AS (SELECT {text('0.5 * 2.0 / (greatest(max(lam), sqrt(9.81 * 1e-6)) + 1e-12)')} AS dt FROM ({_LAM.sql('cell')}) AS l), "
    f"res AS (SELECT * FROM ({_FLAG.sql('padded')}) AS z WHERE {_GRID}), both_ AS (SELECT res.*, top.dt FROM res, top) "
    f"SELECT i, j, {', '.join(rounded('h1', 'hu1', 'hv1', 'dt'))} FROM ({_STEP.sql('both_')}) AS s",
)
