"""Pointwise formulas: primitives, physical and Riemann fluxes, friction, sources of water."""

from __future__ import annotations

G, H_MIN = 9.81, 1e-10


def velocity(h: str, m: str, out: str, h_min: str = "1e-10") -> list[str]:
    return [f"{out} = if({h} <= {h_min}, 0.0, {m} / greatest({h}, {h_min}))"]


def primitives(h_min: str = "1e-10", h="h", hu="hu", hv="hv", u="u", v="v") -> list[str]:
    return velocity(h, hu, u, h_min) + velocity(h, hv, v, h_min)


def flux(h: str, m: str, t: str, p: str) -> list[str]:
    """Physical flux along the axis of momentum m, t the other; the floor is always 1e-10."""
    return [
        *velocity(h, m, f"{p}_u"), *velocity(h, t, f"{p}_v"),
        f"{p}0 = {m}", f"{p}1 = {m} * {p}_u + 0.5 * 9.81 * {h} * {h}", f"{p}2 = {m} * {p}_v",
    ]


def wave_speed_1d(out: str = "lam", h_min: str = "1e-10", h="h", hu="hu", p="w") -> list[str]:
    return [*velocity(h, hu, f"{p}_u", h_min), f"{out} = abs({p}_u) + sqrt(9.81 * greatest({h}, 0.0))"]


def wave_speed_2d(out: str = "lam", h_min: str = "1e-10", h="h", hu="hu", hv="hv", p="w") -> list[str]:
    return [*velocity(h, hu, f"{p}_u", h_min), *velocity(h, hv, f"{p}_v", h_min), f"{out} = greatest(abs({p}_u), abs({p}_v)) + sqrt(9.81 * greatest({h}, 0.0))"]


def wave_speed_l2(out: str = "lam", h_min: str = "1e-10") -> list[str]:
    return [*velocity("h", "hu", "w_u", h_min), *velocity("h", "hv", "w_v", h_min), f"{out} = sqrt(w_u * w_u + w_v * w_v) + sqrt(9.81 * greatest(h, 0.0))"]


def lax_friedrichs(L: tuple, R: tuple, p: str, h_min: str = "1e-10") -> list[str]:
    """Local Lax-Friedrichs flux between states (h, normal, transverse)."""
    return [
        *flux(*L, f"{p}L"), *flux(*R, f"{p}R"),
        *wave_speed_1d(f"{p}_ll", h_min, L[0], L[1], f"{p}_l"), *wave_speed_1d(f"{p}_lr", h_min, R[0], R[1], f"{p}_r"),
        f"{p}_a = greatest({p}_ll, {p}_lr)",
        *[f"{p}{k} = 0.5 * ({p}L{k} + {p}R{k}) - 0.5 * {p}_a * ({R[k]} - {L[k]})" for k in range(3)],
    ]


def speeds(L: tuple, R: tuple, p: str, h_min: str = "1e-10") -> list[str]:
    """Left and right wave speed estimates with dry sides."""
    (hL, mL, _), (hR, mR, _) = L, R
    return [
        *velocity(hL, mL, f"{p}_uL", h_min), *velocity(hR, mR, f"{p}_uR", h_min),
        f"{p}_aL = sqrt(9.81 * greatest({hL}, 0.0))", f"{p}_aR = sqrt(9.81 * greatest({hR}, 0.0))",
        f"{p}_us = 0.5 * ({p}_uL + {p}_uR) + {p}_aL - {p}_aR",
        f"{p}_rt = 0.5 * ({p}_aL + {p}_aR) + 0.25 * ({p}_uL - {p}_uR)",
        f"{p}_hs = if({p}_rt > 0.0, {p}_rt * {p}_rt / 9.81, 0.0)",
        f"{p}_as = sqrt(9.81 * {p}_hs)",
        f"{p}_SL = if({hL} <= {h_min} AND {hR} <= {h_min}, 0.0, if({hL} <= {h_min}, {p}_uR - 2.0 * {p}_aR, least({p}_uL - {p}_aL, {p}_us - {p}_as)))",
        f"{p}_SR = if({hL} <= {h_min} AND {hR} <= {h_min}, 0.0, if({hR} <= {h_min}, {p}_uL + 2.0 * {p}_aL, greatest({p}_uR + {p}_aR, {p}_us + {p}_as)))",
    ]


def hllc(L: tuple, R: tuple, p: str, h_min: str = "1e-10") -> list[str]:
    """HLLC flux with a clamped contact speed; p0, p1, p2 are mass, normal, transverse."""
    (hL, mL, tL), (hR, mR, tR) = L, R
    out = [*speeds(L, R, p, h_min), *velocity(hL, tL, f"{p}_vL", h_min), *velocity(hR, tR, f"{p}_vR", h_min), *flux(*L, f"{p}L"), *flux(*R, f"{p}R")]
    out += [
        f"{p}_den = {hR} * ({p}_uR - {p}_SR) - {hL} * ({p}_uL - {p}_SL)",
        f"{p}_raw = if(abs({p}_den) > 1e-14, ({p}_SL * {hR} * ({p}_uR - {p}_SR) - {p}_SR * {hL} * ({p}_uL - {p}_SL)) / {p}_den, 0.5 * ({p}_uL + {p}_uR))",
        f"{p}_SM = least(greatest({p}_raw, {p}_SL), {p}_SR)",
    ]
    for s, h, m, t in (("L", hL, mL, tL), ("R", hR, mR, tR)):
        out += [
            f"{p}_f{s} = ({p}_S{s} - {p}_u{s}) / ({p}_S{s} - {p}_SM + 1e-30)",
            f"{p}_h{s} = {h} * {p}_f{s}",
            f"{p}_x{s}0 = {p}{s}0 + {p}_S{s} * ({p}_h{s} - {h})",
            f"{p}_x{s}1 = {p}{s}1 + {p}_S{s} * ({p}_h{s} * {p}_SM - {m})",
            f"{p}_x{s}2 = {p}{s}2 + {p}_S{s} * ({p}_h{s} * {p}_v{s} - {t})",
        ]
    return out + [f"{p}{k} = if({p}_SL >= 0.0, {p}L{k}, if({p}_SM >= 0.0, {p}_xL{k}, if({p}_SR >= 0.0, {p}_xR{k}, {p}R{k})))" for k in range(3)]


def friction_explicit_1d(n: str, dt: str, out: str = "hu1") -> list[str]:
    return [
        "fe_h = greatest(h, 1e-10)", "fe_u = hu / fe_h", f"fe_c = 9.81 * {n} * {n} * power(fe_h, -0.333333333333333333)",
        f"fe_q = hu - {dt} * fe_c * fe_u * abs(fe_u)", f"{out} = if(fe_q * hu < 0.0 OR h <= 1e-10, 0.0, fe_q)",
    ]


def friction_newton(n: str, dt: str, a1: str, a2: str | None = None, rounds: int = 5, cap: str | None = "15.0") -> list[str]:
    """Point-implicit friction by a fixed number of Newton rounds, in one or two components.

    Stopping after ``rounds`` for every cell, rather than when the largest change
    anywhere is small, stays within the tolerance and keeps the formula pointwise.
    """
    comps = [("hu", a1, "x")] + ([("hv", a2, "y")] if a2 else [])
    out = ["fn_h = greatest(h, 1e-10)"]
    for q, a, c in comps:
        out += [f"fn_n{c} = {q} / fn_h", f"fn_a{c} = {a} / fn_h", f"fn_{c}0 = fn_n{c} + {dt} * fn_a{c}"]
    mod = lambda k: f"abs(fn_x{k})" if not a2 else f"sqrt(fn_x{k} * fn_x{k} + fn_y{k} * fn_y{k})"
    out.append("fn_p = power(fn_h, -1.333333333333333333)")
    if a2 and cap:
        out += [f"fn_m = {mod(0)}", f"fn_k = if(fn_m > {cap}, greatest({n}, sqrt(1.0 / ((1e-10 + {dt}) * 9.81 * fn_p * (fn_m + 1e-30)))), {n})"]
    else:
        out.append(f"fn_k = {n}")
    out.append("fn_c = 9.81 * fn_k * fn_k * fn_p")
    for k in range(rounds):
        out.append(f"fn_m{k} = {mod(k)}")
        small = "" if not a2 else " + 1e-12"
        out.append(f"fn_d{k} = 1.0 + {dt} * fn_c * 2.0 * (fn_m{k}{small})")
        for _, _, c in comps:
            out.append(f"fn_{c}{k + 1} = fn_{c}{k} - (fn_{c}{k} - fn_n{c} - {dt} * fn_a{c} + {dt} * fn_c * fn_m{k} * fn_{c}{k}) / fn_d{k}")
    return out + [f"{q}1 = if(h <= 1e-10, 0.0, fn_h * fn_{c}{rounds})" for q, _, c in comps]


def friction_step(n: str, dt: str, quadratic: bool = True, cap: str | None = "15.0", h_min: str = "1e-6", h="h", hu="hu", hv="hv", out=("hu1", "hv1")) -> list[str]:
    """The solver's friction: quadratic or linearised root, with the velocity cap."""
    lines = [
        f"fs_h = greatest({h}, {h_min})", f"fs_u = {hu} / fs_h", f"fs_v = {hv} / fs_h", "fs_m = sqrt(fs_u * fs_u + fs_v * fs_v)", "fs_p = power(fs_h, -1.333333333333333333)",
        f"fs_n = if(fs_m > {cap}, greatest({n}, sqrt(1.0 / ((1e-10 + {dt}) * 9.81 * fs_p * (fs_m + 1e-30)))), {n})" if cap else f"fs_n = {n}",
        "fs_c = 9.81 * fs_n * fs_n * fs_p",
        f"fs_a = 2.0 / (1.0 + sqrt(1.0 + 4.0 * {dt} * fs_c * fs_m))" if quadratic else f"fs_a = 1.0 / (1.0 + {dt} * fs_c * fs_m)",
    ]
    return lines + [f"{o} = if({h} < {h_min}, 0.0, {q} * fs_a)" for o, q in zip(out, (hu, hv))]


def wet_dry(h_min: str = "1e-6", h="h", hu="hu", hv="hv", out=("h1", "hu1", "hv1")) -> list[str]:
    return [f"{out[0]} = greatest({h}, 0.0)", f"{out[1]} = if({h} < {h_min}, 0.0, {hu})", f"{out[2]} = if({h} < {h_min}, 0.0, {hv})"]


def _scaled(new: str, out=("h1", "hu1", "hv1"), h="h", hu="hu", hv="hv") -> list[str]:
    """Take water away at constant velocity."""
    return [f"{out[0]} = {new}", f"sc_r = if({h} > 1e-10, {out[0]} / {h}, 0.0)", f"{out[1]} = {hu} * sc_r", f"{out[2]} = {hv} * sc_r"]


def green_ampt(dt: str, k="ks", psi="psi", dth="dth", f="f0", f_max="f_max") -> list[str]:
    """Infiltration of a step, bounded by the water there and the storage left."""
    return [
        f"ga_a = {f} + {k} * {dt}",
        f"ga_f = 0.5 * (ga_a + sqrt(greatest(ga_a * ga_a + 4.0 * {k} * {dt} * ({psi} + h) * {dth}, 0.0)))",
        f"df = greatest(0.0, least(least(ga_f - {f}, h), {f_max} - {f}))",
        f"f1 = {f} + df", *_scaled("h - df"),
    ]


def green_ampt_drain(dt: str, tau="tau") -> list[str]:
    lines = green_ampt(dt)[:4]
    return lines + [f"gd_e = if({tau} > 0.0, exp(-{dt} / {tau}), 1.0)", *_scaled("(h - df) * gd_e")]


def reservoir(dt: str, tau="tau", land="b > 0.0") -> list[str]:
    return [f"lr_e = if({land} AND {tau} > 0.0, exp(-{dt} / {tau}), 1.0)", *_scaled("h * lr_e")]


def infiltration(rate: str, dt: str) -> list[str]:
    return _scaled(f"greatest(0.0, h - {rate} * {dt})")


def depth_limit(limit: str) -> list[str]:
    """Target depth (sinkholes) or stage clamp: lower to the limit, keep the velocity."""
    return _scaled(f"if({limit} IS NOT NULL AND h > {limit}, {limit}, h)")


def depth_cap(cap: str) -> list[str]:
    return [f"h1 = if(h > {cap}, {cap}, h)", f"hu1 = if(h > {cap}, 0.0, hu)", f"hv1 = if(h > {cap}, 0.0, hv)"]


def storage_fraction(rhs: str, dt: str, sigma="sigma") -> list[str]:
    return [f"sg = least(greatest({sigma}, 0.001), 1.0)", f"h1 = h + {dt} * {rhs} / sg"]


def storage_curve(rhs: str, dt: str, c: str, dx: str, dt_ref: str, sigma="sigma") -> list[str]:
    """Volume update: below the depth k sigma squared water fills the channel share only."""
    return [
        f"sg = least(greatest({sigma}, 0.001), 1.0)", f"sk = ({c} * {dx} / {dt_ref}) * ({c} * {dx} / {dt_ref}) / 9.81", "hb = sk * sg * sg", "vb = sg * hb",
        f"hs = h + {dt} * {rhs} / sg", f"v1 = if(h > hb, vb + (h - hb), sg * h) + {dt} * {rhs}",
        "h1 = if(sg < 1.0 AND (hs > hb OR h > hb), if(v1 > vb, hb + (v1 - vb), v1 / sg), hs)",
    ]


def sponge(width: int, nx: int, ny: int, stage: str) -> list[str]:
    """Damping towards still water in bands along the east and north edge."""
    return [
        f"sp_x = if(i >= {nx - width}, 0.08 * ((i - {nx - width}.0 + 1.0) / {width}.0) * ((i - {nx - width}.0 + 1.0) / {width}.0), 0.0)", f"sp_y = if(j >= {ny - width}, 0.08 * ((j - {ny - width}.0 + 1.0) / {width}.0) * ((j - {ny - width}.0 + 1.0) / {width}.0), 0.0)",
        "sp_k = (1.0 - sp_x) * (1.0 - sp_y)", f"sp_a = greatest({stage} - b, 0.0) * (1.0 - sp_k)", "h1 = h * sp_k + sp_a", "hu1 = hu * sp_k", "hv1 = hv * sp_k",
    ]


def sponge_bands(width: int, nx: int, ny: int, stage: str) -> list[str]:
    """The same damping applied band by band: cells of both bands, in the corner, take it twice."""
    lines = sponge(width, nx, ny, stage)[:4]
    one = f"(i >= {nx - width} OR j >= {ny - width})"
    two = f"(i >= {nx - width} AND j >= {ny - width})"
    return lines + [
        f"sb_h = if({one}, h * sp_k + sp_a, h)", f"sb_k = if({one}, sp_k, 1.0)",
        f"h1 = if({two}, sb_h * sp_k + sp_a, sb_h)", f"hu1 = if({two}, hu * sb_k * sp_k, hu * sb_k)", f"hv1 = if({two}, hv * sb_k * sp_k, hv * sb_k)",
    ]
