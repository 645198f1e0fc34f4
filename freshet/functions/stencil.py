"""Neighbour formulas: reconstructions, well-balanced face states and bed sources, residuals.

``axis`` is "x" or "y"; the face of a cell is the one towards its next cell along it.
"""

from __future__ import annotations

from freshet.functions.flow import hllc, lax_friedrichs, velocity

#: Ghost cells that a reconstruction needs on each side.
WIDTH = {"first": 1, "muscl": 2, "linear2": 2, "linear3": 2, "linear5": 3, "weno5": 3}


def _at(c: str, k: int, axis: str) -> str:
    return f"n{axis}({c}, {k})"


def reconstruct(c: str, scheme: str, axis: str, L: str, R: str) -> list[str]:
    """States L and R of column c at the face towards the next cell."""
    near = {k: f"{L}_{'m' if k < 0 else 'p'}{abs(k)}" for k in range(-2, 4)}
    need = {"first": (0, 1), "muscl": (-1, 0, 1, 2), "linear2": (-1, 0, 1, 2), "linear3": (-1, 0, 1, 2), "linear5": range(-2, 4), "weno5": range(-2, 4)}[scheme]
    out = [f"{near[k]} = {_at(c, k, axis)}" for k in need]
    n = near
    if scheme == "first":
        return out + [f"{L} = {n[0]}", f"{R} = {n[1]}"]
    if scheme == "muscl":
        for tag, a, b, d in (("0", -1, 0, 1), ("1", 0, 1, 2)):
            x, y = f"({n[b]} - {n[a]})", f"({n[d]} - {n[b]})"
            out.append(f"{L}_s{tag} = if({x} * {y} <= 0.0, 0.0, if(abs{x} < abs{y}, {x}, {y}))")
        return out + [f"{L} = {n[0]} + 0.5 * {L}_s0", f"{R} = {n[1]} - 0.5 * {L}_s1"]
    if scheme == "linear2":
        return out + [f"{L} = {n[0]} + 0.5 * (0.5 * ({n[1]} - {n[-1]}))", f"{R} = {n[1]} - 0.5 * (0.5 * ({n[2]} - {n[0]}))"]
    if scheme == "linear3":
        return out + [f"{L} = (5.0 * {n[0]} - {n[-1]} + 2.0 * {n[1]}) / 6.0", f"{R} = (2.0 * {n[0]} + 5.0 * {n[1]} - {n[2]}) / 6.0"]
    if scheme == "linear5":
        w = (2.0, -13.0, 47.0, 27.0, -3.0)
        one = " + ".join(f"({a} / 60.0) * {n[k]}" for a, k in zip(w, range(-2, 3)))
        two = " + ".join(f"({a} / 60.0) * {n[k]}" for a, k in zip(w[::-1], range(-1, 4)))
        return out + [f"{L} = {one}", f"{R} = {two}"]
    for side, order in ((L, (-2, -1, 0, 1, 2)), (R, (3, 2, 1, 0, -1))):
        a, b, m, d, e = (n[k] for k in order)
        sq = lambda t: f"({t}) * ({t})"
        out += [
            f"{side}_q0 = {a} / 3.0 - 7.0 * {b} / 6.0 + 11.0 * {m} / 6.0",
            f"{side}_q1 = 5.0 * {m} / 6.0 - {b} / 6.0 + {d} / 3.0",
            f"{side}_q2 = {m} / 3.0 + 5.0 * {d} / 6.0 - {e} / 6.0",
            f"{side}_b0 = (13.0 / 12.0) * {sq(f'{a} - 2.0 * {b} + {m}')} + 0.25 * {sq(f'{a} - 4.0 * {b} + 3.0 * {m}')}",
            f"{side}_b1 = (13.0 / 12.0) * {sq(f'{b} - 2.0 * {m} + {d}')} + 0.25 * {sq(f'{b} - {d}')}",
            f"{side}_b2 = (13.0 / 12.0) * {sq(f'{m} - 2.0 * {d} + {e}')} + 0.25 * {sq(f'3.0 * {m} - 4.0 * {d} + {e}')}",
            *[f"{side}_a{k} = {g} / ((1e-6 + {side}_b{k}) * (1e-6 + {side}_b{k}))" for k, g in enumerate((0.1, 0.6, 0.3))],
            f"{side} = ({side}_a0 * {side}_q0 + {side}_a1 * {side}_q1 + {side}_a2 * {side}_q2) / ({side}_a0 + {side}_a1 + {side}_a2)",
        ]
    return out


def _momenta(axis: str) -> tuple[str, str]:
    return ("hu", "hv") if axis == "x" else ("hv", "hu")


def face_plain(axis: str, scheme: str, p: str) -> tuple[list[str], tuple, tuple]:
    """Left and right (h, normal, transverse) at the face, without bed treatment."""
    m, t = _momenta(axis)
    out = [x for c in ("h", m, t) for x in reconstruct(c, scheme, axis, f"{p}l_{c}", f"{p}r_{c}")]
    return out, tuple(f"{p}l_{c}" for c in ("h", m, t)), tuple(f"{p}r_{c}" for c in ("h", m, t))


def _cells(axis: str, p: str, h_min: str) -> list[str]:
    m, t = _momenta(axis)
    out = [f"{p}e = h + b", f"{p}u = if(h > {h_min}, {m} / greatest(h, {h_min}), 0.0)", f"{p}v = if(h > {h_min}, {t} / greatest(h, {h_min}), 0.0)"]
    return out + [f"{p}n_{c} = {_at(f'{p}{c}' if c in 'euv' else c, 1, axis)}" for c in ("h", "b", "e", "u", "v")]


def face_audusse(axis: str, p: str, h_min: str) -> tuple[list[str], tuple, tuple]:
    """Hydrostatic reconstruction at the face and its two depths."""
    out = _cells(axis, p, h_min) + [
        f"{p}zf = greatest(b, {p}n_b)", f"{p}hl = greatest(0.0, {p}e - {p}zf)", f"{p}hr = greatest(0.0, {p}n_e - {p}zf)",
        *[f"{p}{s}{c} = {p}h{s} * {p}{'n_' if s == 'r' else ''}{c}" for s in "lr" for c in "uv"],
    ]
    return out, (f"{p}hl", f"{p}lu", f"{p}lv"), (f"{p}hr", f"{p}ru", f"{p}rv")


def source_audusse(dx: str, p: str) -> tuple[str, str]:
    """Bed terms of the face for its own cell and for the next one (to be subtracted and added)."""
    return f"0.0 - 0.5 * 9.81 / {dx} * {p}hl * {p}hl", f"0.0 - 0.5 * 9.81 / {dx} * {p}hr * {p}hr"


def bed_gradient(axis: str, dx: str, out: str) -> list[str]:
    return [f"{out} = coalesce(0.5 * ({_at('b', 1, axis)} - {_at('b', -1, axis)}) / {dx}, 0.0)"]


def face_srm(axis: str, p: str, dx: str, h_min: str) -> tuple[list[str], tuple, tuple]:
    """Surface reconstruction at the face, with the bed extrapolated by central slopes."""
    out = _cells(axis, p, h_min) + bed_gradient(axis, dx, f"{p}g") + [
        f"{p}n_g = {_at(f'{p}g', 1, axis)}",
        f"{p}zl = b + 0.5 * {dx} * {p}g", f"{p}zr = {p}n_b - 0.5 * {dx} * {p}n_g",
        f"{p}zf = greatest(b, {p}n_b)", f"{p}zc = {p}zr - {p}zl", f"{p}dz = ({p}n_b - b) - {p}zc",
        f"{p}dl = greatest(0.0, least({p}dz, {p}n_e - {p}e))", f"{p}dr = greatest(0.0, least(0.0 - {p}dz, {p}e - {p}n_e))",
        f"{p}hl = greatest(0.0, {p}e + {p}dl - {p}zf)", f"{p}hr = greatest(0.0, {p}n_e + {p}dr - {p}zf)",
        *[f"{p}{s}{c} = {p}h{s} * {p}{'n_' if s == 'r' else ''}{c}" for s in "lr" for c in "uv"],
    ]
    return out, (f"{p}hl", f"{p}lu", f"{p}lv"), (f"{p}hr", f"{p}ru", f"{p}rv")


def source_srm(p: str, h_min: str) -> list[str]:
    """Bed terms of the face: {p}so for its own cell and {p}sn for the next."""
    out = [f"{p}wet = NOT (h < {h_min} AND {p}n_h < {h_min})"]
    for tag, h, e, b, other, face, sign in (("so", "h", f"{p}e", "b", f"{p}n_h", f"{p}hl", ""), ("sn", f"{p}n_h", f"{p}n_e", f"{p}n_b", "h", f"{p}hr", "0.0 - ")):
        out += [
            f"{p}{tag}h = {p}zf - {e}",
            f"{p}{tag}d = if({other} < {h_min}, greatest(0.0, {p}{tag}h), greatest(0.0, least({sign}{p}zc, {p}{tag}h)))",
            f"{p}{tag} = if({p}wet, 0.5 * 9.81 * ({face} + {h}) * ({p}zf - {p}{tag}d - {b}), 0.0)",
        ]
    return out


def axis_residual(axis: str, dx: str, scheme: str = "first", riemann: str = "hllc", bed: str = "srm", h_min: str = "1e-6") -> tuple[list[str], list[str]]:
    """Lines and the names of this axis' share of (h, hu, hv) tendencies."""
    p = axis
    if bed == "srm":
        out, L, R = face_srm(axis, p, dx, h_min)
    elif bed == "audusse":
        out, L, R = face_audusse(axis, p, h_min)
    else:
        out, L, R = face_plain(axis, scheme, p)
    out += (hllc if riemann == "hllc" else lax_friedrichs)(L, R, f"{p}f", h_min)
    parts = [f"(0.0 - ({p}f{k} - {_at(f'{p}f{k}', -1, axis)})) / {dx}" for k in range(3)]
    if bed == "srm":
        out += source_srm(p, h_min)
        parts[1] += f" - {p}so / {dx} + {_at(f'{p}sn', -1, axis)} / {dx}"
    elif bed == "audusse":
        own, nxt = source_audusse(dx, p)
        out += [f"{p}so = {own}", f"{p}sn = {nxt}"]
        parts[1] += f" - {p}so + {_at(f'{p}sn', -1, axis)}"
    elif bed == "slope":
        parts[1] += f" - 9.81 * h * ({_at('b', 1, axis)} - {_at('b', -1, axis)}) / (2.0 * {dx})"
    names = [f"r{p}_{k}" for k in ("h", "n", "t")]
    return out + [f"{n} = {x}" for n, x in zip(names, parts)], names


def residual(dx: str, dy: str | None = None, **options) -> list[str]:
    """Tendencies rh, rhu, rhv of both axes (one if dy is None)."""
    out, (xh, xn, xt) = axis_residual("x", dx, **options)
    if dy is None:
        return out + [f"rh = {xh}", f"rhu = {xn}", f"rhv = {xt}"]
    more, (yh, yn, yt) = axis_residual("y", dy, **options)
    return out + more + [f"rh = {xh} + {yh}", f"rhu = {xn} + {yt}", f"rhv = {xt} + {yn}"]


def euler(dt: str, h_min: str = "1e-6", rain: str | None = None) -> list[str]:
    """Forward step and the wet/dry rule: h1, hu1, hv1."""
    return [
        f"eh = h + {dt} * {'rh' if not rain else f'(rh + {rain})'}", f"ehu = hu + {dt} * rhu", f"ehv = hv + {dt} * rhv",
        "h1 = greatest(eh, 0.0)", f"hu1 = if(eh < {h_min}, 0.0, ehu)", f"hv1 = if(eh < {h_min}, 0.0, ehv)",
    ]


def velocity_invariants(dx: str, dy: str) -> list[str]:
    """tr^2(Du) + tr((Du)^2) by central differences."""
    d = lambda c, a, s: f"({_at(c, 1, a)} - {_at(c, -1, a)}) / (2.0 * {s})"
    return [
        *velocity("h", "hu", "iu"), *velocity("h", "hv", "iv"),
        f"ux = {d('iu', 'x', dx)}", f"vx = {d('iv', 'x', dx)}", f"uy = {d('iu', 'y', dy)}", f"vy = {d('iv', 'y', dy)}",
        "kin = 2.0 * (ux * ux + vy * vy + ux * vy + uy * vx)",
    ]


def sigma_sweep(alpha: str, dx: str, dy: str, h_min: str = "1e-10") -> list[str]:
    """One Jacobi sweep of the entropic pressure from column sigma to sigma1 (interior cells)."""
    out = [f"js = greatest(h, {h_min})"]
    diag, off = "1.0 / js", []
    for a, s in (("x", dx), ("y", dy)):
        for tag, k in (("m", -1), ("p", 1)):
            out += [f"j{a}{tag} = 1.0 / (0.5 * (js + {_at('js', k, a)}))", f"o{a}{tag} = {_at('sigma', k, a)}"]
            diag += f" + {alpha} / ({s} * {s}) * j{a}{tag}"
            off.append(f"{alpha} / ({s} * {s}) * j{a}{tag} * o{a}{tag}")
    return out + [f"jd = {diag}", f"jo = {' + '.join(off)}", f"sigma1 = ({alpha} * kin + jo) / jd"]
