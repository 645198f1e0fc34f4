"""Exact solutions that runs are held against."""

from __future__ import annotations

import math

G = 9.81


def ritter(x: float, t: float, h0: float = 1.0) -> tuple[float, float]:
    """Depth and velocity of a dam break over a dry bed, the dam at x = 0, water at x < 0."""
    c = math.sqrt(G * h0)
    if x <= -c * t:
        return h0, 0.0
    if x >= 2 * c * t:
        return 0.0, 0.0
    return (2 * c - x / t) ** 2 / (9 * G), 2 * (c + x / t) / 3


def kinematic_depth(x: float, rain: float, slope: float, n: float) -> float:
    """Steady film on a plane under rain (m/s): q = rain x = sqrt(S) h^(5/3) / n."""
    return (rain * x * n / math.sqrt(slope)) ** 0.6


def sheet_flow(length: float, rain: float, slope: float, n: float, cells: int = 400, outflow: str = "normal") -> tuple[list[float], list[float]]:
    """Steady film on a plane (cell centres and depths) from the full momentum balance.

    d/dx (q^2 / h + g h^2 / 2) = g h (S - n^2 q^2 / h^(10/3)), q = rain x, marched upstream
    from normal depth at the foot by a fixed-point solve in each cell.
    """
    if outflow != "normal":
        raise ValueError("only a normal-depth foot is known")
    dx = length / cells
    xs = [(k + 0.5) * dx for k in range(cells)]
    hs = [0.0] * cells
    hs[-1] = kinematic_depth(xs[-1], rain, slope, n)
    for k in range(cells - 2, -1, -1):
        x, below = xs[k], hs[k + 1]
        h = kinematic_depth(x, rain, slope, n)
        up, down = (rain * x) ** 2, (rain * xs[k + 1]) ** 2
        for _ in range(60):
            mid, q = 0.5 * (h + below), rain * (x + 0.5 * dx)
            gradient = (down / below + 0.5 * G * below**2 - up / h - 0.5 * G * h**2) / dx
            # the depth whose friction carries what slope and momentum leave
            drive = slope - gradient / (G * mid)
            new = max(1e-9, 2 * (n * q / math.sqrt(max(drive, 1e-12))) ** 0.6 - below)
            if abs(new - h) < 1e-13:
                break
            h = 0.5 * (h + new)
        hs[k] = h
    return xs, hs
