"""Configuration of a run, checked when it is made."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

from freshet.functions.stencil import WIDTH
from freshet.operators.ghosts import KINDS


@dataclass(frozen=True)
class Config:
    """What a shallow-water run computes and how.

    riemann: hllc or lf; bed: srm, audusse, slope or none; recon applies where the bed
    treatment isn't well balanced; integrator: euler or ssprk3. Lengths are metres, times
    seconds, rainfall metres a second.
    """

    riemann: str = "hllc"
    bed: str = "srm"
    recon: str = "first"
    integrator: str = "euler"
    cfl: float = 0.5
    cfl_norm: str = "linf"
    h_min: float = 1e-6
    manning: float | None = None
    quadratic_friction: bool = True
    velocity_cap: float = 15.0
    rainfall: float = 0.0
    dt_min: float = 0.0
    dt_max: float = math.inf
    ngh: int = 4
    boundary: dict = field(default_factory=lambda: dict.fromkeys(("west", "east", "south", "north"), "extrapolate"))

    def __post_init__(self):
        for name, allowed in (("riemann", ("hllc", "lf")), ("bed", ("srm", "audusse", "slope", "none")), ("recon", tuple(WIDTH)), ("integrator", ("euler", "ssprk3")), ("cfl_norm", ("1d", "linf", "l2"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}, not {getattr(self, name)!r}")
        for name in ("cfl", "h_min"):
            v = getattr(self, name)
            if not (math.isfinite(v) and v > 0):
                raise ValueError(f"{name} must be positive and finite, not {v}")
        for name in ("rainfall", "dt_min", "velocity_cap"):
            v = getattr(self, name)
            if math.isnan(v) or v < 0:
                raise ValueError(f"{name} must not be negative, not {v}")
        if self.cfl > 1:
            warnings.warn(f"cfl = {self.cfl} is above 1", stacklevel=3)
        if self.rainfall > 1e-3:
            warnings.warn("rainfall is in m/s; this is more than 3600 mm/h", stacklevel=3)
        if self.bed in ("srm", "audusse") and self.recon != "first":
            warnings.warn("recon has no effect with a well-balanced bed", stacklevel=3)
        if set(self.boundary) != {"west", "east", "south", "north"} or not set(self.boundary.values()) <= set(KINDS):
            raise ValueError(f"boundary names a kind of {KINDS} for each of west, east, south and north")
        if self.ngh < self.width:
            raise ValueError(f"{self.recon} with bed {self.bed} needs ngh >= {self.width}, not {self.ngh}")

    @property
    def width(self) -> int:
        """Ghost cells that one evaluation of the residual reads."""
        if self.bed in ("srm", "audusse"):
            return 2
        return WIDTH[self.recon] + (self.recon != "first")
