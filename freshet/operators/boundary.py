"""Water that enters and leaves at cells: inlets, stage cells, rings of gauges, ghost modes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.operators.mesh import SIDES

G_INLET = 9.80665
MOST_GAUGES = 10_000


def inlet_ghosts(cells: DataFrame, inlet_cells: DataFrame, inlets: DataFrame, ngh: int, dry_frac: float = 0.1) -> DataFrame:
    """(inlet, i, j, h, hu, hv) for the ghosts outward of each inlet.

    inlets (inlet, q, ds, nx, ny) with the inward normal; inlet_cells (inlet, i, j). Wet
    sections share the discharge by depth. A dry one is seeded from its bed relief and
    carries the flow in its lowest cells; a flat dry one takes the critical depth.
    """
    c = inlet_cells.join(cells.select("i", "j", "h", "b"), ["i", "j"])
    s = c.groupBy("inlet").agg(F.sum("h").alias("hs"), F.min("b").alias("z0"), F.max("b").alias("z1"))
    low = c.join(s, "inlet").where("b <= z0").groupBy("inlet").agg(F.count("*").alias("nl"))
    x = c.join(s, "inlet").join(low, "inlet").join(inlets, "inlet")
    wet = F.col("hs") > 0
    seed = F.greatest(F.col("z0") + dry_frac * (F.col("z1") - F.col("z0")) - F.col("b"), F.lit(0.0))
    qc = F.abs("q") / (F.col("nl") * F.col("ds"))
    # a section is flat if the seed surface lies on its bed everywhere
    flat = dry_frac * (F.col("z1") - F.col("z0")) <= 0
    critical = F.pow(qc * qc / G_INLET, F.lit(1.0 / 3.0))
    x = x.withColumn("hf", F.when(wet, F.col("h")).when(flat, seed + critical).otherwise(seed)).withColumn(
        "w", F.when(wet, F.col("h") / F.when(wet, F.col("hs")).otherwise(1.0)).when(F.col("b") <= F.col("z0"), 1.0 / F.col("nl")).otherwise(0.0)
    )
    qn = F.col("q") / F.col("ds") * F.col("w")
    out = x.select("inlet", "i", "j", F.col("hf").alias("h"), (qn * F.col("nx")).alias("hu"), (qn * F.col("ny")).alias("hv"), "nx", "ny", F.explode(F.sequence(F.lit(1), F.lit(ngh))).alias("g"))
    return out.select("inlet", (F.col("i") - F.col("g") * F.col("nx")).cast("int").alias("i"), (F.col("j") - F.col("g") * F.col("ny")).cast("int").alias("j"), "h", "hu", "hv")


def with_override(padded: DataFrame, cells: DataFrame) -> DataFrame:
    """padded with h, hu, hv replaced where cells (i, j, h, hu, hv) has a row."""
    o = cells.select("i", "j", *[F.col(c).alias(f"_{c}") for c in ("h", "hu", "hv")])
    return padded.join(o, ["i", "j"], "left").select("i", "j", "b", *[F.coalesce(f"_{c}", c).alias(c) for c in ("h", "hu", "hv")])


def apply_stage(cells: DataFrame, stage_cells: DataFrame, eta: float, keep_momentum: bool = False) -> DataFrame:
    """cells with still water at eta on stage_cells (i, j)."""
    mark = stage_cells.select("i", "j").distinct().withColumn("_s", F.lit(True))
    on = F.col("_s").isNotNull()
    out = {"h": F.when(on, F.greatest(F.lit(eta) - F.col("b"), F.lit(0.0))).otherwise(F.col("h"))}
    if not keep_momentum:
        out |= {c: F.when(on, F.lit(0.0)).otherwise(F.col(c)) for c in ("hu", "hv")}
    return cells.join(mark, ["i", "j"], "left").withColumns(out).drop("_s")


def ring_stage(ring: DataFrame, weights: DataFrame, stage: DataFrame) -> DataFrame:
    """(i, j, eta, h): stages (gauge, eta) weighted onto ring cells (i, j, bed)."""
    eta = weights.join(stage, "gauge").groupBy("i", "j").agg(F.sum(F.col("w") * F.col("eta")).alias("eta"))  # a row for each gauge
    return ring.join(eta, ["i", "j"]).select("i", "j", "eta", F.greatest(F.lit(0.0), F.col("eta") - F.col("bed")).alias("h"))


def stage_from_mask(cells: DataFrame, mask: DataFrame) -> DataFrame:
    """(i, j, b): the cells of a mask (i, j, on), with their bed."""
    return cells.select("i", "j", "b").join(mask.where("on").select("i", "j").distinct(), ["i", "j"])


def idw_weights(ring: DataFrame, gauges: DataFrame, dx: float) -> DataFrame:
    """(i, j, gauge, w): inverse square distances, at least one cell, adding up to 1 for each ring cell.

    Every ring cell needs every gauge; at most ``MOST_GAUGES`` are broadcast, more raise.
    """
    if gauges.limit(MOST_GAUGES + 1).count() > MOST_GAUGES:
        raise ValueError(f"more than {MOST_GAUGES} gauges")
    d2 = F.pow((F.col("i") + 0.5) * dx - F.col("x"), F.lit(2)) + F.pow((F.col("j") + 0.5) * dx - F.col("y"), F.lit(2))
    w = 1.0 / F.greatest(d2, F.lit(dx * dx))
    raw = ring.select("i", "j").crossJoin(F.broadcast(gauges)).select("i", "j", F.col("g").alias("gauge"), w.alias("raw"))
    total = raw.groupBy("i", "j").agg(F.sum("raw").alias("all"))
    return raw.join(total, ["i", "j"]).select("i", "j", "gauge", (F.col("raw") / F.col("all")).alias("w"))


def ring_cells(active: DataFrame, nx: int, ny: int) -> DataFrame:
    """Active cells with a neighbour outside the active set."""
    own = active.select("i", "j").distinct()
    near = own.select("i", "j", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in SIDES.values()])).alias("s"))
    near = near.select("i", "j", (F.col("i") + F.col("s.a")).alias("ni"), (F.col("j") + F.col("s.b")).alias("nj"))
    mark = own.select(F.col("i").alias("ni"), F.col("j").alias("nj"), F.lit(1).alias("_in"))
    return near.join(mark, ["ni", "nj"], "left").groupBy("i", "j").agg(F.count("_in").alias("m")).where("m < 4").select("i", "j")


def ghost_pairs(stored: DataFrame) -> DataFrame:
    """(i, j, pi, pj): for each stored cell that isn't active its first active neighbour E, W, N, S."""
    ghost = stored.where("not is_active").select("i", "j", F.posexplode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in SIDES.values()])).alias("o", "s"))
    ghost = ghost.select("i", "j", "o", (F.col("i") + F.col("s.a")).cast("int").alias("pi"), (F.col("j") + F.col("s.b")).cast("int").alias("pj"))
    active = stored.where("is_active").select(F.col("i").alias("pi"), F.col("j").alias("pj"))
    best = ghost.join(active, ["pi", "pj"]).groupBy("i", "j").agg(F.min(F.struct("o", "pi", "pj")).alias("x"))
    return best.select("i", "j", "x.pi", "x.pj")


def ghost_state(stored: DataFrame, pairs: DataFrame, mode: str, eta: float | None = None) -> DataFrame:
    """(i, j, h, hu, hv) of paired ghosts.

    extrapolate copies the neighbour; stage holds still water at eta; stage_uv adds the
    neighbour's velocity to it; hybrid takes the stage where the neighbour lies below eta
    and copies it elsewhere; off leaves ghosts dry; auto is stage where eta is given, else off.
    """
    if mode == "auto":
        mode = "off" if eta is None else "stage"
    if mode not in ("off", "extrapolate", "stage", "stage_uv", "hybrid"):
        raise ValueError(f"unknown ring mode {mode!r}")
    eta = 0.0 if eta is None else eta
    n = stored.select(F.col("i").alias("pi"), F.col("j").alias("pj"), F.col("h").alias("nh"), F.col("hu").alias("nu"), F.col("hv").alias("nv"), F.col("b").alias("nb"))
    x = pairs.join(stored.select("i", "j", "b"), ["i", "j"]).join(n, ["pi", "pj"])
    still = F.greatest(F.lit(eta) - F.col("b"), F.lit(0.0))
    low = F.col("nh") + F.col("nb") < eta
    scale = F.when(F.col("nh") > 1e-10, still / F.when(F.col("nh") > 1e-10, F.col("nh")).otherwise(1.0)).otherwise(0.0)
    zero = F.lit(0.0)
    h = {"off": zero, "extrapolate": F.col("nh"), "stage": still, "stage_uv": still, "hybrid": F.when(low, still).otherwise(F.col("nh"))}[mode]
    hu, hv = ({"off": zero, "extrapolate": c, "stage": zero, "stage_uv": c * scale, "hybrid": F.when(low, zero).otherwise(c)}[mode] for c in (F.col("nu"), F.col("nv")))
    return x.select("i", "j", h.alias("h"), hu.alias("hu"), hv.alias("hv"))
