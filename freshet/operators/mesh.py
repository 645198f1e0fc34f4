"""Active-cell meshes: ids, neighbours, rings, encodings, partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SIDES = {"e": (1, 0), "w": (-1, 0), "n": (0, 1), "s": (0, -1)}


def number(cells: DataFrame, *order: str, out: str = "k") -> DataFrame:
    """Ids 0, 1, ... in the order of the columns given, without one task that sees all rows.

    Rows are numbered within each value of the first column; how many come before is a
    sum over that column's counts, of which there are as many as grid rows.
    """
    head, *rest = order
    before = Window.orderBy(head).rowsBetween(Window.unboundedPreceding, -1)
    counts = cells.groupBy(head).agg(F.count("*").alias("_n")).withColumn("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    own = F.row_number().over(Window.partitionBy(head).orderBy(*rest)) - 1
    return cells.withColumn("_r", own).join(counts.select(head, "_b"), head).withColumn(out, (F.col("_b") + F.col("_r")).cast("long")).drop("_r", "_b")


def neighbours(mesh: DataFrame) -> DataFrame:
    """mesh (k, i, j) with the ids ke, kw, kn, ks next to each cell, null where none is stored.

    Cells in a row or column of the grid are read in order; the next id is the one of the
    next row of the window if it is one cell away.
    """
    out = mesh
    for side, (di, dj) in SIDES.items():
        along, across, step = ("i", "j", di) if di else ("j", "i", dj)
        w = Window.partitionBy(across).orderBy(along)
        move = F.lead if step > 0 else F.lag
        out = out.withColumn(f"k{side}", F.when(move(along).over(w) == F.col(along) + step, move("k").over(w)))
    return out


def dilate(active: DataFrame, nx: int, ny: int, rounds: int = 2) -> DataFrame:
    """(i, j, is_active): active cells and the cells within ``rounds`` steps along the axes."""
    own = active.select("i", "j").distinct()
    ring = own
    shifts = F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a, b in [(0, 0), *SIDES.values()]])
    for _ in range(rounds):
        ring = ring.select("i", "j", F.explode(shifts).alias("s")).select((F.col("i") + F.col("s.di")).cast("int").alias("i"), (F.col("j") + F.col("s.dj")).cast("int").alias("j")).distinct()
    ring = ring.where(F.col("i").between(0, nx - 1) & F.col("j").between(0, ny - 1))
    return ring.join(own.withColumn("is_active", F.lit(True)), ["i", "j"], "left").withColumn("is_active", F.coalesce("is_active", F.lit(False)))


def deltas(mesh: DataFrame) -> DataFrame:
    """Neighbour ids as differences that fit 16 bits (-32768: none); raises if one doesn't."""
    out = mesh.select("k", *[F.coalesce(F.col(f"k{s}") - F.col("k"), F.lit(-32768)).cast("int").alias(f"d{s}") for s in SIDES])
    far = F.greatest(*[F.when(F.col(f"k{s}").isNotNull(), F.abs(F.col(f"k{s}") - F.col("k"))).otherwise(0) for s in SIDES])
    if mesh.agg(F.max(far).alias("m")).first().m > 32767:
        raise ValueError("a neighbour is too far for 16 bits")
    return out


def uncovered(stored: DataFrame, nx: int, ny: int) -> DataFrame:
    """Cells within two steps of an active one that aren't stored (none in a sound mesh)."""
    return dilate(stored.where("is_active"), nx, ny, 2).join(stored.select("i", "j"), ["i", "j"], "left_anti").select("i", "j")


def pack(grid: DataFrame, mesh: DataFrame) -> DataFrame:
    """The grid's rows on the mesh, with ids."""
    return grid.join(mesh.select("i", "j", "k"), ["i", "j"])


def unpack(flat: DataFrame, grid: DataFrame, fill: float, *values: str) -> DataFrame:
    """Values of flat rows on every cell of the grid, ``fill`` where none is stored."""
    return grid.select("i", "j").join(flat.select("i", "j", *values), ["i", "j"], "left").select("i", "j", *[F.coalesce(v, F.lit(fill)).alias(v) for v in values])


def balanced_columns(active: DataFrame, nx: int, parts: int) -> DataFrame:
    """(part, i_begin): column cuts that give each part about the same number of active cells."""
    spark = active.sparkSession
    count = active.groupBy("i").agg(F.count("*").alias("n"))
    all_ = spark.range(nx).select(F.col("id").cast("int").alias("i")).join(count, "i", "left").select("i", F.coalesce("n", F.lit(0)).alias("n"))
    run = all_.withColumn("c", F.sum("n").over(Window.orderBy("i")))  # a row for each grid column
    total = run.agg(F.max("c").alias("total"))
    want = spark.range(1, parts).select(F.col("id").cast("int").alias("part"))
    hit = want.crossJoin(F.broadcast(total)).join(run, F.col("c") * parts >= F.col("part") * F.col("total")).groupBy("part").agg(F.min("i").alias("i0"))
    first = spark.range(1).select(F.lit(0).alias("part"), F.lit(0).alias("i_begin"))
    w = Window.orderBy("part")
    # strictly increasing, as each part needs a column
    return first.unionByName(hit.select("part", (F.max(F.col("i0") + 1 - F.col("part")).over(w) + F.col("part")).cast("int").alias("i_begin")))


def blocks(cells: DataFrame, nx: int, ny: int, px: int, py: int) -> DataFrame:
    """cells with the block (bi, bj) of a px by py division with ceiling sizes."""
    sx, sy = -(-nx // px), -(-ny // py)
    return cells.withColumns({"bi": F.floor(F.col("i") / sx).cast("int"), "bj": F.floor(F.col("j") / sy).cast("int")})


def memory_summary(stored: DataFrame, nx: int, ny: int, per_cell: int = 80) -> DataFrame:
    """Stored and active cells, and bytes beside a dense grid."""
    return stored.agg(F.count("*").alias("n_stored"), F.count_if("is_active").alias("n_active")).withColumns(
        {"bytes": F.col("n_stored") * per_cell, "dense_bytes": F.lit(nx * ny * per_cell).cast("long"), "share": F.col("n_stored") / F.lit(float(nx * ny))}
    )


def regular(mesh: DataFrame) -> DataFrame:
    """Cells whose east neighbour is the modal distance away and whose north one is next."""
    far = F.col("ke") - F.col("k")
    stride = mesh.where("ke is not null").groupBy(far.alias("d")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", (-F.col("d")).alias("m"))).alias("x")).select((-F.col("x.m")).alias("stride"))
    return mesh.crossJoin(F.broadcast(stride)).select("k", "stride", F.coalesce((far == F.col("stride")) & (F.col("kn") - F.col("k") == 1), F.lit(False)).alias("regular"))


def encode(cells: DataFrame, value: str, most: int = 256) -> tuple[DataFrame, DataFrame]:
    """(cells with cls, table (cls, value)): a dictionary of at most ``most`` values."""
    seen = cells.select(value).distinct().limit(most + 1)
    if seen.count() > most:
        raise ValueError(f"more than {most} classes")
    table = seen.withColumn("cls", (F.row_number().over(Window.orderBy(value)) - 1).cast("int"))  # at most ``most`` rows
    return cells.join(F.broadcast(table), value), table


def check_classes(cells: DataFrame, table: DataFrame, cls: str = "cls") -> None:
    """Raise if a class has no row in the table or the table holds a value that isn't finite."""
    if cells.join(F.broadcast(table), cls, "left_anti").limit(1).count():
        raise ValueError("a cell's class is not in the table")
    bad = [c for c, kind in table.dtypes if kind in ("double", "float")]
    if bad and table.where(" or ".join(f"isnan({c}) or abs({c}) = double('infinity') or {c} is null" for c in bad)).limit(1).count():
        raise ValueError("the table holds a value that isn't finite")


def halo_rows(cells: DataFrame, nx: int, parts: int, width: int = 1) -> DataFrame:
    """(to, i, j, h): rows that each of ``parts`` strips along i sends to its neighbours, faces only."""
    size = -(-nx // parts)
    own = F.floor(F.col("i") / size).cast("int")
    at = F.col("i") % size
    send = F.array_compact(F.array(F.when(at < width, own - 1), F.when(at >= size - width, own + 1)))
    return cells.select(F.explode(send).alias("to"), "i", "j", "h").where(F.col("to").between(0, parts - 1))


def stitch(parts: list[DataFrame], nx: int, ny: int) -> DataFrame:
    """The parts of a grid as one table; a cell that is missing or there twice raises."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    told = out.agg(F.count("*").alias("n"), F.count_distinct("i", "j").alias("m")).first()
    if (told.n, told.m) != (nx * ny, nx * ny):
        raise ValueError(f"the parts hold {told.n} rows of {told.m} cells, the grid {nx * ny}")
    return out
