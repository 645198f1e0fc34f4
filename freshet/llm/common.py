"""What the corpus operators share: typed views of a table, Arrow maps, checkpoints, joins on hot keys, graph components."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED = "freshet.shipped.application"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of an Arrow batch, and texts held as Python strings at a time.
BATCH, ROWS = 1000, 500
_DDL = {
    pa.bool_(): "boolean", pa.int32(): "int", pa.int64(): "long", pa.float64(): "double", pa.string(): "string", pa.binary(): "binary",
    pa.list_(pa.int32()): "array<int>", pa.list_(pa.int64()): "array<long>", pa.list_(pa.float64()): "array<double>",
}


_ARROW = {v: k for k, v in _DDL.items()} | {"struct<name:string,score:double>": pa.struct([("name", pa.string()), ("score", pa.float64())])}


def ship(spark: SparkSession) -> None:
    """Make this package importable on every executor (once per application).

    Spark's own file server carries the archive, so no shared folder is needed. Texts are
    long, so rows go to Python ``BATCH`` at a time unless the session says otherwise.
    """
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, BATCH)
    app = spark.sparkContext.applicationId
    if os.environ.get(_SHIPPED) == app:
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="freshet-"), "freshet_pkg.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    spark.sparkContext.addPyFile(target)
    os.environ[_SHIPPED] = app


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local one only where that is unset."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="freshet-ckpt-"))
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later stages reread files, so a lost executor costs nothing."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: like cut(), but columnar and compressed."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches, rows: int | None = None):
    """Arrow batches of at most ``rows`` rows (ROWS if not given)."""
    rows = rows or ROWS
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def ddl(fields: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{k} {_DDL[t]}" for k, t in fields.items())


def record(fields: dict[str, pa.DataType], made, kept: dict[str, pa.Array] | None = None) -> pa.RecordBatch:
    """A batch of Arrow columns as they are beside new ones, so that ids never leave Arrow."""
    new = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, t) for c, t in zip(made, fields.values())]
    kept = kept or {}
    return pa.RecordBatch.from_arrays([*kept.values(), *new], names=[*kept, *fields])


def map_texts(plain: DataFrame, start, fields: dict[str, pa.DataType], *keep: str, rows: int | None = None) -> DataFrame:
    """plain's columns ``keep``, untouched, beside columns made of its texts.

    ``start()`` runs once in each task and returns a function from a list of texts to a
    list of columns, one value for each text.
    """
    ship(plain.sparkSession)

    def run(batches):
        made = start()
        for part in slices(batches, rows):
            yield record(fields, made(part.column("text").to_pylist()), {k: part.column(k) for k in keep})

    plain = plain.select(*keep, "text")
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema if f.name in keep]
    return plain.mapInArrow(run, ", ".join([*kept, ddl(fields)]))


def told_texts(text, start, kind: str):
    """A column of values of ``kind`` that are made of a text column; null texts are empty.

    ``start()`` runs once in each task and returns a function from a list of texts to a
    list of values. Only the text goes to Python; rows and their other columns stay.
    """

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        made = start()
        for part in parts:
            out = []
            for at in range(0, len(part), ROWS):
                out += made([t or "" for t in part.slice(at, ROWS).to_pylist()])
            yield pa.array(out, _ARROW[kind])

    return F.arrow_udf(run, kind).asNondeterministic()(text.cast("string"))


def whole_rows(docs: DataFrame):
    """All columns of docs as one, so that no name can clash; select("row.*") undoes it."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, text, *keep) with null texts empty; rows without doc_id stay."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *[F.col(k) for k in keep],
    )


def fold_of(doc_id, folds: int):
    """crc32 of the decimal doc_id, modulo the number of folds."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % folds).cast("int")


#: A key is hot if it holds more than this share of the rows; so there are at most HOT such keys.
HOT, HOT_ROWS = 1000, 1000


def join_lowest(rows: DataFrame, sized: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with sized (key, n, more columns; a row for each key, n the rows that it has).

    Keys with more than 1 / HOT of the ``total`` rows are at most HOT and are joined by
    broadcast, where their rows stay dealt out as they are; the rest by a shuffle, in which
    no key is large.
    """
    most = max(HOT_ROWS, -(-total // HOT))
    if sized.where(F.col("n") > most).isEmpty():
        return rows.join(sized.drop("n"), key)
    hot = F.broadcast(sized.where(F.col("n") > most).drop("n"))
    rest = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(sized.where(F.col("n") <= most).drop("n"), key))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list (a, b), by large-star and small-star rounds.

    Returns (node, root): the smallest node id of each component, for nodes other than
    the root. Edges stay distributed; each round ends in a reliable checkpoint, and the
    only thing that reaches the driver is a count and a sum per round. Nodes with very many
    edges: minima meet edges through a key of their own, so that the join reads plain
    exchanges, which the engine splits where they are skewed. Self loops and repeated edges
    are allowed; an empty list gives an empty result. The rounds needed grow with the
    logarithm of the nodes; more than ``max_rounds`` raise RuntimeError.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = cut(e)
    seen = None
    key = F.col("u").bitwiseXOR(F.lit(1).cast("long"))
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(key.alias("k"), F.least("u", "m").alias("m"))
        large = both.withColumn("k", key).join(low, "k").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(key.alias("k"), "m")
        small = large.withColumn("k", key).join(low, "k")
        pair = F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        e = cut(small.select(F.explode(pair).alias("x")).select("x.u", "x.v").where("u <> v").distinct())
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        now = (now.n, now.s)
        if now == seen or now[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
    raise RuntimeError("components did not settle; raise max_rounds")


class Marks:
    """A filter of fixed size over 64-bit keys: a key that was put in always hits, few others do.

    The bits (at most 2 ** 28, 32 MB) are set in tasks by parts and go along as a broadcast.
    With more keys than bits nearly all keys hit, which costs work, never a result.
    """

    PIECES, MOST, LEAST = 64, 1 << 28, 1 << 20

    def __init__(self, keys: DataFrame, count: int):
        """keys (k long), about ``count`` of them."""
        spark, pieces = keys.sparkSession, self.PIECES
        bits = self.LEAST
        while bits < self.MOST and bits < 16 * count:
            bits *= 2
        size = bits // pieces
        place = self._place

        def run(batches):
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                piece, x, y = place(batch.column("k").to_numpy(), size)
                for p in np.unique(piece):
                    own = held.setdefault(int(p), np.zeros(size, bool))
                    own[x[piece == p]] = own[y[piece == p]] = True
            fields = {"p": pa.int32(), "b": pa.binary()}
            yield record(fields, (list(held), [np.packbits(v, bitorder="little").tobytes() for v in held.values()]))

        table = np.zeros((pieces, size // 8), np.uint8)
        mixed = F.col("k").bitwiseXOR(F.shiftleft("k", 23)).bitwiseXOR(F.shiftleft("k", 41))
        dealt = keys.select("k").repartition(pieces, F.shiftrightunsigned(mixed, 58).cast("int"))
        for r in dealt.mapInArrow(run, "p int, b binary").collect():  # PIECES rows of fixed size
            table[r.p] |= np.frombuffer(r.b, np.uint8)
        self.size, self.table = size, spark.sparkContext.broadcast(table)

    @staticmethod
    def _place(k: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Part of the filter and two places in it; keys may be least hashes, so their high bits are mixed."""
        k = np.asarray(k).view(np.uint64)
        k = k ^ (k << np.uint64(23)) ^ (k << np.uint64(41))
        other = (k ^ (k >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (k >> np.uint64(58)).astype(np.int64), ((k >> np.uint64(8)) % np.uint64(size)).astype(np.int64), ((other >> np.uint64(20)) % np.uint64(size)).astype(np.int64)

    def hits(self, k: np.ndarray) -> np.ndarray:
        """Whether each key (int64) may have been put in."""
        table = self.table.value
        piece, x, y = self._place(k, self.size)
        return (((table[piece, x >> 3] >> (x & 7)) & (table[piece, y >> 3] >> (y & 7)) & 1)).astype(bool)
