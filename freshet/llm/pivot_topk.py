"""Exact top-k inner products with a pivot-distance index (operator 1).

Method. Inner products become distances: with M the largest norm, x' = (x, sqrt(M^2 -
|x|^2)) and q' = (q, 0) give |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so the nearest x' has the
largest product. Vectors are keyed by (nearest pivot, ring of distance); a ring knows the
least and largest distance of its members to every pivot. For a query, the rings are
sorted by the lower bound that the triangle inequality gives, max over pivots of
max(0, d(q,p) - high, low - d(q,p)); rings are expanded in that order and the search
stops at the first ring whose bound exceeds the distance of the k-th best so far.

Scale. ``PIVOTS`` pivots are a bounded sample; ring statistics are at most PIVOTS *
RINGS rows and may be broadcast. Rings are split into blocks of about ``BLOCK`` vectors
and the queries of a ring into blocks too, so a ring with a third of all vectors is many
tasks of bounded memory. Round one scores each query's first rings and gives the k-th
best so far; round two visits only rings that the bound can't rule out. Every vector is
indexed, every answer is exact: bounds only save work, with slack for rounding.

Edge cases: vectors that are null, empty, or hold null or non-finite components take no
part, nor do vectors of another length than most (the shorter of equally frequent ones);
equal scores go to the smaller id, ids before rows without one. Every query row gets its
own answers: a repeated query row gets its answers once for each time, an id with two
vectors has answers for both. Rows with the query's id are no candidates for it; other
repeated rows are candidates each, and so are rows without vec_id (never queries). With
fewer than k candidates all are returned; empty tables give empty results. Scores are
exact within the range of longs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freshet.llm.common import cut, ddl, record, ship, slices

PIVOTS, RINGS, BLOCK, K = 16, 16, 2048, 5
_SLACK = 1e-6


def whole_vectors(table: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * component) of vectors that are complete."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        table.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0))
        .where(~bad)
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("v"))
    )


def _matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    """Rows of a list column whose lists have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(kind)


def _to_pivots(x: np.ndarray, pivots: np.ndarray, top2: float, query: bool) -> np.ndarray:
    """Distances of lifted rows to lifted pivots."""
    n2 = (x * x).sum(axis=1)
    lift = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, top2 - n2))
    p2 = (pivots * pivots).sum(axis=1)
    plift = np.sqrt(np.maximum(0, top2 - p2))
    d2 = n2[:, None] + lift[:, None] ** 2 + p2 + plift**2 - 2 * (x @ pivots.T) - 2 * lift[:, None] * plift
    return np.sqrt(np.maximum(0, d2))


def _best(scores: np.ndarray, ids: np.ndarray, none: np.ndarray, own: np.ndarray, k: int):
    """(query, candidate, score) of each query's k largest, ties to smaller ids, ids before none."""
    order = np.lexsort((ids, none))
    s, may = scores[:, order], (ids[order][None, :] != own[:, None]) | none[order][None, :]
    least = np.iinfo(np.int64).min if s.dtype == np.int64 else -np.inf
    s = np.where(may, s, least)
    kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] > k else np.full(len(s), least)
    q, c = np.nonzero((s >= kth[:, None]) & may)
    rank = np.lexsort((c, -s[q, c], q))
    q, c = q[rank], c[rank]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    q, c = q[place < k], c[place < k]
    return q, order[c], s[q, c]


def commonest_length(vectors: DataFrame) -> DataFrame:
    """The vectors whose length is the most frequent one, the shorter of equals."""
    top = vectors.groupBy(F.size("v").alias("s")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "s").first()
    return vectors.where(F.size("v") == (top.s if top else 0))


def pivot_sample(vectors: DataFrame, pivots: int) -> np.ndarray:
    """``pivots`` different vectors, the same on every run: those with the smallest hashes.

    Each task hands on its own smallest, so that vectors aren't shuffled.
    """

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            h = batch.column("h").to_numpy()
            for at in np.unique(h, return_index=True)[1][:pivots].tolist():
                held[int(h[at])] = batch.column("v")[at].as_py()
            held = dict(sorted(held.items())[:pivots])
        yield record({"h": pa.int64(), "v": pa.list_(pa.int64())}, (list(held), list(held.values())))

    rows = vectors.select(F.xxhash64("v").alias("h"), "v").mapInArrow(run, "h long, v array<long>")
    rows = rows.groupBy("h").agg(F.min("v").alias("v")).orderBy("h").limit(pivots).collect()
    return np.array([r.v for r in rows], dtype=np.float64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, pivots: int = PIVOTS, rings: int = RINGS, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest inner products of each query row."""
    spark = vectors.sparkSession
    ship(spark)
    schema = "query_id long, rank int, vec_id long, score long"
    vectors = cut(commonest_length(cut(vectors.select("vec_id", "v"))))
    stats = vectors.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("top2"), F.first(F.size("v")).alias("width")).first()
    if stats.top2 is None:
        return spark.createDataFrame([], schema)
    top2 = float(stats.top2)
    exact = np.float64 if top2 < 2.0**52 else np.int64  # products of doubles are whole below 2 ** 53
    slack = _SLACK * (1 + np.sqrt(top2))
    # each different query row once, under a number of its own
    asked = queries.where(F.col("vec_id").isNotNull() & (F.size("v") == stats.width)).groupBy("vec_id", "v").agg(F.count("*").alias("times"))
    asked = cut(asked.withColumn("qk", F.monotonically_increasing_id()))
    p = pivot_sample(vectors, pivots)
    n_p = len(p)
    width = max(1e-9, 2 * np.sqrt(top2) / rings)
    shared = spark.sparkContext.broadcast(p)

    def key(batches):
        for part in slices(batches, 4096):
            d = _to_pivots(_matrix(part.column("v")), shared.value, top2, False)
            near = d.argmin(axis=1)
            ring = near * rings + np.minimum(rings - 1, (d[np.arange(len(d)), near] / width).astype(np.int64))
            yield record({"ring": pa.int64(), "d": pa.list_(pa.float64())}, (ring, list(d)), {c: part.column(c) for c in ("vec_id", "v")})

    index = cut(vectors.mapInArrow(key, "vec_id long, v array<long>, ring long, d array<double>").withColumn("row", F.monotonically_increasing_id()))
    # least and largest distance of each ring to every pivot: at most pivots * rings rows
    told = index.groupBy("ring").agg(
        F.count("*").alias("n"), *[F.min(F.col("d")[i]).alias(f"a{i}") for i in range(n_p)], *[F.max(F.col("d")[i]).alias(f"b{i}") for i in range(n_p)]
    ).collect()
    ring_id = np.array([r.ring for r in told])
    count = np.array([r.n for r in told])
    low = np.array([[r[f"a{i}"] for i in range(n_p)] for r in told])
    high = np.array([[r[f"b{i}"] for i in range(n_p)] for r in told])
    parts = {int(r): int(-(-c // block)) for r, c in zip(ring_id, count)}
    known = spark.sparkContext.broadcast((ring_id, count, low, high))

    def bounds(x: np.ndarray) -> np.ndarray:
        d = _to_pivots(x, shared.value, top2, True)[:, None, :]
        _, _, lo, hi = known.value
        return np.maximum(0, np.maximum(d - hi, lo - d)).max(axis=2)

    def route(first: bool):
        """Which rings a query visits: at first the nearest with over k vectors, later the rest that its bound can't rule out."""

        def run(batches):
            rid, cnt, _, _ = known.value
            for part in slices(batches, 512):
                x = _matrix(part.column("v"))
                lb = bounds(x)
                order = np.argsort(lb, axis=1, kind="stable")
                before = np.cumsum(cnt[order], axis=1) - cnt[order]
                chosen = opening = before <= k  # in order, until over k vectors are seen
                if not first:
                    kth = part.column("kth").to_numpy(zero_copy_only=False).astype(np.float64)
                    far = np.sqrt(np.maximum(0, (x * x).sum(axis=1) + top2 - 2 * kth))
                    near = np.take_along_axis(lb, order, 1) <= (far * (1 + _SLACK) + slack)[:, None]
                    chosen = ~opening & (near | np.isnan(kth)[:, None])
                q, c = np.nonzero(chosen)
                at = pa.array(q)
                yield record({"ring": pa.int64()}, [rid[order[q, c]]], {n: part.column(n).take(at) for n in ("qk", "vec_id", "v")})

        return run

    fields = {"qk": pa.int64(), "vec_id": pa.int64(), "score": pa.int64()}

    def score(ask: pa.Table, held: pa.Table) -> pa.Table:
        out = []
        if ask.num_rows and held.num_rows:
            held, ask = held.combine_chunks(), ask.combine_chunks()
            column = held.column("vec_id").combine_chunks()
            none = column.is_null().to_numpy(zero_copy_only=False)
            ids, x = column.fill_null(0).to_numpy(), _matrix(held.column("v").combine_chunks(), exact)
            for at in range(0, ask.num_rows, 256):
                part = ask.slice(at, 256).combine_chunks()
                y = _matrix(part.column("v").combine_chunks(), exact)
                q, c, s = _best(y @ x.T, ids, none, part.column("vec_id").to_numpy(), k)
                out.append(record(fields, (part.column("qk").to_numpy()[q], column.take(pa.array(c)), s.astype(np.int64))))
        return pa.Table.from_batches(out, pa.schema(list(fields.items())))

    def visit(ask: DataFrame) -> DataFrame:
        """Blocks of queries meet blocks of vectors, ring by ring."""
        split = F.create_map(*[F.lit(x) for r, n in parts.items() for x in (r, n)])
        ask = cut(ask)
        many = {r.ring: r.n for r in ask.groupBy("ring").agg(F.count("*").alias("n")).collect()}  # a row for each ring
        if not many:
            return spark.createDataFrame([], ddl(fields))
        qparts = F.create_map(*[F.lit(x) for r, n in many.items() for x in (int(r), int(-(-n // block)))])
        a = ask.select("qk", "vec_id", "v", "ring", F.pmod(F.xxhash64("qk", F.lit(3)), qparts[F.col("ring")]).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), split[F.col("ring")] - 1)).alias("vb"))
        b = index.where(F.col("ring").isin(*many)).select(
            "vec_id", "v", "ring", F.pmod(F.xxhash64("row", F.lit(5)), split[F.col("ring")]).cast("int").alias("vb"), F.explode(F.sequence(F.lit(0), qparts[F.col("ring")] - 1)).alias("qb")
        )
        keys = ["ring", "vb", "qb"]
        return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(score, ddl(fields))

    opened = cut(visit(asked.select("qk", "vec_id", "v").mapInArrow(route(True), "qk long, vec_id long, v array<long>, ring long")))
    order = Window.partitionBy("qk").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    kth = opened.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select("qk", F.col("score").cast("double").alias("kth"))
    rest = visit(asked.join(kth, "qk", "left").select("qk", "vec_id", "v", "kth").mapInArrow(route(False), "qk long, vec_id long, v array<long>, ring long"))
    best = opened.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    told = asked.select("qk", F.col("vec_id").alias("query_id"), F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("time"))
    return told.join(best, "qk").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
