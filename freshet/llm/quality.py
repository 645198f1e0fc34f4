"""Quality classifier (operator 2): random indexing, pooling, a two-layer network.

Method. Every word falls in one of ``BUCKETS`` hashed buckets with a sparse ternary index
vector of ``DIM`` components. A bucket's context vector is the sum of the index vectors
of the words up to ``REACH`` places away, over the whole corpus (random indexing). A
document pools, over its words, the normalised context vectors (mean and spread), the
index vectors of word shapes ("A!", "a,", "|") and a few ratios. A network of two layers
in numpy, trained on labelled rows, gives a logit; a temperature fitted on rows that the
weights never saw calibrates it.

Scale. Context sums cover all documents: each task adds up its part and emits
``BUCKETS`` vectors in 64 pieces; pieces are added as streams, so memory is bounded by
the bucket count, not the input. The fitting sample is bounded by ``SAMPLE`` labelled
rows, the ones with the smallest hash of their id. What is broadcast is the context
table (``BUCKETS * DIM`` floats) and the network.

Edge cases: null or empty text pools to zeros and is scored like any other; labels that
are null are ignored, an id with several labels counts once for each different label, an
id with several texts is learned from one of them (the one whose features sort first);
without labels, or with labels of one kind, every score is the smoothed base rate; with
under five labelled rows the temperature stays 1; repeated rows and rows without doc_id
stay (the latter are not held out); ids stay in Arrow; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import ddl, fold_of, map_texts, record, ship, slices, texts

DIM, BUCKETS, REACH, NONZERO, PIECES = 48, 1 << 14, 2, 4, 64
SAMPLE, FOLDS, HELD_OUT, THRESHOLD = 8000, 5, 0, 0.3
SLICE = 400_000
_CORE, _NUM, _RUN = re.compile(r"[^\W_]+"), re.compile(r"\d+"), re.compile(r"(.)\1+")


def index_vectors(buckets: int, dim: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero components of each bucket's index vector."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, dim, (buckets, NONZERO)), rng.choice([-1.0, 1.0], (buckets, NONZERO))


PLACE, SIGN = index_vectors(BUCKETS, DIM)


def dense_index() -> np.ndarray:
    out = np.zeros((BUCKETS, DIM), np.float32)
    for k in range(NONZERO):
        np.add.at(out, (np.arange(BUCKETS), PLACE[:, k]), SIGN[:, k])
    return out


def _letters(word: str) -> str | None:
    """The shape of a word of letters in one case or with one capital, if it is one."""
    if word.isalpha():
        if word.islower():
            return "a"
        if word.isupper():
            return "A"
        if word[0].isupper() and word[1:].islower():
            return "Aa"
    return None


def shape(word: str) -> str:
    """Capitals, other letters and digits as A, a and 9; runs of one sign as one."""
    plain = _letters(word)
    if plain:
        return plain
    if not (word[-1].isalnum() or word[-2:-1] == word[-1]) and (plain := _letters(word[:-1])):
        return plain + word[-1]
    s = _NUM.sub("9", word)
    s = "".join(["A" if c.isupper() else "a" if c.isalpha() else c for c in s])
    return _RUN.sub(r"\1", s)[:6]


def _bucket(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) % BUCKETS


#: Words met by this worker with both their buckets in one number, at most KEPT.
_SEEN: dict[str, int] = {}
KEPT = 300_000


def buckets(word: str) -> int:
    """Bucket of a word's core (its first run of letters and digits, lower case) times BUCKETS, plus that of its shape."""
    made = _SEEN.get(word)
    if made is None:
        core = word.lower() if word.isalpha() else (m := _CORE.search(word)) and m.group().lower() or word
        made = _bucket(core) * BUCKETS + _bucket("\0" + shape(word))
        if len(_SEEN) >= KEPT:
            _SEEN.clear()
        _SEEN[word] = made
    return made


class Words:
    """Buckets of words and of their shapes, for a list of texts."""

    def __init__(self, items: list[list[str]]):
        flat = np.array([w for ws in items for w in ws], dtype=object)
        self.count = np.array([len(w) for w in items], dtype=np.int64)
        self.doc = np.repeat(np.arange(len(items)), self.count)
        at, unique = pd.factorize(flat) if len(flat) else (np.empty(0, np.int64), np.empty(0, object))
        both = np.fromiter(map(buckets, unique), np.int64, len(unique))[at]
        self.word, self.shape = both // BUCKETS, both % BUCKETS
        self.size = np.fromiter(map(len, unique), np.float32, len(unique))[at]


def context_sums(made: Words, total: np.ndarray) -> None:
    """Add to total (flat) the index vectors of each word's neighbours."""
    for d in range(1, REACH + 1):
        same = made.doc[:-d] == made.doc[d:]
        a, b = made.word[:-d][same], made.word[d:][same]
        for x, y in ((a, b), (b, a)):
            for k in range(NONZERO):
                total += np.bincount(x * DIM + PLACE[y, k], SIGN[y, k], BUCKETS * DIM)


def _groups(column, most: int = SLICE):
    """Lists of whole texts of about ``most`` words together, with places in the column."""
    held, at, n = [], [], 0
    for i, t in enumerate(column):
        w = t.split()
        held.append(w)
        at.append(i)
        n += len(w)
        if n >= most:
            yield at, held
            held, at, n = [], [], 0
    if held:
        yield at, held


def context_table(docs: DataFrame) -> np.ndarray:
    """(BUCKETS, DIM) normalised context vectors of the whole corpus."""
    ship(docs.sparkSession)
    step = BUCKETS // PIECES

    fields = {"piece": pa.int32(), "v": pa.binary()}

    def count(batches):
        total = np.zeros(BUCKETS * DIM)
        for part in slices(batches):
            for _, held in _groups(part.column("text").to_pylist()):
                context_sums(Words(held), total)
        part = total.astype(np.float32).reshape(PIECES, step * DIM)
        yield record(fields, (np.arange(PIECES, dtype=np.int32), [p.tobytes() for p in part]))

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for part in slices(batches, 64):
            for piece, v in zip(part.column("piece").to_pylist(), part.column("v").to_pylist()):
                x = np.frombuffer(v, np.float32)
                held[piece] = held[piece] + x if piece in held else x.astype(np.float64)
        yield record(fields, (list(held), [v.astype(np.float32).tobytes() for v in held.values()]))

    rows = texts(docs).select("text").mapInArrow(count, ddl(fields)).repartition(PIECES, "piece").mapInArrow(add, ddl(fields)).collect()
    table = np.zeros((PIECES, step * DIM), np.float32)
    for r in rows:  # one of PIECES rows each
        table[r.piece] += np.frombuffer(r.v, np.float32)
    table = table.reshape(BUCKETS, DIM)
    table = np.sign(table) * np.log1p(np.abs(table))
    return table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-6)


def pooled(items: list[list[str]], table: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """One row of features for each list of words."""
    made, n = Words(items), len(items)
    count = made.count.astype(np.float64)
    per = np.maximum(count, 1)[:, None]
    out = np.zeros((n, 3 * DIM + 6), np.float32)
    if len(made.word):
        end = 0
        for d, many in enumerate(made.count.tolist()):
            if not many:
                continue
            begin, end = end, end + many
            v = table[made.word[begin:end]]
            mean = v.sum(axis=0, dtype=np.float64) / many
            out[d, :DIM] = mean
            out[d, DIM : 2 * DIM] = np.sqrt(np.maximum(0, np.einsum("ij,ij->j", v, v) / many - mean**2))
            out[d, 2 * DIM : 3 * DIM] = shapes[made.shape[begin:end]].sum(axis=0) / many
        again = np.zeros(len(made.word))
        again[1:] = (made.word[1:] == made.word[:-1]) & (made.doc[1:] == made.doc[:-1])
        pairs = np.unique(made.doc * BUCKETS + made.word) // BUCKETS
        out[:, -1] = np.bincount(made.doc, again, n) / per[:, 0]
        out[:, -2] = np.bincount(pairs, minlength=n) / per[:, 0]
        out[:, -3] = np.bincount(made.doc, made.size, n) / per[:, 0] / 10
        shape_pairs = np.unique(made.doc * BUCKETS + made.shape) // BUCKETS
        out[:, -4] = np.bincount(shape_pairs, minlength=n) / per[:, 0]
    out[:, -5] = np.log1p(count) / 10
    out[:, -6] = count == 0
    return out


class Network:
    """Two layers, trained with Adam on the log loss; predicts calibrated probabilities."""

    def __init__(self, hidden: int = 32, seed: int = 5):
        self.hidden, self.seed, self.base, self.temperature, self.w = hidden, seed, None, 1.0, None

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-4) -> "Network":
        if len(np.unique(y)) < 2:
            self.base = float((y.sum() + 1) / (len(y) + 2))
            return self
        rng = np.random.default_rng(self.seed)
        order = rng.permutation(len(y))
        cal, fit = order[: len(y) // 5], order[len(y) // 5 :]
        self.mean, self.std = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-3
        z, t = self._scaled(x), y.astype(np.float64)
        d, h = z.shape[1], self.hidden
        w = [rng.normal(0, d**-0.5, (d, h)), np.zeros(h), rng.normal(0, h**-0.5, h), np.zeros(1)]
        m, v, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        for _ in range(epochs):
            shuffled = rng.permutation(fit)
            for at in range(0, len(shuffled), 128):
                b = shuffled[at : at + 128]
                a = np.maximum(0, z[b] @ w[0] + w[1])
                g = (1 / (1 + np.exp(-np.clip(a @ w[2] + w[3], -30, 30))) - t[b]) / len(b)
                back = np.outer(g, w[2]) * (a > 0)
                grads = [z[b].T @ back + decay * w[0], back.sum(axis=0), a.T @ g + decay * w[2], np.array([g.sum()])]
                step += 1
                for p, gr, mm, vv in zip(w, grads, m, v):
                    mm += 0.1 * (gr - mm)
                    vv += 0.001 * (gr * gr - vv)
                    p -= rate * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)
        self.w = w
        if not len(cal):
            return self
        logit, tc = self.logit(x[cal]), t[cal]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        loss = [np.mean(np.logaddexp(0, logit / g) - tc * logit / g) for g in grid]
        self.temperature = float(grid[int(np.argmin(loss))])
        return self

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.std, -8, 8).astype(np.float64)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(0, self._scaled(x) @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.base is not None:
            return np.full(len(x), self.base)
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))


def fit_quality(docs: DataFrame, labels: DataFrame, table: np.ndarray, sample: int = SAMPLE) -> Network:
    """A network from at most ``sample`` labelled rows that aren't held out."""
    spark = docs.sparkSession
    known = (
        labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_y"))
        .where(F.col("_id").isNotNull() & F.col("_y").isNotNull() & (fold_of(F.col("_id"), FOLDS) != HELD_OUT))
        .distinct().orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample)
    )
    both = texts(docs).join(F.broadcast(known), F.col("doc_id") == F.col("_id")).select("text", "_y", "doc_id")
    shared = spark.sparkContext.broadcast(table)

    def start():
        shapes = dense_index()

        def made(column):
            return [[r.tobytes() for _, held in _groups(column) for r in pooled(held, shared.value, shapes)]]

        return made

    found = map_texts(both, start, {"x": pa.binary()}, "doc_id", "_y")
    rows = found.groupBy("doc_id", "_y").agg(F.min("x").alias("x")).toPandas()  # at most ``sample`` rows
    rows = rows.sort_values(["doc_id", "_y"], kind="stable")
    x = np.stack([np.frombuffer(b, np.float32) for b in rows["x"]]) if len(rows) else np.zeros((0, 3 * DIM + 6), np.float32)
    return Network().fit(x, rows["_y"].to_numpy(dtype=np.int64))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    spark = docs.sparkSession
    ship(spark)
    table = context_table(docs)
    model = spark.sparkContext.broadcast((table, fit_quality(docs, labels, table, sample)))

    def start():
        shapes = dense_index()

        def scores(column):
            table_, net = model.value
            return [np.concatenate([net.score(pooled(held, table_, shapes)) for _, held in _groups(column)])]

        return scores

    made = map_texts(texts(docs), start, {"score": pa.float64()}, "doc_id")
    return made.select(
        "doc_id", F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
