"""Near copies by shingle similarity (the pipeline's near-dedup stage).

Two documents are near copies if the sets of their shingles of ``WORDS`` words (the words
of ``simhash_dedup.fingerprint``) have a Jaccard similarity of at least ``SIMILARITY``;
groups are the connected components of that relation.

Method: SimHash. Documents with equal sets are one node, with a fingerprint of ``BITS``
bits: for each bit, what the majority of the set's shingle hashes have. Fingerprints of 64
bits can't tell this similarity: pairs at 0.8 differ in 15 % of the bits, so blocks that such
a pair shares are short. Of 256 bits it differs in 39 +- 6, others in 128 +- 8. Nodes are
candidates if they agree in one of ``KEYS`` samples of ``KEY_BITS`` bits and, within it, in
one of ``CELLS`` samples of ``CELL_BITS`` further bits, and lie within ``RADIUS``; the exact
similarity of each candidate pair decides. Of 12,000 random pairs at 0.8 in sets of 9 to 300
shingles all met; by the expected numbers about one in 1e5 does not, and of sets under 8
shingles about two in 1e4.

Scale. A node goes to the task of each of its keys as 44 packed bytes; cells are found there
in memory, and a task reports a spanning forest of its candidates, not the pairs. The sets of
nodes with candidates alone are written, and go by components of candidates to tasks that
compare all candidate pairs of different groups in memory and again report a forest; so
what is shuffled grows with the nodes, not with the pairs of a large group. Components whose
sets hold more than ``WEIGHT`` hashes are dealt out as pairs of parts: each set is sent once
for each part. Nothing is left out. Exact copies cost one node. Nothing is collected.

Edge cases: texts of under five words are one shingle, so only equal ones match; null and
blank texts form one group; rows without doc_id stay, whatever they resemble, and still
link others; repeated rows leave one; an empty table gives an empty one; columns of docs
may have any name and all stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import components, map_texts, record, ship, texts, written
from freshet.llm.simhash_dedup import BROADCAST_IDS, _roots, _sign, keep_rows, shingles, text_digest

WORDS, SIMILARITY, RADIUS, BITS = 5, 0.8, 64, 256
#: Sets of fewer shingles have less even majorities; their radius is wider.
SHORT, WIDER = 8, 16
#: Keys of a node and their bits; cells within a key and theirs.
KEYS, KEY_BITS, CELLS, CELL_BITS = 32, 6, 16, 10
#: Nodes that are packed at a time, and distances held at a time.
PACKED, HELD = 20_000, 1 << 18
#: Longer runs of a cell are compared as a whole.
SHORT_RUN = 24
#: Hashes of sets that a task compares at a time, and about those of small components dealt together.
WEIGHT, TOGETHER = 4_000_000, 500_000

_LONGS = BITS // 64
_RNG = np.random.default_rng(11)
_ODD = _RNG.integers(0, 1 << 63, (2, _LONGS), np.uint64) * np.uint64(2) + np.uint64(1)
_DEALT = [_RNG.permutation(BITS) for _ in range(KEYS)]
_KEY = [p[:KEY_BITS] for p in _DEALT]
_CELL = [[_RNG.choice(p[KEY_BITS:], CELL_BITS, replace=False) for _ in range(CELLS)] for p in _DEALT]
_ENTRY = np.dtype([("fp", "<u8", (_LONGS,)), ("node", "<i8"), ("n", "<i4")])


def fingerprint(sh: np.ndarray) -> bytes:
    """SimHash of a set of shingle hashes, the bits that more than half of their mixtures have; zero without any."""
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(sh), 255):  # a byte holds the sum of 255 bits
        x = sh[at : at + 255, None]
        x = (x ^ (x >> np.uint64(31))) * _ODD[0]
        x = (x ^ (x >> np.uint64(29))) * _ODD[1]
        x ^= x >> np.uint64(32)
        total += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * total > len(sh), bitorder="little").tobytes()


def shingle_set(text: str, width: int = WORDS) -> np.ndarray:
    return np.unique(shingles(text, width))


def signatures(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """(doc_id, td, node, n, fp): a row for each document; node names its set of n shingles."""

    def one(text: str) -> tuple:
        own = shingle_set(text, width)
        return _sign(xxhash.xxh64_intdigest(own.tobytes())), len(own), fingerprint(own)

    def start():
        return lambda column: zip(*map(one, column))

    fields = {"node": pa.int64(), "n": pa.int32(), "fp": pa.binary()}
    return map_texts(texts(docs).withColumn("td", text_digest(F.col("text"))), start, fields, "doc_id", "td")


def sets_of(docs: DataFrame, reps: DataFrame, width: int = WORDS) -> DataFrame:
    """reps (node, id, td and more columns), each of which names a row of docs, with its set sh, as a table."""

    def start():
        return lambda column: [pa.array([shingle_set(t, width).view(np.int64) for t in column], pa.list_(pa.int64()))]

    count, kept = reps.count(), [c for c in reps.columns if c not in ("id", "td")]
    if count <= BROADCAST_IDS:
        reps = F.broadcast(reps)
    plain = texts(docs).select(F.coalesce("doc_id", F.lit(-1)).alias("id"), text_digest(F.col("text")).alias("td"), "text")
    sets = written(map_texts(plain.join(reps, ["id", "td"]), start, {"sh": pa.list_(pa.int64())}, *kept))
    return sets if sets.count() == count else sets.dropDuplicates(["node"])  # rows of docs may repeat


def _sampled(fp: np.ndarray, places) -> np.ndarray:
    """The bits at some places of each fingerprint, as a number."""
    out = np.zeros(len(fp), np.int64)
    for p in places:
        out = (out << 1) | ((fp[:, p // 64] >> np.uint64(p % 64)) & np.uint64(1)).astype(np.int64)
    return out


def _distance(a: list[np.ndarray], b: list[np.ndarray], i=slice(None), j=slice(None)) -> np.ndarray:
    """Hamming distances of fingerprints given word by word."""
    far = np.bitwise_count(a[0][i] ^ b[0][j]).astype(np.uint16)
    for x, y in zip(a[1:], b[1:]):
        far += np.bitwise_count(x[i] ^ y[j])
    return far


def _alike(n, m, far, least: float, radius: int):
    """Whether sets of n and m shingles at a distance may reach the similarity."""
    low = np.minimum(n, m)
    return (far <= radius + WIDER * (low < SHORT)) & (low >= least * np.maximum(n, m) - 1e-9)


class Held:
    """The nodes that share a key, and the trees of candidates found among them."""

    def __init__(self, entries: np.ndarray, key: int, least: float = SIMILARITY, radius: int = RADIUS):
        self.key, self.least, self.radius = key, least, radius
        self.fp, self.node, self.n = np.ascontiguousarray(entries["fp"]), entries["node"].copy(), entries["n"].astype(np.float64)
        self.words = [self.fp[:, k].copy() for k in range(_LONGS)]
        self.tree = np.arange(len(self.node))

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        """Candidates among the index pairs become one tree."""
        ok = self.tree[i] != self.tree[j]
        i, j = i[ok], j[ok]
        ok = _alike(self.n[i], self.n[j], _distance(self.words, self.words, i, j), self.least, self.radius)
        if ok.any():
            held = np.flatnonzero(self.tree != np.arange(len(self.tree)))
            self.tree = _roots(len(self.tree), np.concatenate([i[ok], held]), np.concatenate([j[ok], self.tree[held]]))

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        """Node ids (a, b) that connect all candidates that share a cell."""
        m = len(self.node)
        for places in _CELL[self.key] if m > 1 else ():
            cell = _sampled(self.fp, places).astype(np.uint16)
            order = np.argsort(cell, kind="stable")
            starts = np.concatenate(([0], np.flatnonzero(np.diff(cell[order])) + 1, [m]))
            length = np.diff(starts)
            end, short = np.repeat(starts[1:], length), np.repeat(length <= SHORT_RUN, length)
            live = np.flatnonzero(short & (np.arange(m) + 1 < end))
            for d in range(1, SHORT_RUN):
                if not len(live):
                    break
                self.join(order[live], order[live + d])
                live = live[live + d + 1 < end[live]]
            for k in np.flatnonzero(length > SHORT_RUN):
                self._join_run(order[starts[k] : starts[k + 1]])
        moved = np.flatnonzero(self.tree != np.arange(m))
        return self.node[moved], self.node[self.tree[moved]]

    def _join_run(self, run: np.ndarray) -> None:
        """Members outside the largest tree of a long run are compared with all of it."""
        trees, at, sizes = np.unique(self.tree[run], return_inverse=True, return_counts=True)
        asked, step = run[at != np.argmax(sizes)], max(1, HELD // len(run))
        whole = [w[run][None, :] for w in self.words]
        for at in range(0, len(asked), step):
            own = asked[at : at + step]
            x, y = np.nonzero(_distance([w[own][:, None] for w in self.words], whole) <= self.radius + WIDER)
            self.join(own[x], run[y])


def linked(fp: np.ndarray, node: np.ndarray, values: np.ndarray, offsets: np.ndarray, least: float = SIMILARITY, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Pairs of nodes that connect all candidates whose sets reach the similarity.

    The sets are slices of values. Each node is compared with those after it that are not
    yet of its group.
    """
    words, n, out = [fp[:, k].copy() for k in range(_LONGS)], np.diff(offsets), []
    names, ids = np.unique(values, return_inverse=True)
    own, tree = np.zeros(len(names), bool), np.arange(len(node))
    for i in range(len(node) - 1):
        later = np.flatnonzero(tree[i + 1 :] != tree[i]) + i + 1
        later = later[_alike(n[i], n[later], _distance(words, words, slice(i, i + 1), later), least, radius)]
        if not len(later):
            continue
        mine = ids[offsets[i] : offsets[i + 1]]
        own[mine] = True
        begins = np.concatenate(([0], np.cumsum(n[later])[:-1]))
        both = np.add.reduceat(own[np.concatenate([ids[offsets[j] : offsets[j + 1]] for j in later])], begins, dtype=np.int64)
        own[mine] = False
        later = later[both >= least * (n[i] + n[later] - both) - 1e-9]
        if len(later):
            others, first = np.unique(tree[later], return_index=True)
            out += [(int(node[i]), int(node[j])) for j in later[first]]
            tree[np.isin(tree, others)] = tree[i]
    return out


def dealt(nodes: DataFrame) -> DataFrame:
    """(k, rows): the nodes (node, n, fp) of each key, packed."""

    def packed(batches) -> pa.RecordBatch:
        part = pa.Table.from_batches(batches)
        e = np.zeros(part.num_rows, _ENTRY)
        e["fp"] = np.frombuffer(b"".join(part.column("fp").to_pylist()), "<u8").reshape(-1, _LONGS)
        for c in ("node", "n"):
            e[c] = part.column(c).to_numpy()
        names, rows = [], []
        for key in range(KEYS):
            value = _sampled(e["fp"], _KEY[key])
            order = np.argsort(value, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(value[order])) + 1):
                names.append((key << KEY_BITS) | int(value[own[0]]))
                rows.append(e[own].tobytes())
        return record({"k": pa.int32(), "rows": pa.binary()}, (names, rows))

    def run(batches):
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= PACKED:
                yield packed(held)
                held, count = [], 0
        if count:
            yield packed(held)

    return nodes.select("node", "n", "fp").mapInArrow(run, "k int, rows binary")


def candidates(nodes: DataFrame, least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect all candidates of nodes (node, n, fp)."""

    def run(table: pa.Table) -> pa.Table:
        entries = np.frombuffer(b"".join(table.column("rows").to_pylist()), _ENTRY)
        held = Held(entries, table.column("k")[0].as_py() >> KEY_BITS, least, radius)
        return pa.Table.from_batches([record({"a": pa.int64(), "b": pa.int64()}, held.forest())])

    return dealt(nodes).groupBy("k").applyInArrow(run, "a long, b long")


def links(sets: DataFrame, buckets: int, least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect nodes of similar sets (node, root, parts, fp, sh), all of which are compared within roots."""

    def run(table: pa.Table) -> pa.Table:
        out, root = [], table.column("root").to_numpy()
        order = np.argsort(root, kind="stable")
        table, root = table.take(pa.array(order)), root[order]
        fp = np.frombuffer(b"".join(table.column("fp").to_pylist()), "<u8").reshape(-1, _LONGS)
        node, sh = table.column("node").to_numpy(), table.column("sh")
        values = sh.combine_chunks().flatten().to_numpy()
        offsets = np.concatenate(([0], np.cumsum(pc.list_value_length(sh).to_numpy())))
        starts = [0, *(np.flatnonzero(np.diff(root)) + 1).tolist(), len(root)]
        for s, e in zip(starts, starts[1:]):
            out += linked(fp[s:e], node[s:e], values[offsets[s] : offsets[e]], offsets[s : e + 1] - offsets[s], least, radius)
        return pa.Table.from_batches([record({"a": pa.int64(), "b": pa.int64()}, ([x for x, _ in out], [y for _, y in out]))])

    own = F.pmod(F.xxhash64("node", F.lit(5)), F.col("parts"))
    place = F.when(F.col("parts") > 1, F.col("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(buckets)))
    parts = sets.withColumn("i", own).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    keyed = parts.select(place.alias("k"), F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), "node", "root", "fp", "sh")
    return keyed.groupBy("k", "p", "q").applyInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, width: int = WORDS, least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, td, grp): a row for each document, with its text's digest and its group."""
    ship(docs.sparkSession)
    marked = written(signatures(docs, width))
    rep = F.min(F.struct(F.coalesce("doc_id", F.lit(-1)).alias("id"), "td")).alias("r")
    nodes = written(marked.groupBy("node").agg(rep, F.first("n").alias("n"), F.first("fp").alias("fp")))

    met = components(candidates(nodes.where("n > 0"), least, radius))
    met = met.unionByName(met.select(F.col("root").alias("node"), "root").distinct())
    asked = written(nodes.join(met, "node").select("node", "r.id", "r.td", "n", "fp", "root"))
    sized = written(asked.groupBy("root").agg(F.sum("n").alias("weight")))
    told = sized.select("root", F.ceil(F.col("weight") / F.lit(WEIGHT)).cast("long").alias("parts"))
    buckets = 16 + (sized.agg(F.sum("weight")).first()[0] or 0) // TOGETHER
    roots = components(links(sets_of(docs, written(asked.join(told, "root").drop("n")), width), buckets, least, radius))
    named = roots.withColumnRenamed("root", "_r")
    return marked.select("doc_id", "td", "node").join(named, "node", "left").select("doc_id", "td", F.coalesce("_r", "node").alias("grp"))


def keep_one(docs: DataFrame, width: int = WORDS, least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """One row of each group of near copies, the one with the smallest doc_id."""
    return keep_rows(docs, near_groups(docs, width, least, radius))
