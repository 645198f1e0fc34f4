"""SimHash near-duplicate components (operator 8).

Method: pigeonhole blocks. A 64-bit fingerprint is cut into ``BLOCKS`` pieces; two
fingerprints at a Hamming distance of at most ``RADIUS`` agree on at least
``BLOCKS - RADIUS`` whole pieces, so joining on every combination of that many pieces
misses no link. Distances are then verified inside each bucket.

The number of blocks grows with the number of fingerprints (``blocks_for``), so that keys
get longer as there are more to tell apart; every choice finds the same links.

Scale. Equal fingerprints collapse to one node first, so exact copies (a third of all
rows, say) cost one row. Buckets are read as sorted runs, never as one group in memory;
a bucket of more than ``CHUNK`` different fingerprints is dealt out as pairs of chunks.
Each task reports a spanning forest of the links it verified, not the links themselves,
which keeps what is shuffled in proportion to the nodes. Components come from
star-contraction rounds over checkpointed edges; nothing is collected.

Edge cases: null or blank texts have the fingerprint zero and link like any other;
repeated doc_ids give repeated rows; rows without doc_id keep their row, never name a
component that has another id, and have a null component_id if no row of their
fingerprint has an id; ids stay in Arrow and are exact over the whole range of longs; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import components, cut, map_texts, ship, texts, whole_rows

RADIUS, BLOCKS, CHUNK, SHINGLE, SEED = 4, 6, 4096, 4, 42
#: Ids that may be broadcast (about 24 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def shingles(text: str, width: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle of ``width`` words, A-Z lower-cased; repeated ones repeat."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, "<u8")
    line, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    last = ends[width - 1 :] if len(words) >= width else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[x:y], seed) for x, y in zip(begins[:n].tolist(), last.tolist())], dtype="<u8")


def majority(h: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        total += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str, width: int = SHINGLE, seed: int = SEED) -> int:
    """Majority bits of the XXH64 of each shingle of ``width`` words; zero without words."""
    h = shingles(text, width, seed)
    return majority(h) if len(h) else 0


def _sign(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def start():
        return lambda column: [[_sign(fingerprint(t, width)) for t in column]]

    return map_texts(texts(docs), start, {"fp": pa.int64()}, "doc_id")


def blocks_for(count: int) -> int:
    """Blocks for so many fingerprints: keys of 21 bits, 27 over 2 ** 24, 32 over 2 ** 30."""
    return BLOCKS + (count > 1 << 24) + (count > 1 << 30)


def block_masks(blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    """One mask for each combination of blocks - radius pieces."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    piece = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(piece, blocks - radius)]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index linked to each of n items."""
    lab = np.arange(n)
    while True:
        la, lb = lab[a], lab[b]
        low, new = np.minimum(la, lb), lab.copy()
        for at in (a, b, la, lb):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def _run_links(fp: np.ndarray, run: np.ndarray, radius: int):
    """Index pairs of a forest that spans the verified links inside runs of equal keys.

    Short runs are compared at every offset at once; in a long run each member is
    compared with those after it, and members already of one tree add nothing.
    """
    n = len(fp)
    end = np.searchsorted(run, run, side="right")
    length = end - np.searchsorted(run, run, side="left")
    out = []
    live = np.flatnonzero((length <= 64) & (np.arange(n) + 1 < end))
    for d in range(1, 64):
        if not len(live):
            break
        near = live[np.bitwise_count(fp[live] ^ fp[live + d]) <= radius]
        if len(near):
            out.append((near, near + d))
        live = live[live + d + 1 < end[live]]
    for s in np.unique(np.searchsorted(run, run[length > 64], side="left")):
        e = end[s]
        part, tree = fp[s:e], np.arange(e - s)
        for i in range(e - s - 1):
            near = np.flatnonzero(np.bitwise_count(part[i + 1 :] ^ part[i]) <= radius) + i + 1
            near = near[tree[near] != tree[i]]
            if len(near):
                others, first = np.unique(tree[near], return_index=True)
                out.append((np.full(len(others), s + i), s + near[first]))
                tree[np.isin(tree, others)] = tree[i]
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def _forest(pdf: pd.DataFrame, keys: list[str], radius: int) -> pd.DataFrame:
    """Star edges (a, b) between representatives, one at most for each node."""
    fp, rep = pdf["fp"].to_numpy().view(np.uint64), pdf["rep"].to_numpy()
    change = np.zeros(len(pdf), bool)
    for k in keys:
        v = pdf[k].to_numpy()
        change[1:] |= v[1:] != v[:-1]
    x, y = _run_links(fp, np.cumsum(change), radius)
    if not len(x):
        return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
    ids, at = np.unique(np.concatenate([rep[x], rep[y]]), return_inverse=True)
    root = _roots(len(ids), at[: len(x)], at[len(x) :])
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return pd.DataFrame({"a": ids[moved], "b": ids[root[moved]]})


def _scan(keys: list[str], radius: int, batch: int = 50_000):
    """Reads rows sorted by keys; holds at most one run beyond a batch."""

    def run(batches):
        held: list[pd.DataFrame] = []
        rows = 0
        for pdf in batches:
            held.append(pdf)
            rows += len(pdf)
            if rows < batch:
                continue
            all_ = pd.concat(held, ignore_index=True)
            last = all_[keys].iloc[-1]
            same = np.ones(len(all_), bool)
            for k in keys:
                same &= all_[k].to_numpy() == last[k]
            done, tail = all_[~same], all_[same]
            if len(done):
                yield _forest(done, keys, radius)
            held, rows = [tail.reset_index(drop=True)], len(tail)
        if held:
            yield _forest(pd.concat(held, ignore_index=True), keys, radius)

    return run


def link_forest(nodes: DataFrame, radius: int = RADIUS, blocks: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) that connect nodes (rep, fp) of different fingerprints within the radius."""
    ship(nodes.sparkSession)
    masks = [_sign(m) for m in block_masks(blocks or blocks_for(nodes.count()), radius)]
    keyed = nodes.select(
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("c", "m"), "fp", "rep"
    )
    counts = keyed.groupBy("c", "m").agg(F.count("*").alias("n")).where("n > 1")
    sized = keyed.join(counts, ["c", "m"])
    small = sized.where(F.col("n") <= chunk).repartition("c", "m").sortWithinPartitions("c", "m")
    parts = F.ceil(F.col("n") / F.lit(chunk)).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), parts).cast("int")
    big = (
        sized.where(F.col("n") > chunk)
        .select("c", "m", "fp", "rep", own.alias("i"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("j"))
        .select("c", "m", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), "fp", "rep")
        .repartition("c", "m", "p", "q")
        .sortWithinPartitions("c", "m", "p", "q")
    )
    schema = "a long, b long"
    return (
        small.select("c", "m", "fp", "rep").mapInPandas(_scan(["c", "m"], radius), schema)
        .unionByName(big.mapInPandas(_scan(["c", "m", "p", "q"], radius), schema))
        .distinct()
    )


def simhash_components(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every document."""
    marked = cut(fingerprints(docs, width))
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = components(link_forest(nodes.where("rep is not null"), radius, blocks))
    named = nodes.join(roots, nodes.rep == roots.node, "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return marked.join(named, "fp", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def text_digest(text):
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def keep_rows(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """One row of docs for each group of marked (doc_id, td, grp), td being the text's digest.

    It is the row with the smallest doc_id, then digest; of rows that repeat both, one
    stays. Rows without doc_id all stay. Up to ``BROADCAST_IDS`` rows to leave out are
    broadcast, more meet docs by a shuffle.
    """
    rows = cut(marked.where("doc_id is not null").groupBy("grp", "doc_id", "td").agg(F.count("*").alias("times")))
    first = cut(rows.groupBy("grp").agg(F.min(F.struct("doc_id", "td")).alias("f")))
    told = rows.join(first, "grp").select("doc_id", "td", (F.struct("doc_id", "td") != F.col("f")).alias("gone"), "times")
    told = cut(told.where("gone or times > 1").groupBy("doc_id", "td").agg(F.max("gone").alias("gone")))
    if told.count() <= BROADCAST_IDS:
        told = F.broadcast(told)
    plain = docs.select(whole_rows(docs), F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text")).alias("td"))
    seen = plain.join(told, ["doc_id", "td"], "left").where("gone is null or not gone")
    once = seen.where("gone is not null").dropDuplicates(["doc_id", "td"])
    return seen.where("gone is null").select("row.*").unionByName(once.select("row.*"))


def keep_one(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """One row of each group of near copies, the one with the smallest doc_id.

    Rows are told apart by doc_id and text: of an id with two texts each goes or stays with
    its own group. Of exact repeats one stays. Documents without doc_id are kept.
    """
    plain = texts(docs).select(text_digest(F.col("text")).alias("doc_id"), "text")
    marked = cut(fingerprints(plain, width).distinct().select(F.col("doc_id").alias("td"), "fp"))
    nodes = cut(marked.select("fp", F.col("fp").alias("rep")).distinct())
    roots = components(link_forest(nodes, radius, blocks))
    named = marked.join(roots, marked.fp == roots.node, "left").select("td", F.coalesce("root", "fp").alias("grp"))
    rows = texts(docs).select("doc_id", text_digest(F.col("text")).alias("td"))
    return keep_rows(docs, rows.join(named, "td"))
