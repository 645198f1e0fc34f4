"""Benchmark decontamination (operator 3).

Method. Every window of a document as long as a benchmark item (in words) gets a 64-bit
SimHash of its shingles. Multi-index Hamming blocks find the items within ``RADIUS``:
with ``BLOCKS`` blocks, two fingerprints within the radius have a block within
RADIUS // BLOCKS, so probing every value that near in every block misses none. A
candidate counts if the exact weighted similarity of its shingles (sum of the smaller
counts over sum of the larger) reaches ``SIMILARITY``.

Windows that can't reach the similarity are passed over first, with no loss: a window of
as many shingles as its item needs 2s / (1 + s) of them among those of items that long.
The radius is wide: pairs of similarity 0.8 lie near distance 10, four deviations below.

Scale. Documents are read once and never shuffled. The benchmark goes along as a
broadcast in shards of at most ``SHARD`` items and ``SHARD_BYTES`` bytes; a larger one is
several passes over the documents, one after the other, none of which drops anything, so
a worker never holds more than one shard's index. Only hits leave the tasks.

Edge cases: words are runs of letters and digits, in lower case; items of under five
words are one shingle of all their words, items without words are ignored, equal items
under several ids are all reported; a document shorter than an item is one window; null
and empty texts have no hits; repeated rows repeat hits, rows without doc_id keep theirs,
and ids stay in Arrow; items without item_id are looked for and reported as null; an empty
table or benchmark gives no hits. The earliest of the best windows is reported for each
document and item.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import ddl, record, ship, slices, texts, told_texts, written

WORDS, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 20, 5
SHARD, SHARD_BYTES = 2000, 8_000_000
SLICE = 200_000
_WORD = re.compile(r"\w+")
_STEP = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]
HIT = {"item_id": pa.int64(), "start_word": pa.int64(), "n_words": pa.int32(), "hamming": pa.int32(), "similarity": pa.float64()}


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def word_hash(w: str) -> int:
    return xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))


def shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit mix of each run of ``width`` word hashes."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, width, np.uint64)
    for j in range(width):
        out += h[j : j + n] * np.uint64(_STEP[j])
    out ^= out >> np.uint64(29)
    out *= np.uint64(_STEP[1])
    return out ^ (out >> np.uint64(32))


def simhash(sh: np.ndarray) -> int:
    bits = np.unpackbits(sh.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(sh), bitorder="little").view("<u8")[0])


def similarity(a: list, b: list) -> float:
    """Weighted Jaccard of two lists of shingles."""
    x, y = Counter(a), Counter(b)
    both = sum((x & y).values())
    return both / (len(a) + len(b) - both)


class Index:
    """One shard of the benchmark: shingles, fingerprints and Hamming blocks."""

    def __init__(self, items: list[tuple[int, str]], width: int, least: float, radius: int, blocks: int):
        self.width, self.least, self.radius = width, least, radius
        self.items = []
        for item_id, text in items:
            w = words_of(text)
            if w:
                k = min(width, len(w))
                sh = shingle_hashes(np.array([word_hash(x) for x in w], np.uint64), k)
                self.items.append((item_id, len(w), k, self.grams(w, k), simhash(sh), sh))
        self.sizes: dict[int, list[int]] = {}
        self.member, self.quick, self.of_size = {}, {}, {}
        for k in {i[2] for i in self.items}:
            known = np.unique(np.concatenate([i[5] for i in self.items if i[2] == k]))
            quick = np.zeros(1 << 20, bool)
            quick[(known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            sizes = self.sizes[k] = sorted({i[1] for i in self.items if i[2] == k})
            of_size = np.zeros((len(known), len(sizes)), bool)
            for i in self.items:
                if i[2] == k:
                    of_size[np.searchsorted(known, i[5]), sizes.index(i[1])] = True
            self.member[k], self.quick[k], self.of_size[k] = known, quick, of_size
        edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
        self.cut = list(zip(edges, edges[1:]))
        self.probe, self.table = [], []
        for a, b in self.cut:
            bits = b - a
            near = [sum(1 << i for i in c) for n in range(radius // blocks + 1) for c in combinations(range(bits), n)]
            self.probe.append(np.array(near, np.int64))
            held: dict[int, list[int]] = {}
            for n, i in enumerate(self.items):
                held.setdefault((i[4] >> a) & ((1 << bits) - 1), []).append(n)
            there = np.zeros(1 << bits, bool)
            there[list(held)] = True
            self.table.append((there, held))

    @staticmethod
    def grams(w: list[str], k: int) -> list[tuple]:
        return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]

    def within(self, fp: int) -> set[int]:
        """Items that have a block near enough; holds all within the radius."""
        found: set[int] = set()
        for (a, b), near, (there, held) in zip(self.cut, self.probe, self.table):
            values = ((fp >> a) & ((1 << (b - a)) - 1)) ^ near
            for v in values[there[values]].tolist():
                found.update(held[v])
        return {n for n in found if (self.items[n][4] ^ fp).bit_count() <= self.radius}

    def hits(self, words: list[str], h: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """(item_id, start, words, hamming, similarity) of the best window for each item."""
        best: dict[int, tuple] = {}
        for k in self.member:
            sh = shingle_hashes(h, min(k, len(h)) or 1)
            if not len(sh):
                continue
            at = np.flatnonzero(self.quick[k][(sh & np.uint64((1 << 20) - 1)).astype(np.int64)])
            if not len(at):
                continue
            known = self.member[k]
            place = np.minimum(np.searchsorted(known, sh[at]), len(known) - 1)
            same = known[place] == sh[at]
            at, own = at[same], self.of_size[k][place[same]]
            counts = own.sum(axis=0)
            for c in np.flatnonzero(counts):
                size = self.sizes[k][c]
                whole = size - k + 1
                run = min(whole, len(sh))
                need = self.least / (1 + self.least) * (whole + run) - 1e-9
                if need > min(run, counts[c]):
                    continue
                seen = np.zeros(len(sh) + 1, np.int64)
                seen[at[own[:, c]] + 1] = 1
                seen = np.cumsum(seen)
                for s in np.flatnonzero(seen[run:] - seen[:-run] >= need).tolist():
                    fp = simhash(sh[s : s + run])
                    for n in self.within(fp):
                        item_id, length, kk, grams, other, _ = self.items[n]
                        if length == size and kk == k:
                            sim = similarity(self.grams(words[s : s + run + k - 1], k), grams)
                            if sim >= self.least - 1e-12 and (n not in best or sim > best[n][4]):
                                best[n] = (item_id, s, run + k - 1, (fp ^ other).bit_count(), sim)
        return list(best.values())


def item_shards(benchmark: DataFrame) -> list[DataFrame]:
    """The benchmark in parts of bounded size."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull()).distinct()
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    many = max(1, -(-2 * size.n // SHARD) if size.n > SHARD else 1, -(-2 * size.b // SHARD_BYTES) if size.b > SHARD_BYTES else 1)
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(many)) == k) for k in range(many)]


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WORDS, least: float = SIMILARITY, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, hamming, similarity), a row for each pair found."""
    spark = docs.sparkSession
    ship(spark)
    plain, out = texts(docs), None
    for part in item_shards(benchmark):
        shared = spark.sparkContext.broadcast([(r.item_id, r.text) for r in part.collect()])  # a bounded shard

        def run(batches, shared=shared):
            index = Index(shared.value, width, least, radius, blocks)
            for batch in slices(batches):
                told = found_in(batch.column("text").to_pylist(), index)
                at = pa.array([i for i, found in enumerate(told) for _ in found], pa.int64())
                yield record(HIT, list(zip(*[x for found in told for x in found])) or [[]] * len(HIT), {"doc_id": batch.column("doc_id").take(at)})

        found = plain.mapInArrow(run, "doc_id long, " + ddl(HIT))
        out = found if out is None else out.unionByName(found)
    return out


def found_in(column, index: Index) -> list[list[tuple]]:
    """The hits of each text, words hashed once for a group of texts."""
    out, group, n = [], [], 0
    for i, t in enumerate(column):
        group.append(words_of(t))
        n += len(group[-1])
        if n >= SLICE or i == len(column) - 1:
            flat = np.array([w for ws in group for w in ws], dtype=object)
            at, unique = pd.factorize(flat) if len(flat) else (np.empty(0, np.int64), [])
            h = np.array([word_hash(w) for w in unique], np.uint64)[at] if len(flat) else np.empty(0, np.uint64)
            start = 0
            for ws in group:
                out.append(index.hits(ws, h[start : start + len(ws)]))
                start += len(ws)
            group, n = [], 0
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, width: int = WORDS, least: float = SIMILARITY, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns and no shuffle.

    With several shards the rows left by each are written before the next one is read.
    """
    spark = docs.sparkSession
    ship(spark)
    for k, part in enumerate(item_shards(benchmark)):
        if k:
            docs = written(docs)
        shared = spark.sparkContext.broadcast([(r.item_id, r.text) for r in part.collect()])  # a bounded shard

        def start(shared=shared):
            index = Index(shared.value, width, least, radius, blocks)
            return lambda column: [not x for x in found_in(column, index)]

        docs = docs.where(told_texts(F.col("text"), start, "boolean"))
    return docs
