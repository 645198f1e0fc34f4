"""Repeated passages (operator 10): suffix automata of reference shards.

A word goes if it lies in a window of ``WINDOW`` words whose sequence also starts in a
document with a smaller id. All windows are judged on the input.

Method. Passages that may repeat are dealt out to shards; in each shard a suffix automaton
over words grows from the passages of ever larger ids. Each document's passages are
streamed through the automaton of all smaller ids for matching statistics, and words of
maximal matches of at least ``WINDOW`` words are removed. Broadcasting automata of the
whole corpus can't work: they grow with the input and every document would meet every
shard. So passages are routed, and every window meets all its equals in one shard. Hashes
only route: a hash that two different passages share costs work, never a result.

Routing.
1. Texts with the same words (by SHA-256) are copies. The one with the smallest id goes on;
   a later copy loses every word that lies in a window.
2. Anchors. Of the 6-grams of a window the one with the least hash is its anchor, so equal
   windows share an anchor. A window whose anchor occurs in one text only is not repeated:
   most of the text ends here. Repeated anchors go along as a filter of fixed size; over
   ``FILTER_KEYS`` of them are several passes, each with its share of the anchors.
3. Neighbouring windows with one anchor make a segment of at most WINDOW + span - 1 words.
   Equal segments (by a 128-bit digest) are added up to one with its smallest id; an
   occurrence in a later document is covered whole. Different segments of one anchor meet
   in one shard, where the automaton decides on their words. An anchor with over
   ``SPLIT`` different segments is cut up into its windows, which are joined on their words.

Scale. There is one plan at all sizes. Only texts that a filter of fixed size takes for
copies, or for texts that lose words, are shuffled. Counts and minima are added up before
shuffles. A shard has about ``REFERENCE`` words. Keys with many rows are joined where
their rows lie (``common.join_lowest``).

Edge cases: null or blank texts have no words; texts of under 13 words lose none; a
repeat inside one document counts only if a smaller id holds it too; rows that repeat a
doc_id are each judged against smaller ids only; rows without doc_id are left whole and
explain nothing; ids stay in Arrow and are exact over the whole range of longs; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import Marks, cut, ddl, join_lowest, map_texts, record, ship, slices, texts, written

WINDOW, GRAM = 13, 6
#: Words of a shard, different segments of an anchor before it is cut up, words hashed together.
REFERENCE, SPLIT, SLICE = 100_000, 2000, 200_000
#: Bytes hashed together.
BLOCK = 1 << 18
#: Repeated anchors for each pass.
FILTER_KEYS = 50_000_000
_ODD = [int(x) | 1 for x in np.random.default_rng(1313).integers(1, 1 << 63, 64, dtype=np.uint64)]
_SIGNS = np.random.default_rng(1314).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS = [np.empty(0, np.uint64)] * 2


def split(text: str) -> list[bytes]:
    """Words between ASCII blanks."""
    return text.encode("utf-8", "surrogatepass").split()


def sha(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def rolling(h: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` word hashes."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out += h[j : j + n] * np.uint64(_ODD[j + salt])
    out ^= out >> np.uint64(31)
    out *= np.uint64(_ODD[63])
    return out ^ (out >> np.uint64(29))


def anchors(grams: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` grams, the place of its least (the last of equals)."""
    least, place, width = grams, np.arange(len(grams)), 1
    while width < span:  # two runs of the width so far make a longer one
        step = min(width, span - width)
        n = len(least) - step
        lower = least[step:] <= least[:n]
        least, place = np.where(lower, least[step:], least[:n]), np.where(lower, place[step:], place[:n])
        width += step
    return place


class Automaton:
    """Suffix automaton that grows word by word (negative numbers: breaks that match nothing)."""

    def __init__(self, sequence=()):
        self.next, self.link, self.length, self.last = [{}], [-1], [0], 0
        self.add(sequence)

    def add(self, sequence) -> None:
        """Append a sequence of word numbers."""
        nxt, link, length, last = self.next, self.link, self.length, self.last
        for c in sequence:
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.last = last

    def matching(self, sequence) -> list[int]:
        """The length of the longest match that ends at each place."""
        nxt, link, length = self.next, self.link, self.length
        at, run, out = 0, 0, []
        for c in sequence:
            while at and c not in nxt[at]:
                at = link[at]
                run = length[at]
            if c in nxt[at]:
                at = nxt[at][c]
                run += 1
            else:
                run = 0
            out.append(run)
        return out


def covered(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """Maximal spans [begin, end) covered by matches of at least ``window`` words."""
    out: list[tuple[int, int]] = []
    for i, n in enumerate(lengths):
        if n >= window:
            b = i + 1 - n
            if out and b <= out[-1][1]:
                out[-1] = (min(out[-1][0], b), i + 1)
            else:
                out.append((b, i + 1))
    return out


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2 ** 64."""
    if len(_POWERS[0]) < n:
        _POWERS[:] = [np.cumprod(np.append(np.uint64(1), np.full(max(n, BLOCK) - 1, x, np.uint64))) for x in (_ODD[62], pow(_ODD[62], -1, 1 << 64))]
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(line: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, hash) of each word of a line of words joined by one space; about ``BLOCK`` bytes at a time."""
    signs = np.frombuffer(line, np.uint8)
    gaps = np.flatnonzero(signs == 32)
    begin, end = np.append(0, gaps + 1), np.append(gaps, len(signs))
    h, at = np.empty(len(begin), np.uint64), 0
    while at < len(begin):
        low = begin[at]
        stop = max(at + 1, int(np.searchsorted(end, low + BLOCK, "right")))
        up, down = _powers(int(end[stop - 1] - low) + 1)
        total = np.zeros(len(up), np.uint64)
        np.cumsum(_SIGNS[signs[low : end[stop - 1]]] * up[:-1], out=total[1:])
        b = begin[at:stop] - low
        h[at:stop] = (total[end[at:stop] - low] - total[b]) * down[b]
        at = stop
    h ^= h >> np.uint64(32)
    h *= np.uint64(_ODD[61])
    return begin, end, h ^ (h >> np.uint64(29))


def passages(lines: list[bytes], sizes: np.ndarray, window: int, gram: int):
    """Passages of texts, ``SLICE`` words or more at a time: (line, text, anchor, at, n, begin, end), all but the line as arrays.

    Texts are words joined by one space, and the number of their words. A passage is the
    words of neighbouring windows with one anchor, and never reaches over the end of a
    text: n words of a text from the word ``at`` on, the bytes from begin to end of a line.
    """
    span, cuts, total = window - gram + 1, [0], 0
    for i, n in enumerate(sizes.tolist()):
        total += n
        if total >= SLICE or i == len(sizes) - 1:
            cuts.append(i + 1)
            total = 0
    for low, high in zip(cuts, cuts[1:]):
        size = sizes[low:high]
        if size.sum() < window:
            continue
        line = b" ".join([x for x in lines[low:high] if x])
        begin, end, h = word_hashes(line)
        grams = rolling(h, gram)
        place = anchors(grams, span)
        text = np.repeat(np.arange(len(size)), size)
        starts = np.flatnonzero(text[: len(place)] == text[window - 1 :])
        if len(starts):
            new = np.flatnonzero(np.diff(place[starts], prepend=-1))
            first, last = starts[new], starts[np.append(new[1:], len(starts)) - 1] + window
            own = text[first]
            yield line, own + low, grams[place[first]], first - (np.cumsum(size) - size)[own], last - first, begin[first], end[last - 1]


def _key(digests: list[bytes]) -> np.ndarray:
    """64 bits of each digest."""
    return np.frombuffer(b"".join(d[:8] for d in digests), "<i8")


def profile(plain: DataFrame) -> DataFrame:
    """(doc_id, n_words, digest, dk): the words of each document, counted and digested; dk is 64 bits of the digest."""

    def start():
        def told(column):
            made = [(len(w), sha(w)) for w in map(split, column)]
            return [m[0] for m in made], [m[1] for m in made], _key([m[1] for m in made])

        return told

    return map_texts(plain, start, {"n_words": pa.int64(), "digest": pa.binary(), "dk": pa.int64()}, "doc_id")


def first_texts(plain: DataFrame, sized: DataFrame) -> tuple[DataFrame, Marks]:
    """(doc_id, text) of the first of each group of copies, and the filter that tells copies.

    sized (digest, dk, first, n) has a row for each group of several rows. Rows that the filter
    takes for copies by mistake are among the texts, too.
    """
    marks = Marks(sized.select(F.col("dk").alias("k")), sized.count())
    fields = {"digest": pa.binary()}

    def run(batches):
        for part in slices(batches):
            told = [sha(split(t)) for t in part.column("text").to_pylist()]
            hit = marks.hits(_key(told))
            yield record(fields, [told], {k: part.column(k) for k in ("doc_id", "text")}).filter(pa.array(hit))

    asked = plain.where("doc_id is not null").mapInArrow(run, "doc_id long, text string, digest binary")
    return written(asked.groupBy("digest").agg(F.min(F.struct("doc_id", "text")).alias("f")).select("f.*")), marks


def scanned(plain: DataFrame, firsts: DataFrame, marks: Marks, made, schema: str) -> DataFrame:
    """made(slices of texts) over the texts without copies and the first of those with copies.

    A slice is (doc_id, lines, sizes, dk): ids in Arrow, words joined by one space, their
    numbers, and 64 bits of their digests.
    """

    def read(alone: bool):
        def told(batches):
            for part in slices(batches):
                lists = [split(t) for t in part.column("text").to_pylist()]
                sizes, lines = np.array([len(w) for w in lists], np.int64), [b" ".join(w) for w in lists]
                ids, dk = part.column("doc_id"), _key([hashlib.sha256(x).digest() for x in lines])
                if alone:
                    left = np.flatnonzero(~marks.hits(dk))
                    ids, lines, sizes, dk = ids.take(pa.array(left, pa.int64())), [lines[i] for i in left.tolist()], sizes[left], dk[left]
                yield ids, lines, sizes, dk

        return lambda batches: made(told(batches))

    whole = plain.where("doc_id is not null").select("doc_id", "text").mapInArrow(read(True), schema)
    return whole.unionByName(firsts.select("doc_id", "text").mapInArrow(read(False), schema))


def anchor_rows(window: int, gram: int):
    """(a): the different anchors of each text."""

    def run(parts):
        for _, lines, sizes, _ in parts:
            for _, text, own, *_ in passages(lines, sizes, window, gram):
                order = np.lexsort((own, text))
                own, text = own[order], text[order]
                new = np.append(True, (own[1:] != own[:-1]) | (text[1:] != text[:-1]))
                yield record({"a": pa.int64()}, [own[new].view(np.int64)])

    return run


#: a: anchor; g: digest of the segment's words; dk: 64 bits of the digest of the document's words.
SEGMENT = {"a": pa.int64(), "g": pa.binary(), "dk": pa.int64(), "begin": pa.int64(), "n": pa.int32(), "words": pa.binary()}


def segment_rows(window: int, gram: int, marks: Marks, share: int, shares: int):
    """Segments of windows whose anchor passes the filter: (doc_id, *SEGMENT)."""

    def run(parts):
        for ids, lines, sizes, dk in parts:
            for line, text, own, at, n, begin, end in passages(lines, sizes, window, gram):
                hold = marks.hits(own.view(np.int64))
                if shares > 1:
                    hold &= own % np.uint64(shares) == share
                text, own = text[hold], own[hold]
                words = [line[b:e] for b, e in zip(begin[hold].tolist(), end[hold].tolist())]
                made = [own.view(np.int64), [xxhash.xxh3_128_digest(x) for x in words], dk[text], at[hold], n[hold].astype(np.int32), words]
                yield record(SEGMENT, made, {"doc_id": ids.take(pa.array(text, pa.int64()))})

    return run


def windows_of(segments: DataFrame, window: int) -> DataFrame:
    """(a, g, first, w, at): each window of segments (a, g, first, words), w being its words."""
    fields = {"w": pa.binary(), "at": pa.int32()}

    def run(batches):
        for part in slices(batches, 5000):
            rows, at = [], []
            for i, line in enumerate(part.column("words").to_pylist()):
                words = line.split()
                rows += [(b" ".join(words[b : b + window]), b) for b in range(len(words) - window + 1)]
                at += [i] * (len(words) - window + 1)
            at = pa.array(at, pa.int64())
            yield record(fields, list(zip(*rows)) or [[], []], {k: part.column(k).take(at) for k in ("a", "g", "first")})

    return segments.select("a", "g", "first", "words").mapInArrow(run, "a long, g binary, first long, " + ddl(fields))


SPAN = {"at": pa.int32(), "n": pa.int32()}


def explain(window: int):
    """For one shard (a, g, first, words): the spans that passages of smaller ids hold too, by segment."""

    def run(table: pa.Table) -> pa.Table:
        first, a = table.column("first").to_numpy(), table.column("a").to_numpy()
        # an anchor with one segment has nothing to explain it
        _, group, size = np.unique(a, return_inverse=True, return_counts=True)
        order = np.flatnonzero(size[group] > 1)
        order = order[np.argsort(first[order], kind="stable")]
        words = table.column("words").to_pylist()
        made, number, breaks = Automaton(), {}, 0
        at, found = [], []
        for ids in np.split(order, np.flatnonzero(np.diff(first[order])) + 1):
            own = [(k, [number.setdefault(w, len(number)) for w in words[k].split()]) for k in ids.tolist()]
            for k, line in own:
                for b, e in covered(made.matching(line), window):
                    at.append(k)
                    found.append((b, e - b))
            for _, line in own:
                breaks -= 1
                made.add(line)
                made.add((breaks,))
        return pa.Table.from_batches([record(SPAN, list(zip(*found)) or [[], []], {k: table.column(k).combine_chunks().take(pa.array(at, pa.int64())) for k in ("a", "g")})])

    return run


def repeated_spans(plain: DataFrame, firsts: DataFrame, marks: Marks, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, dk, begin, n): word spans of different texts that smaller ids hold too."""
    rows = scanned(plain, firsts, marks, anchor_rows(window, gram), "a long")
    often = cut(rows.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a"))
    many = often.count()
    shares = max(1, -(-many // FILTER_KEYS))
    found = None
    for k in range(shares):
        # a window's anchor falls in one share, so the passes divide the windows
        part = often if shares == 1 else often.where(F.expr(f"cast(cast(a as decimal(38,0)) + if(a < 0, 18446744073709551616, 0) as decimal(38,0)) % {shares}") == k)
        known = Marks(part.select(F.col("a").alias("k")), -(-many // shares))
        more = written(scanned(plain, firsts, marks, segment_rows(window, gram, known, k, shares), "doc_id long, " + ddl(SEGMENT)))
        found = more if found is None else found.unionByName(more)
    total = found.count()
    # equal segments once, with their smallest id
    unique = written(found.groupBy("a", "g").agg(F.min("doc_id").alias("first"), F.count("*").alias("times"), F.first("words").alias("words")))
    size = cut(unique.groupBy("a").agg(F.count("*").alias("many")).where(f"many > {SPLIT}"))
    words = unique.agg(F.coalesce(F.sum(F.lit(window + 4)), F.lit(0)).alias("n")).first().n
    shards = max(1, -(-words // REFERENCE))
    few = unique.join(size, "a", "left_anti").select("a", "g", "first", "words", F.pmod(F.xxhash64("a"), F.lit(shards)).alias("shard"))
    spans = few.groupBy("shard").applyInArrow(explain(window), "a long, g binary, " + ddl(SPAN))
    # windows of anchors with very many segments
    hot = written(windows_of(unique.join(size, "a", "left_semi"), window))
    least = cut(hot.groupBy("w").agg(F.min("first").alias("least"), F.max("first").alias("most"), F.count("*").alias("n")).where("least < most").select("w", "least", "n"))
    spans = spans.unionByName(join_lowest(hot, least, "w", hot.count()).where("least < first").select("a", "g", "at", F.lit(window).alias("n")))
    told = cut(spans.groupBy("a", "g").agg(F.collect_list(F.struct("at", "n")).alias("spans")))  # the words of one segment at most
    # what each occurrence loses: all of it in a later document, the spans in the first
    sized = written(unique.join(told, ["a", "g"], "left").where("times > 1 or spans is not null").select(F.struct("a", "g").alias("s"), "first", "spans", F.col("times").alias("n")))
    places = found.select(F.struct("a", "g").alias("s"), "doc_id", "dk", "begin", F.col("n").alias("size"))
    whole = F.array(F.struct(F.lit(0).alias("at"), F.col("size").alias("n")))
    lost = F.when(F.col("doc_id") > F.col("first"), whole).otherwise(F.col("spans"))
    return join_lowest(places, sized, "s", total).select("doc_id", "dk", "begin", F.explode(lost).alias("x")).select("doc_id", "dk", (F.col("begin") + F.col("x.at")).alias("begin"), F.col("x.n").alias("n"))


def _kept(words: list[bytes], spans) -> list[bytes]:
    gone = np.zeros(len(words) + 1, np.int64)
    for begin, n in spans:
        gone[begin] += 1
        gone[begin + n] -= 1
    return [w for w, g in zip(words, np.cumsum(gone)) if g == 0]


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every document."""
    ship(docs.sparkSession)
    plain = texts(docs)
    told = written(profile(plain))
    sized = cut(told.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.first("dk").alias("dk"), F.count("*").alias("n")).where("n > 1"))
    firsts, marks = first_texts(plain, sized)
    lists = repeated_spans(plain, firsts, marks, window, gram).groupBy("doc_id", "dk").agg(F.collect_list(F.struct("begin", "n")).alias("spans"))  # the words of one document at most
    lists = written(lists)
    # documents that lose words are read again, the others end with their digest
    known = Marks(lists.select(F.col("doc_id").bitwiseXOR(F.col("dk")).alias("k")), lists.count())
    made = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string()}

    def asked(batches):
        for part in slices(batches):
            dk = _key([sha(split(t)) for t in part.column("text").to_pylist()])
            yield record({"dk": pa.int64()}, [dk], {k: part.column(k) for k in ("doc_id", "text")}).filter(pa.array(known.hits(dk ^ part.column("doc_id").to_numpy())))

    def removed(batches):
        for part in slices(batches):
            rows = []
            for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                words = split(text)
                left = _kept(words, [(x["begin"], x["n"]) for x in spans])
                rows.append((len(words), len(words) - len(left), sha(left).hex()))
            yield record(made, list(zip(*rows)) or [[]] * 3, {"doc_id": part.column("doc_id")})

    again = plain.where("doc_id is not null").mapInArrow(asked, "doc_id long, text string, dk long")
    cutted = again.join(lists, ["doc_id", "dk"]).select("doc_id", "text", "spans").mapInArrow(removed, "doc_id long, " + ddl(made))
    rest = told.join(lists.select("doc_id", "dk"), ["doc_id", "dk"], "left_anti")
    copies = join_lowest(told.where("doc_id is not null"), sized.drop("dk"), "digest", told.count()).where((F.col("doc_id") > F.col("first")) & (F.col("n_words") >= window))
    copies = cut(copies.select("doc_id", "digest", F.lit(True).alias("copied")).distinct())
    out = rest.join(copies, ["doc_id", "digest"], "left")
    whole = out.select(
        "doc_id", "n_words",
        F.when(F.col("copied"), F.col("n_words")).otherwise(F.lit(0).cast("long")).alias("n_removed"),
        F.when(F.col("copied"), F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.lower(F.hex("digest"))).alias("kept_sha256"),
    )
    return whole.unionByName(cutted)
