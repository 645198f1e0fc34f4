"""Byte-pair encoding and decoding (operator 5) with the vocabulary file of a public tokenizer.

Method: each word is a doubly linked list of symbols; a heap holds the ranks of
adjacent mergeable pairs, stale entries are skipped when popped. Decoding concatenates
vocabulary strings. Words recur, so each Python worker keeps a bounded table of words
already encoded (cleared when full); memory does not grow with the input.

Files understood: JSON with an NFC, white-space and lower-case normalizer, a word
splitting pattern, byte-level symbols and an end-of-word suffix. Special tokens are
found in the raw text first, as the file's library does.

Edge cases: null text is empty; empty text has no ids and decodes to an empty string;
very long words cost n log n; other columns are ignored; repeated rows stay.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from freshet.llm.common import ship, texts

#: Unicode White_Space: what the file calls a blank.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNKS = re.compile(f"[^{_SPACE}]+")
#: Entries of each worker's tables, of words as they stand and of lower-case pieces.
WORDS_KEPT, PIECES_KEPT = 100_000, 150_000
#: Entries of the tables of counts, about 100 bytes each.
COUNTS_KEPT = 400_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = dict(zip(plain, map(chr, plain)))
    for b in range(256):
        shown.setdefault(b, chr(256 + len(shown) - len(plain)))
    return [shown[b] for b in range(256)]


class Counts(dict):
    """Numbers of tokens of chunks of text, kept as they are asked for; cleared when full."""

    def __init__(self, count, most: int):
        super().__init__()
        self.count, self.most = count, most

    def __missing__(self, chunk: str) -> int:
        n = self.count(chunk)
        if len(chunk) <= 48:
            if len(self) >= self.most:
                self.clear()
            self[chunk] = n
        return n


class Bpe:
    """Encoder and decoder built from a tokenizer file's content."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.strings = {i: s for s, i in [*self.ids.items(), *self.special.items()]}
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = (m if isinstance(m, (list, tuple)) else m.split(" ", 1) for m in model["merges"])
        by_id = [(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in pairs]
        self.pair = [(a << 32) | b for a, b, _ in by_id]
        self.made = [c for _, _, c in by_id]
        self.rank = {p: r for r, p in enumerate(self.pair)}
        self.shown = {i: str(i) for i in self.strings}
        self.pieces = regex.compile(data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        symbols = byte_symbols()
        self.first, self.last = [self.ids[c] for c in symbols], [self.ids[c + self.suffix] for c in symbols]
        self.pieces_kept: dict[str, tuple[str, str]] = {}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.kept: dict[str, tuple[str, str]] = {}
        self.counts = Counts(self._count_word, COUNTS_KEPT)
        self.piece_counts = Counts(lambda piece: len(self.merge(piece)), COUNTS_KEPT)

    def merge(self, piece: str) -> list[int]:
        """Ids of one pre-token, merged by rank and then by position.

        A heap entry is one integer, the rank above the position of the left symbol. An
        entry is stale if the two symbols there are no longer the pair of its rank.
        """
        first, last = self.first, self.last
        raw = piece.encode("utf-8", "surrogatepass")
        sym = [first[b] for b in raw]
        sym[-1] = last[raw[-1]]
        n = len(sym)
        right, left = [*range(1, n + 1)], [*range(-1, n - 1)]
        rank, pair, made = self.rank.get, self.pair, self.made
        heap = [(r << 32) | i for i, (a, b) in enumerate(zip(sym, sym[1:])) if (r := rank((a << 32) | b)) is not None]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            r, i = top >> 32, top & 0xFFFFFFFF
            j = right[i]
            if j >= n or (sym[i] << 32) | sym[j] != pair[r]:
                continue  # a neighbour was merged since this entry was pushed
            new = sym[i] = made[r]
            sym[j] = -1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if (r := rank((new << 32) | sym[k])) is not None:
                    heapq.heappush(heap, (r << 32) | i)
            k = left[i]
            if k >= 0 and (r := rank((sym[k] << 32) | new)) is not None:
                heapq.heappush(heap, (r << 32) | k)
        return [s for s in sym if s >= 0]

    def _piece(self, piece: str) -> tuple[str, str]:
        made = self.pieces_kept.get(piece)
        if made is None:
            ids, shown, strings = self.merge(piece), self.shown, self.strings
            made = " ".join([shown[i] for i in ids]), " ".join([strings[i] for i in ids])
            if len(piece) <= 48:
                if len(self.pieces_kept) >= PIECES_KEPT:
                    self.pieces_kept.clear()
                self.pieces_kept[piece] = made
        return made

    def _plain(self, chunk: str) -> str:
        plain = chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk)
        # letter by letter, so that a final sigma is no special case
        return plain.lower() if "\u03a3" not in plain else "".join([c.lower() for c in plain])

    def _word(self, chunk: str) -> tuple[str, str]:
        """Ids and vocabulary strings, each joined by blanks, of text without white space."""
        plain = self._plain(chunk)
        if plain.isalpha():
            made = self._piece(plain)
        elif plain[-1] in ",." and plain[:-1].isalpha():
            (a, b), (c, d) = self._piece(plain[:-1]), self._piece(plain[-1])
            made = f"{a} {c}", f"{b} {d}"
        else:
            parts = [self._piece(m) for m in self.pieces.findall(plain)]
            made = " ".join([p[0] for p in parts]), " ".join([p[1] for p in parts])
        if len(chunk) <= 48:
            if len(self.kept) >= WORDS_KEPT:
                self.kept.clear()
            self.kept[chunk] = made
        return made

    def coded(self, text: str) -> tuple[str, str]:
        """(decimal ids joined by blanks, decoded text)."""
        if self.split_special and "<|" in text:
            parts = [(str(self.special[p]), p) if p in self.special else self.coded_plain(p) for p in self.split_special.split(text)]
            parts = [p for p in parts if p[0]]
            return " ".join(p[0] for p in parts), " ".join(p[1] for p in parts)
        return self.coded_plain(text)

    def coded_plain(self, text: str) -> tuple[str, str]:
        kept, parts = self.kept, []
        for c in _CHUNKS.findall(text):
            made = kept.get(c)
            parts.append(made if made is not None else self._word(c))
        return " ".join([p[0] for p in parts]), " ".join([p[1] for p in parts])

    def count(self, text: str) -> int:
        """The number of ids of a text; counts of words and pieces are kept."""
        if self.split_special and "<|" in text:
            coded = self.coded(text)[0]
            return coded.count(" ") + 1 if coded else 0
        return sum(map(self.counts.__getitem__, _CHUNKS.findall(text)))

    def _count_word(self, chunk: str) -> int:
        """The number of ids of text without white space, without the ids."""
        plain, counts = self._plain(chunk), self.piece_counts
        if plain.isalpha():
            return counts[plain]
        if plain[-1] in ",." and plain[:-1].isalpha():
            return counts[plain[:-1]] + counts[plain[-1]]
        return sum(map(counts.__getitem__, self.pieces.findall(plain)))

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.coded(text)[0].split()]

    def decode(self, ids) -> str:
        return " ".join(self.strings[i] for i in ids)


def read_spec(path: str) -> str:
    """The vocabulary file as text, read once on the driver and sent along (about 1.7 MB)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


_MADE: dict[str, Bpe] = {}


def _encoder(spec) -> Bpe:
    """One encoder for each Python worker process."""
    key = spec.value
    digest = hashlib.sha256(key.encode()).hexdigest()
    if digest not in _MADE:
        _MADE[digest] = Bpe(key)
    return _MADE[digest]


#: Texts held as Python strings at a time.
ROWS = 500


def _sha(s: str) -> str:
    return hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()


def encode_documents(docs: DataFrame, path: str, *keep: str, rows: int = ROWS) -> DataFrame:
    """(doc_id, *keep, n_tokens, ids array<int>, decoded_sha256)."""
    spark = docs.sparkSession
    ship(spark)
    spec = spark.sparkContext.broadcast(read_spec(path))
    plain = texts(docs, *keep)

    def run(batches):
        bpe = _encoder(spec)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                made = [bpe.coded(t) for t in part.column("text").to_pylist()]
                ids = [np.array(m[0].split(), dtype=np.int32) for m in made]
                new = [pa.array([len(i) for i in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([_sha(m[1]) for m in made], pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("doc_id", *keep)] + new, ["doc_id", *keep, "n_tokens", "ids", "decoded_sha256"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.select("doc_id", *keep).schema)
    return plain.mapInArrow(run, f"{kept}, n_tokens long, ids array<int>, decoded_sha256 string")


def digest_documents(docs: DataFrame, path: str, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256); the lists stay in the worker."""
    spark = docs.sparkSession
    ship(spark)
    spec = spark.sparkContext.broadcast(read_spec(path))

    def run(batches):
        bpe = _encoder(spec)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                made = [bpe.coded(t) for t in part.column("text").to_pylist()]
                n = [m[0].count(" ") + 1 if m[0] else 0 for m in made]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array([_sha(m[0]) for m in made], pa.string()), pa.array([_sha(m[1]) for m in made], pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
