"""Language identification by rank-order n-gram profiles (operator 7).

Method: a profile is a language's ``TOP`` most frequent 1- to 3-grams of letters, in
order; a document's own profile is compared with each by the out-of-place distance (the
sum of rank differences, ``TOP`` for a gram that the profile lacks).

Scale. Counts of n-grams are added up inside each task, then by (language, gram), and
cut to the profiles before anything reaches the driver: ``TOP`` rows for each language.
Training and prediction each read the texts once, with no shuffle of texts. A long text
is counted in slices of words.

Edge cases: text that is null or has no letter is ``und`` with score 0; rows with a null
lang teach nothing; with no learned language every row is ``und``; ties between
languages go to the smaller name, ties between grams to the smaller gram; repeated rows
stay, other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freshet.llm.common import ddl, fold_of, map_texts, record, ship, slices, texts, told_texts, whole_rows

TOP, FOLDS, HELD_OUT, SLICE, LEAST = 300, 3, 1, 100_000, 0.1
_LETTERS = re.compile(r"[^\W\d_]+")
_PAD = ord("_")


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the 1- to 3-grams of padded lower-case words.

    A code packs up to three code points of 21 bits; grams lie within one padded word.
    """
    words = _LETTERS.findall(text.lower())
    found = []
    for at in range(0, len(words), SLICE):
        line = "_" + "_".join(words[at : at + SLICE]) + "_"
        c = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        pad = c == _PAD
        one = c[~pad]
        two = ((c[:-1] << 21) | c[1:])[~(pad[:-1] & pad[1:])]
        three = ((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])[~pad[1:-1]]
        found.append(np.unique(np.concatenate([one, two, three]), return_counts=True))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return found[0] if len(found) == 1 else added(found)


def added(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """The sum of several (codes, counts)."""
    codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return codes, np.bincount(at, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)


def ranked(codes: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The most frequent codes in order, ties by code."""
    if len(codes) > 4 * top:  # drop what can't be among the first
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.lexsort((codes, -counts))[:top]]


def profiles(docs: DataFrame, top: int = TOP) -> dict[str, np.ndarray]:
    """Each language's most frequent grams, from all rows of docs with text and lang."""
    ship(docs.sparkSession)

    fields = {"lang": pa.string(), "gram": pa.int64(), "n": pa.int64()}

    def count(batches):
        held: dict[str, list] = {}
        size = 0
        for part in slices(batches):
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                codes, n = gram_counts(text)
                if len(codes):
                    held.setdefault(lang, []).append((codes, n))
                    size += len(codes)
            if size > 2_000_000:
                held = {k: [added(v)] for k, v in held.items()}
                size = sum(len(v[0][0]) for v in held.values())
                if size > 1_000_000:  # hand on what has been counted so far
                    yield from rows(held)
                    held, size = {}, 0
        yield from rows(held)

    def rows(held):
        for lang, v in held.items():
            codes, n = added(v)
            yield record(fields, (pa.array([lang] * len(codes), pa.string()), codes, n))

    total = (
        texts(docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()), "lang").select("lang", "text")
        .mapInArrow(count, ddl(fields))
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = total.withColumn("r", rank).where(F.col("r") <= top).orderBy("lang", "r").collect()  # top rows a language
    found: dict[str, list[int]] = {}
    for r in rows:
        found.setdefault(r.lang, []).append(r.gram)
    return {k: np.array(v, dtype=np.int64) for k, v in found.items()}


def tables(known: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Names, all grams in order, and the rank of each gram by language (-1: none)."""
    names = sorted(known)
    grams = np.unique(np.concatenate([known[k] for k in names])) if names else np.empty(0, np.int64)
    rank = np.full((len(names), len(grams)), -1, np.int64)
    for i, k in enumerate(names):
        rank[i, np.searchsorted(grams, known[k])] = np.arange(len(known[k]))
    return names, grams, rank


def guess(text: str, names: list[str], grams: np.ndarray, rank: np.ndarray, top: int = TOP) -> tuple[str, float]:
    """(language, score): 1 - distance / largest possible distance."""
    own = ranked(*gram_counts(text), top)
    if not len(own) or not names:
        return "und", 0.0
    at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
    r = np.where(grams[at] == own, rank[:, at], -1)
    away = np.where(r >= 0, np.abs(r - np.arange(len(own))), top).sum(axis=1)
    best = int(np.argmin(away))
    return names[best], float(1 - away[best] / (top * len(own)))


def predict(docs: DataFrame, known: dict[str, np.ndarray], top: int = TOP) -> DataFrame:
    """(doc_id, lang_pred, score)."""
    made = docs.sparkSession.sparkContext.broadcast(tables(known))

    def start():
        return lambda column: zip(*[guess(t, *made.value, top) for t in column])

    return map_texts(texts(docs), start, {"lang_pred": pa.string(), "score": pa.float64()}, "doc_id")


def taught(docs: DataFrame, top: int = TOP) -> dict[str, np.ndarray]:
    """Profiles from the rows that aren't held out."""
    fold = fold_of(F.col("doc_id"), FOLDS)
    return profiles(docs.where(fold.isNull() | (fold != HELD_OUT)), top)


def identify(docs: DataFrame, top: int = TOP) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); learns only from rows that aren't held out."""
    made = predict(docs, taught(docs, top), top)
    return made.select("doc_id", F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, top: int = TOP, least: float = LEAST) -> DataFrame:
    """The rows of docs in a language that was found, with all their columns and no shuffle.

    A document goes if it is ``und`` or if its score is under ``least``: its grams are then
    nearly as far from the nearest profile as grams that no profile holds. Where ``lang`` is
    null it becomes the language found; a lang that was given stays. Null text is empty.
    """
    made = docs.sparkSession.sparkContext.broadcast(tables(taught(docs, top)))
    ship(docs.sparkSession)

    def start():
        return lambda column: [dict(zip(("name", "score"), guess(t, *made.value, top))) for t in column]

    told = docs.select(whole_rows(docs), told_texts(F.col("text"), start, "struct<name:string,score:double>").alias("t"))
    lang = F.coalesce(F.col("row.lang").cast("string"), F.col("t.name"))
    return told.where((F.col("t.name") != "und") & (F.col("t.score") >= least)).select(F.col("row").withField("lang", lang).alias("row")).select("row.*")
