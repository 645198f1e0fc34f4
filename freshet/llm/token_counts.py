"""Token counts kept by deltas (operator 6).

A change feed of signed rows (insert: +n, delete: -n, revise: new - old) is added up by
source, language and tokenizer version; totals are the sum of all committed batches.
Versions are public tokenizers: vocabulary files, counted with this package's byte-pair
encoder (.json) or with tiktoken (.tiktoken).

Commits are idempotent. A batch is first written aside, then renamed to its place in one
step that fails if the place is taken, so of two writers one succeeds and a batch that is
sent again counts once. A batch that was never renamed is not seen. ``compact`` adds up
what is committed into a snapshot that also lists its batches, published by the same kind
of rename; totals read the newest snapshot and the batches it doesn't list.

Scale. Texts are read once, without a shuffle; each batch is one map-side aggregation:
what is shuffled and stored is a row for each (source, language, version), however many
documents change. Nothing is collected but names of batches since the last snapshot.

Edge cases: null text counts no tokens; null source or lang form groups of their own;
empty batches commit as empty; repeated rows count each time, rows without doc_id count
like others; very long texts are counted whole; other columns are ignored; groups whose
documents are all gone disappear from the totals.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm import bpe
from freshet.llm.common import checkpoint_root, map_texts, ship, texts, written

KEYS = ["source", "lang", "version"]
#: Files of the query's tokenizer versions.
VERSIONS = ["word_bpe_49k.json", "byte_bpe_50k.tiktoken"]
_TOTALS = "source string, lang string, version string, docs long, tokens long"


class Ranks:
    """Counts the tokens of a byte-level vocabulary given as ranks; keeps the counts of chunks it met.

    A chunk is a run without white space, with the blank before it; runs of white space
    stand alone but for that blank. No piece of the pattern crosses the edge of a chunk.
    """

    KEPT = 400_000
    #: Those of the pattern's white space: Unicode White_Space, as the pattern's library has it.
    CHUNKS = re.compile(" ?[^{0}]+|[{0}]+(?![^{0}])|[{0}]".format("\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"))

    def __init__(self, spec: str, pattern: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in spec.splitlines() if line.strip())}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.kept = bpe.Counts(lambda chunk: len(self.encoding.encode_ordinary(chunk)), self.KEPT)

    def count(self, text: str) -> int:
        return sum(map(self.kept.__getitem__, self.CHUNKS.findall(text)))


_MADE: dict[str, object] = {}


def counter(name: str, spec: str, pattern: str):
    """The counting function of a version, made once for each Python worker."""
    key = f"{name}:{hashlib.sha256((pattern + spec).encode()).hexdigest()}"
    if key not in _MADE:
        _MADE[key] = Ranks(spec, pattern) if name.endswith(".tiktoken") else bpe.Bpe(spec)
    return _MADE[key].count


def counted(docs: DataFrame, versions: list[str] | None = None) -> DataFrame:
    """(doc_id, source, lang, version, n_tokens): a row for each document and tokenizer."""
    import public_tokenizers

    spark = docs.sparkSession
    ship(spark)
    names = VERSIONS if versions is None else versions
    specs = spark.sparkContext.broadcast([(n, bpe.read_spec(public_tokenizers.path(n)), public_tokenizers.PATTERN) for n in names])  # vocabulary files
    fields = {f"n{k}": pa.int64() for k in range(len(names))}

    def start():
        counts = [counter(*s) for s in specs.value]
        return lambda column: [[c(t) for t in column] for c in counts]

    made = map_texts(texts(docs, "source", "lang"), start, fields, "doc_id", "source", "lang")
    each = F.array(*[F.struct(F.lit(n).alias("version"), F.col(f"n{k}").alias("n_tokens")) for k, n in enumerate(names)])
    return made.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.inline(each))


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).cast("long").alias("docs"), F.col("n_tokens").alias("tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("docs"), (-F.col("n_tokens")).alias("tokens"))


def revisions(counts: DataFrame, new: str = "new_tokens") -> DataFrame:
    """counts also holds the new count of each row."""
    return counts.select(*KEYS, F.lit(0).cast("long").alias("docs"), (F.col(new) - F.col("n_tokens")).alias("tokens"))


def added(changes: DataFrame) -> DataFrame:
    return changes.groupBy(*KEYS).agg(F.sum("docs").cast("long").alias("docs"), F.sum("tokens").cast("long").alias("tokens"))


class Rollup:
    """Additive totals under one folder of a shared file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, kind: str) -> list[str]:
        top, fs = self._at(self.path)
        if not fs.exists(top):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(top)]
        return sorted(n[len(kind) + 1 :] for n in names if n.startswith(f"{kind}="))

    def _publish(self, aside: str, place: str) -> bool:
        """Rename a folder to a place that must be free; False if it is taken."""
        (a, fs), (b, _) = self._at(aside), self._at(place)
        a, b = fs.makeQualified(a), fs.makeQualified(b)
        fs.mkdirs(b.getParent())
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(b.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(a, b, none)
            return True
        except Py4JJavaError as e:
            if not fs.exists(b):
                raise
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            return False
        finally:
            fs.delete(a, True)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of signed rows; False if it had been committed before."""
        if batch in self.batches():
            return False
        aside = f"{self.path}/_aside/{uuid.uuid4().hex}"
        added(changes).write.parquet(aside)
        return self._publish(aside, f"{self.path}/batch={batch}")

    def _listed(self) -> tuple[str | None, set[str]]:
        """The newest snapshot and the batches that it holds."""
        names = self._names("snapshot")
        if not names:
            return None, set()
        place = f"{self.path}/snapshot={names[-1]}"
        return place, {r.batch for r in self.spark.read.schema("batch string").parquet(f"{place}/batches").collect()}

    def batches(self) -> list[str]:
        return sorted({*self._listed()[1], *self._names("batch")})

    def totals(self) -> DataFrame:
        """(source, lang, version, docs, tokens) of all committed batches; groups without documents go."""
        place, listed = self._listed()
        paths = [f"{self.path}/batch={b}" for b in self._names("batch") if b not in listed]
        paths += [f"{place}/totals"] if place else []
        if not paths:
            return self.spark.createDataFrame([], _TOTALS)
        return added(self.spark.read.schema(_TOTALS).parquet(*paths)).where("docs <> 0 or tokens <> 0")

    def compact(self) -> bool:
        """Put all committed batches in one snapshot; False if another compaction came first."""
        number = int((self._names("snapshot") or ["0"])[-1]) + 1
        names, aside = self.batches(), f"{self.path}/_aside/{uuid.uuid4().hex}"
        if not names:
            return False
        self.totals().write.parquet(f"{aside}/totals")
        self.spark.createDataFrame([(b,) for b in names], "batch string").coalesce(1).write.parquet(f"{aside}/batches")
        done = self._publish(aside, f"{self.path}/snapshot={number:09d}")
        if done:
            for b in names:  # listed now, so no longer read
                place, fs = self._at(f"{self.path}/batch={b}")
                fs.delete(place, True)
        return done


def replay(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Token counts of all documents after a feed of batches, one sent twice, with a compaction between.

    At first documents whose id leaves 3 modulo 10 are missing and those whose id leaves 7
    stand with counts of an older text, one token longer. Then the missing come and those
    that leave 1 go; at last those that leave 7 are revised and those that leave 1 come
    back. The totals are those of the whole corpus.
    """
    counts = written(counted(docs))
    left = F.coalesce(F.pmod("doc_id", F.lit(10)), F.lit(0))
    store = Rollup(spark, f"{checkpoint_root(spark)}/token-rollup-{uuid.uuid4().hex}")
    older = F.when(left == 7, F.col("n_tokens") + 1).otherwise(F.col("n_tokens"))
    store.commit("0001", inserts(counts.where(left != 3).withColumn("n_tokens", older)))
    change = inserts(counts.where(left == 3)).unionByName(deletes(counts.where(left == 1)))
    store.commit("0002", change)
    store.commit("0002", change)
    store.compact()
    store.commit("0002", change)
    revised = revisions(counts.where(left == 7).select(*KEYS, (F.col("n_tokens") + 1).alias("n_tokens"), F.col("n_tokens").alias("new_tokens")))
    store.commit("0003", revised.unionByName(inserts(counts.where(left == 1))))
    return store.totals()
