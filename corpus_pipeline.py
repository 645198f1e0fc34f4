"""The corpus pipeline: stages written and reread one after the other (see freshet.llm).

Stages take documents (doc_id, text, lang, source, n_chars) with any further columns, also
such whose names operators use on their way; all but the last return the columns they
were given. An empty table gives an empty one. Texts are read whole, however long.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm import bpe, decontaminate, language_id, near_copies, pii
from freshet.llm.common import checkpoint_root, read_table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go; a null lang becomes the language found.

    A document has none if its text is null or without a letter, or if no profile is nearer
    than chance. Repeated rows and rows without doc_id are judged like others; ties
    between languages go to the smaller name.
    """
    return language_id.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five words, similarity 0.8) stays, the one with the smallest id.

    Null and blank texts are one group. Of rows that repeat id and text one stays, of an id
    with two texts each is judged for itself. Rows without doc_id stay.
    """
    return near_copies.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item (similarity 0.8 in a window as long) go.

    Null and empty texts stay, items without words are ignored, repeated rows go together.
    """
    return decontaminate.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in text become placeholders; n_chars follows the new text.

    A null text stays null, and so does its n_chars. Spans that overlap become one
    placeholder of the first one's kind. No row goes.
    """
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, decoded_sha256): token ids of every document and a digest of what they decode to.

    Null text is empty: no ids, the digest of an empty text. Repeated rows repeat.
    """
    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), "lang", "source")


STAGES = [
    ("language ID", identify),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminated),
    ("PII", private),
    ("BPE encoding and decoding", encoded),
]

#: SQL can't express merge ranks or learned profiles; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to documents; each result is a Parquet table in the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    base = f"{checkpoint_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{base}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
