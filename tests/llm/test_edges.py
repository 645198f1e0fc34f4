"""What every corpus operator must take: rows without id beside ids above 2 ** 53, repeated rows, ties, clashing columns, empty tables."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from freshet.llm import bpe, decontaminate, language_id, licenses, near_copies, pii, pivot_topk, quality, simhash_dedup, substring_dedup, token_counts

BIG = 2**60 + 1
PROSE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
OTHER = " ".join(f"word{k}" for k in range(40))
ROWS = [(None, PROSE), (BIG, PROSE), (5, OTHER), (5, OTHER), (7, None), (8, ""), (9, OTHER + " " + PROSE), (10, "x" * 30_000 + " mail a@b.c"), (None, None)]
IDS = sorted([i for i, _ in ROWS], key=str)
#: Columns named like those that operators make on their way.
CLASH = ["fp", "words", "rank", "_gone", "_i", "_t", "gone", "grp", "td", "dk", "spans", "n", "k", "hit", "row", "version", "key", "line", "license", "a.b"]


@pytest.fixture(scope="module")
def docs(spark):
    made = spark.createDataFrame([(i, t, "en" if i != 9 else None, "s" if i != 9 else None, 3) for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    return made.select("*", *[F.lit(n).alias(c) for n, c in enumerate(CLASH)]).repartition(2)


def ids(df, name="doc_id"):
    return sorted((r[name] for r in df.select(name).collect()), key=str)


def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


PER_ROW = {
    "op2": lambda d: quality.classify(d, d.select("doc_id", F.lit(1).alias("quality")).where("doc_id = 5 or doc_id is null").unionByName(d.where("doc_id = 9").select("doc_id", F.lit(0).alias("quality")))),
    "op4": lambda d: licenses.scan(d.withColumn("path", F.lit("a/b.txt"))),
    "op5": lambda d: bpe.digest_documents(d, vocabulary()),
    "op7": language_id.identify,
    "op8": simhash_dedup.simhash_components,
    "op9": pii.report,
    "op10": substring_dedup.remove_repeats,
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_for_each_row(spark, docs, name):
    assert ids(PER_ROW[name](docs)) == IDS
    assert PER_ROW[name](docs.limit(0)).count() == 0


def test_repeated_rows_and_rows_without_id_have_defined_results(docs):
    out = substring_dedup.remove_repeats(docs).collect()
    gone = {r.doc_id: r.n_removed for r in out if r.doc_id is not None}
    # 9 holds the text of 5; its last 14 words stand in BIG, whose id is larger, and in rows without id
    assert gone == {BIG: 14, 5: 0, 7: 0, 8: 0, 9: 40, 10: 0} and all(r.n_removed == 0 for r in out if r.doc_id is None)
    comp = {(r.doc_id, r.fingerprint): r.component_id for r in simhash_dedup.simhash_components(docs).collect()}
    empty = "0" * 16
    assert comp[None, empty] == comp[7, empty] == comp[8, empty] == 7
    assert {v for (i, f), v in comp.items() if i is None and f != empty} == {BIG}


def test_decontamination_ids(spark, docs):
    bench = spark.createDataFrame([(BIG, PROSE, 1), (None, OTHER, 1), (3, None, 1)], "item_id long, text string, doc_id int")
    hits = decontaminate.contaminated(docs, bench)
    assert sorted(((r.doc_id, r.item_id) for r in hits.collect()), key=str) == sorted([(None, BIG), (BIG, BIG), (9, BIG), (5, None), (5, None), (9, None)], key=str)
    kept = decontaminate.keep_clean(docs, bench)
    assert kept.columns == docs.columns and ids(kept) == sorted([7, 8, 10, None], key=str)
    assert ids(decontaminate.keep_clean(docs, bench.limit(0))) == IDS and decontaminate.keep_clean(docs.limit(0), bench).count() == 0


def test_top_k_of_repeated_and_unnamed_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [-1.0, 0.0]), (None, [3.0, 3.0]), (BIG, [3.0, 3.0]), (1, [3.0, 3.0]), (2, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0])]
    t = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, qk int, ring int")
    v = pivot_topk.whole_vectors(t)
    out = pivot_topk.top_k(v, v.where("vec_id % 50 = 0"), k=4).collect()
    got = {}
    for r in out:
        got.setdefault((r.query_id, r["rank"]), []).append((r.vec_id, r.score))
    top = 9 * 256 * 256
    # two equal rows and one other of id 0: three answers of each rank
    assert sorted(got) == [(0, k) for k in (1, 2, 3, 4)] and all(len(x) == 3 for x in got.values())
    assert sorted(got[0, 1], key=str) == sorted([(1, top), (1, top), (2, 0)], key=str)
    assert got[0, 2].count((BIG, top)) == 2 and got[0, 3].count((None, top)) == 2 and got[0, 4].count((2, 0)) == 2
    big = spark.createDataFrame([(0, [2**31 + 1, 1]), (1, [2**31 - 1, 3]), (2, [2**31 - 1, 2])], "vec_id long, v array<long>")
    exact = pivot_topk.top_k(big, big.where("vec_id = 0")).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in exact] == [(1, (2**31 + 1) * (2**31 - 1) + 3), (2, (2**31 + 1) * (2**31 - 1) + 2)]


def test_token_counts_of_odd_rows(spark, docs):
    out = token_counts.replay(spark, docs).collect()
    assert {(r.source, r.lang) for r in out} == {("s", "en"), (None, None)}
    assert token_counts.replay(spark, docs.limit(0)).count() == 0


def test_near_copies_keep_one_row(spark, docs):
    for keep in (near_copies.keep_one, simhash_dedup.keep_one):
        out = keep(docs)
        assert out.columns == docs.columns
        # one of the rows of 5, one of the blank 7 and 8; rows without id stay
        assert ids(out) == sorted([None, None, BIG, 5, 7, 9, 10], key=str)
        assert keep(docs.limit(0)).count() == 0


def test_stages_take_odd_rows(spark, docs, tmp_path):
    bench = spark.createDataFrame([(1, OTHER)], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = [f for _, f in corpus_pipeline.STAGES]
    for k, stage in enumerate(stages):
        out = stage(spark, docs, str(tmp_path))
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        if k < 4:
            assert out.columns == docs.columns
        rows = out.collect()
        if k == 0:  # no letter: gone; the language of 9 is filled in
            assert sorted((r.doc_id for r in rows), key=str) == sorted([None, BIG, 5, 5, 9, 10], key=str) and {r.lang for r in rows} == {"en"}
        elif k == 2:
            assert sorted((r.doc_id for r in rows), key=str) == sorted([None, None, BIG, 7, 8, 10], key=str)
        elif k == 3:
            assert ids(out) == IDS and [r.text[-7:] for r in rows if r.doc_id == 10] == ["[EMAIL]"] and [r.text for r in rows if r.doc_id == 7] == [None]
        elif k == 4:
            assert ids(out) == IDS and all(re.fullmatch("[0-9a-f]{64}", r.decoded_sha256) for r in rows)
