"""Corpus operators against brute force, with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from freshet.llm import bpe, common, decontaminate, language_id, licenses, pii, pivot_topk, quality, simhash_dedup, substring_dedup, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, words string, rank int"


def table(spark, texts, lang="en", source="s"):
    """Documents with columns whose names clash with those the operators use."""
    rows = [(i, t, lang[i % len(lang)] if isinstance(lang, list) else lang, source, 0, "x", "y", 7) for i, t in (texts.items() if isinstance(texts, dict) else enumerate(texts))]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [None, "", " \t\n", "a", "word " * 3000, "é\U0001F600 İΣ", "x" * 50_000, "a b c d e f g h i j k l m n o p"]


def some(n, seed=0, words=60, vocabulary=80):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(vocabulary)]
    return [" ".join(r.choice(vocab) for _ in range(r.randint(0, words))) for _ in range(n)]


def near_copies(n=60, seed=1):
    r = random.Random(seed)
    base = some(12, seed, 200, 400)
    out = []
    for _ in range(n):
        w = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, 2])):
            if w:
                w[r.randrange(len(w))] = "zz"
        out.append(" ".join(w))
    return out


# ---- 8 ----


def brute_components(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def brute_fingerprint(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(spark):
    docs = dict(enumerate(ODD + near_copies() + some(40)))
    out = simhash_dedup.simhash_components(table(spark, docs)).collect()
    fps = {i: brute_fingerprint(t) for i, t in docs.items()}
    want = brute_components(fps)
    assert len(out) == len(docs)
    for r in out:
        assert (r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", want[r.doc_id])
    kept = {r.doc_id for r in simhash_dedup.keep_one(table(spark, docs)).collect()}
    assert kept == set(want.values())


def test_simhash_large_buckets_are_dealt_out(spark):
    rng = np.random.default_rng(4)
    fps = np.unique(np.uint64(0xABCDEF0123456789) ^ (np.uint64(1) << rng.integers(0, 40, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 40, 300).astype(np.uint64)) ^ (np.uint64(7) << rng.integers(0, 40, 300).astype(np.uint64)))
    nodes = spark.createDataFrame([(int(f.astype(np.int64)), k) for k, f in enumerate(fps)], "fp long, rep long")
    want = brute_components({k: int(f) for k, f in enumerate(fps)})
    for chunk in (4096, 37):
        roots = {r.node: r.root for r in common.components(simhash_dedup.link_forest(nodes, chunk=chunk)).collect()}
        assert {k: roots.get(k, k) for k in want} == want


def test_simhash_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash_dedup.simhash_components(empty).count() == 0 and simhash_dedup.keep_one(empty).columns == empty.columns


def test_block_masks_miss_no_pair():
    masks, r = simhash_dedup.block_masks(), random.Random(2)
    for _ in range(2000):
        d = sum(1 << b for b in r.sample(range(64), 4))
        assert any(d & m == 0 for m in masks)


def test_components_of_long_paths(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    roots = {r.node: r.root for r in common.components(edges).collect()}
    assert roots == {k: 0 for k in range(1, 201)} | {501: 500}


# ---- 5 ----


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_bpe_equals_the_library(spark, vocabulary):
    tok = pytest.importorskip("tokenizers").Tokenizer.from_file(vocabulary)
    r = random.Random(1)
    pool = [*"aA1 '\t\n\u0085  é́ΣςİßǅⅣ²½漢字한한_-!?’sT٥ำ​﻿", "\U0001F600", "<|endoftext|>", "<|startoftext|>", "'ll", "'RE", "<|", "the ", "ing"]
    texts = ODD + ["".join(r.choice(pool) for _ in range(r.randint(0, 40))) for _ in range(400)]
    out = {x.doc_id: x for x in bpe.digest_documents(table(spark, texts), vocabulary).collect()}
    ids = {x.doc_id: x for x in bpe.encode_documents(table(spark, texts), vocabulary, "lang", rows=7).collect()}
    for i, t in enumerate(texts):
        e = tok.encode(t or "", add_special_tokens=False)
        back = tok.decode(e.ids, skip_special_tokens=False)
        assert out[i].n_tokens == len(e.ids) and ids[i]["ids"] == e.ids and ids[i].lang == "en"
        assert out[i].ids_sha256 == hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest()
        assert out[i].decoded_sha256 == ids[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    assert bpe.digest_documents(spark.createDataFrame([], SCHEMA), vocabulary).count() == 0


# ---- 7 ----


def test_language_id(spark):
    r = random.Random(3)
    words = {"aa": ["the", "thing", "and", "other"], "bb": ["der", "ding", "und", "ander"], "cc": ["la", "cosa", "y", "otra"]}
    docs = [(i, " ".join(r.choice(words[k]) for _ in range(r.randint(3, 30))), k) for i, k in ((i, ["aa", "bb", "cc"][i % 3]) for i in range(150))]
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 !?", "bb"), (1003, "the thing", None)]
    df = spark.createDataFrame(docs + odd, "doc_id long, text string, lang string")
    out = {x.doc_id: x for x in language_id.identify(df).collect()}
    assert len(out) == 154
    for i, _, k in docs:
        assert out[i].lang_pred == k and 0 <= out[i].score <= 1
        assert out[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
    assert [out[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "aa"]
    assert {x.doc_id for x in language_id.keep_identified(df).collect()} == {i for i, *_ in docs} | {1003}
    assert language_id.identify(df.limit(0)).count() == 0
    assert {x.lang_pred for x in language_id.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_counts_are_whole():
    text = "ab abc " * 5
    codes, n = language_id.gram_counts(text)
    whole = dict(zip(codes.tolist(), n.tolist()))
    keep, language_id.SLICE = language_id.SLICE, 3
    try:
        codes, n = language_id.gram_counts(text)
    finally:
        language_id.SLICE = keep
    assert dict(zip(codes.tolist(), n.tolist())) == whole and whole[ord("a")] == 10


# ---- 10 ----


def brute_repeats(docs, size=13):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in docs.items()}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - size + 1):
            first.setdefault(tuple(words[i][k : k + size]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        kept = [x for x, g in zip(w, gone) if not g]
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode("utf-8", "surrogatepass")).hexdigest())
    return out


def test_repeated_passages(spark, monkeypatch):
    r = random.Random(5)
    passages = [" ".join(f"p{k}w{j}" for j in range(r.randint(10, 60))) for k in range(8)]
    docs = {}
    for i in range(80):
        parts = [r.choice(passages) if r.random() < 0.4 else some(1, r.random(), 40, 30)[0] for _ in range(r.randint(1, 5))]
        docs[i] = " ".join(parts)
    docs[80], docs[81] = docs[3], docs[3]
    docs |= {100 + k: t for k, t in enumerate(ODD + ODD)}
    want = brute_repeats(docs)
    for limits in ({}, {"REFERENCE": 40, "FILTER_KEYS": 20}, {"SPLIT": 1}):
        for k, v in limits.items():
            monkeypatch.setattr(substring_dedup, k, v)
        out = substring_dedup.remove_repeats(table(spark, docs).repartition(3)).collect()
        assert {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in out} == want and len(out) == len(docs)
    assert substring_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_suffix_automaton():
    r = random.Random(6)
    for _ in range(50):
        a, b = ([r.randrange(3) for _ in range(40)] for _ in range(2))
        got = substring_dedup.Automaton(a).matching(b)
        subs = {tuple(a[i:j]) for i in range(40) for j in range(i + 1, 41)}
        want = [max((n for n in range(1, k + 2) if tuple(b[k + 1 - n : k + 1]) in subs), default=0) for k in range(40)]
        assert got == want


# ---- 9 ----

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            odd = [int(c) for c in reversed(d)]
            luhn = sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(odd)) % 10 == 0
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def test_pii_base_spans(spark):
    r = random.Random(7)
    pool = [*"ab.@-+ ()0123456789é%_", "\U0001F600", "1.2.3.4", "+1 (555) 123-4567", "4111111111111111", "a@b.c", "256.1.1.1", "x@y", "@d.e"]
    texts = ODD + ["".join(r.choice(pool) for _ in range(r.randint(0, 60))) for _ in range(500)] + ["1" * 9000, "1-" * 9000, "1." * 9000, "a@b.c " * 700, "+1" + "(" * 9000]
    out = {x.doc_id: x for x in pii.report(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        spans = brute_spans(t or "")
        base = ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
        x = out[i]
        assert (x.n_email, x.n_ip, x.n_card, x.n_phone) == tuple(sum(s[3] == k for s in spans) for k in PATTERNS)
        assert x.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(x.spans.split(","))


def test_pii_learns_keys_and_redacts(spark):
    key = "ab12cd34" * 5
    texts = [f'before token = "{key}" after {k}' for k in range(30)] + ["averyveryverylongwordindeedwithoutdigits and more"] * 30 + ["mail me@x.org or +1 (555) 123-4567 now", None, ""]
    df = table(spark, texts)
    rows = {x.doc_id: x for x in pii.redact(df).collect()}
    assert rows[0].text == 'before token = "[SECRET]" after 0' and rows[30].text == texts[30]
    assert rows[60].text == "mail [EMAIL] or [PHONE] now" and rows[61].text is None and rows[62].text == ""
    assert pii.redact(df).columns == df.columns and pii.report(df.limit(0)).count() == 0


def test_pii_plan_is_native(spark):
    plan = pii.report(table(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- 3 ----


def test_decontamination(spark):
    r = random.Random(8)
    items = {k: " ".join(f"i{k}w{r.randrange(40)}" for _ in range(n)) for k, n in enumerate([30, 15, 3, 59, 0])}
    items[5] = items[0]
    bench = spark.createDataFrame([*items.items(), (9, None)], "item_id long, text string")
    w = items[0].split()
    cut = w[:14] + ["zz"] + w[15:]
    docs = {
        0: "lead " * 20 + items[0].upper() + " tail", 1: " ".join(some(1, 1)), 2: "x " + " ".join(cut) + " y", 3: items[2], 4: "a b " + " ".join(w[:15]),
        5: ", ".join(items[3].split()), 6: None, 7: "", 8: items[1] + " and " + items[1],
    }
    out = {(x.doc_id, x.item_id): x for x in decontaminate.contaminated(table(spark, docs), bench).collect()}
    assert set(out) == {(0, 0), (0, 5), (3, 2), (5, 3), (8, 1)} | {k for k in out if k[0] == 2}
    exact = decontaminate.similarity([tuple(cut[i : i + 5]) for i in range(26)], [tuple(w[i : i + 5]) for i in range(26)])
    assert ((2, 0) in out) == (exact >= 0.8)
    assert out[0, 0].start_word == 20 and out[0, 0].similarity == 1 and out[8, 1].start_word == 0
    clean = {x.doc_id for x in decontaminate.keep_clean(table(spark, docs), bench).collect()}
    assert clean == set(docs) - {k[0] for k in out}
    assert decontaminate.contaminated(table(spark, docs), bench.limit(0)).count() == 0


def test_hamming_blocks_find_all_within_the_radius():
    r = random.Random(9)
    index = decontaminate.Index([(k, " ".join(f"q{r.randrange(999)}" for _ in range(20))) for k in range(50)], 5, 0.8, 20, 5)
    for _ in range(300):
        n = r.randrange(50)
        fp = index.items[n][4] ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 24)))
        assert index.within(fp) == {k for k, i in enumerate(index.items) if (i[4] ^ fp).bit_count() <= 20}


def test_items_in_many_shards(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD", 4)
    texts = [" ".join(f"k{k}x{j}" for j in range(20)) for k in range(20)]
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    out = decontaminate.contaminated(table(spark, texts), bench).collect()
    assert {(x.doc_id, x.item_id) for x in out} == {(k, k) for k in range(20)}


# ---- 1 ----


def test_exact_top_k(spark):
    rng = np.random.default_rng(10)
    v = rng.normal(size=(400, 8)) + 3 * rng.integers(0, 4, (400, 1))
    v[100:220] = v[100]  # a vector that many rows share: ties
    rows = [(k, [float(x) for x in r]) for k, r in enumerate(v)] + [(900, None), (901, [1.0, None] + [0.0] * 6), (902, [float("nan")] * 8), (903, []), (950, [0.0] * 8)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = pivot_topk.whole_vectors(t)
    m = {r.vec_id: np.array(r.v) for r in whole.collect()}
    assert set(m) == set(range(400)) | {950}
    for block in (2048, 16):
        got = {}
        for r in pivot_topk.top_k(whole, whole.where("vec_id % 50 = 0"), pivots=5, rings=6, block=block).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
        for q in [k for k in m if k % 50 == 0]:
            want = sorted(((-int(m[q] @ x), k) for k, x in m.items() if k != q))[:5]
            assert [got[q][n] for n in range(1, 6)] == [(k, -s) for s, k in want]
    few = pivot_topk.top_k(whole.where("vec_id < 3"), whole.where("vec_id = 0")).collect()
    assert len(few) == 2 and pivot_topk.top_k(whole.limit(0), whole.limit(0)).count() == 0
    other = whole.unionByName(spark.createDataFrame([(5000, [1]), (50, [2])], "vec_id long, v array<long>"))
    assert {(r.query_id, r.vec_id) for r in pivot_topk.top_k(other, other.where("vec_id in (50, 5000)")).collect()} == {(50, k) for k in got[50] and [v for v, _ in got[50].values()]}


# ---- 2 ----


def test_quality_on_held_out_rows(spark):
    good, bad = some(150, 11, 80), [x.upper().replace(" ", "!! ") for x in some(150, 12, 80)]
    docs = dict(enumerate([x + " end" for x in good] + [x + " END!!" for x in bad])) | {1000: None, 1001: ""}
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300)] + [(5000, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    out = {x.doc_id: x for x in quality.classify(table(spark, docs), labels).collect()}
    assert len(out) == 302 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in out.values())
    held = [x for i, x in out.items() if x.held_out and i < 300]
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, x in out.items())
    assert np.mean([x.predicted == int(x.doc_id < 150) for x in held]) > 0.95
    none = quality.classify(table(spark, {0: "a", 1: None}), labels.limit(0)).collect()
    assert {x.score for x in none} == {0.5}
    assert quality.classify(spark.createDataFrame([], SCHEMA), labels.limit(0)).count() == 0


def test_shapes_and_context():
    assert [quality.shape(w) for w in ("The", "THE!!", "the,", "a1b22", "|", "x", "X")] == ["Aa", "A!", "a,", "a9a9", "|", "a", "A"]
    total = np.zeros(quality.BUCKETS * quality.DIM)
    made = quality.Words([["a", "b"], ["c"]])
    quality.context_sums(made, total)
    table_ = total.reshape(quality.BUCKETS, quality.DIM)
    dense = quality.dense_index()
    assert np.allclose(table_[made.word[0]], dense[made.word[1]]) and not table_[made.word[2]].any()


# ---- 4 ----


WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY."""


def wrapped(text, width, mark=""):
    import textwrap

    return "\n".join(mark + x for x in textwrap.wrap(text, width))


def test_licences_and_inheritance(spark):
    known = licenses.TEMPLATES
    mit, gpl, mit_grant, mit_whole = known["MIT"][0], known["GPL-3.0"][2], known["MIT"][3], known["MIT"][4]
    mit_file = f"MIT License\n\nCopyright (c) 2020 Someone\n\n{wrapped(mit_grant, 70)}\n\n{wrapped(mit_whole[len(mit_grant) + 1:], 70)}\n\n{WARRANTY}\n"
    apache_file = f"{' ' * 30}Apache License\n{' ' * 27}Version 2.0, January 2004\n{' ' * 24}http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.\n" + "more of it and of other words\n" * 300
    gpl_file = "GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n\nEveryone is permitted to copy and distribute verbatim copies of this document.\n" + "sentence about freedom\n" * 300
    bsd3 = wrapped(known["BSD-3-Clause"][2], 60, "// ")
    gpl_header = "#!/bin/sh\n# a tool\n#\n" + wrapped(known["GPL-2.0"][1], 50, "# ") + "\n#\necho hello"
    rows = [
        (1, "a/LICENSE", mit), (2, "a/x.txt", "no notice"), (3, "a/b/c/y.txt", "text\n" + gpl + "\nmore"), (4, "a/b/LICENSE", gpl), (5, "a/b/c/z.txt", None), (6, "d/e.txt", "licence to chill"),
        (7, None, mit), (8, "top.txt", ""), (9, "a/x.txt", "no notice"), (10, "ab/x.txt", "no notice"),
        (20, "m/LICENSE", mit_file), (21, "m/1/2/3/deep.c", "int x;"), (22, "m/1/COPYING", gpl_file), (23, "m/1/2/y.c", "int y;"), (24, "ap/LICENSE.txt", apache_file), (25, "ap/a/b.c", " \n"),
        (26, "h/a.c", "// SPDX-License-Identifier: MIT\nint main;"), (27, "h/b.py", "# SPDX-License-Identifier: GPL-3.0-or-later"), (28, "h/c.sh", gpl_header), (29, "h/d.cc", bsd3 + "\nint x;"),
        (30, "h/e.txt", "we thank you for the license you have to use all of it " * 2000), (31, "m/LICENSE", "unlike any licence"), (32, "", mit), (33, "h/a.c", "// SPDX-License-Identifier: MIT\nint main;"), (None, "h/f.c", "/*\n * " + known["MPL-2.0"][2] + "\n */"),
    ]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, path string, text string, license string, kind int")
    got = {x.doc_id: (x.own_license, x.license, x.origin) for x in licenses.scan(df).collect()}
    assert got == {
        1: ("MIT", "MIT", "own"), 2: (None, "MIT", "inherited"), 3: ("GPL-3.0", "GPL-3.0", "own"), 4: ("GPL-3.0", "GPL-3.0", "own"), 5: (None, "GPL-3.0", "inherited"),
        6: (None, None, None), 7: ("MIT", "MIT", "own"), 8: (None, None, None), 9: (None, "MIT", "inherited"), 10: (None, None, None),
        20: ("MIT", "MIT", "own"), 21: (None, "GPL-3.0", "inherited"), 22: ("GPL-3.0", "GPL-3.0", "own"), 23: (None, "GPL-3.0", "inherited"), 24: ("Apache-2.0", "Apache-2.0", "own"), 25: (None, "Apache-2.0", "inherited"),
        26: ("MIT", "MIT", "own"), 27: ("GPL-3.0", "GPL-3.0", "own"), 28: ("GPL-2.0", "GPL-2.0", "own"), 29: ("BSD-3-Clause", "BSD-3-Clause", "own"), 30: (None, None, None), 31: (None, "MIT", "inherited"), 32: ("MIT", "MIT", "own"),
        33: ("MIT", "MIT", "own"), None: ("MPL-2.0", "MPL-2.0", "own"),
    }
    assert licenses.scan(df.limit(0)).count() == 0
    plan = licenses.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_what_is_passed_over_cannot_match(spark):
    assert licenses.check_templates() < licenses.LEAST
    r = random.Random(12)
    vocabulary = [w for w in licenses.IDF] + ["unknown%d" % k for k in range(40)]
    some_lines = []
    for _, t in licenses.lines():
        w = t.split()
        for share in (0.2, 0.5, 0.7, 0.9):
            some_lines.append(" ".join(x if r.random() < share else r.choice(vocabulary) for x in w) + " " + " ".join(r.choices(vocabulary, k=r.randint(0, len(w)))))
    df = spark.createDataFrame([(k, x) for k, x in enumerate(some_lines)], "n long, line string").withColumn("key", licenses.digest(F.col("line")))
    hits = {x.key for x in licenses.score_lines(df.select("key", "line")).collect()}
    kept = {x.key for x in df.where(licenses.may_match(F.col("line"))).collect()}
    content = set(licenses.IDF) - set(licenses.STOP)
    assert hits and hits <= kept and all(content & set(licenses.terms_of(x.line)) for x in df.collect() if x.key in hits)


# ---- 6 ----


def test_token_counts_equal_the_libraries(spark, vocabulary):
    import base64

    import public_tokenizers
    import tiktoken
    import tokenizers

    word = tokenizers.Tokenizer.from_file(vocabulary)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    byte = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(13)
    pool = [*"aA1 '\t\n\u0085\u00a0é́ΣςİßǅⅣ²½漢字한한_-!?’sT٥", "\U0001F600", "<|endoftext|>", "'ll", "  ", "the ", "ing"]
    texts = ODD + ["".join(r.choice(pool) for _ in range(r.randint(0, 40))) for _ in range(300)]
    got = {(x.doc_id, x.version): x.n_tokens for x in token_counts.counted(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i, "word_bpe_49k.json"] == len(word.encode(t or "", add_special_tokens=False).ids)
        assert got[i, "byte_bpe_50k.tiktoken"] == len(byte.encode_ordinary(t or ""))
    want = {}
    for (i, v), n in got.items():
        d, k = want.get(v, (0, 0))
        want[v] = (d + 1, k + n)
    assert {x.version: (x.docs, x.tokens) for x in token_counts.replay(spark, table(spark, texts)).collect()} == want


def test_token_rollup_is_idempotent(spark, tmp_path):
    docs = table(spark, ["a b c", None, "d e", "é f9!"], source="s1")
    store = token_counts.Rollup(spark, str(tmp_path / "r"))
    assert store.totals().count() == 0 and not store.compact()
    size = F.size(F.split(F.coalesce("text", F.lit("")), " ")) - F.when(F.col("text").isNull(), 1).otherwise(0)
    counts = docs.select("doc_id", "source", "lang", F.lit("w").alias("version"), size.cast("long").alias("n_tokens"))
    assert store.commit("1", token_counts.inserts(counts)) and not store.commit("1", token_counts.inserts(counts))
    assert store.commit("2", token_counts.deletes(counts.where("doc_id = 0")))
    assert store.compact() and store.batches() == ["1", "2"] and not store.commit("2", token_counts.inserts(counts))
    assert store.commit("3", token_counts.revisions(counts.where("doc_id = 2").withColumn("new_tokens", F.lit(10).cast("long"))))
    assert store.commit("4", token_counts.inserts(counts.limit(0)))
    got = {x.version: (x.docs, x.tokens) for x in store.totals().collect()}
    assert got == {"w": (3, 0 + 10 + 2)}
    assert store.compact() and store.batches() == ["1", "2", "3", "4"] and {x.version: (x.docs, x.tokens) for x in store.totals().collect()} == got
    # a writer that passed the look at the batches at the same time loses the rename
    aside = str(tmp_path / "late")
    token_counts.added(token_counts.inserts(counts)).write.parquet(aside)
    assert store.commit("5", token_counts.deletes(counts.where("doc_id <> 0"))) and not store._publish(aside, f"{store.path}/batch=5")
    assert not [f for f in (tmp_path / "r" / "batch=5").iterdir() if f.is_dir()]
    assert store.commit("6", token_counts.inserts(docs.select(F.lit(None).cast("string").alias("source"), "lang", F.lit("v").alias("version"), F.lit(1).cast("long").alias("n_tokens"))))
    assert store.totals().where("source is null").first().tokens == 4
