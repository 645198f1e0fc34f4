"""Operators that SQL can't express against plain versions written for the test."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from freshet.llm import decontaminate, language_id, pii

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def grams(words, k):
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute_hits(docs, items, least=0.8):
    """(doc, item): some window as long as the item reaches the similarity; every window is tried."""
    found = {}
    for i, text in docs.items():
        w = re.findall(r"\w+", text.lower())
        for item, t in items.items():
            u = re.findall(r"\w+", t.lower())
            k = min(5, len(u))
            want = grams(u, k)
            for s in range(max(1, len(w) - len(u) + 1)):
                own = grams(w[s : s + len(u)], k)
                both, size = sum((own & want).values()), sum((own | want).values())
                if size and both / size >= least - 1e-12:
                    found[i, item] = max(found.get((i, item), 0.0), both / size)
    return found


def test_decontamination_finds_what_all_windows_hold(spark):
    r = random.Random(21)
    vocabulary = [f"v{k}" for k in range(60)]
    items = {k: " ".join(r.choice(vocabulary) for _ in range(r.choice([8, 25, 40, 60]))) for k in range(12)}
    docs = {}
    for i in range(90):
        w = items[r.randrange(12)].split()
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):  # words changed, dropped or put in
            at = r.randrange(len(w))
            w[at : at + 1] = r.choice([["new"], [], [w[at], "more"]])
        lead, tail = ([r.choice(vocabulary) for _ in range(r.randrange(40))] for _ in "ab")
        docs[i] = " ".join(lead + w + tail)
    want = brute_hits(docs, items)
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs.items()], SCHEMA)
    got = {(x.doc_id, x.item_id): x.similarity for x in decontaminate.contaminated(df, spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    missed = set(want) - set(got)
    assert set(got) <= set(want) and len(missed) <= 0.01 * len(want) and len(want) > 30
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def brute_profile(texts, top):
    count = Counter()
    for t in texts:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            padded = f"_{w}_"
            count.update(w)
            count.update(padded[k : k + 2] for k in range(len(padded) - 1))
            count.update(padded[k : k + 3] for k in range(len(padded) - 2))
    code = lambda g: sum((ord(c)) << (21 * (len(g) - 1 - k)) for k, c in enumerate(g))
    return sorted(count, key=lambda g: (-count[g], code(g)))[:top]


def test_language_distances(spark):
    r = random.Random(22)
    parts = {"aa": ["the", "thing", "other", "with"], "bb": ["der", "ding", "ander", "mit"], "cc": ["la", "cosa", "otra", "con"]}
    docs = [(i, " ".join(r.choice(parts[k if r.random() < 0.8 else r.choice(list(parts))]) for _ in range(r.randint(1, 25))), k) for i, k in ((i, r.choice(list(parts))) for i in range(120))]
    docs += [(500 + k, "die 3 thing! Ça", None) for k in range(3)] + [(600, "x " * 4000, "aa"), (601, "tie", "aa"), (601, "tie", "aa")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, lang string, gram int")
    held = {x.doc_id: x.held_out for x in language_id.identify(df, 40).collect()}
    known = {k: brute_profile([t for i, t, lang in docs if lang == k and not held[i]], 40) for k in parts}
    out = language_id.identify(df, 40).collect()
    assert len(out) == len(docs)
    text = {i: t for i, t, _ in docs}
    for x in out:
        own = brute_profile([text[x.doc_id]], 40)
        away = {k: sum(abs(n - p.index(g)) if g in p else 40 for n, g in enumerate(own)) for k, p in known.items()}
        best = min(away, key=lambda k: (away[k], k))
        assert x.lang_pred == best and abs(x.score - (1 - away[best] / (40 * len(own)))) < 1e-12


def test_added_spans_are_the_planted_keys(spark):
    """Precision and recall of the kind secret on the keys that the test table plants."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    planted = {(r.doc_id, m.start(1), m.end(1)) for r in docs.where(F.col("text").contains("token")).collect() for m in re.finditer(r'token = "([0-9a-f]{40})"', r.text)}
    found = set()
    for r in pii.report(docs).where(F.col("spans").contains("secret")).collect():
        found |= {(r.doc_id, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",")) if k == "secret"}
    assert planted and len(planted & found) / len(planted) >= 0.99 and len(planted & found) / len(found) >= 0.95


def test_chunk_counts_are_the_encoders():
    """Counts by chunks are those of whole texts, with white space of all kinds, and no ids are made for them."""
    import public_tokenizers

    from freshet.llm import bpe, token_counts

    r, ranks = random.Random(4), token_counts.Ranks(bpe.read_spec(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    words = bpe.Bpe(bpe.read_spec(public_tokenizers.path("word_bpe_49k.json")))
    signs = [*" \n\t\r\x0b\x1c\x1f\x85\xa0\u2003\u3000\u200b", *"ab'st1,.", "\u00e9", "e\u0301", "\u03a3", "\u4e00", "'ll", "  ", "<|", "Word."]
    for _ in range(4000):
        text = "".join(r.choice(signs) for _ in range(r.randrange(14)))
        assert ranks.count(text) == len(ranks.encoding.encode_ordinary(text))
        assert words.count(text) == len(bpe.Bpe.encode(words, text))
    fresh = bpe.Bpe(bpe.read_spec(public_tokenizers.path("word_bpe_49k.json")))
    assert fresh.count("uncommonlymadeword, and another") > 3 and not fresh.pieces_kept


def test_license_units_go_once_and_prose_is_passed_over(spark):
    """Equal units go with their first kind only; few known words beside unknown ones are no reason to score."""
    from freshet.llm import licenses

    text = "Licensed under the MIT License.\nThe cat sat on the mat and the big dog ran to the red house, garden fence, barn for a walk"
    df = spark.createDataFrame([("Licensed under the MIT License.",), (text,)], "text string")
    found = df.select("text", F.explode(licenses.units(F.col("text"), F.lit(True))).alias("u")).select("text", "u.kind", "u.line").where("trim(line) <> ''").collect()
    assert [(x.kind, x.line) for x in found if x.text != text] == [(0, "Licensed under the MIT License.")]
    assert len({x.line for x in found if x.text == text}) == len([x for x in found if x.text == text])
    kept = spark.createDataFrame([(x,) for x in text.split("\n")], "line string").where(licenses.may_match(F.col("line"))).collect()
    assert [x.line for x in kept] == ["Licensed under the MIT License."]


def test_license_filters_are_cheap_and_lose_nothing(spark):
    """Everyday prose is passed over as a text, the pattern of content terms finds just those, and a unit's words are split once."""
    from freshet.llm import licenses

    content = set(licenses.IDF) - set(licenses.STOP)
    assert licenses.check_templates() < licenses.LEAST - 1e-6
    assert not content & set("the of and to a in is it that for was on with as be by at this are from do its may so has any".split())
    r = random.Random(9)
    signs = ["\n", " ", "_", "-", "x", "7", "s", "\u212a", "\u0130", "\u00e9", "// "]
    texts = [r.choice(signs) + w + r.choice(signs) for w in sorted(licenses.IDF) for _ in range(4)] + ["", "Mit", "GNU", "gnus", "xmit", "v", "vers", "licensed", "license7"]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    got = {x.text for x in df.where(F.lower("text").rlike(licenses._any_of(content))).collect()}
    told = {x.text for x in df.where(F.arrays_overlap(F.split(F.lower("text"), licenses._BREAK), F.array(*map(F.lit, sorted(content))))).collect()}
    assert got == told and 0 < len(got) < len(set(texts))
    plan = df.where(licenses.may_match(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_passages_are_those_of_each_text(monkeypatch):
    """Words hash alike wherever they stand; passages of many texts at a time are the runs of one anchor of each text."""
    import numpy as np

    from freshet.llm import substring_dedup as op10

    r = random.Random(21)
    vocabulary = ["a", "b", "ab", "ba", "\u00e9", "\u3000x", "\U0001F600", "\x1c", "\x85", "w" * 700] + ["v%d" % k for k in range(60)]
    texts = [" \n".join(r.choice(vocabulary[: r.choice([3, 70])]) for _ in range(n)) for n in [0, 0, 1, 12, 13, 14, 0, 20, 40, 90, 5, 300, 0] for _ in range(3)]
    lists = [op10.split(x) for x in texts]
    for block, size in ((50, 1), (1 << 18, 100), (1 << 18, 10_000)):
        monkeypatch.setattr(op10, "BLOCK", block)
        monkeypatch.setattr(op10, "SLICE", size)
        told: dict[bytes, set] = {}
        for words in filter(None, lists):
            line = b" ".join(words)
            begin, end, h = op10.word_hashes(line)
            assert [line[b:e] for b, e in zip(begin, end)] == words
            for w, x in zip(words, h.tolist()):
                told.setdefault(w, set()).add(x)
        assert all(len(x) == 1 for x in told.values()) and len(set.union(*told.values())) == len(told)
        got = []
        for line, text, own, at, n, begin, end in op10.passages([b" ".join(x) for x in lists], np.array([len(x) for x in lists]), 13, 6):
            got += [(t, a, k, line[b:e].split()) for t, a, k, b, e, m in zip(text.tolist(), own.tolist(), at.tolist(), begin.tolist(), end.tolist(), n.tolist()) if len(line[b:e].split()) == m]
        want = []
        for i, words in enumerate(lists):
            grams = [int(op10.rolling(np.array([min(told[w]) for w in words[k : k + 6]], np.uint64), 6)[0]) for k in range(len(words) - 5)]
            places = [max(k for k in range(b, b + 8) if grams[k] == min(grams[b : b + 8])) for b in range(len(words) - 12)]
            for b, p in enumerate(places):
                if b and p == places[b - 1]:
                    want[-1] = (*want[-1][:3], want[-1][3] + [words[b + 12]])
                else:
                    want.append((i, grams[p], b, words[b : b + 13]))
        assert got == want and len(want) > 100
