"""The near-dedup stage against brute force over all pairs of shingle sets."""

import random

import corpus_pipeline
import numpy as np
from freshet.llm import near_copies, simhash_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_groups(docs):
    def shingles(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)])

    sets, root = [shingles(t) for _, t in docs], list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    groups = {}
    for k, (i, _) in enumerate(docs):
        groups.setdefault(find(k), []).append(i)
    return groups


def test_stage_keeps_one_of_each_group(spark):
    r = random.Random(3)
    base = [[f"w{r.randrange(5000)}" for _ in range(n)] for n in (60, 90, 200, 200, 700)]
    texts = [None, "", "a b", "a b", "a c"]
    for w in base:
        for _ in range(14):
            v = list(w)
            for _ in range(r.choice([0, 1, 1, 2, 3, 5])):
                v[r.randrange(len(v))] = f"z{r.randrange(10**6)}"
            texts.append(" ".join(v))
    docs = list(enumerate(texts))
    r.shuffle(docs)
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], SCHEMA)
    got = sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, df, "").collect())
    assert got == sorted(min(g) for g in brute_groups(docs).values())


def test_stage_decides_by_row(spark):
    long = " ".join(f"x{k}" for k in range(80))
    rows = [(1, long), (5, long + " y"), (5, "another text of more than five words"), (7, "once only"), (7, "once only"), (None, long)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    out = near_copies.keep_one(df)
    assert out.columns == df.columns
    assert sorted(((x.doc_id or 0), x.text) for x in out.collect()) == [(0, long), (1, long), (5, rows[2][1]), (7, "once only")]


def test_simhash_keep_one_decides_by_row(spark):
    long = " ".join(f"x{k}" for k in range(80))
    rows = [(1, long), (5, long), (5, "another text of more than five words"), (7, "once only"), (7, "once only"), (None, long)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    out = simhash_dedup.keep_one(df)
    assert sorted(((x.doc_id or 0), x.text) for x in out.collect()) == [(0, long), (1, long), (5, rows[2][1]), (7, "once only")]


def test_simhash_keys_meet_what_is_similar():
    """Pairs at 0.8 share a cell and lie within the radius; a task tells of no more edges than nodes."""
    r = np.random.default_rng(5)
    for n, same in ((9, 8), (45, 40), (300, 267)):
        base = r.integers(0, 1 << 64, (200, 2 * n - same), dtype=np.uint64)
        e = np.zeros(400, near_copies._ENTRY)
        e["node"], e["n"] = np.arange(400), n
        for k, h in enumerate(base):
            for at, part in ((k, h[:n]), (k + 200, h[n - same :])):
                e["fp"][at] = np.frombuffer(near_copies.fingerprint(part), "<u8")
        met = set()
        for key in range(near_copies.KEYS):
            value = near_copies._sampled(e["fp"], near_copies._KEY[key])
            for v in np.unique(value):
                held = e[value == v]
                a, b = near_copies.Held(held, key).forest()
                assert len(a) < len(held)
                met |= {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())}
        assert met == {(k, k + 200) for k in range(200)}


def test_large_groups_by_parts(spark, monkeypatch):
    """A large group of near copies, many under the similarity: few edges, and the same groups in parts as in one."""
    r = random.Random(8)
    base = [f"w{r.randrange(5000)}" for _ in range(150)]
    texts = []
    for _ in range(120):
        v = list(base)
        for _ in range(r.choice([1, 3, 4, 6])):
            v[r.randrange(150)] = f"z{r.randrange(10**6)}"
        texts.append(" ".join(v))
    docs = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], SCHEMA)
    want = sorted(sorted(g) for g in brute_groups(docs).values())
    edges, links = [], near_copies.links

    def counted(*args):
        found = links(*args)
        edges.append((found.count(), args[0].agg({"parts": "max"}).first()[0]))
        return found

    monkeypatch.setattr(near_copies, "links", counted)
    for weight in (near_copies.WEIGHT, 5000):
        monkeypatch.setattr(near_copies, "WEIGHT", weight)
        got = {}
        for x in near_copies.near_groups(df).collect():
            got.setdefault(x.grp, []).append(x.doc_id)
        assert sorted(sorted(g) for g in got.values()) == want
    assert edges[0][1] == 1 < edges[1][1] and edges[0][0] == len(docs) - len(want)
