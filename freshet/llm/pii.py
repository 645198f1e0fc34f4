"""Personal data in texts (operator 9), with DataFrame functions only.

Base kinds are found by patterns and kept if they pass a test (octets, Luhn, digit
count). Weak supervision adds spans of the kind ``secret``: long runs of key characters
are candidates; regex, gazetteer and context labelers vote on each; expectation
maximisation over the counts of vote patterns estimates how reliable each labeler is
(a two-class latent model with independent votes); its posteriors train the final span
classifier, a logistic model on the votes and on features of the span. The classifier
is applied as a column expression.

Scale. Two scans of the texts, no shuffle of them. What meets at the driver is one row
for each pattern of votes and features, at most 2 ** 8 rows at any input size. Spans are
lists within a row; offsets come from two-level prefix sums, so many matches in one text
cost n ** 1.5 at worst.

Patterns are written with possessive runs and a check of the character before, which
find what the plain leftmost patterns find, without a stack or quadratic search on long
runs. Offsets count code points.

Edge cases: null text is empty and has no spans; repeated rows stay; other columns are
ignored; without candidates, or with all of one pattern, no span is added beyond what
the labelers' majority says.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import texts

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: kind: (pattern, a character or pattern without which no match exists)
BASE = {
    "email": (rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++", "@"),
    "ip": (r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", "."),
    "card": (r"[0-9](?:[\x20-]?+[0-9])++", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
KINDS = [*BASE, "secret"]
_KEY = "[A-Za-z0-9_+/=-]"
CANDIDATE = rf"(?:(?<!{_KEY})|\G){_KEY}{{20,}}+"
#: Words that announce a key, and openings of well-known keys (fixed lists).
GAZETTEER = ["token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "access_key", "auth", "bearer", "credential", "private_key"]
OPENINGS = ["AKIA", "ghp_", "gho_", "sk-", "xoxb-", "xoxp-", "AIza", "eyJ"]
LABELERS = ["regex", "gazetteer", "context", "mixture"]
FEATURES = ["quoted", "long", "wordlike"]


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether the digit string passes Luhn's check."""
    n = F.length(d)

    def part(i: Column) -> Column:
        v = F.ascii(F.substring(d, n - i, F.lit(1))) - F.lit(48)
        twice = v * 2
        return F.when(i % 2 == 0, v).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + part(i)) % 10 == 0


def passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return let(digits(m), lambda d: F.length(d).between(14, 19) & luhn(d))
    if kind == "phone":
        return F.length(digits(m)).between(10, 15)
    return F.lit(True)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def spans_of(text: Column, pattern: str, need: str | None) -> Column:
    """Array of (start, end, m, before, after) of a pattern's matches in code points."""
    has = F.lit(True) if need is None else F.contains(text, F.lit(need))
    none = F.array().cast("array<struct<start:int,end:int,m:string,before:string,after:string>>")

    def located(both: Column) -> Column:
        m, seg = both["m"], both["s"]
        step = F.transform(m, lambda x, i: F.length(F.get(seg, i)) + F.length(x))

        def with_steps(s: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(s) / 64).cast("int")), lambda b: _sum(F.slice(s, b * 64 + 1, F.lit(64))))

            def with_blocks(t: Column) -> Column:
                begins = F.transform(t, lambda _, b: _sum(F.slice(t, F.lit(1), b)))

                def with_begins(g: Column) -> Column:
                    def one(x: Column, i: Column) -> Column:
                        k = F.floor(i / 64).cast("int")
                        at = F.get(g, k) + _sum(F.slice(s, k * 64 + 1, i % 64)) + F.length(F.get(seg, i))
                        return F.struct(
                            at.alias("start"), (at + F.length(x)).alias("end"), x.alias("m"), F.right(F.get(seg, i), F.lit(24)).alias("before"), F.left(F.get(seg, i + 1), F.lit(2)).alias("after")
                        )

                    return F.transform(m, one)

                return let(begins, with_begins)

            return let(blocks, with_blocks)

        return let(step, with_steps)

    def found(m: Column) -> Column:
        # two scans see the same matches: the pieces between them give the offsets
        return F.when(F.size(m) > 0, let(F.struct(m.alias("m"), F.split(text, pattern, -1).alias("s")), located)).otherwise(none)

    return F.when(has, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)).otherwise(none)


def base_spans(text: Column) -> dict[str, Column]:
    """For each base kind, the array of its passing spans."""
    def passing(kind: str):
        return lambda s: passes(kind, s["m"])

    return {k: F.filter(spans_of(text, p, need), passing(k)) for k, (p, need) in BASE.items()}


def signals(s: Column) -> dict[str, Column]:
    """Votes of the labelers and features, as booleans, for a candidate span."""
    m, before = s["m"], F.lower(s["before"])
    near = "(?:" + "|".join(w.replace("_", "[_]").replace("-", "[-]") for w in GAZETTEER) + r")[\"']?\s*(?:[:=]|is)?\s*[\"']?$"
    n = F.length(m)
    numbers = F.length(digits(m))
    return {
        "regex": m.rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$") | m.rlike("^(?:" + "|".join(OPENINGS) + ")"),
        "gazetteer": before.rlike(near),
        "context": before.rlike("[:=]\\s*[\"']?$"),
        "mixture": (numbers * 8 >= n) & ((n - numbers) * 8 >= n),
        "quoted": before.rlike("[\"']$") & s["after"].rlike("^[\"']"),
        "long": n >= 32,
        "wordlike": m.rlike("^[A-Za-z]+$|^[_=/+-]+$") | (numbers == n),
    }


def candidates(text: Column) -> Column:
    return spans_of(text, CANDIDATE, None)


def vote_counts(docs: DataFrame) -> list[tuple[tuple[int, ...], int]]:
    """How many candidates show each pattern of votes and features, over all documents."""
    c = texts(docs).select(F.explode(candidates(F.col("text"))).alias("s"))
    told = signals(F.col("s"))
    rows = c.select(*[v.cast("int").alias(k) for k, v in told.items()]).groupBy(*told).agg(F.count("*").alias("n")).collect()  # at most 2 ** 7 rows
    return sorted((tuple(r[k] for k in told), r.n) for r in rows)


def reliabilities(counts: list[tuple[tuple[int, ...], int]], rounds: int = 100) -> tuple[float, list[float], list[float]]:
    """Expectation maximisation: (share of true spans, P(vote | true), P(vote | false))."""
    k = len(LABELERS)
    prior, yes, no = 0.5, [0.8] * k, [0.2] * k
    total = sum(n for _, n in counts)
    if not total:
        return prior, yes, no
    for _ in range(rounds):
        post = [posterior(v[:k], prior, yes, no) for v, _ in counts]
        true = sum(p * n for p, (_, n) in zip(post, counts))
        false = total - true
        prior = min(0.99, max(0.01, (true + 1) / (total + 2)))
        for i in range(k):
            on = sum(p * n for p, (v, n) in zip(post, counts) if v[i])
            off = sum((1 - p) * n for p, (v, n) in zip(post, counts) if v[i])
            # a beta prior keeps labelers better than chance: the classes can't swap
            yes[i] = max(0.5, (on + 4) / (true + 5))
            no[i] = min(0.5, (off + 1) / (false + 5))
    return prior, yes, no


def posterior(votes, prior: float, yes: list[float], no: list[float]) -> float:
    a, b = math.log(prior), math.log(1 - prior)
    for v, y, n in zip(votes, yes, no):
        a += math.log(y if v else 1 - y)
        b += math.log(n if v else 1 - n)
    return 1 / (1 + math.exp(min(700, b - a)))


def train(counts: list[tuple[tuple[int, ...], int]], rounds: int = 400) -> list[float]:
    """Weights (bias first) of a logistic model on votes and features, from posteriors."""
    size = len(LABELERS) + len(FEATURES) + 1
    w = [-2.0, *[1.0] * len(LABELERS), *[0.0] * len(FEATURES)]
    total = sum(n for _, n in counts)
    if not total:
        return w
    prior, yes, no = reliabilities(counts)
    rows = [((1, *v), posterior(v[: len(LABELERS)], prior, yes, no), n / total) for v, n in counts]
    for _ in range(rounds):
        g = [0.0] * size
        for x, target, share in rows:
            z = sum(a * b for a, b in zip(w, x))
            e = (1 / (1 + math.exp(-max(-30, min(30, z)))) - target) * share
            for i, v in enumerate(x):
                g[i] += e * v
        w = [a - 2.0 * (b + 1e-4 * a) for a, b in zip(w, g)]
    return w


def accepted(s: Column, weights: list[float]) -> Column:
    score = F.lit(weights[0])
    for w, v in zip(weights[1:], signals(s).values()):
        score = score + F.when(v, F.lit(w)).otherwise(F.lit(0.0))
    return score > 0


def _tag(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("k"), s["end"].alias("end")))


def _written(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """docs' (doc_id, text) with ``base`` and ``spans``, sorted arrays of (start, k, end)."""
    weights = train(vote_counts(docs)) if weights is None else weights
    plain = texts(docs)
    found = plain.select("doc_id", "text", *[c.alias(f"_{k}") for k, c in base_spans(F.col("text")).items()], F.filter(candidates(F.col("text")), lambda s: accepted(s, weights)).alias("_secret"))
    base = F.array_sort(F.concat(*[_tag(F.col(f"_{k}"), k) for k in BASE]))
    more = F.concat(*[_tag(F.col(f"_{k}"), k) for k in KINDS])
    return found.select("doc_id", "text", *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS], base.alias("base"), F.array_sort(more).alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)."""
    return find(docs).select(
        "doc_id", *[f"n_{k}" for k in BASE], F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans")
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of text replaced by its kind in brackets; all columns stay.

    Spans that overlap are replaced together, under the kind of the first. A null text
    stays null.
    """
    weights = train(vote_counts(docs))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    parts = [_tag(c, k) for k, c in base_spans(text).items()]
    parts.append(_tag(F.filter(candidates(text), lambda s: accepted(s, weights)), "secret"))
    name = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def rebuilt(spans: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

        def step(a: Column, s: Column) -> Column:
            fresh = s["start"] >= a["at"]
            gap = F.when(fresh, F.concat(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.get(name, s["k"]))).otherwise(F.lit(""))
            return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], gap).alias("out"))

        return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))

    made = F.when(F.col("text").isNotNull(), let(F.array_sort(F.concat(*parts)), lambda s: F.when(F.size(s) > 0, rebuilt(s)).otherwise(text)))
    return docs.withColumn("text", made)
