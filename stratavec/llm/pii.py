"""Personal data by weak supervision, in DataFrame and SQL functions only.

Candidates are base matches (valid or not) and looser forms. Labelers vote on each: a regex labeler (the strict form is
valid), a gazetteer labeler (known endings, ranges and prefixes) and a context labeler (words nearby). Votes are counted
by pattern; expectation-maximisation over those counts estimates each labeler's reliability a kind, and the posterior of
each pattern trains a naive Bayes span classifier on shape features. Valid base spans always stay; other candidates are
added when the classifier's posterior reaches `ACCEPT`.

The counts are at most one row for each combination of kind, votes and shape (all of fixed domains), so what the driver
sees has a fixed bound. Positions count code points, ends are exclusive.

Patterns are written so that Java's matcher neither backtracks over a run twice nor recurses; they find what the
contract's patterns find. Defined results: a null or empty text has no spans; repeated rows are scanned one by one; an
empty table gives an empty result (and a model of priors only); extra columns are ignored by the query and kept by the
stage, whatever their names; texts are scanned whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavec.llm.common import stored, table, unused

#: Kinds in output order; the first four are base kinds.
KINDS = ["email", "ip", "card", "phone", "ssn", "secret"]
BASE = KINDS[:4]
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Looser forms, each a candidate of its kind that base patterns do not find.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]{1,63}+){1,4}+",
    "phone": r"(?<![0-9A-Za-z+().-])(?<![0-9+)] )(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}(?![0-9A-Z])|(?:password|passwd|secret|token|api_key)[=:][^ \t\n\x0B\f\r]{6,200})",
}
#: A part may be zeros only: the possessive run must not leave nothing for the digits behind it.
_OCTET = r"0*+(?:(?<=0)(?![0-9])|[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_OCTETS = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
#: Gazetteers: what a span of the kind must match to be known, and what makes it known as something else.
KNOWN = {
    "email": r"\.(?:com|org|net|edu|gov|mil|int|info|io|co|de|fr|es|uk|eu|ch|at|it|nl|us)$",
    "ip": r"^(?!0|127\.|255\.|2(?:2[4-9]|[34][0-9])\.)[0-9]",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^(?:\+[1-9]|\(?[2-9])",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
    "secret": r"^(?:AKIA|password|passwd|api_key)",
}
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|contact|write|mailto|reach)\b[^\n]{0,24}$",
    "ip": r"(?i)\b(?:ip|host|server|address|from|login)\b[^\n]{0,16}$",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|payment|account)\b[^\n]{0,24}$",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|whatsapp)\b[^\n]{0,24}$",
    "ssn": r"(?i)\b(?:ssn|social|security)\b[^\n]{0,24}$",
    "secret": r"(?i)\b(?:key|secret|credentials?|login|password)\b[^\n]{0,24}$",
}
LABELERS = ["regex", "gazetteer", "context"]
ACCEPT = 0.5
EM_STEPS = 50


def _found(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match>> of all matches: gaps and matches alternate, so positions are running lengths."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    empty = F.array().cast("array<struct<start:int,end:int,match:string>>")
    begin = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(done, x):
        start = done.at + x.gap
        end = start + F.length(x.match)
        return F.struct(end.alias("at"), F.concat(done.out, F.array(F.struct(start.alias("start"), end.alias("end"), x.match.alias("match")))).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda gap, match: F.struct(gap.alias("gap"), match.alias("match")))
    return F.when(text.rlike(pattern), F.aggregate(pairs, begin, step, lambda done: done.out)).otherwise(empty)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    reverse = F.reverse(digits)

    def worth(i):
        d = F.substring(reverse, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return (F.length(digits) > 0) & (F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), worth), F.lit(0), lambda a, x: a + x) % 10 == 0)


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(_OCTETS)
    if kind == "card":
        return luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def candidates(docs: DataFrame, name: str = "spans") -> DataFrame:
    """docs with spans: array<struct<kind, start, end, base, votes..., shape features>>, kinds in order, starts ascending."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def judged(kind: str, base: bool, found: Column) -> Column:
        def one(s):
            match, before = s.match, F.substring(text, F.greatest(s.start - 39, F.lit(1)), F.least(s.start, F.lit(40)))
            after = F.substring(text, s.end + 1, F.lit(1))
            valid = _valid(kind, match)
            clean = ~(before.rlike(r"[0-9A-Za-z@._-]$") | after.rlike(r"^[0-9A-Za-z@_-]"))
            votes = [
                F.when(valid, 1).otherwise(0) if base else F.when(valid, F.lit(None).cast("int")).otherwise(0),
                F.when(match.rlike(KNOWN[kind]), 1).otherwise(0),
                F.when(F.rtrim(before).rlike(CONTEXT[kind]), 1).when(clean, F.lit(None).cast("int")).otherwise(0),
            ]
            return F.struct(F.lit(kind).alias("kind"), s.start.alias("start"), s.end.alias("end"), (valid if base else F.lit(False)).alias("base"), *(v.cast("int").alias(n) for n, v in zip(LABELERS, votes, strict=True)), F.least(F.length(_digits(match)), F.lit(20)).cast("int").alias("digits"), F.least(F.floor(F.length(match) / 4), F.lit(12)).cast("int").alias("size"), clean.cast("int").alias("edge"))

        return F.transform(found, one)

    parts = [judged(k, True, _found(text, PATTERNS[k])) for k in BASE] + [judged(k, False, _found(text, p)) for k, p in LOOSE.items()]
    return docs.withColumn(name, F.concat(*parts))


def _em(counts: dict[tuple, int]) -> dict[tuple, float]:
    """Posterior of each (kind, votes) under conditionally independent labelers with reliabilities by kind."""
    posterior = {}
    for kind in sorted({k[0] for k in counts}):
        own = {k: n for k, n in counts.items() if k[0] == kind}
        total, prior = sum(own.values()), 0.5
        #: Chance that a labeler votes yes, given that the span is (1) or is not (0) personal data; beta(8, 2)-like start.
        yes = [{1: 0.8, 0: 0.2} for _ in LABELERS]
        for _ in range(EM_STEPS):
            p = {}
            for key in own:
                odds = math.log(prior / (1 - prior))
                for vote, rate in zip(key[1:], yes, strict=True):
                    if vote is not None:
                        odds += math.log(rate[1] / rate[0]) if vote else math.log((1 - rate[1]) / (1 - rate[0]))
                p[key] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
            prior = (sum(p[k] * n for k, n in own.items()) + 1) / (total + 2)
            for i, rate in enumerate(yes):
                for truth in (1, 0):
                    seen = [(n * (p[k] if truth else 1 - p[k]), k[1 + i]) for k, n in own.items() if k[1 + i] is not None]
                    start = 0.8 if truth else 0.2
                    rate[truth] = (sum(w for w, v in seen if v) + 10 * start) / (sum(w for w, _ in seen) + 10)
        posterior |= p
    return posterior


FEATURES = ["digits", "size", "edge", *LABELERS]


def fit(found: DataFrame) -> dict:
    """The span classifier: per kind a prior and per feature value a log ratio. found: a table with candidates' spans."""
    flat = found.select(F.inline("spans"))
    rows = flat.groupBy("kind", *LABELERS, "digits", "size", "edge").agg(F.count(F.lit(1)).alias("n")).collect()
    counts: dict[tuple, int] = {}
    for r in rows:
        key = (r.kind, *(r[x] for x in LABELERS))
        counts[key] = counts.get(key, 0) + r.n
    truth = _em(counts)
    model: dict = {}
    for kind in KINDS:
        own = [(r, r.n * truth[(r.kind, *(r[x] for x in LABELERS))]) for r in rows if r.kind == kind]
        yes, total = sum(w for _, w in own), sum(r.n for r, _ in own)
        no = total - yes
        weights = {}
        for f in FEATURES:
            values = {r[f] for r, _ in own}
            for v in values:
                a = sum(w for r, w in own if r[f] == v)
                b = sum(r.n - w for r, w in own if r[f] == v)
                weights[(f, v)] = math.log((a + 0.5) / (yes + 0.5 * len(values))) - math.log((b + 0.5) / (no + 0.5 * len(values)))
        model[kind] = {"prior": math.log((yes + 1) / (no + 1)), "weights": weights}
    return model


def _score(model: dict, s) -> Column:
    """Log odds of a span struct under the classifier."""
    total = F.lit(None).cast("double")
    for kind, own in model.items():
        odds = F.lit(float(own["prior"]))
        for f in FEATURES:
            values = sorted(((v, w) for (g, v), w in own["weights"].items() if g == f), key=str)
            if values:
                case = F.lit(0.0)
                for v, w in values:
                    case = F.when(s[f].eqNullSafe(F.lit(v).cast("int")), F.lit(float(w))).otherwise(case)
                odds = odds + case
        total = F.when(s.kind == kind, odds).otherwise(total)
    return total


def detect(found: DataFrame, model: dict, name: str = "spans") -> DataFrame:
    """found with spans reduced to base spans and accepted others, by start, then kind in order."""
    order = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)))
    limit = math.log(ACCEPT / (1 - ACCEPT))

    def overlaps(spans, s):
        return F.exists(spans, lambda b: b.base & (b.start < s.end) & (s.start < b.end))

    kept = F.filter(name, lambda s: s.base | ((_score(model, s) >= limit) & ~overlaps(F.col(name), s) & s.regex.isNull()))
    slim = F.transform(kept, lambda s: F.struct(s.start.alias("start"), F.element_at(order, s.kind).alias("rank"), s.kind.alias("kind"), s.end.alias("end"), s.base.alias("base")))
    return found.withColumn(name, F.array_sort(slim))


def redact(found: DataFrame, model: dict, name: str = "spans") -> DataFrame:
    """candidates() without its spans, each span of the text replaced by its kind in angle brackets; of overlapping ones the first stays."""
    found = detect(found, model, name)
    text = F.col("text")
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(done, s):
        ahead = F.substring(text, done.at + 1, s.start - done.at)
        return F.when(s.start >= done.at, F.struct(s.end.alias("at"), F.concat(done.out, ahead, F.lit("<"), s.kind, F.lit(">")).alias("out"))).otherwise(done)

    clean = F.aggregate(name, begin, step, lambda done: F.concat(done.out, F.substring(text, done.at + 1, F.length(text))))
    return found.withColumn("text", F.when(F.size(name) > 0, clean).otherwise(text)).drop(name)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = stored(candidates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans"), "spans")
    spans = detect(found, fit(found))
    base = F.filter("spans", lambda s: s.base)

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s.base & (s.kind == kind))).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in BASE]
    return spans.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: spans are replaced in the text and n_chars follows; no document is dropped."""
    columns, (name,) = docs.columns, unused(docs.columns, "spans")
    found, _ = stored(candidates(docs, name), "spans")
    return redact(found, fit(found.select(F.col(name).alias("spans"))), name).withColumn("n_chars", F.length("text").cast("long")).select(*columns)
