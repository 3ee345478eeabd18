"""Personal data: regex, gazetteer and context labelers vote on candidate spans; expectation-maximisation weighs
them, and a span classifier trained on the weighed votes adds spans to the validated ones.

DataFrame and SQL functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skillgrid.llm.common import kept

KINDS = ("email", "ip", "card", "phone")
#: The patterns of the contract. Possessive groups match the same text without recursion; the look-behind keeps a search from
#: starting again inside a run that has just failed.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider candidates, only ever added by the classifier.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|\[dot\]|\(dot\))\x20?[A-Za-z0-9-]{1,63}){1,4}",
    "phone": r"(?<![A-Za-z0-9+.-])(?:\(0?[0-9]{2,4}\)|0[0-9]{2,4}|[0-9]{3})[\x20./-][0-9]{3,4}[\x20.-][0-9]{4}(?![A-Za-z0-9.-])",
}
#: Words that announce each kind, top-level domains, issuer prefixes, calling codes.
CONTEXT = {"email": r"(?i)(e-?mail|mail|contact|write to)\W*$", "ip": r"(?i)(\bip\b|host|server|address|login)\W*$",
           "card": r"(?i)(card|visa|mastercard|amex|payment|karte|tarjeta|carte)\W*$", "phone": r"(?i)(phone|tel|telephone|call|fax|mobile|cell|telefon|teléfono|téléphone)\W*$"}
GAZETTEER = {
    "email": r"(?i)[.)\]\x20](com|org|net|edu|gov|io|co|info|biz|example|test|de|fr|es|it|nl|uk|us|ca|au|ch|at|be|eu)$",
    "ip": r"^(10|127|172|192|198|203|[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.",
    "card": r"^(4|5[1-5]|2[2-7]|3[47]|3[0689]|6011|65|35)",
    "phone": r"^(\+(1|7|2[07]|3[0-4]|36|39|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|\(|0|[2-9])",
}
#: A candidate that isn't validated is added from this probability on.
ADDED = 0.9
VOTES = ("regex", "gazetteer", "context", "edges")


def _row_key(id: str, text: str) -> Column:
    return F.xxhash64(F.col(id).cast("string"), F.col(text))


def _spans(docs: DataFrame, id: str, text: str, kind: str, pattern: str, wide: bool) -> DataFrame:
    """(k, kind, wide, start, end, match, before, after) of all leftmost non-overlapping matches; places in code points."""
    mark = {"email": "(at" if wide else "@", "phone": None if wide else "+"}.get(kind)
    rows = docs.select(_row_key(id, text).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    if kind == "email" and wide:
        rows = rows.where(F.contains(F.lower("t"), F.lit("(at)")) | F.contains(F.lower("t"), F.lit("[at]")))
    elif mark:
        rows = rows.where(F.contains("t", F.lit(mark)))
    pattern_lit = F.lit(pattern)
    rows = rows.withColumn("m", F.regexp_extract_all("t", pattern_lit, F.lit(0))).where(F.size("m") > 0)
    rows = rows.select("k", "m", F.split("t", pattern, -1).alias("gap"))
    parts = rows.select("k", "gap", F.posexplode("m").alias("n", "match"))
    parts = parts.select("k", "n", "match", F.get("gap", F.col("n")).alias("gap"), F.left(F.get("gap", F.col("n") + 1), F.lit(1)).alias("after"))
    parts = parts.select("k", "n", "match", F.length("gap").alias("skip"), F.right("gap", F.lit(24)).alias("before"), "after").distinct()
    run = F.sum(F.col("skip") + F.length("match")).over(W.partitionBy("k").orderBy("n"))
    return parts.select("k", F.lit(kind).alias("kind"), F.lit(wide).alias("wide"), (run - F.length("match")).alias("start"), run.alias("end"), "match", "before", "after")


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a short string of digits passes the Luhn sum."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid() -> Column:
    """Whether a base match passes the check of its kind."""
    octet = r"0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
    d = _digits(F.col("match"))
    return (F.when(F.col("kind") == "email", F.lit(True))
            .when(F.col("kind") == "ip", F.col("match").rlike(rf"^{octet}\.{octet}\.{octet}\.{octet}$"))
            .when(F.col("kind") == "card", F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))
            .otherwise(F.length(d).between(10, 15)))


def candidates(docs: DataFrame, id: str, text: str) -> DataFrame:
    """All candidate spans of all rows with their votes: 1 for, 0 against, -1 for no vote."""
    found = None
    for wide, patterns in ((False, BASE), (True, WIDE)):
        for kind, pattern in patterns.items():
            part = _spans(docs, id, text, kind, pattern, wide)
            found = part if found is None else found.unionByName(part)
    found = found.withColumn("base", ~F.col("wide") & _valid()).where(F.col("base") | F.col("wide"))
    by_kind = lambda table: F.coalesce(*[F.when(F.col("kind") == k, F.col(c).rlike(p)) for k, (c, p) in table.items()])
    gazetteer = by_kind({k: ("match", p) for k, p in GAZETTEER.items()})
    context = by_kind({k: ("before", p) for k, p in CONTEXT.items()})
    edges = ~(F.col("before").rlike(r"[\p{L}\p{N}_]$") | F.col("after").rlike(r"^[\p{L}\p{N}_]"))
    return found.select("k", "kind", "base", "start", "end", F.col("base").cast("int").alias("regex"), gazetteer.cast("int").alias("gazetteer"),
                        F.when(context, 1).otherwise(-1).alias("context"), edges.cast("int").alias("edges"))


def reliabilities(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 30) -> dict[str, list[float]]:
    """Posterior of each vote pattern by expectation-maximisation of two classes with labelers that err independently.

    ``patterns`` are (kind, votes, count), bounded by the number of different votes. Returns kind -> posteriors in the order given.
    """
    out: dict[str, list[float]] = {}
    for kind in {p[0] for p in patterns}:
        rows = [(v, n) for k, v, n in patterns if k == kind]
        post = [min(0.95, max(0.05, (sum(x for x in v if x >= 0) + 0.5) / (sum(x >= 0 for x in v) + 1))) for v, _ in rows]
        for _ in range(rounds):
            total = sum(n for _, n in rows)
            prior = (sum(p * n for p, (_, n) in zip(post, rows)) + 1) / (total + 2)
            hit, noise = [], []
            for j in range(len(VOTES)):
                voting = [(p, v[j], n) for p, (v, n) in zip(post, rows) if v[j] >= 0]
                hit.append((sum(p * n for p, x, n in voting if x) + 4) / (sum(p * n for p, _, n in voting) + 5))
                noise.append((sum((1 - p) * n for p, x, n in voting if x) + 1) / (sum((1 - p) * n for p, _, n in voting) + 5))
            new = []
            for v, _ in rows:
                odds = math.log(prior / (1 - prior))
                for j, x in enumerate(v):
                    if x >= 0:
                        a, b = (hit[j], noise[j]) if x else (1 - hit[j], 1 - noise[j])
                        odds += math.log(a / b)
                new.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
            post = new
        out[kind] = post
    return out


def train(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 400) -> dict[str, list[float]]:
    """Logistic weights (bias first) of each kind's span classifier, fitted to the posteriors of the vote patterns."""
    posts = reliabilities(patterns)
    weights = {}
    for kind in KINDS:
        rows = [(v, n) for k, v, n in patterns if k == kind]
        total = sum(n for _, n in rows)
        w = [0.0] * (len(VOTES) + 1)
        for _ in range(rounds if total else 0):
            grad = [0.02 * x for x in w]
            for (v, n), p in zip(rows, posts[kind]):
                x = [1.0, *[{1: 1.0, 0: -1.0, -1: 0.0}[y] for y in v]]
                s = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x))))
                for j, y in enumerate(x):
                    grad[j] += n / total * (s - p) * y
            w = [a - 1.0 * g for a, g in zip(w, grad)]
        weights[kind] = w
    return weights


def find(docs: DataFrame, id: str = "doc_id", text: str = "text", least: float = ADDED) -> DataFrame:
    """(k, kind, start, end, base, probability) of all spans: validated base matches, and added candidates.

    A candidate from a wider pattern is added if the classifier gives it at least ``least`` and it overlaps no base
    span of its kind; of overlapping additions the first stays. Only the counts of the vote patterns, a few hundred rows at most, reach the driver.
    """
    spans = kept(candidates(docs, id, text), "spans")
    counted = spans.groupBy("kind", *VOTES).agg(F.count("*").alias("n")).collect()
    weights = train([(r["kind"], tuple(r[v] for v in VOTES), r["n"]) for r in sorted(counted, key=str)])
    signal = {v: F.when(F.col(v) < 0, 0.0).when(F.col(v) == 1, 1.0).otherwise(-1.0) for v in VOTES}
    score = F.coalesce(*[F.when(F.col("kind") == k, F.lit(w[0]) + sum((F.lit(x) * signal[v] for x, v in zip(w[1:], VOTES)), F.lit(0.0))) for k, w in weights.items()])
    spans = spans.withColumn("probability", 1 / (1 + F.exp(-score)))
    # candidates of one row and kind, in order: the furthest end of what came before, base spans first of all
    base_end = F.max(F.when(F.col("base"), F.col("end"))).over(W.partitionBy("k", "kind").orderBy("start", F.desc("base"), "end").rowsBetween(W.unboundedPreceding, -1))
    base_next = F.min(F.when(F.col("base"), F.col("start"))).over(W.partitionBy("k", "kind").orderBy("start", F.desc("base"), "end").rowsBetween(1, W.unboundedFollowing))
    free = (F.coalesce(base_end, F.lit(0)) <= F.col("start")) & (F.coalesce(base_next, F.col("end")) >= F.col("end"))
    spans = spans.withColumn("free", free).where(F.col("base") | (F.col("free") & (F.col("probability") >= least)))
    return spans.select("k", "kind", "start", "end", "base", "probability")


def report(docs: DataFrame, id: str = "doc_id", text: str = "text", least: float = ADDED) -> DataFrame:
    """One row per row of ``docs``: id, counts of the base spans by kind, base_sha256 and spans.

    Base spans are the leftmost non-overlapping matches of each kind's pattern that pass its check (ip parts up to 255, cards of 14 to 19
    digits with a Luhn sum, phones of 10 to 15 digits). Spans read kind:start:end in code points, end
    exclusive, by start, then kind as listed. A null or empty text has none; rows with equal id and text share their spans; an empty
    table gives an empty table.
    """
    order = F.coalesce(*[F.when(F.col("kind") == k, n) for n, k in enumerate(KINDS)])
    found = find(docs, id, text, least).withColumn("o", order)
    entry = F.struct("start", "o", "end", "kind")
    text_of = lambda c: F.array_join(F.transform(F.sort_array(c), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    per_row = found.groupBy(F.col("k").alias("g")).agg(
        *[F.sum((F.col("base") & (F.col("kind") == k)).cast("long")).alias(f"n_{k}") for k in KINDS],
        F.collect_list(F.when(F.col("base"), entry)).alias("b"), F.collect_list(entry).alias("a"))
    per_row = per_row.select("g", *[f"n_{k}" for k in KINDS], F.sha2(text_of(F.col("b")), 256).alias("base_sha256"), text_of(F.col("a")).alias("spans"))
    rows = docs.select(F.col(id).alias("__i"), _row_key(id, text).alias("k")).join(per_row, F.col("k") == F.col("g"), "left")
    return rows.select(F.col("__i").alias(id), *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in KINDS],
                       F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
