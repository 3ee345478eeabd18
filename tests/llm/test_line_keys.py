"""Keys of alike lines, small and large, against all pairs; what a finished step leaves on disk."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from skillgrid.llm import line_dedup
from skillgrid.llm.common import kept, small


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def components(edges, nodes):
    of = {n: n for n in nodes}

    def top(n):
        while of[n] != n:
            n = of[n]
        return n

    for u, v in edges:
        of[max(top(u), top(v))] = min(top(u), top(v))
    return {n: top(n) for n in nodes}


def near_lines():
    """Lines of one common start, one word of each replaced, and their like with another word."""
    draw = random.Random(5)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrs"]
    bases = [[draw.choice(words) for _ in range(30)] for _ in range(4)]
    out = {" ".join(base) for base in bases}
    for base in bases:
        for _ in range(12):
            line = list(base)
            line[draw.randrange(30)] = draw.choice(words)
            out.add(" ".join(line))
    return sorted(out)


@pytest.mark.parametrize("most", (2, 1024))
def test_groups_are_those_of_all_pairs(spark, most):
    lines = spark.createDataFrame([(x,) for x in near_lines()], "line string").select(F.xxhash64("line").alias("h"), "line")
    rows = lines.withColumn("fp", line_dedup.simhash(F.split("line", " "))).collect()
    prints = spark.createDataFrame([(r["h"], r["fp"]) for r in rows], "h long, fp long")
    links = [(a["h"], b["h"]) for a, b in combinations(rows, 2) if ((a["fp"] ^ b["fp"]) & (2**64 - 1)).bit_count() <= 3
             and distance(a["line"], b["line"]) <= 0.1 * max(len(a["line"]), len(b["line"]))]
    want = components(links, [r["h"] for r in rows])
    got = {r["node"]: r["component"] for r in line_dedup.line_groups(prints, lines, 0.9, most).collect()}
    assert len(links) > 20
    assert {h: got.get(h, h) for h in want} == want


def test_chance_mates_make_no_rows(spark):
    """Members of a small key that are not near each other never leave the join; the radius is on the join itself."""
    members = spark.range(60).select(F.col("id").alias("h"), F.expr("shiftleft(bigint(pow(2, id % 12)) - 1, 30)").alias("fp"), F.lit(0).cast("long").alias("key"))
    none = spark.createDataFrame([], "node long, component long")
    met = line_dedup._inside(members, none)
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_count" in next(x for x in plan.splitlines() if "Join" in x)
    want = {(u, v) for u, v in combinations(range(60), 2) if abs(u % 12 - v % 12) <= 3}
    assert {(r["u"], r["v"]) for r in met.collect()} == want


def test_repeated_rows_lose_each_line_once(spark):
    text = "one two three four five\nsix seven eight nine\none two three four five"
    docs = spark.createDataFrame([(1, text), (1, text), (2, "six seven eight nine")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["dropped"]) for r in line_dedup.line_report(docs).collect())
    assert got == [(1, [2]), (1, [2]), (2, [0])]


def test_a_kept_table_leaves_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = disk.getAllBlocks().size()
    spread = kept(spark.range(10_000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count(), "test")
    for _ in range(50):  # Spark removes them in the background
        if disk.getAllBlocks().size() <= before:
            break
        spark.range(1).count()
    assert spread.count() == 7
    assert disk.getAllBlocks().size() <= before + 2


def test_a_simhash_is_a_small_expression(spark):
    """Nested rounds of votes made an expression of 239,000 characters, which every executor compiled."""
    rows = spark.range(1).select(F.array(F.xxhash64("id")).alias("x"))
    assert len(rows.select(line_dedup.simhash_of(F.col("x")))._jdf.queryExecution().optimizedPlan().toString()) < 40_000


def test_only_little_is_sent_to_the_driver(spark):
    plans = [small(spark.range(n))._jdf.queryExecution().logical().toString() for n in (1_000, 300_000)]
    assert ["broadcast" in p for p in plans] == [True, False]
