"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact weighted-shingle check.

DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skillgrid.llm.common import kept, small
from skillgrid.llm.line_dedup import simhash_of

SIZE, PERCENT = 5, 80
#: All fingerprints up to this distance are found: of four 16-bit blocks one differs in at most 4 bits.
RADIUS = 19
FLIPS = [m for m in range(1 << 16) if m.bit_count() <= RADIUS // 4]


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), "")


def _hash(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(words, at + j) for j in range(size)])


def _shingles(words: Column, start: Column, count: Column, size: int) -> Column:
    """Hashes of ``count`` runs of ``size`` words from ``start`` on."""
    return F.transform(F.sequence(F.lit(0), count - 1), lambda j: _hash(words, start + j, size))


def _numbered(hashes: Column) -> Column:
    """The hashes, repeated ones told apart by their number, so that sets of them intersect as bags do."""
    tagged = F.transform(hashes, lambda x, i: F.xxhash64(x, F.size(F.filter(F.slice(hashes, 1, i + 1), lambda y: y == x))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.transform(hashes, lambda x: F.xxhash64(x, F.lit(1)))).otherwise(tagged)


def _blocks(fp: Column) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("b"), F.shiftrightunsigned(fp, 16 * k).bitwiseAND(0xFFFF).cast("int").alias("x")) for k in range(4)])


def _row_key(id: str, text: str) -> Column:
    return F.xxhash64(F.col(id).cast("string"), F.col(text))


def contaminated(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
                 percent: int = PERCENT) -> DataFrame:
    """(k, id, item, similarity, first_word, n_words): the best window of each document row for each item it holds.

    Words are lower-cased runs without space and U+0009 to U+000D. A window has as many words as the
    item. It is a leak if 100 * intersection >= ``percent`` * union of the bags of 5-word shingles of
    window and item (of all words, where an item has fewer than 5). Only windows are fingerprinted that can reach this: those
    with enough shingles of items of their length. Their SimHashes meet those of the items within 19 of 64
    bits by four blocks of 16 bits, of which one differs in at most 4 bits; every pair that meets is
    then checked exactly. Ties go to the first window. A null or empty text or item holds nothing;
    repeated items are listed each; rows with equal id and text are one; empty tables give an empty table.
    """
    wanted = items.select(F.col(item_id).alias("item"), _words(F.col(item_text)).alias("iw")).where(F.size("iw") > 0).withColumn("n", F.size("iw"))
    found = None
    sizes = sorted(r[0] for r in wanted.select(F.least("n", F.lit(SIZE))).distinct().collect())  # at most SIZE numbers
    for size in sizes:
        these = wanted.where(F.col("n") == size) if size < SIZE else wanted.where(F.col("n") >= SIZE)
        these = kept(these.withColumn("ih", _shingles(F.col("iw"), F.lit(0), F.col("n") - size + 1, size)).withColumn("ifp", simhash_of(F.col("ih"))).drop("iw"), "items")
        part = _of_size(docs, these, id, text, size, percent)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.select(F.lit(None).cast("long").alias("k"), F.col(id).alias("i"), F.lit(None).cast("double").alias("similarity"), F.lit(0).alias("first_word"), F.lit(0).alias("n_words")).join(
            items.select(F.col(item_id).alias("item")), F.lit(False)).select("k", "i", "item", "similarity", "first_word", "n_words")
    return found


def _of_size(docs: DataFrame, items: DataFrame, id: str, text: str, size: int, percent: int) -> DataFrame:
    longest = items.agg(F.max("n")).first()[0]
    known = items.select("n", F.explode("ih").alias("h")).distinct()
    rows = docs.select(_row_key(id, text).alias("k"), _words(F.col(text)).alias("w"))
    # outer: no filter that would split the words once more
    places = rows.select("k", "w", F.explode_outer(F.when(F.size("w") >= size, F.sequence(F.lit(0), F.size("w") - size))).alias("p"))
    hits = places.select("k", "p", _hash(F.col("w"), F.col("p"), size).alias("h")).where("p IS NOT NULL").join(small(known), "h").select("k", "n", "p").distinct()
    hits = kept(hits, "hits")
    # windows with at least ceil(2 * percent / (100 + percent) * shingles) known ones, by their first known one
    order = W.partitionBy("k", "n").orderBy("p")
    shingles = F.col("n") - size + 1
    need = F.ceil(2 * percent * shingles / (100 + percent) - 1e-9).cast("int")
    ahead = hits.withColumn("before", F.lag("p").over(order)).withColumn("ahead", F.collect_list("p").over(order.rangeBetween(0, longest - size))).withColumn("need", need)
    starts = ahead.where(F.size("ahead") >= F.col("need")).select("k", "n", "p", "ahead", "before", "need", F.explode(F.sequence(F.lit(0), shingles - F.col("need"))).alias("d"))
    start = F.col("p") - F.col("d")
    enough = F.size(F.filter("ahead", lambda q: q < start + F.col("n") - size + 1)) >= F.col("need")
    windows = starts.where((start >= 0) & (F.coalesce("before", F.lit(-1)) < start) & enough).select("k", "n", start.alias("s"))
    per_row = kept(windows.groupBy("k").agg(F.collect_set(F.struct("s", "n")).alias("windows")), "windows")
    rows = docs.select(_row_key(id, text).alias("dk"), F.col(id).alias("i"), F.col(text).alias("t")).join(small(per_row, 100_000), F.col("dk") == F.col("k")).dropDuplicates(["k"])
    rows = rows.select("k", "i", _words(F.col("t")).alias("w"), "windows").select("k", "i", "w", F.explode("windows").alias("win")).select("k", "i", "w", "win.s", "win.n")
    rows = rows.where(F.col("s") + F.col("n") <= F.size("w"))
    rows = rows.withColumn("wh", _shingles(F.slice("w", F.col("s") + 1, F.col("n")), F.lit(0), F.col("n") - size + 1, size)).drop("w")
    prints = kept(rows.withColumn("fp", simhash_of(F.col("wh"))), "prints")
    pairs = _near(prints.select("n", "fp"), items)
    both = prints.join(pairs, ["n", "fp"]).join(items.select("item", "n", "ih").distinct(), ["item", "n"])
    same = F.size(F.array_intersect("a", "b"))
    both = both.withColumns({"a": _numbered(F.col("wh")), "b": _numbered(F.col("ih"))}).select("k", "i", "item", "s", "n", same.alias("same"), (2 * F.size("a") - same).alias("all"))
    good = both.where(100 * F.col("same") >= percent * F.col("all")).withColumn("similarity", F.col("same") / F.col("all"))
    best = good.groupBy("k", "item", "n").agg(F.max(F.struct("similarity", (-F.col("s")).alias("s"), "i")).alias("m"))
    return best.select("k", F.col("m.i").alias("i"), "item", F.col("m.similarity").alias("similarity"), (-F.col("m.s")).alias("first_word"), F.col("n").alias("n_words"))


def _near(prints: DataFrame, items: DataFrame) -> DataFrame:
    """(n, fp, item): fingerprints of windows and items of as many words that differ in at most ``RADIUS`` bits.

    Every item has thousands of flipped blocks, far more than Spark's estimate of them: both sides are shuffled, neither is sent to the driver.
    """
    index = items.select("item", "n", "ifp", F.explode(_blocks(F.col("ifp"))).alias("b")).select("item", "n", "ifp", "b.b", "b.x", F.explode(F.lit(FLIPS)).alias("flip"))
    index = index.select("item", "n", "ifp", "b", F.col("x").bitwiseXOR(F.col("flip")).alias("x"))
    asked = prints.select("n", "fp", F.explode(_blocks(F.col("fp"))).alias("b")).select("n", "fp", "b.b", "b.x").distinct()
    return asked.join(index.hint("merge"), ["n", "b", "x"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= RADIUS).select("n", "fp", "item").distinct()


def leaks(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and benchmark item found in it: id, item_id, similarity, first_word and n_words (see ``contaminated``)."""
    found = contaminated(docs, items, id, text)
    return found.select(F.col("i").alias(id), F.col("item").alias("item_id"), "similarity", "first_word", "n_words")


def drop_leaks(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns as they were."""
    bad = kept(contaminated(docs, items, id, text).select(F.col("k").alias("__bad")).distinct(), "leaks")
    return docs.withColumn("__k", _row_key(id, text)).join(small(bad), F.col("__k") == F.col("__bad"), "left_anti").drop("__k")
