"""Line deduplication: SimHash of normalised lines, pigeonhole blocks, edit similarity, one line of each group kept.

DataFrame and SQL functions only.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skillgrid.llm.common import kept, small
from skillgrid.llm.components import components
from skillgrid.session import shuffle_width

#: Fingerprints within this Hamming distance are all met: 5 blocks leave 2 whole ones, and every pair of blocks is a key.
RADIUS = 3
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
SIMILARITY = 0.9
_BYTES = 0x0101010101010101
_LOW = 0x0001010101010101
_PIECE = 127
#: Members of a key that all meet inside one join, some microseconds each; larger keys go by components.
MANY = 1024


def normal_line(line: Column) -> Column:
    """Lower case, digits as 0, everything but letters, marks and digits as one blank between words."""
    plain = F.regexp_replace(F.lower(line), r"\p{N}", "0")
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{M}0]+", " "))


def _vote(hashes: Column) -> Column:
    """Majority of at most 127 hashes, bit by bit.

    The counts of 64 bits lie in eight longs, a byte each. Adding 128 - ceil(n / 2) to a byte sets its
    top bit exactly if its count is ceil(n / 2) or more; no byte can overflow. The highest byte is
    compared by itself, so that no sum reaches the sign.
    """
    names = [f"c{k}" for k in range(8)]
    start = F.struct(*[F.lit(0).cast("long").alias(c) for c in names], F.lit(0).cast("long").alias("n"))

    def add(acc: Column, h: Column) -> Column:
        return F.struct(*[(acc[c] + F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_BYTES))).alias(c) for k, c in enumerate(names)], (acc["n"] + 1).alias("n"))

    return F.aggregate(hashes, start, add, lambda acc: _majority([acc[c] for c in names], acc["n"]))


def _majority(counts: list[Column], n: Column) -> Column:
    out, half = F.lit(0).cast("long"), F.shiftright(n + 1, 1)
    for k, c in enumerate(counts):
        low = F.shiftrightunsigned(c.bitwiseAND(F.lit((1 << 56) - 1)) + (F.lit(128) - half) * F.lit(_LOW), 7).bitwiseAND(F.lit(_LOW))
        top = F.when(F.shiftrightunsigned(c, 56) >= half, F.lit(1 << 56)).otherwise(F.lit(0).cast("long"))
        out = out.bitwiseOR(F.shiftleft(low.bitwiseOR(top), k))
    return out


def _pieces(hashes: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(hashes), F.lit(_PIECE)), lambda i: _vote(F.slice(hashes, i, _PIECE)))


def simhash(words: Column) -> Column:
    """64-bit SimHash of an array of words; null for no words.

    A line of more than 127 words is cut into runs of 127, and the majorities of the runs vote again.
    """
    return simhash_of(F.transform(words, lambda w: F.xxhash64(w)))


def simhash_of(hashes: Column) -> Column:
    """64-bit SimHash of an array of 64-bit feature hashes; null for none.

    Four rounds leave at most 127 votes of any array; each is the same expression, as nested ones would have 15 votes in them,
    which cost the executors memory to compile.
    """
    left = F.aggregate(F.sequence(F.lit(1), F.lit(4)), hashes, lambda votes, _: F.when(F.size(votes) <= _PIECE, votes).otherwise(_pieces(votes)))
    return F.when(F.size(hashes) > 0, _vote(left))


def _keys(fingerprint: Column) -> Column:
    """One key for every pair of the five blocks."""
    part = [F.shiftrightunsigned(fingerprint, at).bitwiseAND((1 << size) - 1) for at, size in BLOCKS]
    return F.array(*[F.lit(k << 32).bitwiseOR(F.shiftleft(part[a], 13)).bitwiseOR(part[b]).cast("long")
                     for k, (a, b) in enumerate(combinations(range(len(BLOCKS)), 2))])


def _row_key(id: str, text: str) -> Column:
    return F.xxhash64(F.col(id).cast("string"), F.col(text))


def _lines(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(i, k, pos, h, line) of every line with a letter or digit; line is normalised, h its hash."""
    rows = docs.select(F.col(id).alias("i"), _row_key(id, text).alias("k"), F.posexplode(F.split(F.col(text), "\n")).alias("pos", "raw"))
    rows = rows.select("i", "k", "pos", normal_line(F.col("raw")).alias("line")).where("line <> ''")
    return rows.select("i", "k", "pos", F.xxhash64("line").alias("h"), "line")


def _fingerprints(lines: DataFrame) -> DataFrame:
    """(i, k, pos, h, fp): the SimHash of each line, its bit counts summed by a grouped aggregation.

    Pieces of 127 words are counted first; ``simhash`` of the words is the same number.
    """
    rows = lines.withColumn("row", F.monotonically_increasing_id()).withColumn("words", F.split("line", " "))
    words = rows.select("i", "k", "pos", "h", "row", (F.size("words") <= _PIECE).alias("short"), F.posexplode("words").alias("n", "word"))
    words = words.select("i", "k", "pos", "h", "row", "short", F.expr(f"n div {_PIECE}").alias("piece"), F.xxhash64("word").alias("x"))
    sums = [F.sum(F.shiftrightunsigned("x", j).bitwiseAND(F.lit(_BYTES))).alias(f"c{j}") for j in range(8)]
    votes = words.groupBy("i", "k", "pos", "h", "row", "short", "piece").agg(*sums, F.count("*").alias("n"))
    votes = votes.select("i", "k", "pos", "h", "short", "piece", _majority([F.col(f"c{j}") for j in range(8)], F.col("n")).alias("vote"))
    # a repeated row has the same votes once more
    one = votes.where("short").groupBy("i", "k", "pos", "h").agg(F.min("vote").alias("fp"))
    many = votes.where("NOT short").groupBy("i", "k", "pos", "h").agg(F.sort_array(F.collect_set(F.struct("piece", "vote"))).alias("all"))
    return one.unionByName(many.select("i", "k", "pos", "h", simhash_of(F.transform("all", lambda v: v["vote"])).alias("fp")))


def _near(u: str, v: str) -> Column:
    return F.bit_count(F.col(u).bitwiseXOR(F.col(v))) <= RADIUS


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def _past_common(pair: Column) -> Column:
    """The word lists u and v of a struct without their common first words but one, both turned round."""
    differs = F.array_position(F.zip_with(pair["u"], pair["v"], lambda a, b: a.eqNullSafe(b)), False)

    def tail(side: str, at: Column) -> Column:
        return F.reverse(F.slice(pair[side], at, F.size(pair[side]))).alias(side)

    return _let(F.greatest(differs - 1, F.lit(1)).cast("int"), lambda at: F.struct(tail("u", at), tail("v", at)))


def edit_alike(u: Column, v: Column, allowed: Column) -> Column:
    """Whether the edit distance of two lines of words parted by single blanks is at most ``allowed``.

    Equal words at both ends but the innermost are cut off, which leaves the distance as it is. If as many words
    remain on both sides, the letters of the words that differ are an upper bound; beyond it the distance is worked out.
    """
    def close(w: Column) -> Column:
        letters = F.zip_with(w["u"], w["v"], lambda a, b: F.when(a == b, 0).otherwise(F.greatest(F.length(a), F.length(b))))
        bound = F.aggregate(letters, F.lit(0), lambda x, y: x + y)
        distance = F.call_function("levenshtein", F.array_join(w["u"], " "), F.array_join(w["v"], " "), allowed)
        return F.when((F.size(w["u"]) == F.size(w["v"])) & (bound <= allowed), True).otherwise(distance >= 0)

    words = F.struct(F.split(u, " ").alias("u"), F.split(v, " ").alias("v"))
    return _let(words, lambda w: _let(_past_common(w), lambda x: _let(_past_common(x), close)))


def _alike(pairs: DataFrame, lines: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) of line hashes whose lines have an edit similarity of at least ``similarity``."""
    named = kept(pairs.select(F.col("u").alias("h")).unionByName(pairs.select(F.col("v").alias("h"))).distinct(), "named")
    texts = kept(lines.select("h", "line").join(small(named), "h", "left_semi").groupBy("h").agg(F.min("line").alias("line")), "texts")
    spread = pairs.repartition(shuffle_width(pairs.sparkSession), "u", "v")
    both = spread.join(texts.select(F.col("h").alias("u"), F.col("line").alias("lu")), "u").join(texts.select(F.col("h").alias("v"), F.col("line").alias("lv")), "v")
    both = both.withColumn("allowed", F.floor((1 - F.lit(similarity)) * F.greatest(F.length("lu"), F.length("lv")) + 1e-9).cast("int"))
    both = both.where(F.abs(F.length("lu") - F.length("lv")) <= F.col("allowed"))
    return both.where(edit_alike(F.col("lu"), F.col("lv"), F.col("allowed"))).select("u", "v")


def _first_key(flips: Column) -> Column:
    """The number of the first pair of blocks in which no bit differs."""
    same = [F.shiftrightunsigned(flips, at).bitwiseAND((1 << size) - 1) == 0 for at, size in BLOCKS]
    return F.coalesce(*[F.when(same[a] & same[b], k) for k, (a, b) in enumerate(combinations(range(len(BLOCKS)), 2))])


def _of_component(members: DataFrame, groups: DataFrame) -> DataFrame:
    return members.join(small(groups), F.col("h") == F.col("node"), "left").select("key", "h", "fp", F.coalesce("component", "h").alias("c"))


def _inside(members: DataFrame, groups: DataFrame) -> DataFrame:
    """As ``_apart``, for small keys: all members of a key meet, and what else they meet never leaves the join."""
    members = _of_component(members, groups)
    mine = members.select("key", F.col("h").alias("u"), F.col("fp").alias("fu"), F.col("c").alias("cu"))
    other = members.select("key", F.col("h").alias("v"), F.col("fp").alias("fv"), F.col("c").alias("cv"))
    first = F.shiftright("key", 32) == _first_key(F.col("fu").bitwiseXOR(F.col("fv")))
    return mine.join(other.hint("merge"), "key").where((F.col("u") < F.col("v")) & (F.col("cu") != F.col("cv")) & _near("fu", "fv") & first).select("u", "v")


def line_groups(prints: DataFrame, lines: DataFrame, similarity: float, most: int = MANY) -> DataFrame:
    """(node, component) of the line hashes that are linked with another line; ``prints`` has h and fp of each line once.

    Every member of a key first meets the key's smallest member; then members of a key that are still in different
    components meet: all of them in keys of up to ``most``, by parts of the other bits in larger ones (see ``_apart``).
    Pairs inside a component need no check.
    """
    # the key is worked out on both sides of the shuffle, so only its number is moved
    key = F.get(_keys(F.col("fp")), F.col("number"))
    numbers = F.array(*[F.lit(k).cast("byte") for k in range(10)])
    keyed = prints.select("h", "fp", F.explode(numbers).alias("number")).repartition(key).select("h", "fp", key.alias("key"))
    of_key = W.partitionBy("key")
    met = keyed.withColumns({"many": F.count("*").over(of_key), "lead": F.min(F.struct("h", "fp")).over(of_key)}).where("many > 1")
    close = (F.col("h") != F.col("lead.h")) & _near("fp", "lead.fp")
    members = kept(met.select("h", "fp", "key", "many", F.when(close, F.col("lead.h")).alias("led")), "members")
    pairs = kept(members.where("led IS NOT NULL").select(F.col("led").alias("u"), F.col("h").alias("v")).distinct(), "pairs")
    links = kept(_alike(pairs, lines, similarity), "links")
    groups = components(links)
    # two members have met already
    rest, large = _inside(members.where((F.col("many") > 2) & (F.col("many") <= most)), groups), members.where(F.col("many") > most)
    if not large.isEmpty():
        rest = rest.unionByName(_apart(large, groups))
    rest = kept(rest.join(pairs, ["u", "v"], "left_anti"), "pairs")
    if rest.isEmpty():
        return groups
    return components(links.unionByName(_alike(rest, lines, similarity)))


def _apart(members: DataFrame, groups: DataFrame) -> DataFrame:
    """(u, v) of all pairs within the radius that share no component of ``groups`` and whose first common key is one of ``members``.

    Members outside the largest component of a key meet all others of the key that agree with them in one of four parts of
    the 39 bits outside the key's blocks: 3 flipped bits leave one part whole.
    """
    rest = F.coalesce(*[F.when(F.shiftright("key", 32) == k, _join_bits([j for j in range(5) if j not in two])) for k, two in enumerate(combinations(range(5), 2))])
    large = _of_component(members, groups)
    sizes = large.groupBy("key", "c").agg(F.count("*").alias("n"))
    top = sizes.groupBy("key").agg(F.max(F.struct("n", "c")).alias("t"), F.count("*").alias("parts")).where("parts > 1").select("key", F.col("t.c").alias("top"))
    large = large.join(top, "key").withColumn("rest", rest)
    large = kept(large.select("key", "h", "fp", "c", "top", "rest", F.posexplode(F.array(*[F.shiftright("rest", 10 * j).bitwiseAND(1023) for j in range(4)])).alias("part", "bits")), "apart")
    few = large.where("c <> top").drop("top")
    others = large.select("key", "part", "bits", F.col("h").alias("oh"), F.col("fp").alias("ofp"), F.col("c").alias("oc"), F.col("rest").alias("orest"))
    # each pair at the first key and the first part that it shares only
    first_key = _first_key(F.col("fp").bitwiseXOR(F.col("ofp")))
    mine, other = F.col("rest"), F.col("orest")
    first_part = F.coalesce(*[F.when(F.shiftright(mine.bitwiseXOR(other), 10 * j).bitwiseAND(1023) == 0, j) for j in range(4)])
    met = few.join(others, ["key", "part", "bits"]).where("c <> oc").where(_near("fp", "ofp"))
    return met.where((F.shiftright("key", 32) == first_key) & (F.col("part") == first_part)).select(F.least("h", "oh").alias("u"), F.greatest("h", "oh").alias("v")).distinct()


def _join_bits(blocks: list[int]) -> Column:
    out = F.lit(0).cast("long")
    for j in blocks:
        at, size = BLOCKS[j]
        out = F.shiftleft(out, 13).bitwiseOR(F.shiftrightunsigned("fp", at).bitwiseAND((1 << size) - 1))
    return out


def dropped_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(k, dropped) of every row that loses lines: its key and the numbers of those lines, from 0.

    Lines are the pieces between line feeds. Two lines are linked if the SimHashes of their normalised
    words differ in at most 3 of 64 bits and their edit similarity, 1 - distance / longer length, is at
    least ``similarity``; equal normalised lines always are. Of each connected group the line with the
    smallest (id, row key, number) stays. Lines without a letter or digit are never dropped. A line is
    known by a 64-bit hash of its normal form. Nulls sort first; rows with the same id and text are one
    document; a null or empty text has nothing to drop; an empty table gives an empty table.
    """
    lines = kept(_lines(docs, id, text), "lines")
    prints = kept(_fingerprints(lines).groupBy("h").agg(F.min("fp").alias("fp"), F.count("*").alias("n"), F.min(F.struct("i", "k", "pos")).alias("at")), "prints")
    groups = line_groups(prints, lines, similarity)
    by_hash = prints.join(small(groups), F.col("h") == F.col("node"), "left").select("h", "n", "at", F.coalesce("component", "h").alias("g"))
    by_hash = kept(by_hash, "groups")
    stays = by_hash.groupBy("g").agg(F.sum("n").alias("n"), F.min("at").alias("at")).where("n > 1").select(F.col("g").alias("sg"), F.col("at").alias("stays"))
    twice = by_hash.join(stays, F.col("g") == F.col("sg")).select(F.col("h").alias("th"), "stays")
    gone = lines.select("k", "pos", "h").join(twice, F.col("h") == F.col("th")).where(~((F.col("k") == F.col("stays.k")) & (F.col("pos") == F.col("stays.pos"))))
    # a repeated row has the same lines once more
    return gone.groupBy("k").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def dedup_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with the kept lines of each text; all columns as they were, and __lines, __dropped (see ``dropped_lines``).

    A text that loses all its lines becomes empty, a null text stays null.
    """
    gone = kept(dropped_lines(docs, id, text, similarity), "dropped")
    rows = docs.withColumn("__k", _row_key(id, text)).join(gone.select(F.col("k").alias("__g"), F.col("dropped").alias("__dropped")), F.col("__k") == F.col("__g"), "left")
    rows = rows.withColumn("__split", F.split(F.col(text), "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size("__split") - 1), F.col("__dropped"))
    cut = F.array_join(F.transform(left, lambda i: F.get("__split", i)), "\n")
    rows = rows.withColumns({text: F.when(F.col("__dropped").isNull(), F.col(text)).otherwise(cut), "__lines": F.coalesce(F.size("__split"), F.lit(0))})
    return rows.drop("__k", "__g", "__split")


def line_report(docs: DataFrame, id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: id, n_lines, n_dropped and the dropped line numbers."""
    gone = dropped_lines(docs, id, text, similarity).withColumnRenamed("k", "g")
    rows = docs.select(F.col(id), _row_key(id, text).alias("k"), F.when(F.col(text).isNull(), 0).otherwise(F.size(F.split(F.col(text), "\n"))).alias("n_lines"))
    none = F.array().cast("array<int>")
    return rows.join(gone, F.col("k") == F.col("g"), "left").select(F.col(id), "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).alias("n_dropped"), F.coalesce("dropped", none).alias("dropped"))
