"""Chunking, training and pooling of text vectors, similarity of names."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillgrid.functions import scores, skills, text
from skillgrid.session import freed_shuffles, work_dir

CHUNK_CHARS, MAX_CHUNKS = 3500, 12


def text_chunks(c: Column, size: int = CHUNK_CHARS, max_chunks: int | None = MAX_CHUNKS) -> Column:
    """Squeezed text cut before ``size`` characters at the last blank, hard where that blank is too early.

    Without ``max_chunks`` the whole text is cut, however long it is.
    """
    flat = text.squeeze(c)
    early = int(size * 0.65)
    # every full chunk takes at least `early` characters, which bounds the number of steps
    steps = F.ceil(F.length(flat) / F.lit(early)).cast("int") + 1
    rounds = steps if max_chunks is None else F.least(steps, F.lit(max_chunks))

    def step(acc, _):
        rest = acc["rest"]
        blank = F.instr(F.reverse(F.left(rest, F.lit(size))), " ")
        cut = F.when((blank == 0) | (size - blank < early), size).otherwise(size - blank)
        whole = F.length(rest) <= size
        piece = F.when(whole, rest).otherwise(F.trim(F.left(rest, cut)))
        left = F.when(whole, "").otherwise(F.trim(F.substring(rest, cut + 1, F.length(rest))))
        return F.when(rest == "", acc).otherwise(
            F.struct(left.alias("rest"), F.array_append(acc["out"], piece).alias("out")))

    start = F.struct(flat.alias("rest"), F.array().cast("array<string>").alias("out"))
    cutted = F.aggregate(F.sequence(F.lit(1), rounds), start, step, lambda acc: acc["out"])
    return F.when(flat == "", F.array(F.lit(""))).when(F.length(flat) <= size, F.array(flat)).otherwise(cutted)


#: Characters of cleaned text that one block of documents holds, on average.
BLOCK_CHARS = 16 << 20
#: Tokens that one step of a block works on; noise words drawn for each of them together, and how many each pair counts.
STEP, NOISE, NEGATIVES = 128, 64, 5
#: Pairs that move a vector in one step at most, and its greatest length.
MOST, LONGEST = 40, 8
#: Learning rate at the start and at the end.
RATE, LAST_RATE = 0.025, 0.0001


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = work_dir(df.sparkSession, label)
    with freed_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def token_blocks(docs: DataFrame, doc: str = "doc_id", text_col: str = "text", chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc, tokens, block): cleaned texts, stored once and dealt to blocks of about ``chars`` characters by their row."""
    total = docs.agg(F.sum(F.length(text_col).cast("long"))).first()[0] or 0
    busy = min(docs.sparkSession.sparkContext.defaultParallelism, -(-16 * total // chars))  # a small table still gives every core a block
    block = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(int(max(1, busy, -(-total // chars))))).cast("int")
    return _stored(docs.select(doc, text.normalise_text(F.col(text_col)).alias("tokens"), block.alias("block")), "blocks")


def _block_count(blocks: DataFrame) -> int:
    return (blocks.agg(F.max("block")).first()[0] or 0) + 1


def block_words(blocks: DataFrame) -> DataFrame:
    """(block, word, n): the distinct words of every block."""
    words = F.explode(F.filter(F.split("tokens", " "), lambda t: t != ""))
    return blocks.select("block", words.alias("word")).groupBy("block", "word").agg(F.count("*").alias("n"))


def _start(words: pd.Series, size: int, seed: int) -> np.ndarray:
    """First vectors of words: the same for a word wherever it stands."""
    keys = pd.util.hash_array(words.to_numpy(object), categorize=False) ^ np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
    cells = keys[:, None] + np.arange(1, size + 1, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93)
    drawn = (pd.util.hash_array(cells.ravel()) >> np.uint64(40)).astype(np.float32).reshape(cells.shape)
    return (drawn / np.float32(1 << 24) - np.float32(0.5)) / np.float32(size)


def _matrix(cells: pd.Series, size: int) -> np.ndarray:
    return np.array(np.frombuffer(b"".join(cells) or bytearray(), np.float32).reshape(len(cells), size))


def _cells(m: np.ndarray) -> list[bytes]:
    return [row.tobytes() for row in np.ascontiguousarray(m, np.float32)]


def _moved(old: np.ndarray, step: np.ndarray, weight: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Vectors after the sum of their steps. A step that many pairs share is cut to that of ``MOST`` pairs, a vector to length ``LONGEST``, so that no text runs away."""
    order = np.argsort(at, kind="stable")
    first = np.searchsorted(at[order], np.arange(len(old)))
    new = old + np.add.reduceat(step[order], first, axis=0) * np.minimum(1, MOST / np.maximum(np.add.reduceat(weight[order], first), 1e-9))[:, None]
    return new * np.minimum(1, LONGEST / np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-9))


def _skip_grams(ids: np.ndarray, part: np.ndarray, v: np.ndarray, u: np.ndarray, counts: np.ndarray, window: int, rates: tuple[float, float], draw) -> None:
    """One pass of skip-grams with negative samples over a block, in place; ``part`` tells sentences apart."""
    noise = np.cumsum(counts.astype(np.float64) ** 0.75)
    for at in range(0, len(ids), STEP):
        rate = np.float32(rates[0] + (rates[1] - rates[0]) * at / len(ids))
        low, end = max(0, at - window), min(len(ids), at + STEP)
        high = min(len(ids), end + window)
        c, x = ids[at:end], ids[low:high]
        far = np.abs(np.arange(at, end)[:, None] - np.arange(low, high)[None, :])
        near = (far > 0) & (far <= draw.integers(1, window + 1, len(c))[:, None]) & (part[at:end, None] == part[None, low:high])
        pairs = near.sum(1).astype(np.float32)
        neg = np.searchsorted(noise, draw.random(NOISE) * noise[-1])
        both = np.concatenate([x, neg])
        vc, ub = v[c], u[both]
        p = 1 / (1 + np.exp(-(vc @ ub.T)))
        share = np.empty_like(p)
        share[:, :len(x)] = near
        share[:, len(x):] = (pairs * np.float32(NEGATIVES / NOISE))[:, None] * (neg[None, :] != c[:, None])
        p[:, :len(x)] -= 1
        g = -rate * p * share
        for table, rows, weight, where in ((v, g @ ub, share.sum(1), c), (u, g.T @ vc, share.sum(0), both)):
            words, inside = np.unique(where, return_inverse=True)
            table[words] = _moved(table[words], rows, weight, inside)


def train_word_vectors(docs: DataFrame, text_col: str = "text", size: int = 100, window: int = 5, rounds: int = 10,
                       seed: int = 42, sentence: int = 1000, doc: str = "doc_id", chars: int = BLOCK_CHARS) -> DataFrame:
    """(word, vector) of every word of the cleaned texts: skip-grams with negative samples; ``vector`` holds ``size`` floats as bytes.

    A round trains each block of documents by itself, from the vectors of its own words, and averages a word's vectors over its blocks by its
    occurrences. The vocabulary stays a table: a task holds the words of one block, the driver none. Windows end at the end of a text or of ``sentence`` words.
    """
    blocks = token_blocks(docs, doc, text_col, chars)
    return _trained(blocks, _stored(block_words(blocks), "block-words"), size, window, rounds, seed, sentence)


def _by(df: DataFrame, column: str, groups: int):
    """``df`` grouped by ``column``, in tasks of a group or two: the work on a group is long, whatever its bytes."""
    return df.repartition(2 * groups, column).groupBy(column)


def _trainer(turn: int, last: bool, rates: tuple[float, float], size: int, window: int, seed: int, sentence: int):
    def train(key, texts, own):
        if not len(own):
            return pd.DataFrame({"word": [], "v": [], "u": [], "n": []})
        own = own.sort_values("word", ignore_index=True)
        v = _start(own["word"], size, seed) if not turn else _matrix(own["v"], size)
        u = np.zeros_like(v) if not turn else _matrix(own["u"], size)
        number = dict(zip(own["word"], range(len(own))))
        lists = [t.split() for t in texts["tokens"].sort_values()]
        ids = np.array([number[w] for t in lists for w in t], np.int64)
        sizes = np.array([len(t) for t in lists], np.int64)
        inside = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        part = np.repeat(np.arange(len(lists)) << 32, sizes) + inside // sentence
        _skip_grams(ids, part, v, u, own["n"].to_numpy(), window, rates, np.random.default_rng([seed, turn, int(key[0])]))
        return pd.DataFrame({"word": own["word"], "v": _cells(v), "u": [None] * len(own) if last else _cells(u), "n": own["n"]})

    return train


def _averager(last: bool, size: int):
    def mean(rows):
        at, names = pd.factorize(rows["word"])
        order = np.argsort(at, kind="stable")
        first = np.searchsorted(at[order], np.arange(len(names)))
        n = rows["n"].to_numpy(np.float64)[order, None]
        out = {"word": names}
        for c in ("v", "u"):
            out[c] = [None] * len(names) if c == "u" and last else _cells(
                np.add.reduceat(_matrix(rows[c].iloc[order], size) * n, first, axis=0) / np.add.reduceat(n, first, axis=0))
        return pd.DataFrame(out)

    return mean


def _trained(blocks: DataFrame, words: DataFrame, size: int, window: int, rounds: int, seed: int, sentence: int) -> DataFrame:
    none = F.lit(None).cast("binary")
    table, n = None, _block_count(blocks)
    for turn in range(rounds):
        last = turn == rounds - 1
        span = RATE - LAST_RATE
        rates = (RATE - span * turn / rounds, RATE - span * (turn + 1) / rounds)

        own = words.withColumn("v", none).withColumn("u", none) if table is None else words.join(table, "word")
        done = _by(blocks.where("tokens <> ''").select("block", "tokens"), "block", n).cogroup(_by(own, "block", n)).applyInPandas(
            _trainer(turn, last, rates, size, window, seed, sentence), "word string, v binary, u binary, n long")
        # words are dealt to as many groups as there are blocks, so a group holds about the words of a block
        table = _stored(_by(done.withColumn("g", F.pmod(F.xxhash64("word"), F.lit(n))), "g", n).applyInPandas(
            _averager(last, size), "word string, v binary, u binary"), "word-vectors")
    return table.select("word", F.col("v").alias("vector"))


def document_vectors(model: DataFrame, docs: DataFrame, doc: str = "doc_id", text_col: str = "text", size: int = 100, chars: int = BLOCK_CHARS) -> DataFrame:
    """Mean of the known word vectors of a text; zeros when there are none. A task holds one block of texts and the vectors of its words."""
    blocks = token_blocks(docs, doc, text_col, chars)
    return _averaged(blocks, block_words(blocks).join(model, "word").select("block", "word", "vector"), doc, size)


def _averaged(blocks: DataFrame, own: DataFrame, doc: str, size: int) -> DataFrame:
    def mean(texts: pa.Table, own: pa.Table) -> pa.Table:
        number = {w: k for k, w in enumerate(own.column("word").to_pylist())}
        table = _matrix(own.column("vector").to_pylist(), size).astype(np.float64)
        out, tokens = np.zeros((len(texts), size)), texts.column("tokens")
        for k in range(len(texts)):
            at = np.array([number[w] for w in tokens[k].as_py().split() if w in number], np.int64)
            for low in range(0, len(at), 1 << 14):  # a very long text in steps
                out[k] += table[at[low:low + (1 << 14)]].sum(axis=0) / len(at)
        bounds = np.arange(0, out.size + 1, size, dtype=np.int32)
        return pa.table([texts.column(doc), pa.ListArray.from_arrays(pa.array(bounds), pa.array(out.ravel()))], [doc, "vector"])

    schema = f"`{doc}` {blocks.schema[doc].dataType.simpleString()}, vector array<double>"
    n = _block_count(blocks)
    return _by(blocks, "block", n).cogroup(_by(own.withColumnRenamed("block", "_block"), "_block", n)).applyInArrow(mean, schema)


def pooled_vectors(chunks: DataFrame, owner: list[str], vector: str = "vector") -> DataFrame:
    """Mean of the chunk vectors of an owner, scaled to length one."""
    mean = chunks.withColumn("_v", array_to_vector(vector)).groupBy(*owner).agg(Summarizer.mean(F.col("_v")).alias("_m"))
    pooled = mean.withColumn("_a", vector_to_array("_m")).withColumn("_n", scores.norm(F.col("_a")))
    return pooled.select(*owner, F.transform("_a", lambda x: F.when(F.col("_n") > 0, x / F.col("_n")).otherwise(x)).alias("vector"))


def with_neutral(docs: DataFrame, vectors: DataFrame, key: str, dim: int) -> DataFrame:
    """Documents without a vector get zeros and are marked as failed."""
    zero = F.array_repeat(F.lit(0.0), dim)
    return docs.join(vectors.select(key, "vector"), key, "left").withColumn("failed", F.col("vector").isNull()).withColumn(
        "vector", F.coalesce("vector", zero))


def name_cosine(pairs: DataFrame, left: str, right: str) -> Column:
    """Token-bag cosine of two skill names on one row."""
    a, b = skills.skill_tokens(F.col(left)), skills.skill_tokens(F.col(right))

    def count(tokens, t):
        return F.size(F.filter(tokens, lambda x: x == t))

    def total(of, other):
        return F.aggregate(F.array_distinct(of), F.lit(0), lambda s, t: s + count(of, t) * count(other, t))

    size = F.sqrt(total(a, a)) * F.sqrt(total(b, b))
    return F.when(size == 0, 0.0).otherwise(total(a, b) / F.greatest(size, F.lit(1e-9)))


def token_pairs(names: DataFrame, name: str = "skill") -> DataFrame:
    """Cosine of all name pairs (left < right) that share a token, by an equi-join on tokens."""
    bags = names.select(name).distinct().select(F.col(name).alias("n"), F.explode(skills.skill_tokens(F.col(name))).alias("t"))
    bags = bags.groupBy("n", "t").agg(F.count("*").alias("c"))
    norms = bags.groupBy("n").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("size"))
    l = bags.select(F.col("n").alias("left"), "t", F.col("c").alias("lc"))
    r = bags.select(F.col("n").alias("right"), "t", F.col("c").alias("rc"))
    dots = l.join(r, "t").filter("left < right").groupBy("left", "right").agg(F.sum(F.col("lc") * F.col("rc")).alias("dot"))
    ln = norms.select(F.col("n").alias("left"), F.col("size").alias("ls"))
    rn = norms.select(F.col("n").alias("right"), F.col("size").alias("rs"))
    return dots.join(ln, "left").join(rn, "right").select("left", "right", (F.col("dot") / (F.col("ls") * F.col("rs"))).alias("cosine"))
