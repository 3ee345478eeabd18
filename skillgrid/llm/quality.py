"""Quality rules: word rules, and perplexity bands of a character n-gram model of each language."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillgrid.llm.charlm import BITS, MOST, Model, code_points, collect, count_grams, gram_hashes, gram_scores, languages, means, opened, packed, smooth
from skillgrid.llm.common import Words, kept, range_hashes, scramble, steps

ORDER = 5
#: A band reaches this many robust deviations (1.4826 times the median distance from the median), and at least this share of the median.
REACH, LEAST = 5.5, 0.2
#: Nats per character that count as equal for the medians; parts a language from its fold.
STEP, FOLD = 0.0005, "\x01"
WINDOW = 8
#: Characters of a block of texts that is scored by joins.
BLOCK_CHARS = 16 << 20
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_U = np.uint64


def word_rules(text: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text of a slice."""
    w = Words(text)
    n, many = w.counts(), w.n_texts
    lead = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])  # bytes that begin a character
    chars = lead[w.end] - lead[w.start]
    total = np.concatenate([[0], np.cumsum(chars)])
    marks = np.concatenate([[0], np.cumsum(np.isin(w.data, SYMBOLS))])
    h = w.hashes()
    return {"n_words": n, "word_chars": total[w.first[1:]] - total[w.first[:-1]], "n_symbols": marks[w.at[1:]] - marks[w.at[:-1]],
            "n_dup_lines": _dup_lines(w, many), "n_repeat_words": _repeat_words(w, h, n)}


def _again(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    if len(keys) < 2:
        return np.zeros(len(keys), bool)
    s = np.sort(keys)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def _repeat_words(w: Words, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Words that lie in a window of 8 words found twice or more in its text."""
    m = len(h) - WINDOW + 1
    if m <= 0:
        return np.zeros(w.n_texts, np.int64)
    key = np.zeros(m, np.uint64)
    for j in range(WINDOW):
        key += scramble(h[j:j + m] + _U(j * 0x1F3D5B79))
    ok = w.text[:m] == w.text[WINDOW - 1:]
    key = scramble(key) ^ scramble(w.text[:m].astype(np.uint64) + _U(77))
    at = np.flatnonzero(ok)
    at = at[_again(key[at])]
    change = np.zeros(len(h) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])
    return covered[w.first[1:]] - covered[w.first[:-1]]


def _dup_lines(w: Words, many: int) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    data, at = w.data, w.at
    if not len(w.start):
        return np.zeros(many, np.int64)
    stop = np.zeros(len(data) + 1, bool)
    stop[1:][data == 10] = True  # a line begins after each line feed and at each text
    stop[at] = True
    begin = np.flatnonzero(stop[:-1])
    end = np.append(begin[1:], len(data))
    end = end - (data[end - 1] == 10)
    has = np.searchsorted(w.start, end) > np.searchsorted(w.start, begin)
    begin, end = begin[has], end[has]
    owner = np.searchsorted(at, begin, "right") - 1
    key = range_hashes(data, begin, end) ^ scramble(owner.astype(np.uint64) + _U(99))
    _, back = np.unique(key, return_index=True)
    first = np.zeros(len(key), bool)
    first[back] = True
    return np.bincount(owner[~first], minlength=many)


def _grouped(docs: DataFrame, id: str, text: str, lang: str, source: str) -> DataFrame:
    """(i, t, g, s, fold) of every row: id, text, language, source and one of two folds. Equal texts share a fold."""
    s = F.coalesce(F.col(source).cast("string"), F.lit("")) if source in docs.columns else F.lit("")
    fold = F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.lit(2)).cast("int")
    return docs.select(F.col(id).alias("i"), F.col(text).alias("t"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("g"), s.alias("s"), fold.alias("fold"))


def fit(rows: DataFrame, order: int = ORDER, bits: int = BITS) -> Model:
    """Modified Kneser-Ney models of both folds of all languages of ``rows`` (see ``_grouped``), counted over every whole text."""
    return collect(_smoothed(rows, order), order, bits)


def _smoothed(rows: DataFrame, order: int) -> DataFrame:
    counts = count_grams(rows.select("t", F.concat("g", F.lit(FOLD), "fold").alias("g")), "t", "g", order)
    return smooth(counts, order, modified=True)


_RULES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_CARRIED = ("i", "g", "s", "fold")


def _schema(rows: DataFrame) -> str:
    kind = rows.schema["i"].dataType.simpleString()
    return f"i {kind}, g string, s string, fold int, {', '.join(f'{c} long' for c in _RULES)}, chars long, cross_entropy double"


def _judged(batch, order: int, log_probs) -> pa.RecordBatch:
    """The rules and the cross-entropy of a slice; ``log_probs`` gives the log probability of each place of ``codes``, from the texts' ``sizes``."""
    got = word_rules(batch.column("t"))
    codes, bounds = code_points(batch.column("t"), order - 1)
    size = np.diff(bounds)
    places = np.arange(bounds[-1]) + np.repeat((order - 1) * (np.arange(len(size)) + 1), size)
    entropy = -means(log_probs(codes, places, size), bounds)
    return pa.RecordBatch.from_arrays(
        [*[batch.column(c) for c in _CARRIED], *[pa.array(got[c].astype(np.int64)) for c in _RULES], pa.array(size), pa.array(entropy)], [*_CARRIED, *_RULES, "chars", "cross_entropy"])


def score(rows: DataFrame, model: Model) -> DataFrame:
    """(i, g, s, fold, the word rules, chars, cross_entropy) of every row; cross-entropy in nats per character, 0 for no text.

    A row is scored by the model of the other fold of its language; by its own only if the other has no text.
    """
    shared = model.share(rows.sparkSession)

    def run(batches):
        m = opened(shared)
        number = {name: k for k, name in enumerate(m.langs)}
        for batch in steps(batches, "t"):
            names = zip(batch.column("g").to_pylist(), batch.column("fold").to_pylist())
            lang_of = np.array([number.get(f"{g}{FOLD}{1 - f}", number.get(f"{g}{FOLD}{f}", 0)) for g, f in names], np.int64)
            yield _judged(batch, m.order, lambda codes, places, size: m.log_probs(codes, places, np.repeat(lang_of, size)) if m.langs else np.zeros(len(places)))

    return rows.mapInArrow(run, _schema(rows))


def score_joined(rows: DataFrame, model: DataFrame, order: int = ORDER, chars: int = BLOCK_CHARS) -> DataFrame:
    """As ``score``, with the model as a table (see ``smooth``) of any size.

    Texts are dealt to blocks of about ``chars`` characters; each gram gets its value by joins, and a task holds one block of texts and the values of its grams.
    """
    total = rows.agg(F.sum(F.length("t").cast("long"))).first()[0] or 0
    block = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(int(max(1, -(-total // chars))))).cast("int")
    texts = kept(rows.withColumn("block", block), "blocks")
    langs = languages(model)
    of = F.concat("g", F.lit(FOLD), F.lit(1) - F.col("fold"))
    of = F.when(of.isin(langs), of).otherwise(F.concat("g", F.lit(FOLD), "fold"))
    named = texts.withColumn("by", F.concat(F.col("block").cast("string"), F.lit(FOLD), of))
    grams = count_grams(named, "t", "by", order).select(F.substring_index("lang", FOLD, 1).cast("int").alias("b"), F.expr(f"substr(lang, instr(lang, '{FOLD}') + 1)").alias("lang"), "hi", "lo")
    grams = kept(grams, "block-grams")
    values = gram_scores(grams.select("lang", "hi", "lo").distinct(), model, order)
    values = grams.join(values, ["lang", "hi", "lo"]).select("b", "lang", "hi", "lo", "value")

    def run(batch: pa.Table, own: pa.Table) -> pa.Table:
        number = {name: k for k, name in enumerate(sorted(set(own.column("lang").to_pylist())))}
        owner = np.array([number[x] for x in own.column("lang").to_pylist()], np.uint64)
        hi, lo, value = (own.column(c).to_numpy() for c in ("hi", "lo", "value"))
        salt = 0
        while True:  # the block's grams have different hashes, and hold all grams of its texts
            keys = gram_hashes(owner, hi, lo, salt)
            by = np.argsort(keys)
            keys = keys[by]
            if not (keys[1:] == keys[:-1]).any():
                break
            salt += 1
        value = value[by]

        def log_probs(part):
            def probs(codes, places, size):
                names = zip(part.column("g").to_pylist(), part.column("fold").to_pylist())
                lang_of = np.array([number.get(f"{g}{FOLD}{1 - f}", number.get(f"{g}{FOLD}{f}", 0)) for g, f in names], np.uint64)
                if not len(places):
                    return np.zeros(0)
                h, l = packed(np.stack([codes[places - j] for j in range(order - 1, -1, -1)]).astype(np.int64))
                return value[np.searchsorted(keys, gram_hashes(np.repeat(lang_of, size), h, l, salt))]
            return probs

        made = [_judged(part, order, log_probs(part)) for part in steps(batch.combine_chunks().to_batches(), "t")]
        return pa.Table.from_batches(made)

    return texts.groupBy("block").cogroup(values.groupBy("b")).applyInArrow(run, _schema(rows))


def _bands(rows: DataFrame, reach: float) -> DataFrame:
    """(bg, bf, low, high) of each language and fold: the median of ``rows`` and ``reach`` deviations around it.

    The deviation is the median distance from the median, scaled to a normal distribution. Every source weighs as much as
    any other, whatever its rows, so less than half of the sources can't move a band far. Values are counted in
    steps of ``STEP`` nats: what a language gathers doesn't grow with its rows.
    """
    steps = rows.groupBy("g", "fold", "s", F.round(F.col("cross_entropy") / STEP).cast("long").alias("x")).agg(F.count("*").alias("n"))
    steps = kept(steps, "steps")
    total = steps.groupBy("g", "fold", "s").agg(F.sum("n").alias("total"))
    spread = steps.join(total, ["g", "fold", "s"]).groupBy("g", "fold", "x").agg(F.sum(F.col("n") / F.col("total")).alias("w"))
    spread = kept(spread.select("g", "fold", "x", F.greatest(F.round(F.col("w") * 1e9), F.lit(1)).cast("long").alias("w")), "spread")
    middle = spread.groupBy("g", "fold").agg(F.percentile("x", 0.5, F.col("w")).alias("mid"))
    # one row per language and fold
    wide = spread.join(F.broadcast(middle), ["g", "fold"]).groupBy("g", "fold", "mid").agg(F.percentile(F.abs(F.col("x") - F.col("mid")), 0.5, F.col("w")).alias("mad"))
    half = F.greatest(F.lit(reach * 1.4826) * F.col("mad"), LEAST * F.col("mid"))
    return wide.select(F.col("g").alias("bg"), F.col("fold").alias("bf"), (STEP * (F.col("mid") - half)).alias("low"), (STEP * (F.col("mid") + half)).alias("high"))


def judge(scored: DataFrame, reach: float = REACH) -> DataFrame:
    """Adds low, high, base_failed and kept.

    The band of a language and fold reaches ``reach`` robust deviations around the median cross-entropy of its
    rows that pass the word rules, and never less than 20 % of the median; see ``_bands``. A language
    with no such row has no band. Equal values are inside.
    """
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = scored.withColumn("base_failed", failed)
    bands = _bands(rows.where("NOT base_failed"), reach)
    inside = F.coalesce(F.col("cross_entropy").between(F.col("low"), F.col("high")), F.lit(True))
    return rows.join(F.broadcast(bands), (F.col("g") == F.col("bg")) & (F.col("fold") == F.col("bf")), "left").withColumn("kept", ~F.col("base_failed") & inside).drop("bg", "bf")


def quality(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", order: int = ORDER, reach: float = REACH, source: str = "source", most: int = MOST) -> DataFrame:
    """One row per row of ``docs``: id, the word rules, perplexity, its band, base_failed and kept.

    Words are runs without the characters space and U+0009 to U+000D. Rejected: fewer than 20 words,
    more than 30 % of the words in repeated 8-word windows, or a perplexity per character outside the
    band of the row's language and fold (see ``judge``), by a model that never saw the row's fold. A null text counts as empty and fails; a null language is a language
    of its own; repeated ids and rows are judged one by one; models of more than ``most`` entries stay tables (``score_joined``), with the same values; a single very long text takes a step of
    its own. An empty table gives an empty table. Of the other columns of ``docs`` only ``source`` is read, if it is there.
    """
    rows = _grouped(docs, id, text, lang, source)
    model = kept(_smoothed(rows, order), "model")
    scored = score(rows, collect(model, order)) if model.count() <= most else score_joined(rows, model, order)
    out = judge(kept(scored, "quality"), reach)
    return out.select(F.col("i").alias(id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                      F.exp("cross_entropy").alias("perplexity"), F.exp("low").alias("perplexity_low"), F.exp("high").alias("perplexity_high"))


def keep_good(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they were. Rows that share an id go if any of them is rejected; null ids go with each other."""
    bad = quality(docs, id, text, lang).where("NOT kept").select(F.col(id).alias("__bad")).distinct()
    return docs.join(bad, F.col(id).eqNullSafe(F.col("__bad")), "left_anti")
