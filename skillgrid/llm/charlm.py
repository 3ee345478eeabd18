"""Kneser-Ney character language models: counted and smoothed by Spark, looked up in sorted hash arrays.

A gram of n characters is held in two longs of 21-bit code points: ``lo`` has the last three, ``hi``
the older ones. Code 0 stands before the beginning of a text. The finished model is one array of
sorted 64-bit hashes with one log value each (log probability of a gram, or log back-off weight of a
context). All 64 bits are compared and no two grams of a model share a hash, so every gram has its own
value. A model of more than ``MOST`` entries stays a table: ``gram_scores`` gives each gram its value by joins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillgrid.llm.common import kept, scramble, steps

MASK = (1 << 21) - 1
#: Leading bits of a hash by which its place is looked up.
BITS = 22
#: Entries of a model that is sent to the tasks as arrays (12 bytes each).
MOST = 1 << 23
#: Bits of a hash that a bounded model holds.
WIDTH = 24
_U = np.uint64


def code_points(text: pa.Array, pad: int, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each after ``pad`` zeros, and where each text's characters begin and end (n + 1 bounds before padding)."""
    if text.null_count:
        text = text.fill_null("")
    if lower:
        text = pc.utf8_lower(text)
    sizes = pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
    whole = "".join(text.to_pylist())
    raw = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    codes = np.zeros(len(raw) + pad * len(sizes), np.uint32)
    at = np.arange(len(raw)) + np.repeat(pad * (np.arange(len(sizes)) + 1), sizes)
    codes[at] = raw
    return codes, bounds


def _grams(codes: np.ndarray, bounds: np.ndarray, order: int, group: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (group, gram) and their counts; the gram as rows of ``order`` code points, oldest first."""
    sizes = np.diff(bounds)
    place = np.arange(bounds[-1]) + np.repeat((order - 1) * (np.arange(len(sizes)) + 1), sizes)
    owner = np.repeat(group, sizes)
    seen = np.zeros(0x110000, bool)
    seen[codes] = True
    seen[0] = True
    letters = np.flatnonzero(seen).astype(np.uint32)
    dense = np.zeros(0x110000, np.uint32)
    dense[letters] = np.arange(len(letters), dtype=np.uint32)
    small = dense[codes].astype(np.uint64)
    bits = max(1, int(len(letters) - 1).bit_length())
    if bits * order + int(group.max(initial=0)).bit_length() <= 64:
        key = owner.astype(np.uint64)
        for j in range(order - 1, -1, -1):
            key <<= _U(bits)
            key |= small[place - j]
        key.sort()
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        counts = np.diff(np.append(new, len(key)))
        key = key[new]
        low = _U((1 << bits) - 1)
        cols = [letters[((key >> _U(bits * j)) & low).astype(np.int64)] for j in range(order - 1, -1, -1)]
        return (key >> _U(bits * order)).astype(np.int64), np.array(cols, np.int64).reshape(order, -1), counts
    rows = np.stack([owner, *[codes[place - j] for j in range(order - 1, -1, -1)]], axis=1).astype(np.int64)
    rows, counts = np.unique(rows, axis=0, return_counts=True)
    return rows[:, 0], rows[:, 1:].T, counts


def packed(cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hi, lo) of grams given as rows of code points, oldest first."""
    lo, hi = np.zeros(cols.shape[1], np.int64), np.zeros(cols.shape[1], np.int64)
    for c in cols[:-3]:
        hi = (hi << 21) | c
    for c in cols[-3:]:
        lo = (lo << 21) | c
    return hi, lo


def gram_hashes(lang: np.ndarray, hi: np.ndarray, lo: np.ndarray, salt: int) -> np.ndarray:
    """64-bit hashes of grams of numbered languages."""
    return scramble(scramble(hi.astype(np.uint64) + (lang << _U(48)) + _U(salt + 1)) + lo.astype(np.uint64))


def count_grams(docs: DataFrame, text: str, lang: str, order: int, lower: bool = False) -> DataFrame:
    """(lang, hi, lo, n): how often each gram of ``order`` characters stands in the texts of each language."""
    if not 2 <= order <= 6:
        raise ValueError("order must lie between 2 and 6")

    def count(batches):
        for batch in steps(batches, "t", 2 << 20):
            langs = batch.column("g").dictionary_encode()
            codes, bounds = code_points(batch.column("t"), order - 1, lower)
            owner, cols, n = _grams(codes, bounds, order, langs.indices.to_numpy(zero_copy_only=False).astype(np.int64))
            hi, lo = packed(cols)
            for at in range(0, len(n), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(owner[part])).cast(pa.string()), pa.array(hi[part]), pa.array(lo[part]), pa.array(n[part].astype(np.int64))], ["lang", "hi", "lo", "n"])

    rows = docs.select(F.col(text).alias("t"), F.col(lang).alias("g")).where("t IS NOT NULL AND g IS NOT NULL")
    return rows.mapInArrow(count, "lang string, hi long, lo long, n long").groupBy("lang", "hi", "lo").agg(F.sum("n").alias("n"))


def _suffix(n: int) -> list[Column]:
    """The gram without its oldest character."""
    if n > 3:
        return [F.col("hi").bitwiseAND((1 << (21 * (n - 4))) - 1), F.col("lo")]
    return [F.lit(0).cast("long"), F.col("lo").bitwiseAND((1 << (21 * (n - 1))) - 1)]


def _context() -> list[Column]:
    """The gram without its newest character."""
    return [F.shiftrightunsigned("hi", 21), F.shiftrightunsigned("lo", 21).bitwiseOR(F.shiftleft(F.col("hi").bitwiseAND(MASK), 42))]


def _discounts(grams: DataFrame, modified: bool) -> DataFrame:
    """Absolute discounts of each language from its counts of counts: one value, or three for counts of 1, 2 and more."""
    n = [F.sum((F.col("n") == k).cast("double")) for k in (1, 2, 3, 4)]
    c = grams.groupBy("lang").agg(*[x.alias(f"n{k}") for k, x in enumerate(n, 1)])
    y = F.when(F.col("n1") + F.col("n2") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(F.lit(0.5))

    def step(k: int) -> Column:
        up, down = F.col(f"n{k + 1}"), F.col(f"n{k}")
        d = F.when(down > 0, k - (k + 1) * y * up / down).otherwise(F.lit(0.5 * k))
        return F.least(F.greatest(d, F.lit(0.05 * k)), F.lit(0.95 * k))

    if not modified:
        d = F.least(F.greatest(y, F.lit(0.05)), F.lit(0.95))
        return c.select(F.col("lang").alias("dl"), d.alias("d1"), d.alias("d2"), d.alias("d3"))
    return c.select(F.col("lang").alias("dl"), *[step(k).alias(f"d{k}") for k in (1, 2, 3)])


def smooth(counts: DataFrame, order: int, modified: bool) -> DataFrame:
    """(lang, size, kind, hi, lo, value) of an interpolated Kneser-Ney model.

    kind 0: log probability of the last character of a gram of ``size``; kind 1: log back-off weight
    of the context of such a gram; size 0: log probability of a character never seen. Lower orders
    use continuation counts. ``modified`` takes three discounts instead of one.
    """
    levels = {order: kept(counts, "grams")}
    for n in range(order, 1, -1):
        hi, lo = _suffix(n)
        levels[n - 1] = kept(levels[n].groupBy("lang", hi.alias("hi"), lo.alias("lo")).agg(F.count("*").alias("n")), "grams")
    below, out = None, []
    for n in range(1, order + 1):
        grams = levels[n].join(F.broadcast(_discounts(levels[n], modified)), F.col("lang") == F.col("dl")).withColumn(
            "d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))).select("lang", "hi", "lo", "n", "d")
        hi, lo = _context()
        grams = grams.withColumns({"ch": hi, "cl": lo})
        contexts = kept(grams.groupBy("lang", "ch", "cl").agg(F.sum("n").alias("total"), F.sum("d").alias("cut"), F.count("*").alias("kinds")), "contexts")
        weight = F.col("cut") / F.col("total")
        joined = grams.join(contexts, ["lang", "ch", "cl"])
        if n == 1:
            lower = 1.0 / (F.col("kinds") + 1)
            out.append(contexts.select("lang", F.lit(0).alias("size"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("hi"), F.lit(0).cast("long").alias("lo"), F.log(weight * lower).alias("value")))
        else:
            hi, lo = _suffix(n)
            joined = joined.withColumns({"sh": hi, "sl": lo}).join(below.select(F.col("lang"), F.col("hi").alias("sh"), F.col("lo").alias("sl"), "p"), ["lang", "sh", "sl"])
            lower = F.col("p")
            out.append(contexts.select("lang", F.lit(n).alias("size"), F.lit(1).alias("kind"), F.col("ch").alias("hi"), F.col("cl").alias("lo"), F.log(weight).alias("value")))
        below = kept(joined.select("lang", "hi", "lo", ((F.col("n") - F.col("d")) / F.col("total") + weight * lower).alias("p")), "probabilities")
        out.append(below.select("lang", F.lit(n).alias("size"), F.lit(0).alias("kind"), "hi", "lo", F.log("p").alias("value")))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows


def _seed(lang: int, size: int, kind: int, salt: int = 0) -> int:
    return int(scramble(np.array([(lang * 16 + size) * 2 + kind + 1 + (salt << 48)], np.uint64))[0])


_STEP = [int(x) | 1 for x in scramble(np.arange(11, 19, dtype=np.uint64))]  # unrelated odd factors, one for each place in a gram


class Model:
    """Sorted hashes with a log value each, for the named languages. Every task opens it once."""

    def __init__(self, langs: list[str], order: int, bits: int, keys: np.ndarray, values: np.ndarray, salt: int = 0, width: int = 64):
        self.langs, self.order, self.bits, self.keys, self.values, self.salt, self.width = langs, order, bits, keys, values, salt, width
        self._first = None

    def share(self, spark):
        """A broadcast of the plain arrays with room for the opened model."""
        return spark.sparkContext.broadcast((self.langs, self.order, self.bits, self.keys, self.values, self.salt, self.width, {}))

    def _find(self, asked: np.ndarray) -> np.ndarray:
        """The values of hashes; NaN for one that the model doesn't hold."""
        shift, rest = _U(64 - self.bits), _U(64 - self.width)
        asked = asked >> rest << rest
        if self._first is None:  # where the hashes of each run of leading bits begin
            sizes = np.bincount((self.keys >> shift).astype(np.int64), minlength=1 << self.bits)
            self._first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        run = (asked >> shift).astype(np.int64)
        at, end = self._first[run], self._first[run + 1]
        out = np.full(len(asked), np.nan, np.float32)
        todo = np.flatnonzero(at < end)
        while len(todo):
            place = at[todo]
            hit = self.keys[place] == asked[todo]
            out[todo[hit]] = self.values[place[hit]]
            todo = todo[~hit]
            at[todo] += 1
            todo = todo[at[todo] < end[todo]]
        return out

    def log_probs(self, codes: np.ndarray, places: np.ndarray, lang: np.ndarray | int) -> np.ndarray:
        """Natural log probability of the character at each place, given the ones before it; ``codes`` must be padded."""
        out = np.empty(len(places), np.float32)
        for at in range(0, len(places), 1 << 17):
            part = slice(at, at + (1 << 17))
            out[part] = self._some(codes, places[part], lang if np.isscalar(lang) else lang[part])
        return out

    def _some(self, codes, places, lang):
        one = np.isscalar(lang)
        seeds = np.array([[[_seed(k, size, kind, self.salt) for kind in (0, 1)] for size in range(self.order + 1)] for k in range(len(self.langs))], np.uint64) if not one else None
        chars = [codes[places - j].astype(np.uint64) for j in range(self.order)]
        sums = [np.zeros(len(places), np.uint64)]
        ctx = [sums[0], sums[0]]
        for j in range(self.order):
            sums.append(sums[-1] + chars[j] * _U(_STEP[j]))
        for j in range(1, self.order):
            ctx.append(ctx[-1] + chars[j] * _U(_STEP[j - 1]))
        out = np.zeros(len(places), np.float32)
        todo = np.arange(len(places))
        for size in range(self.order, -1, -1):
            if not len(todo):
                break
            seed = (lambda kind: _U(_seed(lang, size, kind, self.salt))) if one else (lambda kind, size=size: seeds[lang[todo], size, kind])
            value = self._find(scramble(sums[size][todo] + seed(0)))
            miss = np.isnan(value)
            if size == 0:
                value[miss] = -30.0
                out[todo] += value
                break
            out[todo] += np.where(miss, np.float32(0), value)
            todo = todo[miss]
            if size > 1 and len(todo):
                back = self._find(scramble(ctx[size][todo] + seed(1)))
                out[todo] += np.where(np.isnan(back), np.float32(0), back)
        return out


def opened(shared) -> Model:
    """The model of a broadcast; a worker process opens it once."""
    *parts, room = shared.value
    if "model" not in room:
        room["model"] = Model(*parts)
    return room["model"]


def languages(rows: DataFrame) -> list[str]:
    """The languages of a model by name, as many rows as there are languages."""
    return sorted(r["lang"] for r in rows.where("size = 0").select("lang").distinct().collect())


def collect(rows: DataFrame, order: int, bits: int = BITS, most: int | None = None) -> Model:
    """The model as arrays of all its entries; languages are numbered by name.

    With more than ``most`` entries only the first ``WIDTH`` bits of a hash are held and compared, so at most 2**WIDTH entries reach the driver; two that share them share the larger value.
    """
    langs = languages(rows)
    number = {name: k for k, name in enumerate(langs)}
    if most is not None:
        rows = kept(rows, "model")
        if rows.count() > most:
            return Model(langs, order, bits, *_hashed(rows, order, number, 0, WIDTH), 0, WIDTH)
    salt = 0
    while True:
        keys, values = _hashed(rows, order, number, salt)
        if not (keys[1:] == keys[:-1]).any():
            return Model(langs, order, bits, keys, values, salt)
        salt += 1  # two entries share a hash: all are hashed anew


def _hashed(rows: DataFrame, order: int, number: dict[str, int], salt: int, width: int = 64) -> tuple[np.ndarray, np.ndarray]:
    rest = _U(64 - width)

    def hashed(batches):
        for batch in batches:
            t = batch.to_pandas()
            hi, lo = t["hi"].to_numpy(np.int64), t["lo"].to_numpy(np.int64)
            total = np.zeros(len(t), np.uint64)
            for j in range(order):
                c = (lo >> (21 * j)) & MASK if j < 3 else (hi >> (21 * (j - 3))) & MASK
                total += c.astype(np.uint64) * _U(_STEP[j])
            key = scramble(total + _seeds(t, number, salt)) >> rest << rest
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(t["value"].to_numpy(np.float32))], ["key", "value"])

    table = rows.mapInArrow(hashed, "key long, value float")
    table = (table if width == 64 else table.groupBy("key").agg(F.max("value").alias("value"))).toArrow()
    keys, values = table.column("key").to_numpy().view(np.uint64), table.column("value").to_numpy()
    by = np.argsort(keys)
    return keys[by], values[by]


def gram_scores(grams: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """(lang, hi, lo, value): log probability of the last character of each of the distinct ``grams`` (lang, hi, lo) of ``size`` characters, by joins with the model ``rows``.

    What the model doesn't hold is backed off to its suffix: the suffixes of those are looked up in turn.
    """
    part = lambda n, kind: rows.where((F.col("size") == n) & (F.col("kind") == kind)).select("lang", "hi", "lo", "value")
    grams = grams.select("lang", "hi", "lo")
    if size == 0:
        return grams.join(part(0, 0).select("lang", "value"), "lang", "left").withColumn("value", F.coalesce("value", F.lit(-30.0)))
    met = kept(grams.join(part(size, 0), ["lang", "hi", "lo"], "left"), "looked-up")
    (sh, sl), (ch, cl) = (_suffix(size) if size > 1 else [F.lit(0).cast("long")] * 2), _context()
    missed = met.where("value IS NULL").select("lang", "hi", "lo", sh.alias("sh"), sl.alias("sl"), ch.alias("ch"), cl.alias("cl"))
    below = gram_scores(missed.select("lang", F.col("sh").alias("hi"), F.col("sl").alias("lo")).distinct(), rows, size - 1)
    out = missed.join(below.select("lang", F.col("hi").alias("sh"), F.col("lo").alias("sl"), F.col("value").alias("lower")), ["lang", "sh", "sl"])
    if size > 1:
        back = part(size, 1).select("lang", F.col("hi").alias("ch"), F.col("lo").alias("cl"), F.col("value").alias("back"))
        out = out.join(back, ["lang", "ch", "cl"], "left")
    else:
        out = out.withColumn("back", F.lit(0.0))
    scored = out.select("lang", "hi", "lo", (F.col("lower") + F.coalesce("back", F.lit(0.0))).alias("value"))
    return met.where("value IS NOT NULL").unionByName(scored)


def _seeds(t: pd.DataFrame, number: dict[str, int], salt: int) -> np.ndarray:
    out = np.zeros(len(t), np.uint64)
    for (lang, size, kind), at in t.groupby(["lang", "size", "kind"]).indices.items():
        out[at] = _seed(number[lang], size, kind, salt)
    return out


def means(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Mean of each text's values; 0 for a text without any."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    size = np.diff(bounds)
    return (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(size, 1)
