"""Helpers shared by the corpus operators: tables in the shared folder and whole-batch text arithmetic."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skillgrid.session import freed_shuffles, work_dir

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one step of a task works on; a longer text makes a step of its own.
STEP_BYTES = 1 << 20
_U = np.uint64


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: short lineage, nothing lost with an executor, no shuffle files left."""
    spark = df.sparkSession
    path = work_dir(spark, label)
    with freed_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def steps(batches, column: str, max_bytes: int = STEP_BYTES):
    """Cuts Arrow batches into slices whose texts hold about ``max_bytes``; rows are never cut."""
    for batch in batches:
        text = batch.column(column)
        if not len(text):
            continue
        sizes = np.cumsum(np.diff(offsets_of(text)) + 16)
        at = 0
        while at < len(text):
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + max_bytes, "right")))
            yield batch.slice(at, end - at)
            at = end


def offsets_of(text: pa.Array) -> np.ndarray:
    """Byte offsets of the texts of an Arrow string array, from its first text on."""
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    raw = text.buffers()[1]
    if raw is None:
        return np.zeros(len(text) + 1, np.int64)
    return np.frombuffer(raw, kind)[text.offset:text.offset + len(text) + 1].astype(np.int64)


def bytes_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and the offset of each text in them. A null text has no bytes."""
    if text.null_count:
        text = text.fill_null("")
    at = offsets_of(text)
    raw = text.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[at[0]:at[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BASE, _powers = 0x9E3779B97F4A7C15 | 1, {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64, up to n."""
    have = _powers.get("t")
    if have is None or len(have[0]) <= n:
        size = max(n + 1, STEP_BYTES)
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        have = tuple(made)
        if size <= 3 * STEP_BYTES:
            _powers["t"] = have
    return have


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges: a polynomial of the bytes, whatever their place, and their number."""
    up, down = _power_tables(len(data))
    run = np.empty(len(data) + 1, np.uint64)
    run[0] = 0
    np.cumsum((data + _U(1)) * up[:len(data)], out=run[1:])
    return scramble((run[end] - run[start]) * down[start] ^ (end - start).astype(np.uint64))


class Words:
    """The words of a slice of texts: byte range, text number and 64-bit hash of each, in order."""

    def __init__(self, text: pa.Array, lower: bool = False, letters: bool = False):
        """lower: A-Z as a-z. letters: ASCII characters other than letters and digits part words, too."""
        data, at = bytes_of(text)
        fold = np.arange(256, dtype=np.uint8)
        if lower:
            fold[65:91] += 32
        if letters:
            fold[[c for c in range(128) if not chr(c).isalnum()]] = 32
        if lower or letters:
            data = fold[data]
        self.data, self.at, self.n_texts = data, at, len(at) - 1
        gap = (data == 32) | ((data >= 9) & (data <= 13))
        cut = np.zeros(len(data) + 1, bool)
        cut[at] = True
        solid = ~gap
        first = solid.copy()
        first[1:] &= gap[:-1] | cut[1:-1]
        last = solid
        last[:-1] &= gap[1:] | cut[1:-1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.text = np.searchsorted(at, self.start, "right") - 1 if len(self.start) else np.zeros(0, np.int64)
        #: Where the words of each text begin.
        self.first = np.searchsorted(self.start, at)
        self._gap = gap

    def hashes(self) -> np.ndarray:
        return range_hashes(self.data, self.start, self.end)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def shingles(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside a text, and the text of each.

    A text with fewer words has one run of all its words; a text without words has none.
    """
    n = np.diff(first)
    mixed = [words * _U((0xD6E8FEB86659FD93 * (2 * j + 1)) & (2**64 - 1)) ^ _U(j + 1) for j in range(size)]
    out = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for j in range(size):
        part = mixed[j][j:j + len(out)]
        out += scramble(part)
    text = np.repeat(np.arange(len(n)), n)
    ok = text[:len(out)] == text[size - 1:size - 1 + len(out)] if len(out) else np.zeros(0, bool)
    h, owner = scramble(out[ok]), text[:len(out)][ok]
    small = np.flatnonzero((n > 0) & (n < size))
    if len(small):
        extra = []
        for t in small:
            w = words[first[t]:first[t + 1]]
            total = np.add.reduce(np.array([scramble(w[j:j + 1] * _U((0xD6E8FEB86659FD93 * (2 * j + 1)) & (2**64 - 1)) ^ _U(j + 1))[0] for j in range(len(w))], np.uint64))
            extra.append(total)
        h2 = scramble(np.array(extra, np.uint64) + _U(0x51ED270B35A3C1F7) * (n[small]).astype(np.uint64))
        h, owner = np.concatenate([h, h2]), np.concatenate([owner, small])
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
    return h, owner


#: A join side is broadcast only if it has at most this many rows of a few numbers each (some 10 MB); the driver builds it, whatever the input.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is proven small by counting it, else as it is, so that Spark shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
