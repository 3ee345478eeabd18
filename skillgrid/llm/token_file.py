"""Token-id files: ids of whole texts, coded by a static range asymmetric numeral system.

A file is a Parquet table of independent blocks in ascending id order, so that Spark's readers, writers and commit
protocol serve any store. A block holds whole documents. Its ids are dealt to interleaved
coder states (lane = place modulo the number of lanes) that share one frequency table; it keeps the states a decoder
begins with, the same at regular steps inside (checkpoints, from which a part can be decoded
alone), the renormalisation words in reading order and a CRC-32 of the ids.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skillgrid.llm.common import kept, small, steps
from skillgrid.session import freed_shuffles, work_dir

PRECISION = 20
LANES = 1024
BLOCK_IDS = 1 << 17
CHECKPOINT_STEPS = 64
#: Different pre-tokens whose ids a task process keeps; bounds its memory, not its results.
KEPT_TOKENS = 1_500_000
_U = np.uint64
_LOW = _U(1 << 31)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer on the machine that runs the task."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Overlay(dict):
    """Entries of one call on top of a full cache."""

    def __init__(self, below: dict):
        self.below = below

    def __missing__(self, key):
        return self.below[key]

    def keys(self):
        return self.below.keys()


class Encoder:
    """Ids of whole texts by the tokenizers library.

    The byte-level pattern always starts a new pre-token at a blank that stands before a character that is
    no white space, so a text is cut there and each different cut is encoded once. Texts with other white space after
    a blank, or with an added token's string, go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.cache: dict[str, bytes | None] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        cache = self.cache if len(self.cache) < KEPT_TOKENS else Overlay(self.cache)
        cuts = [t.split(" ") for t in texts]
        new = {c for cut in cuts for c in cut[1:]} - cache.keys()
        odd = {c for c in new if not c or c[0].isspace()}
        new = list(new - odd)
        cache.update(zip(new, self._whole([" " + c for c in new])))
        cache.update(dict.fromkeys(odd))
        heads = self._whole([cut[0] for cut in cuts])
        out = []
        for text, cut, head in zip(texts, cuts, heads):
            parts = [cache[c] for c in cut[1:]]
            if None in parts or any(s in text for s in self.special):
                out.append(self._whole([text])[0])
            else:
                out.append(head + b"".join(parts))
        return out


def tokenise(docs: DataFrame, id: str, text: str, path: str | None, end: int) -> DataFrame:
    """(i, ids) of every row: its ids and the end id as little-endian bytes; a null text has the end id only."""
    shared = docs.sparkSession.sparkContext.broadcast({})  # room for a task process's encoder

    def run(batches):
        room = shared.value
        if "encoder" not in room:
            room["encoder"] = Encoder(path or vocabulary_path())
        encoder = room["encoder"]
        last = np.array([end], encoder.kind).tobytes()
        for batch in steps(batches, "t"):
            ids = [x + last for x in encoder.encode(batch.column("t").fill_null("").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(ids, pa.binary()), pa.array([encoder.kind.itemsize] * len(ids), pa.int32())], ["i", "ids", "width"])

    rows = docs.select(F.col(id).cast("long").alias("i"), F.col(text).alias("t"))
    return rows.mapInArrow(run, "i long, ids binary, width int")


def _numbers(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{width}").astype(np.uint32)


def frequencies(tokens: DataFrame) -> np.ndarray:
    """Shared table: frequencies of all ids, scaled to 2**PRECISION, at least 1 for each id that occurs. Its length is the largest id + 1."""

    def count(batches):
        for batch in batches:
            if batch.num_rows:
                width = batch.column("width")[0].as_py()
                n = np.bincount(_numbers(b"".join(batch.column("ids").to_pylist()), width))
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some].astype(np.int64))], ["id", "n"])

    counted = tokens.select("ids", "width").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    table = counted.toArrow()  # as many rows as the vocabulary has ids
    ids, n = table.column("id").to_numpy(), table.column("n").to_numpy().astype(np.float64)
    if not len(ids):
        return np.zeros(0, np.uint32)
    if len(ids) >= 1 << PRECISION:
        raise ValueError(f"more than {1 << PRECISION} different ids")
    by = np.argsort(ids)
    ids, n = ids[by], n[by]
    scaled = np.maximum(1, np.floor(n / n.sum() * ((1 << PRECISION) - len(ids)))).astype(np.int64)
    scaled[int(np.argmax(scaled))] += (1 << PRECISION) - scaled.sum()
    out = np.zeros(int(ids[-1]) + 1, np.uint32)
    out[ids] = scaled
    return out


class Coder:
    """Interleaved rANS with 64-bit states and 32-bit words over one frequency table."""

    def __init__(self, freq: np.ndarray, lanes: int = LANES):
        self.freq, self.lanes = freq.astype(np.uint64), lanes
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64) if len(freq) else self.freq
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(states, words, checkpoint states, checkpoint word places) of a block of ids."""
        n, lanes = len(ids), self.lanes
        steps_ = -(-n // lanes)
        x = np.full(lanes, _LOW)
        words, marks = [], []
        for t in range(steps_ - 1, -1, -1):
            s = ids[t * lanes:(t + 1) * lanes]
            m = len(s)
            f, y = self.freq[s], x[:m]
            full = y >= f << _U(63 - PRECISION)
            words.append((y[full] & _U(0xFFFFFFFF)).astype(np.uint32))
            y = np.where(full, y >> _U(32), y)
            q = y // f
            x[:m] = (q << _U(PRECISION)) + (y - q * f) + self.start[s]
            if t and t % CHECKPOINT_STEPS == 0:
                marks.append(x.copy())
        words.reverse()
        places = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        at = places[CHECKPOINT_STEPS:steps_:CHECKPOINT_STEPS]
        return x, np.concatenate(words) if words else np.zeros(0, np.uint32), np.array(marks[::-1], np.uint64).reshape(-1, lanes), at

    def decode(self, n: int, states: np.ndarray, words: np.ndarray, first: int = 0, place: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids from step ``first`` to before step ``stop``, given the states and the word place of that step."""
        lanes, x = self.lanes, states.copy()
        steps_ = -(-n // lanes) if stop is None else min(stop, -(-n // lanes))
        out = np.empty(max(0, min(n, steps_ * lanes) - first * lanes), np.uint32)
        low = _U((1 << PRECISION) - 1)
        for t in range(first, steps_):
            m = min(lanes, n - t * lanes)
            y = x[:m]
            slot = y & low
            s = self.symbol[slot]
            y = self.freq[s] * (y >> _U(PRECISION)) + slot - self.start[s]
            need = np.flatnonzero(y < _LOW)
            y[need] = (y[need] << _U(32)) | words[place:place + len(need)]
            place += len(need)
            x[:m] = y
            out[(t - first) * lanes:(t - first) * lanes + m] = s
        return out


def write(tokens: DataFrame, freq: np.ndarray, path: str) -> None:
    """Writes the blocks to ``path`` in ascending order of i (nulls first, then by the ids), and the frequency table beside them."""
    spark = tokens.sparkSession
    shared = spark.sparkContext.broadcast((freq, {}))  # one number per id of the vocabulary
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        table, room = shared.value
        if "coder" not in room:
            room["coder"] = Coder(table)
        coder, part = room["coder"], TaskContext.get().partitionId()
        held, sizes, total, block = [], [], 0, 0

        def finished():
            ids = np.concatenate(held)
            x, words, marks, at = coder.encode(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([[s[0] for s in sizes]], pa.list_(pa.int64())), pa.array([[s[1] for s in sizes]], pa.list_(pa.int64())),
                 pa.array([x.tobytes()], pa.binary()), pa.array([words.tobytes()], pa.binary()), pa.array([marks.tobytes()], pa.binary()), pa.array([at.tolist()], pa.list_(pa.int64())), pa.array([zlib.crc32(ids.astype("<u4").tobytes())], pa.int64())],
                ["part", "block", "n", "doc", "size", "states", "words", "marks", "places", "crc"])

        for batch in batches:
            width = batch.column("width")
            for r, (i, raw) in enumerate(zip(batch.column("i").to_pylist(), batch.column("ids").to_pylist())):
                ids = _numbers(raw, width[r].as_py())
                held.append(ids)
                sizes.append((i, len(ids)))
                total += len(ids)
                if total >= BLOCK_IDS:
                    yield finished()
                    held, sizes, total, block = [], [], 0, block + 1
        if held:
            yield finished()

    ordered = tokens.repartitionByRange(n_parts, "i").sortWithinPartitions("i", "ids")
    blocks = ordered.mapInArrow(run, "part int, block int, n long, doc array<long>, size array<long>, states binary, words binary, marks binary, places array<long>, crc long")
    with freed_shuffles(tokens.sparkSession):
        blocks.write.option("compression", "none").parquet(f"{path}/blocks")
    rows = [(int(k), int(freq[k])) for k in np.flatnonzero(freq)]
    spark.createDataFrame(rows, "id int, freq int").coalesce(1).write.parquet(f"{path}/frequencies")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(i, start, n_tokens, ids_crc32, ids) of every document of a file, decoded block by block; a broken block raises an error."""
    table = spark.read.parquet(f"{path}/frequencies").toArrow()  # as many rows as the vocabulary has ids
    ids = table.column("id").to_numpy()
    freq = np.zeros(int(ids.max()) + 1 if len(ids) else 0, np.uint32)
    freq[ids] = table.column("freq").to_numpy()
    shared = spark.sparkContext.broadcast((freq, {}))
    blocks = spark.read.parquet(f"{path}/blocks")
    sizes = blocks.select("part", "block", "n")
    parts = sizes.groupBy("part").agg(F.sum("n").alias("total"))
    ahead = parts.select("part", (F.sum("total").over(W.orderBy("part")) - F.col("total")).alias("ahead"))  # one row per write task
    within = sizes.withColumn("inside", F.sum("n").over(W.partitionBy("part").orderBy("block")) - F.col("n"))
    starts = within.join(ahead, "part").select("part", "block", (F.col("ahead") + F.col("inside")).alias("start"))

    def run(batches):
        table, room = shared.value
        if "coder" not in room:
            room["coder"] = Coder(table)
        coder = room["coder"]
        for batch in batches:
            for r in batch.to_pylist():
                found = coder.decode(r["n"], np.frombuffer(r["states"], np.uint64), np.frombuffer(r["words"], np.uint32))
                raw = found.astype("<u4").tobytes()
                if zlib.crc32(raw) != r["crc"]:
                    raise ValueError(f"block {r['block']} of part {r['part']} is damaged")
                bounds = np.concatenate([[0], np.cumsum(r["size"])])
                cuts = [raw[4 * a:4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc"], pa.int64()), pa.array(bounds[:-1] + r["start"]), pa.array(r["size"], pa.int64()), pa.array([zlib.crc32(c) for c in cuts], pa.int64()), pa.array(cuts, pa.binary())],
                    ["i", "start", "n_tokens", "ids_crc32", "ids"])

    return blocks.join(small(starts), ["part", "block"]).select("start", "part", "block", "n", "doc", "size", "states", "words", "crc").mapInArrow(
        run, "i long, start long, n_tokens long, ids_crc32 long, ids binary")


def round_trip(docs: DataFrame, id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end: int = 0, path: str | None = None) -> DataFrame:
    """Encodes and writes ``docs`` to ``path`` (default: the shared folder) and returns, read back from there: id, start, n_tokens, ids_crc32 and ids.

    Documents lie in ascending id order; rows that share an id each keep their own ids, ordered by these; null ids come first. A
    null or empty text is the end id alone. An empty table gives an empty file and an empty result.
    start counts the ids of all documents before. ids are little-endian unsigned 32-bit numbers. A
    task holds one block, or one longer document.
    """
    spark = docs.sparkSession
    path = path or work_dir(spark, "token-file")
    tokens = kept(tokenise(docs, id, text, tokenizer, end), "tokens")
    write(tokens, frequencies(tokens), path)
    return read_documents(spark, path).withColumnRenamed("i", id)
