"""Packing of token ids into windows: a seed document's window is filled with its lexical neighbours, found by BM25."""

from __future__ import annotations

import math
import os
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from skillgrid.llm.common import bytes_of, kept, range_hashes, scramble, small, steps

WINDOW = 4096
#: Tokens of one shard of the index, in one task's memory; tokens that a task reads shard by shard.
SHARD_TOKENS, TASK_TOKENS = 1 << 19, 1 << 23
#: Usual constants of BM25: saturation of a term's count, and share of the length in its weight.
K1, B = 1.2, 0.75
#: Bytes of text encoded at once; different words that a task process keeps (bounds its memory, not its results); longest word kept.
TEXT_BYTES, KEPT_WORDS, LONGEST = 1 << 21, 1_500_000, 64
#: A control sign between words that are encoded together, and how many of them are.
MARK, LINE = "\x01", 64
_U = np.uint64


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer on the machine that runs the task."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of whole texts by the tokenizers library, each different word encoded once.

    The vocabulary's pattern drops white space and ends a run of letters before ASCII punctuation, and neither its normaliser nor its merges reach over
    these places. So a text is cut at ASCII white space and between an ASCII letter and ASCII punctuation, and the ids of a cut don't depend on what
    stands around it. ASCII words are kept in lower case, which the normaliser makes of them. Texts with the string of an added token go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()
        self.mark = self._library([MARK])[0]
        codes = np.arange(256, dtype=np.uint8)
        self.fold = np.where((codes >= 65) & (codes <= 90), codes + 32, codes).astype(np.uint8)
        self.letter = np.array([chr(c).isalpha() and c < 128 for c in range(256)])
        self.sign = np.array([33 <= c < 127 and not chr(c).isalnum() for c in range(256)])

    def _clear(self) -> None:
        self.words, self.at, self.n, self.ids, self.filled = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 16, self.kind), 0

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in a row, and the number of ids of each. Words go to the library together, parted by a sign that none of them has."""
        if len(self.mark) == 1 and not any(MARK in w for w in words):
            lines = [f" {MARK} ".join([*words[i:i + LINE], ""]) for i in range(0, len(words), LINE)]
            ids = np.concatenate([np.array(x, self.kind) for x in self._library(lines)] or [np.zeros(0, self.kind)])
            marks = np.flatnonzero(ids == self.mark[0])
            return ids[ids != self.mark[0]], np.diff(marks, prepend=-1) - 1
        got = self._library(words)
        n = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((x for ids in got for x in ids), self.kind, int(n.sum())), n

    def _store(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Encodes words behind the ids kept so far; where each begins, and its number of ids."""
        flat, n = self._each(words)
        if self.filled + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(flat)), self.kind)])
        at = self.filled + np.cumsum(n) - n
        self.ids[self.filled:self.filled + len(flat)] = flat
        self.filled += len(flat)
        return at, n

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and the place where each text's ids begin (one more at the end). A null text has no ids."""
        if len(self.words) > KEPT_WORDS:
            self._clear()
        text = text.fill_null("")
        data, bound = bytes_of(text)
        solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
        first = solid.copy()
        cut = np.zeros(len(data) + 1, bool)
        cut[bound] = True
        first[1:] &= ~solid[:-1] | cut[1:-1] | (self.letter[data[:-1]] & self.sign[data[1:]])
        last = solid.copy()
        last[:-1] &= ~solid[1:] | first[1:] | cut[1:-1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        high = np.concatenate([[0], np.cumsum(data >= 128)])
        raw = high[end] > high[start]
        folded = self.fold[data]
        if raw.any():
            mark = np.zeros(len(data) + 1, np.int8)
            np.add.at(mark, start[raw], 1)
            np.add.at(mark, end[raw], -1)
            inside = np.cumsum(mark, dtype=np.int8)[:-1].astype(bool)
            folded[inside] = data[inside]
        hashes = range_hashes(folded, start, end)

        def written(places):
            return [folded[start[i]:end[i]].tobytes().decode() for i in places]

        short = np.flatnonzero(end - start <= LONGEST)
        at, n = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        distinct, example, which = np.unique(hashes[short], return_index=True, return_inverse=True)
        place = np.searchsorted(self.words, distinct)
        known = np.zeros(len(distinct), bool)
        inner = place < len(self.words)
        known[inner] = self.words[place[inner]] == distinct[inner]
        if not known.all():
            new_at, new_n = self._store(written(short[example[~known]]))
            where = place[~known]
            self.words, self.at, self.n = np.insert(self.words, where, distinct[~known]), np.insert(self.at, where, new_at), np.insert(self.n, where, new_n)
            place = np.searchsorted(self.words, distinct)
        at[short], n[short] = self.at[place][which], self.n[place][which]
        long = np.flatnonzero(end - start > LONGEST)
        filled = self.filled
        if len(long):
            at[long], n[long] = self._store(written(long))
        before = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.repeat(at - before[:-1], n) + np.arange(before[-1])]
        self.filled = filled  # ids of long words are not kept
        begin = before[np.searchsorted(start, bound)]
        odd = [i for s in self.added for i in pc.indices_nonzero(pc.match_substring(text, s)).to_pylist()]
        if odd:
            whole = dict(zip(sorted(set(odd)), self._library([text[i].as_py() for i in sorted(set(odd))])))
            parts = [np.array(whole[i], self.kind) if i in whole else ids[begin[i]:begin[i + 1]] for i in range(len(text))]
            ids, begin = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, begin


def _distinct(ids: np.ndarray, begin: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, id, count) of the different ids of each document, by owner and id."""
    owner = np.repeat(np.arange(len(begin) - 1, dtype=np.int64), np.diff(begin))
    keys, count = np.unique(owner * size + ids, return_counts=True)
    return keys // size, keys % size, count


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


#: A row is a document with its ids (kind 0), a piece of a sequence (kind 1), or a count of documents that hold an id (kind 2).
_FIELDS = [("kind", "int"), ("row", "long"), ("ids", "binary"), ("near", "long"), ("start", "long"), ("length", "long"), ("doc_tokens", "long"), ("ids_crc32", "long"),
           ("task", "long"), ("local", "long"), ("offset", "long")]
_NAMES = [n for n, _ in _FIELDS]
_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _batch(rows: list[tuple], doc: list, doc_type: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([*[pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(columns, _FIELDS)], pa.array(doc, doc_type)], [*_NAMES, "doc"])


def _schema(doc_type: T.DataType) -> T.StructType:
    kinds = {"int": T.IntegerType(), "long": T.LongType(), "binary": T.BinaryType()}
    return T.StructType([*[T.StructField(n, kinds[k]) for n, k in _FIELDS], T.StructField("doc", doc_type)])


def _tokenise(docs: DataFrame, id: str, text: str, path: str | None, end: int, window: int) -> DataFrame:
    """One pass over the texts: their ids, the pieces that fill a window alone, and in how many documents each id is found.

    ``near`` is the smallest of the document's ids under a fixed shuffle of the vocabulary, and the second such: documents with many common words often agree in it.
    """
    shared = docs.sparkSession.sparkContext.broadcast({})  # room for a task process's encoder

    def run(batches):
        room = shared.value
        if "encoder" not in room:
            room["encoder"] = WordEncoder(path or vocabulary_path())
        encoder = room["encoder"]
        order = np.argsort(scramble(np.arange(encoder.size, dtype=np.uint64) + _U(1)), kind="stable")
        rank = np.empty(encoder.size, np.int64)
        rank[order] = np.arange(encoder.size)
        seen, task, row, doc_type = np.zeros(encoder.size, np.int64), TaskContext.get().partitionId(), 0, None
        local = 0
        for batch in steps(batches, "t", TEXT_BYTES):
            doc_type = batch.column("doc").type
            ids, begin = encoder.encode(batch.column("t"))
            ids = np.insert(ids, begin[1:], end)
            begin = begin + np.arange(len(begin))
            owner, token, _ = _distinct(ids, begin, encoder.size)
            seen += np.bincount(token, minlength=encoder.size)
            by_rank = np.sort(owner * encoder.size + rank[token])
            lowest = np.searchsorted(by_rank, np.arange(len(batch)) * encoder.size)
            owned = np.bincount(owner, minlength=len(batch))
            near = by_rank[lowest] % encoder.size * (1 << 24) + np.where(owned > 1, by_rank[np.minimum(lowest + 1, len(by_rank) - 1)] % encoder.size, 0)
            rows, docs_of, names = [], [], batch.column("doc").to_pylist()
            for i, name in enumerate(names):
                own, key = ids[begin[i]:begin[i + 1]], (task << 36) + row
                row += 1
                full = len(own) // window * window
                rows.append((0, key, own.tobytes(), int(near[i]), full, len(own) - full, len(own), None, None, None, None))
                docs_of.append(name)
                for at in range(0, full, window):
                    rows.append((1, key, None, None, at, window, len(own), _crc(own[at:at + window]), task, local, 0))
                    docs_of.append(name)
                    local += 1
            yield _batch(rows, docs_of, doc_type)
        found = np.flatnonzero(seen)
        if len(found):
            yield _batch([(2, int(t), None, None, None, int(n), None, None, None, None, None) for t, n in zip(found, seen[found])], [None] * len(found), doc_type)

    rows = docs.select(F.col(id).alias("doc"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, _schema(rows.schema["doc"].dataType))


class Shard:
    """A BM25 inverted index over some documents (arrays of ids), with the counts of the whole corpus."""

    def __init__(self, ids: list[np.ndarray], weight: np.ndarray, mean: float):
        """weight: inverse document frequency of every id of the vocabulary. mean: ids of a document on average."""
        length = np.array([len(x) for x in ids], np.int64)
        begin = np.concatenate([[0], np.cumsum(length)])
        owner, token, count = _distinct(np.concatenate(ids), begin, len(weight))
        self.token, self.begin = token, np.searchsorted(owner, np.arange(len(ids) + 1))
        score = weight[token] * count * (K1 + 1) / (count + K1 * (1 - B + B * length[owner] / mean))
        order = np.argsort(token, kind="stable")
        self.documents, self.score = owner[order], score[order]
        self.first = np.searchsorted(token[order], np.arange(len(weight) + 1))

    def scores(self, i: int) -> np.ndarray:
        """BM25 of every document of the shard for the different ids of document i."""
        terms = self.token[self.begin[i]:self.begin[i + 1]]
        at, n = self.first[terms], self.first[terms + 1] - self.first[terms]
        before = np.cumsum(n) - n
        postings = np.repeat(at - before, n) + np.arange(n.sum())
        return np.bincount(self.documents[postings], self.score[postings], len(self.begin) - 1)


def _fill(items: list[tuple], weight: np.ndarray, mean: float, window: int, local: int) -> tuple[list[tuple], list[tuple], int]:
    """Pieces of full windows made of the items, the items left (less than a window), and the next sequence.

    The first unused item is the seed; its neighbours follow by falling score, ties in order, until the window is full. The last one is cut, and its
    rest stays unused. An item: (row, doc, start, doc_tokens, ids).
    """
    pieces: list[tuple] = []
    if sum(len(x[4]) for x in items) < window:
        return pieces, items, local
    index = Shard([x[4] for x in items], weight, mean)
    taken = np.zeros(len(items), np.int64)
    size = np.array([len(x[4]) for x in items], np.int64)
    total = int(size.sum())
    seed = 0
    while total >= window:
        while taken[seed] == size[seed]:
            seed += 1
        score = index.scores(seed)
        score[seed] = np.inf
        score[taken == size] = -1.0
        filled = 0
        for i in np.argsort(-score, kind="stable"):
            use = min(window - filled, int(size[i] - taken[i]))
            if not use:
                break
            row, doc, start, n, ids = items[i]
            part = ids[taken[i]:taken[i] + use]
            pieces.append((row, doc, start + int(taken[i]), use, n, _crc(part), local, filled))
            taken[i] += use
            filled += use
            if filled == window:
                break
        total -= window
        local += 1
    left = [(row, doc, start + int(t), n, ids[t:]) for (row, doc, start, n, ids), t in zip(items, taken) if t < len(ids)]
    return pieces, left, local


def _halved(items: list[tuple], local: int) -> list[tuple]:
    """Pieces of the last items, in sequences of falling powers of two: none of them needs padding."""
    total = sum(len(x[4]) for x in items)
    pieces, room, filled = [], 0, 0
    for row, doc, start, n, ids in items:
        at = 0
        while at < len(ids):
            if not room:
                room, filled = 1 << (total.bit_length() - 1), 0
                total -= room
            use = min(room, len(ids) - at)
            pieces.append((row, doc, start + at, use, n, _crc(ids[at:at + use]), local, filled))
            at, room, filled = at + use, room - use, filled + use
            local += not room
    return pieces


def _pack(items: DataFrame, weight: np.ndarray, mean: float, window: int, shard_tokens: int, group: int, kind: np.dtype, last: bool) -> DataFrame:
    """Packs each partition shard by shard, in its order; what is left of a shard goes to the next one, what is left of the partition comes back as items.

    ``last``: nothing comes back, the rest becomes sequences of powers of two. ``group`` tells the sequences of this call from those of others.
    """
    shared = items.sparkSession.sparkContext.broadcast(weight)

    def run(batches):
        weight, task = shared.value, (group << 32) + TaskContext.get().partitionId()
        waiting, tokens, local, doc_type = [], 0, 0, None

        def batch_of(pieces):
            return _batch([(1, row, None, None, start, use, n, crc, task, at, offset) for row, _, start, use, n, crc, at, offset in pieces], [p[1] for p in pieces], doc_type)

        for batch in batches:
            doc_type = batch.column("doc").type
            columns = [batch.column(c).to_pylist() for c in ("row", "doc", "start", "doc_tokens")]
            for row, doc, start, n, ids in zip(*columns, batch.column("ids")):
                ids = np.frombuffer(ids.as_buffer(), kind)
                waiting.append((row, doc, start, n, ids))
                tokens += len(ids)
                if tokens >= shard_tokens:
                    pieces, waiting, local = _fill(waiting, weight, mean, window, local)
                    waiting = [(*x[:4], x[4].copy()) for x in waiting]
                    tokens = sum(len(x[4]) for x in waiting)
                    yield batch_of(pieces)
        if waiting:
            pieces, waiting, local = _fill(waiting, weight, mean, window, local)
            if last:
                pieces, waiting = pieces + _halved(waiting, local), []
            if pieces:
                yield batch_of(pieces)
            if waiting:
                yield _batch([(0, row, ids.tobytes(), 0, start, len(ids), n, None, None, None, None) for row, _, start, n, ids in waiting], [x[1] for x in waiting], doc_type)

    columns = ["row", "doc", "start", "doc_tokens", "ids"]
    ordered = items.sortWithinPartitions("near", "row", "start").select(*columns)
    return ordered.mapInArrow(run, _schema(items.schema["doc"].dataType))


@dataclass
class Packed:
    """``pieces``: where each piece of a document lies. ``documents``: row, ids (little-endian, ``width`` bytes each). ``window``: the length of a sequence."""

    pieces: DataFrame
    documents: DataFrame
    window: int
    width: int

    def sequences(self) -> DataFrame:
        """(sequence_id, pieces, ids): the ids of every sequence in order, without padding. A sequence has a bounded length, so a group is small."""
        w = F.lit(self.width)
        cut = F.substring("ids", (F.col("start") * w + 1).cast("int"), (F.col("length") * w).cast("int"))
        each = self.pieces.join(self.documents.select("row", "ids"), "row").select("sequence_id", F.struct("offset", cut.alias("ids")).alias("p"))
        inside = F.array_sort(F.collect_list("p"))
        return each.groupBy("sequence_id").agg(F.count("*").alias("pieces"), inside.alias("p")).select(
            "sequence_id", "pieces", F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))


def pack(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None, end: int = 2, window: int = WINDOW,
         shard_tokens: int = SHARD_TOKENS, task_tokens: int = TASK_TOKENS) -> Packed:
    """Every token of every document in exactly one piece of a sequence of ``window`` tokens.

    Documents fill as many windows as they can alone; their rests are items that are packed with their lexical neighbours: items are ordered by their smallest hashed
    ids and cut into shards of about ``shard_tokens``; each shard is a BM25 inverted index with the document counts of the whole corpus, in which the first unused item asks for
    its unused neighbours. They fill its window in the order of their scores; the last is cut and its rest stays unused. What a task has left, less than a window, meets in a
    further round, and the very last rest (less than a window in the whole table) becomes sequences of powers of two. So nothing is padded.

    Pieces: the id column, ``start`` and ``length`` (tokens of the document), ``ids_crc32``, ``doc_tokens``, ``sequence_id`` (from 0, without gaps), ``offset`` (in the sequence)
    and ``row`` (a key of the document's row, as ids may repeat).

    A null or empty text has the end id only. Null and repeated ids are kept, each row is a document. Ties of scores follow the order of the shard, which is fixed by the ids of
    the tokens and the row. An empty table has no pieces. Very long texts are encoded in a step of their own. Other columns are left out, so their names don't matter.
    """
    task_tokens = max(task_tokens, 8 * window)  # a task leaves less than a window, so each round leaves an eighth at most
    table = kept(_tokenise(docs, id, text, path, end, window), "tokens")
    counts = {r["row"]: r["n"] for r in table.where("kind = 2").groupBy("row").agg(F.sum("length").alias("n")).collect()}  # as many as the vocabulary at most
    encoder = WordEncoder(path or vocabulary_path())
    n, tokens, rest = table.where("kind = 0").agg(F.count("*"), F.sum("doc_tokens"), F.sum("length")).first()
    found = np.zeros(encoder.size)
    found[list(counts)] = list(counts.values())
    weight = np.log(1 + (n - found + 0.5) / (found + 0.5))
    mean = max(1.0, (rest or 0) / max(1, n))
    width = encoder.kind.itemsize
    # an item takes along the ids behind its document's last full window, and nothing else of it
    tail = F.substring("ids", (F.col("start") * width + 1).cast("int"), (F.col("length") * width).cast("int"))
    items = table.where("kind = 0 AND length > 0").select("row", "doc", "near", "start", "doc_tokens", tail.alias("ids"))
    made = [table.where("kind = 1")]
    group, rest = 1, rest or 0
    while rest:
        last = rest <= task_tokens
        dealt = items.coalesce(1) if last else items.repartitionByRange(math.ceil(rest / task_tokens), "near", "row", "start")
        done = kept(_pack(dealt, weight, mean, window, shard_tokens, group, encoder.kind, last), "packed")
        made.append(done.where("kind = 1"))
        items = done.where("kind = 0")
        group, rest = group + 1, 0 if last else items.agg(F.sum("length")).first()[0] or 0
    pieces = made[0]
    for more in made[1:]:
        pieces = pieces.unionByName(more)
    pieces = pieces.select("row", "doc", "start", "length", "ids_crc32", "doc_tokens", "task", "local", "offset")
    # a row for each task, so the running sum over all of them is small
    per_task = pieces.groupBy("task").agg((F.max("local") + 1).alias("n"))
    base = per_task.select(F.col("task").alias("t"), (F.sum("n").over(W.orderBy("task")) - F.col("n")).alias("base"))
    numbered = pieces.join(small(base), F.col("task") == F.col("t")).select(
        F.col("doc").alias(id), "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("local")).alias("sequence_id"), "offset", "row")
    return Packed(numbered, table.where("kind = 0").select("row", F.col("doc").alias(id), "doc_tokens", "ids"), window, width)
