"""Vector code compression: product codes whose nearest entries are found by Orchard search."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillgrid.llm.common import kept, small
from skillgrid.llm.vectors import matrix, summed, whole_numbers

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors that a task searches for at once.
ROWS = 4096


class Orchard:
    """Exact nearest entry, ties to the lower index, for many queries side by side.

    Each entry has the list of all entries by distance from it. A query stands at its best entry so far and reads that entry's list
    from the front; entries met before are marked and skipped; a better one makes the query jump to the better
    one's list. By the triangle inequality no entry farther from the best than twice the query's distance can be nearer, so there it stops.
    """

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        apart = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(-1)
        self.lists = np.argsort(apart, axis=1, kind="stable")
        # squared distance over 4, rounded up: beyond twice a distance means above its square
        self.reach = -(-np.take_along_axis(apart, self.lists, 1) // 4)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and squared distance of every query."""
        n, k = len(queries), len(self.entries)
        best = np.zeros(n, np.int64)
        far = ((queries - self.entries[0]) ** 2).sum(1)
        seen = np.zeros((n, k), bool)
        seen[:, 0] = True
        place = np.zeros(n, np.int64)
        live = np.arange(n)
        while len(live):
            live = live[place[live] < k]
            at, p = best[live], place[live]
            going = self.reach[at, p] <= far[live]
            live, met = live[going], self.lists[at[going], p[going]]
            place[live] += 1
            fresh = ~seen[live, met]
            rows, met = live[fresh], met[fresh]
            seen[rows, met] = True
            d = ((queries[rows] - self.entries[met]) ** 2).sum(1)
            better = (d < far[rows]) | ((d == far[rows]) & (met < best[rows]))
            rows, met = rows[better], met[better]
            best[rows], far[rows], place[rows] = met, d[better], 0
        return best, far


@dataclass
class Codebooks:
    """``entries``: whole numbers by part, entry and position. ``scale``: what components were multiplied by."""

    entries: np.ndarray
    scale: float

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decode(self, code: str) -> np.ndarray:
        """The vector that a code stands for: middles of the cells that floor() leaves."""
        index = np.frombuffer(bytes.fromhex(code), np.uint8)
        return (np.concatenate([part[i] for part, i in zip(self.entries, index)]) + 0.5) / self.scale


def _pieces(x: np.ndarray, parts: int):
    return np.split(x, parts, axis=1)


def train(rows: DataFrame, first: np.ndarray, rounds: int) -> np.ndarray:
    """Entries after ``rounds`` passes over all rows: each entry becomes the mean of the parts nearest to it, rounded down; unused ones stay.

    ``first``: entries by part, entry and position. A pass sends home one sum per entry and position.
    """
    entries = first
    parts, k, d = first.shape

    for _ in range(rounds):
        def part(batches, entries=entries):
            search = [Orchard(e) for e in entries]
            total = np.zeros((parts, k, d + 1), np.int64)
            for batch in batches:
                x = matrix(batch.column("x"), parts * d)
                for at in range(0, len(x), ROWS):
                    for p, q in enumerate(_pieces(x[at:at + ROWS], parts)):
                        near, _ = search[p].nearest(q)
                        order = np.argsort(near, kind="stable")
                        used, start = np.unique(near[order], return_index=True)
                        total[p, used, :d] += np.add.reduceat(q[order], start, axis=0)
                        total[p, used, d] += np.diff(np.append(start, len(q)))
            return total.reshape(parts * k, d + 1)

        part.whole = True
        total = summed(rows.select("x"), parts * k, d + 1, part).reshape(parts, k, d + 1)
        count = total[..., d:]
        entries = np.where(count > 0, total[..., :d] // np.maximum(count, 1), entries)
    return entries


def encode(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES,
           rounds: int = ROUNDS, scale: float = SCALE) -> tuple[DataFrame, Codebooks | None]:
    """(codes, codebooks): product codes of all vectors, with their errors.

    codes: the id and label columns, ``code`` (two hex digits a part), ``error`` (squared distance in whole numbers, summed over the parts)
    and ``label_error`` (its sum over the rows with an equal label, null labels together; null where it passes 64 bits).
    The codebooks begin with the rows of the smallest ids (null ids last, equal ids by their numbers).

    Rows with a null vector or a null or non-finite component are dropped. Repeated ids and rows all count and are all returned. With fewer rows
    than entries, each part has as many entries as there are rows; without rows there are no codes and no codebooks. Vectors are filled up with
    zeros to one width that ``parts`` divides (an empty vector is all zeros). Components beyond +-32768 (less for more than 64 of them) count as that, so that errors
    stay exact. Other columns are left out, so their names don't matter.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    widest = vectors.agg(F.max(F.size(vector))).first()[0] or 0
    limit = 1 << (27 - max(0, math.ceil(math.log2(max(widest, 64) / 64) / 2)))
    rows, width = whole_numbers(vectors, vector, scale, limit, i=id, l=label)
    d = max(1, -(-width // parts))
    if width != parts * d:
        rows = kept(rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0), F.lit(parts * d - width)))), "vectors")
    first = rows.orderBy(F.asc_nulls_last("i"), "x").limit(entries).select("x").collect()
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    schema = T.StructType([T.StructField("i", kinds["i"]), T.StructField("l", kinds["l"]), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    names = [F.col("i").alias(id), F.col("l").alias(label), "code", "error"]
    if not first:
        return rows.sparkSession.createDataFrame([], schema).select(*names, F.lit(None).cast("long").alias("label_error")), None
    seeds = np.array([r[0] for r in first], np.int64).reshape(len(first), parts, d).transpose(1, 0, 2)
    books = Codebooks(train(rows, seeds, rounds), scale)

    def run(batches):
        search = [Orchard(e) for e in books.entries]
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                piece = batch.slice(at, ROWS)
                found = [o.nearest(q) for o, q in zip(search, _pieces(matrix(piece.column("x"), parts * d), parts))]
                text = np.stack([f[0] for f in found], 1).astype(np.uint8).tobytes().hex()
                code = [text[j:j + 2 * parts] for j in range(0, len(text), 2 * parts)]
                error = np.sum([f[1] for f in found], axis=0)
                yield pa.RecordBatch.from_arrays([piece.column("i"), piece.column("l"), pa.array(code, pa.string()), pa.array(error)], ["i", "l", "code", "error"])

    codes = kept(rows.mapInArrow(run, schema), "codes")
    totals = codes.groupBy(F.col("l").alias("l2")).agg(F.try_sum("error").alias("label_error"))
    both = codes.join(small(totals), F.col("l").eqNullSafe(F.col("l2")), "left")
    return both.select(*names, "label_error"), books
