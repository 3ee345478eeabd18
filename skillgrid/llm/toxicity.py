"""Toxicity: a chain of linear classifiers, each fed the probabilities of the categories before it."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillgrid.llm.common import Words, kept, range_hashes, small, steps

#: Labelled rows that are learned from at most: those with the smallest hashes of their ids.
MAX_ROWS = 8_000
FOLDS = 3
BITS = 18
_U = np.uint64


def features(text: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of every text, one for each occurrence, and the bounds of each text: words and their first 4 and 5 bytes.

    A-Z are lower-cased, ASCII characters that are no letter or digit part words.
    """
    w = Words(text, lower=True, letters=True)
    n = len(w.start)
    parts = [range_hashes(w.data, w.start, w.end)]
    parts += [range_hashes(w.data, w.start, np.minimum(w.end, w.start + k)) * _U(2 * k + 1) for k in (4, 5)]
    out = np.empty(3 * n, np.int32)
    for j, h in enumerate(parts):
        out[j::3] = (h >> _U(64 - bits)).astype(np.int32)
    return out, 3 * w.first


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _root(bounds: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(np.diff(bounds), 1))


def fit_linear(idx: np.ndarray, val: np.ndarray, bounds: np.ndarray, extra: np.ndarray, y: np.ndarray, bits: int, rounds: int = 200, decay: float = 1e-7) -> np.ndarray:
    """Logistic regression by adaptive gradient steps over all rows: weights of the hashed features, of the extra ones, and a bias.

    Rows of the rarer class weigh as much as those of the other in total. With a single class the bias alone says so.
    """
    size = 1 << bits
    w = np.zeros(size + extra.shape[1] + 1)
    share = y.mean() if len(y) else 0.0
    if share in (0.0, 1.0):
        w[-1] = 4.0 if share else -4.0
        return w
    balance = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) / len(y)
    row = np.repeat(np.arange(len(y)), np.diff(bounds))
    past = np.full(len(w), 1e-4)
    for _ in range(rounds):
        z = _sums(w[idx] * val, bounds) + extra @ w[size:-1] + w[-1]
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * balance
        grad = np.concatenate([np.bincount(idx, weights=val * err[row], minlength=size), extra.T @ err, [err.sum()]])
        grad[:-1] += decay * w[:-1]
        past += grad * grad
        w -= 5.0 * grad / np.sqrt(past)
    return w


def _chance(w: np.ndarray, z: np.ndarray, extra: np.ndarray, bits: int) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z + extra @ w[1 << bits:-1] + w[-1], -30, 30)))


def _chain_inputs(chances: list[np.ndarray], n: int) -> np.ndarray:
    """Probabilities of the earlier categories as log odds."""
    if not chances:
        return np.zeros((n, 0))
    p = np.clip(np.stack(chances, axis=1), 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _fold_fit(k: int, folds: int, bits: int):
    """Fits category k without one fold and gives that fold's probabilities; with all rows it gives the weights."""

    def fit(key, part):
        part = part.sort_values("i", kind="stable")
        idx = np.frombuffer(b"".join(part["f"]), "<i4")
        val = np.frombuffer(b"".join(part["v"]), "<f4")
        bounds = np.concatenate([[0], np.cumsum([len(x) // 4 for x in part["f"]])])
        out = (part["fold"] == key[0]).to_numpy()
        extra = _chain_inputs([part[f"p{j}"].to_numpy() for j in range(k)], len(part))
        inner = np.concatenate([[0], np.cumsum(np.diff(bounds)[~out])])
        keep = np.repeat(~out, np.diff(bounds))
        w = fit_linear(idx[keep], val[keep], inner, extra[~out], part[f"y{k}"].to_numpy()[~out].astype(float), bits)
        chance = _chance(w, _sums(w[idx] * val, bounds), extra, bits)[out]
        whole = w.astype("<f8").tobytes() if key[0] == folds else None
        return pd.DataFrame({"i": [*part["i"][out], None], "p": [*chance, 0.0], "w": [*[None] * len(chance), whole]})

    return fit


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str], id: str = "doc_id", text: str = "text", max_rows: int = MAX_ROWS, folds: int = FOLDS, bits: int = BITS) -> np.ndarray:
    """One row of weights for each category, in order; learned from at most ``max_rows`` labelled rows.

    The model of a category learns from the labels of its rows and, as extra inputs, the probabilities of
    the earlier categories that models of the other folds gave each row. Fold models of one category are fitted by separate tasks.
    Of several label rows of a document the least counts, category by category in order; rows with a null label or id are left out.
    """
    names = list(categories)
    marks = labels.select(F.col(id).alias("l"), *[F.expr(e).cast("int").alias(f"y{k}") for k, e in enumerate(categories.values())]).where(" AND ".join(f"y{k} IS NOT NULL" for k in range(len(names))) + " AND l IS NOT NULL")
    marks = marks.groupBy("l").agg(F.min(F.struct(*[f"y{k}" for k in range(len(names))])).alias("y")).select("l", "y.*").orderBy(F.xxhash64(F.col("l").cast("string")), "l").limit(max_rows)
    marks = kept(marks.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), F.col("l").cast("string")), F.lit(folds)).cast("int")), "labels")
    # at most max_rows rows
    rows = docs.select(F.col(id).alias("i"), F.col(text).alias("t")).where("t IS NOT NULL").join(F.broadcast(marks), F.col("i") == F.col("l")).drop("l")

    def extract(batches):
        for batch in steps(batches, "t"):
            idx, bounds = features(batch.column("t"), bits)
            raw_i, raw_v = [], []
            for a, b in zip(bounds[:-1], bounds[1:]):
                f, n = np.unique(idx[a:b], return_counts=True)
                raw_i.append(f.astype("<i4").tobytes())
                raw_v.append((n / np.sqrt(max(b - a, 1))).astype("<f4").tobytes())
            cols = [batch.column("i").cast(pa.string()), batch.column("fold"), *[batch.column(f"y{k}") for k in range(len(names))], pa.array(raw_i, pa.binary()), pa.array(raw_v, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["i", "fold", *[f"y{k}" for k in range(len(names))], "f", "v"])

    ys = ", ".join(f"y{k} int" for k in range(len(names)))
    rows = kept(rows.mapInArrow(extract, f"i string, fold int, {ys}, f binary, v binary"), "features")
    weights = []
    for k in range(len(names)):
        # at most max_rows rows, once for each fold and once for all; fold number ``folds`` leaves no row out
        copies = rows.withColumn("leave", F.explode(F.sequence(F.lit(0), F.lit(folds))))
        got = kept(copies.groupBy("leave").applyInPandas(_fold_fit(k, folds, bits), "i string, p double, w binary"), "chain")
        final = got.where("w IS NOT NULL").select("w").collect()  # one row of 2**bits numbers
        weights.append(np.frombuffer(final[0]["w"], "<f8") if final else np.concatenate([np.zeros((1 << bits) + k), [-4.0]]))
        if k + 1 < len(names):
            rows = kept(rows.join(got.where("i IS NOT NULL").select(F.col("i").alias("pi"), F.col("p").alias(f"p{k}")), F.col("i") == F.col("pi")).drop("pi"), "features")
    return weights


def classify(docs: DataFrame, labels: DataFrame, categories: dict[str, str] | None = None, id: str = "doc_id", text: str = "text", max_rows: int = MAX_ROWS, threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: id, and for each category its probability (p_<name>) and whether it reaches ``threshold`` (<name>).

    ``categories`` maps names to SQL conditions on the labels, in chain order. Labels with a null in any
    of them, and those of unknown documents, teach nothing; of repeated labels of a document one counts; without usable labels all
    probabilities are small. A null or empty text has the probabilities of a text without words. Texts are read whole. Repeated rows
    are judged one by one; an empty table gives an empty table.
    """
    categories = categories or {"low_quality": "quality = 0", "toxic": "toxic = 1"}
    names, bits = list(categories), BITS
    weights = train(docs, labels, categories, id, text, max_rows, FOLDS, bits)
    shared = docs.sparkSession.sparkContext.broadcast([np.asarray(w) for w in weights])  # 2**bits numbers a category

    def run(batches):
        for batch in steps(batches, "t"):
            idx, bounds = features(batch.column("t").fill_null(""), bits)
            root = _root(bounds)
            chances: list[np.ndarray] = []
            for w in shared.value:
                z = _sums(w[idx], bounds) / root
                chances.append(_chance(w, z, _chain_inputs(chances, len(root)), bits))
            yield pa.RecordBatch.from_arrays([batch.column("i"), *[pa.array(c) for c in chances]], ["i", *[f"p{k}" for k in range(len(names))]])

    rows = docs.select(F.col(id).alias("i"), F.col(text).alias("t"))
    kind = rows.schema["i"].dataType.simpleString()
    out = rows.mapInArrow(run, f"i {kind}, {', '.join(f'p{k} double' for k in range(len(names)))}")
    return out.select(F.col("i").alias(id), *[c for k, n in enumerate(names) for c in (F.col(f"p{k}").alias(f"p_{n}"), (F.col(f"p{k}") >= threshold).alias(n))])
