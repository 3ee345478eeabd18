"""Language identification: an interpolated Kneser-Ney character model of each language, lowest cross-entropy, calibrated rejection."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillgrid.llm.charlm import BITS, MOST, Model, code_points, collect, count_grams, gram_hashes, gram_scores, languages, means, opened, packed, smooth
from skillgrid.llm.common import kept, steps

ORDER = 4
#: A text is rejected if its cross-entropy lies above this point of the learned texts of its language, and a tenth more.
POINT, SLACK = 0.995, 1.1
#: Characters whose evidence the score counts.
EVIDENCE = 20.0
#: Characters of a block of texts that is scored by joins.
BLOCK_CHARS = 16 << 20


def held_out(id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text is a multiple of 5; a null id is the empty text."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", order: int = ORDER, bits: int = BITS) -> Model:
    """Models of all languages of the rows with a text and a language, counted over whole texts."""
    return collect(_smoothed(docs, text, lang, order), order, bits)


def _smoothed(docs: DataFrame, text: str, lang: str, order: int) -> DataFrame:
    counts = count_grams(docs.select(F.col(text).alias("t"), F.col(lang).cast("string").alias("g")), "t", "g", order, lower=True)
    return smooth(counts, order, modified=False)


def _named(batch, langs: list[str], entropy: np.ndarray, n_carry: int) -> pa.RecordBatch:
    """The best language of each text of a slice, by the cross-entropies of all languages."""
    n = batch.num_rows
    usable = batch.column("letters").fill_null(False).to_numpy(zero_copy_only=False) & (len(langs) > 0)
    best = entropy.argmin(axis=1)  # ties: the first name
    low = entropy[np.arange(n), best]
    with np.errstate(invalid="ignore"):
        share = 1.0 / np.exp(-EVIDENCE * np.maximum(entropy - low[:, None], 0)).sum(axis=1)
    names = [langs[b] if u else "und" for b, u in zip(best, usable)]
    return pa.RecordBatch.from_arrays(
        [*[batch.column(f"c{k}") for k in range(n_carry)], pa.array(names, pa.string()), pa.array(np.where(usable, share, 0.0)), pa.array(np.where(usable, low, 0.0))],
        [*[f"c{k}" for k in range(n_carry)], "lang_pred", "score", "cross_entropy"])


def _rows(docs: DataFrame, text: str, carry: tuple[str, ...]) -> tuple[DataFrame, str]:
    rows = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(carry)], F.col(text).alias("t"), F.col(text).rlike(r"\p{L}").alias("letters"))
    kinds = ", ".join(f"c{k} {rows.schema[f'c{k}'].dataType.simpleString()}" for k in range(len(carry)))
    return rows, f"{kinds}{', ' if kinds else ''}lang_pred string, score double, cross_entropy double"


def predict(docs: DataFrame, model: Model, text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``carry`` columns, lang_pred, score and cross_entropy (nats per character) of every row; only the text is used."""
    shared = model.share(docs.sparkSession)
    n_carry = len(carry)

    def run(batches):
        m = opened(shared)
        for batch in steps(batches, "t"):
            n = batch.num_rows
            entropy = np.full((n, max(1, len(m.langs))), np.inf)
            if m.langs:
                codes, bounds = code_points(batch.column("t"), m.order - 1, lower=True)
                size = np.diff(bounds)
                places = np.arange(bounds[-1]) + np.repeat((m.order - 1) * (np.arange(n) + 1), size)
                for k in range(len(m.langs)):
                    entropy[:, k] = -means(m.log_probs(codes, places, k), bounds)
            yield _named(batch, m.langs, entropy, n_carry)

    rows, schema = _rows(docs, text, carry)
    return rows.mapInArrow(run, schema).toDF(*carry, "lang_pred", "score", "cross_entropy")


def predict_joined(docs: DataFrame, model: DataFrame, order: int = ORDER, text: str = "text", carry: tuple[str, ...] = (), chars: int = BLOCK_CHARS) -> DataFrame:
    """As ``predict``, with the model as a table (see ``smooth``) of any size: no entry is left out and none shares a value.

    Texts are dealt to blocks of about ``chars`` characters; each gram of a block gets its value in every language by joins, and a task holds one block
    of texts and the values of its grams.
    """
    rows, schema = _rows(docs, text, carry)
    n_carry, langs = len(carry), languages(model)
    total = rows.agg(F.sum(F.length("t").cast("long"))).first()[0] or 0
    block = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(int(max(1, -(-total // chars))))).cast("int")
    texts = kept(rows.withColumn("block", block), "blocks")
    grams = count_grams(texts.withColumn("by", F.col("block").cast("string")), "t", "by", order, lower=True)
    grams = kept(grams.select(F.col("lang").cast("int").alias("b"), "hi", "lo"), "block-grams")
    asked = grams.select("hi", "lo").distinct().select(F.explode(F.array(*[F.lit(x) for x in langs]).cast("array<string>")).alias("lang"), "hi", "lo")
    each = gram_scores(asked, model, order).groupBy("hi", "lo").agg(F.transform(F.array_sort(F.collect_list(F.struct("lang", "value"))), lambda x: x["value"]).alias("values"))
    values = grams.join(each, ["hi", "lo"]).select("b", "hi", "lo", "values")

    def run(batch: pa.Table, own: pa.Table) -> pa.Table:
        hi, lo = (own.column(c).to_numpy() for c in ("hi", "lo"))
        value = own.column("values").combine_chunks().flatten().to_numpy().reshape(len(hi), len(langs))
        salt = 0
        while True:  # the block's grams have different hashes, and hold all grams of its texts
            keys = gram_hashes(np.uint64(0), hi, lo, salt)
            by = np.argsort(keys)
            keys = keys[by]
            if not (keys[1:] == keys[:-1]).any():
                break
            salt += 1
        made = []
        for part in steps(batch.combine_chunks().to_batches(), "t"):
            codes, bounds = code_points(part.column("t"), order - 1, lower=True)
            size = np.diff(bounds)
            places = np.arange(bounds[-1]) + np.repeat((order - 1) * (np.arange(len(size)) + 1), size)
            entropy = np.full((len(size), max(1, len(langs))), np.inf)
            if langs:
                h, l = packed(np.stack([codes[places - j] for j in range(order - 1, -1, -1)]).astype(np.int64))
                at = by[np.searchsorted(keys, gram_hashes(np.uint64(0), h, l, salt))] if len(places) else np.zeros(0, np.int64)
                for k in range(len(langs)):
                    entropy[:, k] = -means(value[at, k] if len(places) else np.zeros(0), bounds)
            made.append(_named(part, langs, entropy, n_carry))
        return pa.Table.from_batches(made)

    out = texts.groupBy("block").cogroup(values.groupBy("b")).applyInArrow(run, schema)
    return out.toDF(*carry, "lang_pred", "score", "cross_entropy")


def identify(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", most: int = MOST) -> DataFrame:
    """One row per row of ``docs``: id, held_out, lang_pred, score, cross_entropy, rejected.

    Learns from the rows that are not held out and have a text and a language, over whole texts. lang_pred has the
    lowest cross-entropy per character; the first name wins a tie; und for a null text, one without a
    letter, or if nothing was learned. score: the share of the best language, between 0 and 1, in exp(-20 *
    cross-entropy). rejected: und, or a cross-entropy above that of 99.5 % of the learned texts of the
    language, with a tenth of slack. Repeated rows and ids are predicted one by one. Models of more than ``most`` entries
    stay tables (``predict_joined``), with the same values. An empty table gives an empty table.
    """
    rows = docs.select(F.col(id).alias("i"), F.col(text).alias("t"), F.col(lang).cast("string").alias("g"), held_out(F.col(id)).alias("h"))
    model = kept(_smoothed(rows.where("NOT h"), "t", "g", ORDER), "model")
    carry = ("i", "g", "h")
    got = predict(rows, collect(model, ORDER, BITS), "t", carry) if model.count() <= most else predict_joined(rows, model, ORDER, "t", carry)
    got = kept(got, "languages")
    limits = got.where("NOT h AND g = lang_pred").groupBy(F.col("lang_pred").alias("l")).agg((SLACK * F.percentile_approx("cross_entropy", POINT, 10000)).alias("limit"))
    # one row per language
    return got.join(F.broadcast(limits), F.col("lang_pred") == F.col("l"), "left").select(
        F.col("i").alias(id), F.col("h").alias("held_out"), "lang_pred", "score", "cross_entropy",
        ((F.col("lang_pred") == "und") | F.coalesce(F.col("cross_entropy") > F.col("limit"), F.lit(False))).alias("rejected"))
