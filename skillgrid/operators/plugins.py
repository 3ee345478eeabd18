"""Extension points: own functions for the vectors of texts and for the skill spans in them.

Both take a *loader*, a function without arguments that a task calls once and that gives the vectorised function, so a model is loaded once a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillgrid.operators import vectors

#: Gives the vectors of many texts, as an array of one row per text.
Embed = Callable[[list[str]], np.ndarray]
#: Gives the spans of many texts: for each a list of (word, label, score, start, end); offsets in code points or None.
Spans = Callable[[list[str]], list[list[tuple]]]

SPAN = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType()),
                                 T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def embedded(docs: DataFrame, owner: list[str], load: Callable[[], Embed], dim: int, text_col: str = "text", size: int = vectors.CHUNK_CHARS,
             max_chunks: int | None = None) -> DataFrame:
    """Pooled vectors of texts by an own function: the columns ``owner``, vector, failed.

    Texts are cut into chunks, the function gets whole Arrow batches of them, the chunk vectors of an owner are averaged and scaled to length one. An owner with
    several rows has the mean of all their chunks; rows with a null in ``owner`` are left out. A null or blank text, and one of which no chunk has a vector of finite
    numbers, gives zeros and ``failed``. An array of another shape than (texts, ``dim``) is an error. Other columns of ``docs`` are ignored.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = load()
        for batch in batches:
            found = np.asarray(embed(batch.tolist()), dtype="float64")
            if found.shape != (len(batch), dim):
                raise ValueError(f"vectors of shape {found.shape} for {len(batch)} texts of {dim} dimensions")
            good = np.isfinite(found).all(axis=1)
            yield pd.Series([row if ok else None for row, ok in zip(found, good)], dtype=object)

    known = docs.select(*owner, F.col(text_col).alias("_text")).where(" AND ".join(f"`{c}` IS NOT NULL" for c in owner))
    chunks = known.select(*owner, F.explode(vectors.text_chunks(F.col("_text"), size, max_chunks)).alias("_chunk")).where("_chunk <> ''")
    own = chunks.withColumn("vector", apply("_chunk")).where("vector IS NOT NULL")
    key = F.struct(*owner)
    pooled = vectors.pooled_vectors(own, owner).select(key.alias("_key"), "vector")
    return vectors.with_neutral(known.select(key.alias("_key")).distinct(), pooled, "_key", dim).select("_key.*", "vector", "failed")


def spans(docs: DataFrame, load: Callable[[], Spans], doc: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans that an own function finds: doc_id, word, label, score, start, end, as ``extract.accepted_spans`` and ``extract.extract_entities`` take them.

    The function gets whole texts, in Arrow batches; null and blank ones are not shown to it. It has to answer with a list for every text. Repeated rows give
    repeated spans; other columns of ``docs`` are ignored.
    """

    @F.pandas_udf(SPAN)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = load()
        for batch in batches:
            found = find(batch.tolist())
            if len(found) != len(batch):
                raise ValueError(f"spans of {len(found)} texts for {len(batch)}")
            yield pd.Series([[dict(zip(("word", "label", "score", "start", "end"), s)) for s in each] for each in found], dtype=object)

    shown = docs.select(F.col(doc).alias("doc_id"), F.col(text_col).alias("_text")).where(r"_text RLIKE '\\S'")
    return shown.select("doc_id", F.explode(apply("_text")).alias("_s")).select("doc_id", "_s.*")
