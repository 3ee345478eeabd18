"""Registered queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from skillgrid.llm import decontam, language, licenses, line_dedup, near_dedup, packing, pieces, pii, quality, token_file, toxicity, vector_codes, whitening
from skillgrid.llm.common import table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return register


@query("op10_quality_rules")
def quality_rules(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"))


@query("op8_fuzzy_lines")
def fuzzy_lines(spark, sf_dir):
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


@query("op5_near_duplicates")
def near_duplicates(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=4)


@query("op3_benchmark_leaks")
def benchmark_leaks(spark, sf_dir):
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_sampled_pieces")
def sampled_pieces(spark, sf_dir):
    """Two different segmentations of every text; the ids as their number and a hash."""
    docs = table(spark, sf_dir, "documents")
    got = pieces.sample(docs, k=2)
    return got.select("doc_id", "rank", F.size("ids").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "log_prob", "perturbed", "log_inclusion", F.md5("decoded").alias("decoded_md5"))


@query("op6_language_id")
def language_id(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


@query("op1_token_file")
def token_ids(spark, sf_dir):
    return token_file.round_trip(table(spark, sf_dir, "documents")).drop("ids")


@query("op9_personal_data")
def personal_data(spark, sf_dir):
    return pii.report(table(spark, sf_dir, "documents"))


@query("op4_toxicity_chain")
def toxicity_chain(spark, sf_dir):
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_license_scan")
def license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op11_vector_codes")
def vector_code_table(spark, sf_dir):
    codes, books = vector_codes.encode(table(spark, sf_dir, "embeddings"))
    return codes.select("vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"))


@query("op12_whitened_embeddings")
def whitened_embeddings(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))[0]


@query("op13_packed_sequences")
def packed_sequences(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents")).pieces.drop("row")
