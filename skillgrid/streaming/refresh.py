"""Skill matches of a stored text corpus, kept current while aliases are approved, rejected or renamed.

The store is a folder with these tables:

* ``docs`` - texts, dealt to folders by a hash of their id;
* ``words`` - which text holds which word, dealt to folders by a hash of the word;
* ``hits`` - phrase matches, in the folders of their texts; a text without a match keeps one row without a skill;
* ``aliases`` - the newest decision on every alias, a folder for each refresh;
* ``refreshes`` - a row for each settled refresh.

A refresh compares the lexicon before and after a batch of decisions, looks up the first words of the phrases that differ and matches the texts that
hold one of them again, with the whole new lexicon. No other folder of texts is opened, and no other text is matched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skillgrid.operators import extract
from skillgrid.session import cut, freed_shuffles, work_dir
from skillgrid.sources.store import replace_parts, stored

#: Folders that texts and words are dealt to.
BUCKETS = 256
DECISION = "canonical_skill string, alias string, status string, seq long"
DOCS = "doc_id string, text string, load string, bucket int"
WORDS = "word string, doc_id string, doc_bucket int, load string, bucket int"
HITS = "doc_id string, skill string, text string, start int, end int, load string, bucket int"
REFRESHES = "batch long, stream string, batch_id long, phrases long, documents long"


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _lexicon(base: DataFrame, aliases: DataFrame) -> DataFrame:
    return extract.assemble_lexicon(base, extract.approved_aliases(aliases))


def _matched(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Every match of the texts, and one row without a skill for a text that has none, so that no folder of ``hits`` ever gets empty."""
    hits = extract.phrase_hits(docs, lexicon)
    return docs.select("doc_id", "load", "bucket").join(hits, "doc_id", "left").select(
        "doc_id", "skill", "text", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "load", "bucket")


def add_documents(docs: DataFrame, base: DataFrame, store: str, load: str = "0", buckets: int = BUCKETS) -> None:
    """Stores the texts (doc_id, text) of one load with their words and matches.

    ``load`` names the load: the same load given again replaces itself. An id belongs to one load. A null text is an empty text, rows without an id are left out,
    of repeated ids the greatest text counts. ``base`` is the lexicon without aliases (phrase, skill, rank); ``buckets`` stays the same for the life of a store.
    """
    spark = docs.sparkSession
    rows = docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.coalesce(F.max("text"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.lit(load).alias("load"), _bucket(F.col("doc_id"), buckets).alias("bucket"))
    replace_parts(rows.repartition("bucket"), f"{store}/docs", "load", "bucket")
    kept = spark.read.schema(DOCS).parquet(f"{store}/docs").where(F.col("load") == load)
    runs = extract.segments(extract.sentences(kept.select("doc_id", "text", F.col("bucket").alias("doc_bucket"))))
    words = runs.select("doc_id", "doc_bucket", F.explode(F.array_distinct(F.split("segment", " "))).alias("word")).where("word <> ''").distinct()
    words = words.select("word", "doc_id", "doc_bucket", F.lit(load).alias("load"), _bucket(F.col("word"), buckets).alias("bucket"))
    # two numbers deal a word, so that the texts of a very common one lie in several files
    replace_parts(words.repartition("bucket", F.col("doc_bucket") % 8), f"{store}/words", "load", "bucket")
    replace_parts(_matched(kept, _lexicon(base, _aliases(spark, store, _settled(spark, store)))).repartition("bucket"), f"{store}/hits", "load", "bucket")


def refreshes(spark: SparkSession, store: str) -> DataFrame:
    """One row per settled refresh: phrases that changed and texts that were matched again."""
    return stored(spark, f"{store}/refreshes", REFRESHES)


def _settled(spark: SparkSession, store: str) -> int:
    return refreshes(spark, store).agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]


def _aliases(spark: SparkSession, store: str, batch: int) -> DataFrame:
    return stored(spark, f"{store}/aliases/batch={batch}", DECISION)


def changed_phrases(before: DataFrame, after: DataFrame) -> DataFrame:
    """(phrase, first_word) of the phrases that name another skill, or none, in one of two lexicons."""
    was = before.select("phrase", "first_word", F.col("skill").alias("was"))
    now = after.select("phrase", "first_word", F.col("skill").alias("now"))
    return was.join(now, ["phrase", "first_word"], "full").where("NOT (was <=> now)").select("phrase", "first_word")


def touched_documents(spark: SparkSession, store: str, heads: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, doc_bucket) of the texts that hold one of the words (first_word); only the folders those words fall into are read."""
    own = heads.select("first_word").distinct().withColumn("b", _bucket(F.col("first_word"), buckets))
    asked = [r[0] for r in own.select("b").distinct().collect()]  # as many numbers as there are folders at most
    words = stored(spark, f"{store}/words", WORDS).where(F.col("bucket").isin(asked))
    return words.join(own, F.col("word") == F.col("first_word"), "left_semi").select("doc_id", "doc_bucket").distinct()


def touched_texts(spark: SparkSession, store: str, touched: DataFrame) -> DataFrame:
    """The touched texts; only their folders are read."""
    asked = [r[0] for r in touched.select("doc_bucket").distinct().collect()]  # as many numbers as there are folders at most
    return stored(spark, f"{store}/docs", DOCS).where(F.col("bucket").isin(asked)).join(touched.select("doc_id"), "doc_id", "left_semi")


def refresh(decisions: DataFrame, base: DataFrame, store: str, stream: str, batch_id: int, buckets: int = BUCKETS) -> None:
    """Applies a batch of decisions (canonical_skill, alias, status, seq) to the store.

    The newest decision on a pair counts: the greatest seq (null is the least), then the greatest status. A refresh that is repeated, also after it was
    stopped half-way, gives the same store: it starts from the aliases of the refresh before and replaces whole folders of matches.
    """
    spark = decisions.sparkSession
    log = refreshes(spark, store)
    known = log.where((F.col("stream") == stream) & (F.col("batch_id") == batch_id)).agg(F.max("batch")).first()[0]
    if known is not None:  # settled before the stream could note it
        return
    number = _settled(spark, store) + 1
    old = _aliases(spark, store, number - 1)
    rows = old.unionByName(decisions.select("canonical_skill", "alias", "status", F.coalesce(F.col("seq").cast("long"), F.lit(-(2**63))).alias("seq")))
    newest = rows.where("canonical_skill IS NOT NULL AND alias IS NOT NULL").groupBy("canonical_skill", "alias").agg(F.max(F.struct("seq", "status")).alias("d"))
    newest.select("canonical_skill", "alias", "d.status", "d.seq").write.mode("overwrite").parquet(f"{store}/aliases/batch={number}")
    after = cut(_lexicon(base, _aliases(spark, store, number)))
    heads = cut(changed_phrases(_lexicon(base, old), after))
    touched = cut(touched_documents(spark, store, heads, buckets))
    documents = touched.count()
    if documents:
        again = touched_texts(spark, store, touched)
        asked = [r[0] for r in touched.select("doc_bucket").distinct().collect()]
        stay = stored(spark, f"{store}/hits", HITS).where(F.col("bucket").isin(asked)).join(touched.select("doc_id"), "doc_id", "left_anti")
        staged = work_dir(spark, "refreshed")
        with freed_shuffles(spark):
            _matched(again, after).unionByName(stay.select("doc_id", "skill", "text", "start", "end", "load", "bucket")).write.parquet(staged)
        replace_parts(spark.read.schema(HITS).parquet(staged).repartition("load", "bucket"), f"{store}/hits", "load", "bucket")
    row = (number, stream, batch_id, heads.count(), documents)
    spark.createDataFrame([row], REFRESHES).coalesce(1).write.mode("append").parquet(f"{store}/refreshes")


def refresh_from(spark: SparkSession, landing: str, base: DataFrame, store: str, checkpoint: str, buckets: int = BUCKETS):
    """All decisions that have landed since the last call, as one stream that ends by itself; call it hourly, or after approvals."""
    landed = spark.readStream.schema(DECISION).json(landing)

    def apply(batch: DataFrame, batch_id: int) -> None:
        stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        refresh(cut(batch), base, store, stream, batch_id, buckets)

    return landed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_hits(spark: SparkSession, store: str) -> DataFrame:
    """All matches of the stored texts: doc_id, skill, text, start, end."""
    return stored(spark, f"{store}/hits", HITS).where("skill IS NOT NULL").select("doc_id", "skill", "text", "start", "end")
