"""Skill extraction: lexicon, phrase matching, consolidation, evidence windows."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from skillgrid.functions import constants as K
from skillgrid.functions import skills, text

# Where a hit came from: order of trust and confidence.
PASSES = {"ner": (0, 0.96), "bert-ner": (1, None), "phrase_matcher": (2, 0.92), "regex": (3, 0.74), "noun_chunk": (4, 0.66)}


# ---- lexicon -----------------------------------------------------------------------------------

def base_lexicon(spark: SparkSession) -> DataFrame:
    """Keywords and built-in aliases as (phrase, skill, rank)."""
    rows = [(k, k, 0) for k in K.KEYWORDS if k not in K.EXCLUDED_TERMS]
    for skill, phrases in K.ALIASES.items():
        rows += [(skill, skill, 1)] + [(p, skill, 1) for p in phrases]
    return spark.createDataFrame(rows, "phrase string, skill string, rank int")


def approved_aliases(aliases: DataFrame) -> DataFrame:
    """(phrase, skill) of approved aliases with two different, non-empty names."""
    skill, alias = skills.canonical(F.col("canonical_skill")), skills.canonical(F.col("alias"))
    return (
        aliases.filter(F.col("status") == "approved")
        .select(alias.alias("phrase"), skill.alias("skill"))
        .filter((F.col("phrase") != "") & (F.col("skill") != "") & (F.col("phrase") != F.col("skill")))
    )


def dynamic_terms(entities: DataFrame, plain: DataFrame | None = None, csv_terms: DataFrame | None = None,
                  min_frequency: int = 1, max_terms: int | None = None, reviewed_only: bool = False,
                  allow_excluded: bool = True) -> DataFrame:
    """Skills already stored, most frequent first: (skill, frequency).

    ``entities``: skill, text, label, label_status; ``plain``: skill of records without entities.
    """
    kept = entities.filter((F.col("label_status") != "candidate") & (F.coalesce(text.blank_to_null(F.col("label")), F.lit("SKILL")) == "SKILL"))
    if reviewed_only:
        kept = kept.filter(F.col("label_status") == "reviewed")
    sources = [kept.select(skills.canonical(text.first_filled(F.col("skill"), F.col("text"))).alias("skill"))]
    if plain is not None and not reviewed_only:
        sources.append(plain.select(skills.canonical(F.col("skill")).alias("skill")))
    if csv_terms is not None:
        sources.append(csv_terms.select(skills.canonical(F.col("skill")).alias("skill")))
    counts = (
        reduce(DataFrame.unionByName, sources).filter(F.col("skill") != "")
        .groupBy("skill").agg(F.count("*").alias("frequency")).filter(F.col("frequency") >= min_frequency)
    )
    if not allow_excluded:
        counts = counts.filter(~F.col("skill").isin(*K.EXCLUDED_TERMS))
    return counts.orderBy(F.desc("frequency"), "skill").limit(max_terms) if max_terms else counts


def assemble_lexicon(base: DataFrame, aliases: DataFrame | None = None, dynamic: DataFrame | None = None) -> DataFrame:
    """One skill per phrase: (phrase, skill, first_word, n_words). Later sources win, as in an override."""
    sources = [base.select("phrase", "skill", "rank")]
    if aliases is not None:
        sources.append(aliases.select("phrase", "skill", F.lit(2).alias("rank")))
        sources.append(aliases.select(F.col("skill").alias("phrase"), "skill", F.lit(2).alias("rank")))
    if dynamic is not None:
        sources.append(dynamic.select(F.col("skill").alias("phrase"), "skill", F.lit(3).alias("rank")))
    rows = reduce(DataFrame.unionByName, sources).select(
        skills.canonical(F.col("phrase")).alias("phrase"), skills.canonical(F.col("skill")).alias("skill"), "rank")
    best = rows.filter("phrase <> '' AND skill <> ''").groupBy("phrase").agg(
        F.max_by("skill", F.struct("rank", "skill")).alias("skill"))
    return with_words(best)


def with_words(lexicon: DataFrame) -> DataFrame:
    parts = F.split("phrase", " ")
    return lexicon.withColumn("first_word", F.get(parts, 0)).withColumn("n_words", F.size(parts))


# ---- text pieces with offsets ------------------------------------------------------------------

@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _offsets(pieces: pd.Series) -> pd.Series:
    """Start of every piece of a text that was split at single characters: one running sum a text, linear in its pieces."""
    def starts(given):
        ends = np.cumsum(np.fromiter(map(len, given), np.int64, len(given)) + 1)
        return np.concatenate([[0], ends[:-1]]) if len(given) else ends

    return pieces.map(starts, na_action="ignore")


def _pieces(df: DataFrame, source: str, delimiter: str, piece: str, start: str, keep: Column | None = None) -> DataFrame:
    split = df.withColumn("_p", F.split(source, delimiter))
    zipped = split.withColumn("_z", F.arrays_zip(F.col("_p").alias("piece"), _offsets(F.col("_p")).alias("start")))
    solid = F.filter("_z", lambda z: z["piece"].rlike(r"[\p{L}\p{N}]"))
    return zipped.withColumn("_e", F.explode(solid)).withColumn(piece, F.col("_e.piece")).withColumn(
        start, F.col("_e.start")).drop("_p", "_z", "_e")


def sentences(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per sentence with its start in the document; the whole text is dropped."""
    return _pieces(docs, text_col, r"[.!?\n]", "sentence", "sentence_start").drop(text_col)


def segments(sents: DataFrame) -> DataFrame:
    """Runs of words without punctuation in between; a phrase never crosses a segment.

    Hyphens count as blanks, so offsets are kept while 'power-bi' meets 'power bi'.
    """
    flat = F.lower(F.translate("sentence", "-", " "))
    return _pieces(sents.withColumn("_flat", flat), "_flat", r"[^\p{L}\p{N}+#&/ ]", "segment", "segment_start").drop("_flat")


def word_runs(words: Column, most: int) -> Column:
    """Every word with the words after it, ``most`` in all: ARRAY<STRUCT<w0, w1, ...>>, linear in the text."""
    def zipped(w):
        return F.arrays_zip(*[F.slice(w, F.lit(n + 1), F.greatest(F.size(w), F.lit(1))) for n in range(most)])

    return text.let(words, zipped)


def _run_text(run: Column, most: int, n_words: Column) -> Column:
    fields = F.array(*[run[str(n)] for n in range(most)])
    return F.array_join(F.slice(fields, F.lit(1), n_words), " ")


def longest(phrases: DataFrame) -> tuple[int, int]:
    """Words and characters of the longest phrase (two numbers from a small table)."""
    row = phrases.agg(F.max("n_words"), F.max(F.length("phrase"))).first()
    return row[0] or 1, row[1] or 1


#: Words that a task hands on at once, and characters of text that it looks at together; a longer text is looked at alone.
WORD_ROWS, SLICE_CHARS = 50_000, 1 << 19


def _strings(chars: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The pieces of an array of code points as strings."""
    at = np.concatenate([[0], np.cumsum(size)])
    got = chars[np.repeat(start - at[:-1], size) + np.arange(at[-1])]
    ends = np.concatenate([[0], np.cumsum(1 + (got > 0x7F) + (got > 0x7FF) + (got > 0xFFFF))])[at]
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(got.tobytes().decode("utf-32-le").encode()))


def _words_of(raws: list[str], flats: list[str], width: int, per_sentence: bool):
    """The words of some texts in slices: text numbers, contexts and lists of words (see ``_words_ahead``)."""
    body = ".".join(raws)
    raw, flat = (np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in (body, ".".join(flats)))
    texts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in raws])])[:-1]
    raw_ends, flat_ends = (np.append(np.flatnonzero(x == 46), len(x)) for x in (raw, flat))
    raw_starts, flat_starts = (np.concatenate([[0], e[:-1] + 1]) for e in (raw_ends, flat_ends))
    cut = (flat == 46) | (flat == 10)
    solid = ~cut & (flat != 32)
    # segments that hold a letter or digit; the only other characters left are + # & /
    plain = np.concatenate([[0], np.cumsum(solid & ~np.isin(flat, [35, 38, 43, 47]))])
    seg_ends = np.append(np.flatnonzero(cut), len(flat))
    seg_starts = np.concatenate([[0], seg_ends[:-1] + 1])
    words = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
    seg = np.searchsorted(seg_ends, words)
    some = plain[seg_ends[seg]] > plain[seg_starts[seg]]
    words, seg = words[some], seg[some]
    differs = np.concatenate([[0], np.cumsum(raw != flat)]) if len(raw) == len(flat) else None
    sentences_ = body.split(".") if per_sentence else None
    for k in range(0, len(words), WORD_ROWS):
        w, size = words[k:k + WORD_ROWS], np.minimum(width + 1, seg_ends[seg[k:k + WORD_ROWS]] - words[k:k + WORD_ROWS])
        sentence = np.searchsorted(flat_ends, w)
        place = raw_starts[sentence] + w - flat_starts[sentence]
        text = np.searchsorted(texts, raw_starts[sentence], "right") - 1
        other = differs[w + size] > differs[w] if differs is not None else np.ones(len(w), bool)
        left = np.maximum(np.minimum(place + size, raw_ends[sentence]) - place, 0)
        near = _strings(raw, np.minimum(place, len(raw))[other], left[other]).take(pa.array(np.cumsum(other) - 1, mask=~other))
        rows = pa.StructArray.from_arrays([pa.array((place - texts[text]).astype(np.int32)), _strings(flat, w, size), near], ["start", "run", "near"])
        owner = sentence if per_sentence else text
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        context = pa.array([sentences_[j].strip(" ")[:500] for j in owner[first]] if per_sentence else [None] * len(first), pa.string())
        yield text[first], context, pa.ListArray.from_arrays(pa.array(np.append(first, len(w)).astype(np.int32)), rows)


def _words_ahead(docs: DataFrame, doc: str, text_col: str, width: int, per_sentence: bool) -> DataFrame:
    """doc, context and words, an array of (start, run, near): the words of a slice of a text, or of one sentence with its first 500 characters as context.

    ``run`` is the segment from the word on, lower-cased, hyphens as blanks, up to ``width`` characters and one more; ``near`` the same place as it is written,
    null if equal. A text crosses to Python once, its sentences parted by full stops and, in the flat form, its segments by line feeds.
    """
    schema = T.StructType([T.StructField(doc, docs.schema[doc].dataType), T.StructField("context", T.StringType()), T.StructField("words", T.ArrayType(T.StructType([
        T.StructField("start", T.IntegerType()), T.StructField("run", T.StringType()), T.StructField("near", T.StringType())])))])

    def cut(batches):
        for batch in batches:
            rows, raws, flats, chars = [], [], [], 0
            for r in range(batch.num_rows):
                raw = batch.column(1)[r].as_py()
                if raw:
                    rows.append(r)
                    raws.append(raw)
                    flats.append(batch.column(2)[r].as_py())
                    chars += len(raw)
                if raws and (chars >= SLICE_CHARS or r == batch.num_rows - 1):
                    for text_, context, words in _words_of(raws, flats, width, per_sentence):
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.array(rows)[text_])), context, words], schema.names)
                    rows, raws, flats, chars = [], [], [], 0

    parts = F.split(text_col, r"[.!?\n]")
    lowered = F.array_join(F.transform(parts, lambda s: F.lower(F.translate(s, "-", " "))), ".")
    flat = F.regexp_replace(lowered, r"[^\p{L}\p{N}+#&/. ]", "\n")
    return docs.select(doc, F.array_join(parts, ".").alias("_raw"), flat.alias("_flat")).mapInArrow(cut, schema)


def phrase_hits(docs: DataFrame, lexicon: DataFrame, doc: str = "doc_id", text_col: str = "text",
                with_context: bool = False) -> DataFrame:
    """All occurrences of lexicon phrases: doc, skill, text, start, end (and the sentence).

    Words are matched with the first word of the phrases by an equi-join, so the cost does not grow with
    the lexicon. A word row carries only as many following characters as the longest phrase has, so even a text
    without any punctuation stays linear.
    """
    _, width = longest(lexicon)
    rows = _words_ahead(docs, doc, text_col, width, with_context).select(doc, "context", F.explode("words").alias("t"))
    rows = rows.select(doc, "context", "t.start", "t.run", "t.near")
    met = rows.join(lexicon, F.substring_index("run", " ", 1) == lexicon.first_word).filter(
        F.concat("run", F.lit(" ")).startswith(F.concat("phrase", F.lit(" "))))
    out = met.select(doc, "skill", F.left(F.coalesce("near", "run"), F.length("phrase")).alias("text"), "start",
                     (F.col("start") + F.length("phrase")).alias("end"), "context")
    return out if with_context else out.drop("context")


def token_hits(docs: DataFrame, tokens: Column, phrases: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Distinct (doc, skill) whose phrase is a run of the given tokens; ``phrases``: phrase, skill, first_word, n_words."""
    most, _ = longest(phrases)
    runs = docs.select(doc, F.explode(word_runs(tokens, most)).alias("run"))
    return (
        runs.join(phrases, F.col("run.0") == F.col("first_word"))
        .filter(_run_text(F.col("run"), most, F.col("n_words")) == F.col("phrase"))
        .select(doc, "skill").distinct()
    )


def keyword_phrases(spark: SparkSession, keywords=K.KEYWORDS) -> DataFrame:
    """Keywords as phrases of the cleaned text; a longest keyword bounds the window."""
    rows = spark.createDataFrame([(k,) for k in keywords if k not in K.EXCLUDED_TERMS], "skill string")
    return with_words(rows.withColumn("phrase", text.normalise_text(F.col("skill"))).filter("phrase <> ''"))


def keyword_skills(docs: DataFrame, phrases: DataFrame, doc: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keyword extraction on cleaned text: doc, sorted skills (documents without any keep an empty list)."""
    hits = token_hits(docs, text.words(F.col(text_col)), phrases, doc)
    return skill_lists(docs.select(doc), hits, doc)


def padded_skills(docs: DataFrame, phrases: DataFrame, doc: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lexicon match on ' text ' where +, # and single blanks count."""
    flat = F.regexp_replace(F.lower(text.text_or_empty(F.col(text_col))), "[^a-z0-9+# ]+", " ")
    hits = token_hits(docs, F.split(flat, " "), phrases, doc)
    return skill_lists(docs.select(doc), hits, doc)


def skill_lists(docs: DataFrame, hits: DataFrame, doc: str) -> DataFrame:
    lists = hits.groupBy(doc).agg(F.array_sort(F.collect_set("skill")).alias("skills"))
    return docs.join(lists, doc, "left").withColumn("skills", F.coalesce("skills", F.array().cast("array<string>")))


# ---- entities ----------------------------------------------------------------------------------

def accepted_spans(spans: DataFrame, min_score: float = 0.65) -> DataFrame:
    """Model spans that name a skill with enough confidence: doc, skill, text, start, end, confidence."""
    word = F.trim(F.replace(F.col("word"), F.lit("##"), F.lit("")))
    return (
        spans.filter(F.upper("label").isin("SKILL", "B-SKILL", "I-SKILL") & (F.col("score") >= min_score))
        .select("doc_id", skills.canonical(word).alias("skill"), word.alias("text"), "start", "end",
                F.col("score").alias("confidence"))
        .filter(F.col("skill") != "")
    )


def drop_excluded(hits: DataFrame, dynamic: DataFrame | None = None) -> DataFrame:
    """Excluded terms go, unless they are in the learned lexicon."""
    bad = skills.is_excluded(F.col("skill"))
    if dynamic is None:
        return hits.filter(~bad)
    learned = dynamic.select(F.col("skill").alias("_known")).distinct()
    return hits.join(learned, F.col("skill") == F.col("_known"), "left").filter(~bad | F.col("_known").isNotNull()).drop("_known")


def consolidate(hits: DataFrame, doc: str = "doc_id", mentions: int = 5) -> DataFrame:
    """One entity per document and skill: the first hit of the most trusted pass sets its fields.

    ``hits``: doc, skill, text, start, end, source, confidence, context.
    """
    order = F.create_map(*[F.lit(v) for name, (rank, _) in PASSES.items() for v in (name, rank)])
    ranked = hits.withColumn("_pass", F.coalesce(F.try_element_at(order, F.col("source")), F.lit(9)))
    w = W.partitionBy(doc, "skill").orderBy("_pass", F.asc_nulls_last("start"), F.asc_nulls_last("end"), "text")
    ranked = ranked.withColumn("_rn", F.row_number().over(w))
    first = F.when(F.col("_rn") == 1, F.struct("text", "start", "end", "source", "confidence", "context"))
    mention = F.when(F.col("_rn") <= mentions, F.struct("_rn", "text", "start", "end"))
    merged = ranked.groupBy(doc, "skill").agg(
        F.max(first).alias("f"), F.count("*").alias("mention_count"), F.array_sort(F.collect_list(mention)).alias("m"))
    typed = merged.withColumn("wide", skills.classify(F.col("skill"), F.col("f.text"), F.col("f.context")))
    typed = typed.withColumn("narrow", skills.classify(F.col("skill"), F.col("f.text"), source=F.col("f.source")))
    return typed.select(
        doc, skills.entity_id(F.col("skill")).alias("entity_id"),
        skills.chunk_id(F.col(doc), F.col("skill"), F.col("f.start"), F.col("f.end")).alias("chunk_id"),
        "skill", F.lit("SKILL").alias("label"), F.col("narrow.tier").alias("tier"),
        F.col("wide.skill_type").alias("skill_type"),
        F.struct("wide.technical", "wide.soft", "wide.business", "wide.domain").alias("classification_scores"),
        skills.surface_pattern(F.col("f.text")).alias("pattern"), F.col("f.text").alias("text"),
        F.col("f.start").alias("start"), F.col("f.end").alias("end"), F.col("f.source").alias("source"),
        F.col("f.confidence").alias("confidence"),
        F.transform("m", lambda m: F.struct(m["text"].alias("text"), m["start"].alias("start"), m["end"].alias("end"))).alias("mentions"),
        F.col("mention_count").cast("int").alias("mention_count"), F.lit("machine").alias("label_status"))


def extract_entities(docs: DataFrame, lexicon: DataFrame, dynamic: DataFrame | None = None, spans: DataFrame | None = None,
                     doc: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Phrase hits (and accepted model spans) of every document, consolidated into entities."""
    hits = phrase_hits(docs, lexicon, doc, text_col, with_context=True).withColumn(
        "source", F.lit("phrase_matcher")).withColumn("confidence", F.lit(PASSES["phrase_matcher"][1]))
    if spans is not None:
        hits = hits.unionByName(accepted_spans(spans).withColumnRenamed("doc_id", doc).withColumn(
            "source", F.lit("bert-ner")).withColumn("context", F.lit("")))
    return consolidate(drop_excluded(hits, dynamic), doc)


def mined_phrases(docs: DataFrame, lexicon: DataFrame, doc: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Phrases of two to four words that contain a known skill's words, or else a head term: (doc, skill).

    A phrase has at most 15 word subsets, so the subset test is an equi-join on sorted word sets.
    The longest known phrase wins, ties by name; an exact match is its own longest subset.
    """
    rows = segments(sentences(docs.select(doc, text_col), text_col))
    rows = rows.withColumn("w", F.filter(F.split("segment", " "), lambda t: t != ""))
    grams = F.flatten(F.transform(
        F.sequence(F.lit(1), F.size("w")),
        lambda i: F.filter(F.transform(F.array(F.lit(2), F.lit(3), F.lit(4)), lambda n: F.when(
            i + n - 1 <= F.size("w"), F.slice(F.col("w"), i, n))), lambda g: g.isNotNull())))
    phrases = rows.withColumn("g", F.explode(grams)).select(doc, F.array_join("g", " ").alias("phrase")).distinct()
    tokens = F.array_sort(F.array_distinct(F.split("phrase", " ")))
    phrases = phrases.withColumn("tk", tokens)
    picks = F.sequence(F.lit(1), F.pow(F.lit(2.0), F.size("tk")).cast("int") - 1)
    subsets = F.transform(picks, lambda m: F.array_join(
        F.filter("tk", lambda t, j: F.getbit(m, j) == 1), " "))
    keyed = lexicon.select(
        F.array_join(F.array_sort(F.array_distinct(F.split("phrase", " "))), " ").alias("key"),
        F.col("phrase").alias("known"), F.col("skill").alias("known_skill"))
    candidates = phrases.withColumn("key", F.explode(subsets)).join(keyed, "key", "left")
    exact = F.col("known") == F.col("phrase")
    best = candidates.groupBy(doc, "phrase").agg(F.min_by(
        "known_skill",
        F.when(F.col("known").isNotNull(), F.struct(
            F.when(exact, 0).otherwise(1), -F.length("known"), F.col("known")))).alias("known_skill"))
    headed = F.arrays_overlap(F.split("phrase", " "), skills.literal_array(K.HEAD_TERMS))
    return best.select(doc, F.coalesce("known_skill", F.when(headed, F.col("phrase"))).alias("skill")).filter(
        "skill IS NOT NULL").distinct()


def extract_missing(docs: DataFrame, stored: DataFrame, lexicon: DataFrame, doc: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, skill): stored skills where a document has any, extracted skills elsewhere."""
    todo = docs.join(stored.select(doc).distinct(), doc, "left_anti")
    found = phrase_hits(todo, lexicon, doc, text_col).select(doc, "skill").distinct()
    return stored.select(doc, "skill").distinct().unionByName(found)


def skill_frequency(hits: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Document frequency of every skill."""
    return hits.select(doc, "skill").distinct().groupBy("skill").agg(F.count("*").alias("frequency"))


# ---- offsets and evidence ----------------------------------------------------------------------

def skill_offsets(text_c: Column, skill: Column) -> Column:
    """STRUCT<start, end> (0-based) of the first whole-word occurrence, null when there is none."""
    name = text.squeeze(skill)
    quoted = F.regexp_replace(name, r"([\\.\[\]{}()*+?^$|#&~-])", r"\\$1")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_])"), F.replace(quoted, F.lit(" "), F.lit(text.WS + "+")),
                       F.lit(r"(?![\p{L}\p{N}_])"))
    start = F.regexp_instr(text_c, pattern) - 1
    return F.when((name != "") & (start >= 0), F.struct(
        start.alias("start"), (start + F.length(F.regexp_substr(text_c, pattern))).alias("end")))


def sentence_of(text_c: Column, start: Column) -> Column:
    """Sentence around an offset, at most 500 characters."""
    flat = F.translate(text_c, ".!?", "\n\n\n")
    before = F.length(F.substring_index(F.left(flat, start), "\n", -1))
    after = F.length(F.substring_index(F.substring(flat, start + 1, F.length(flat)), "\n", 1))
    return F.left(F.trim(F.substring(text_c, start - before + 1, before + after)), F.lit(500))


def evidence_window(text_c: Column, start: Column, end: Column, skill: Column, width: int = 360) -> Column:
    """Squeezed text around a span, half the width to each side; the skill is looked up when the span is unknown."""
    at = F.instr(F.lower(text_c), F.lower(skill)) - 1
    known = start.isNotNull() & end.isNotNull()
    lo = F.when(known, start).otherwise(at)
    hi = F.when(known, end).when(at >= 0, at + F.length(skill)).otherwise(0)
    left = F.greatest(F.lit(0), lo - width // 2)
    right = F.least(F.length(text_c), hi + width // 2)
    cut = text.squeeze(F.substring(text_c, left + 1, right - left))
    framed = F.concat(F.when(left > 0, "...").otherwise(""), cut, F.when(right < F.length(text_c), "...").otherwise(""))
    return (
        F.when(F.coalesce(text_c, F.lit("")) == "", "")
        .when((lo < 0) | (hi <= lo), F.left(text.squeeze(text_c), F.lit(width)))
        .otherwise(framed)
    )


def paragraph_context(text_c: Column, start: Column, end: Column, mention: Column, width: int = 900) -> Column:
    """Paragraph around a span; a window when the paragraph is too long; compact text when no span is known."""
    size = F.length(text_c)
    valid = F.coalesce((start >= 0) & (start < end) & (end <= size), F.lit(False))
    at = F.when(F.trim(mention) != "", F.instr(F.lower(text_c), F.lower(F.trim(mention))) - 1).otherwise(-1)
    lo = F.when(valid, start).when(at >= 0, at)
    hi = F.when(valid, end).when(at >= 0, at + F.length(F.trim(mention)))
    before, after = F.left(text_c, lo), F.substring(text_c, hi + 1, size)
    paragraph = text.strip(F.concat(
        F.substring_index(before, "\n\n", -1), F.substring(text_c, lo + 1, hi - lo), F.substring_index(after, "\n\n", 1)))
    left, right = F.greatest(F.lit(0), lo - width // 2), F.least(size, hi + width // 2)
    window = F.concat(F.when(left > 0, "... ").otherwise(""), text.strip(F.substring(text_c, left + 1, right - left)),
                      F.when(right < size, " ...").otherwise(""))
    flat = text.squeeze(text_c)
    compact = F.when(F.length(flat) <= width, flat).otherwise(
        F.concat(F.rtrim(F.left(flat, F.lit(width - 4))), F.lit(" ...")))
    return (
        F.when(text.strip(text_c) == "", "").when(lo.isNull(), compact)
        .when(F.length(paragraph) <= width, paragraph).otherwise(window)
    )


def reclassify(entities: Column) -> Column:
    """Entity array with type and tier recomputed from skill, text and mentions."""
    def again(e):
        skill = text.first_filled(e["skill"], e["text"])
        mentions = F.array_join(F.transform(F.coalesce(e["mentions"], F.array().cast("array<struct<text:string,start:int,end:int>>")),
                                            lambda m: F.coalesce(m["text"], F.lit(""))), " ")
        kind = skills.classify(skill, text.first_filled(e["text"], skill), mentions, e["source"])
        return e.withField("skill_type", kind["skill_type"]).withField("tier", kind["tier"])

    return F.transform(entities, again)


def classes_differ(old: Column, new: Column) -> Column:
    changed = F.zip_with(old, new, lambda a, b: ~(a["skill_type"].eqNullSafe(b["skill_type"]) & a["tier"].eqNullSafe(b["tier"])))
    return F.exists(changed, lambda c: c)
