"""Own vector and span functions put through the extension points. The two functions here are simple ones that SQL can say too."""

from __future__ import annotations

import re
import string

import numpy as np
from pyspark.sql import functions as F

from skillgrid.functions import constants as K
from skillgrid.functions import scores
from skillgrid.operators import extract, pairs, plugins
from skillgrid.plans import binding as B
from skillgrid.plans.registry import query
from skillgrid.plans.score_queries import SEMANTIC_SQL, chunk_sql

LETTERS = string.ascii_lowercase
LETTERS_SQL = "list_transform(string_split('" + " ".join(LETTERS) + "', ' '), lambda l: (length({c}) - length(replace({c}, l, '')))::DOUBLE)"


def letter_counts():
    """Vectors of the counts of the small letters."""
    return lambda texts: np.array([[text.count(letter) for letter in LETTERS] for text in texts], dtype="float64").reshape(len(texts), len(LETTERS))


def long_words():
    """Spans of words of at least six small letters between blanks and line ends; longer ones score higher."""
    word = re.compile(r"(?:(?<=[ \n])|\A)[a-z]{6,}(?=[ \n]|\Z)")
    return lambda texts: [[(m.group(), "SKILL", min(1.0, len(m.group()) / 10), m.start(), m.end()) for m in word.finditer(text)] for text in texts]


@query("E8_plugged_vectors", f"""
    WITH ch AS ({chunk_sql(3500, '')}), lv AS (SELECT doc_id, {LETTERS_SQL.format(c='chunk')} AS v FROM ch WHERE chunk <> ''),
    un AS (SELECT doc_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM lv),
    mean AS (SELECT doc_id, list(x ORDER BY i) AS vector FROM (SELECT doc_id, i, avg(x) AS x FROM un GROUP BY 1, 2) GROUP BY 1),
    jobs AS (SELECT d.doc_id AS job_id, coalesce(vector, list_transform(range({len(LETTERS)}), lambda x: 0.0::DOUBLE)) AS vector FROM documents d LEFT JOIN mean USING (doc_id)),
    mods AS (SELECT course_id, module_id, {LETTERS_SQL.format(c='content')} AS vector FROM m_module),
    {SEMANTIC_SQL.format(mods='mods', jobs='jobs')}
    SELECT course_id, job_id, {B.sql_round('semantic_score', 6)} AS semantic_score FROM sem""", ("m_module",))
def plugged_vectors(t):
    """Documents against all courses, with vectors of an own function on both sides."""
    mods = plugins.embedded(t.modules, ["course_id", "module_id"], letter_counts, len(LETTERS), "content")
    jobs = plugins.embedded(t.documents, ["doc_id"], letter_counts, len(LETTERS)).withColumnRenamed("doc_id", "job_id")
    return pairs.semantic_scores(mods, jobs).withColumn("semantic_score", scores.half_up(F.col("semantic_score"), 6))


@query("D6_plugged_spans", f"""
    WITH p AS (SELECT doc_id, unnest(ps) AS token, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, string_split_regex(text, '[ \n]') AS ps FROM documents)),
    o AS (SELECT doc_id, token, sum(length(token) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(token) - 1 AS a FROM p),
    h AS (SELECT doc_id, {B.sql_canonical('token')} AS skill, token AS text, CAST(a AS INT) AS "start", CAST(a + length(token) AS INT) AS "end",
      least(1.0::DOUBLE, length(token)::DOUBLE / 10.0::DOUBLE) AS confidence FROM o WHERE regexp_full_match(token, '[a-z]{{6,}}')),
    r AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY doc_id, skill) AS n FROM h
      WHERE confidence >= 0.65 AND NOT list_contains({B._in(K.EXCLUDED_TERMS)}, skill) WINDOW w AS (PARTITION BY doc_id, skill ORDER BY "start", "end", text))
    SELECT doc_id, skill, {B.sql_entity_id('skill')} AS entity_id, text, "start", "end", confidence, CAST(n AS INT) AS mention_count FROM r WHERE rn = 1""")
def plugged_spans(t):
    """Entities of the documents from the spans of an own function alone."""
    docs = t.documents.select("doc_id", "text")
    found = extract.extract_entities(docs, t.lexicon.where("false"), spans=plugins.spans(docs, long_words))
    return found.select("doc_id", "skill", "entity_id", "text", "start", "end", "confidence", "mention_count")
