"""Column functions for skill names: canonical form, identity, class, sector."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skillgrid.functions import constants as K
from skillgrid.functions.text import let, squeeze, text_or_empty


def literal_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def canonical(c: Column) -> Column:
    return squeeze(F.translate(F.lower(text_or_empty(c)), "-", " "))


def canonical_loose(c: Column) -> Column:
    """Also treats underscores as blanks."""
    return squeeze(F.translate(F.lower(text_or_empty(c)), "-_", "  "))


def entity_id(c: Column) -> Column:
    def slugged(name):
        slug = F.regexp_replace(F.regexp_replace(name, r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
        return F.struct(name.alias("name"), slug.alias("slug"), F.left(F.sha1(name.cast("binary")), F.lit(8)).alias("sha"))

    def named(p):
        return (
            F.when(p["slug"] == "", F.concat(F.lit("skill-"), p["sha"]))
            .when(p["slug"] != F.replace(p["name"], F.lit(" "), F.lit("-")),
                  F.concat(F.lit("skill-"), F.left(p["slug"], F.lit(63)), F.lit("-"), p["sha"]))
            .otherwise(F.concat(F.lit("skill-"), F.left(p["slug"], F.lit(72))))
        )

    return let(let(canonical(c), slugged), named)


def chunk_id(document: Column, skill: Column, start: Column, end: Column) -> Column:
    place = [F.coalesce(c.cast("string"), F.lit("None")) for c in (start, end)]
    raw = F.concat_ws("|", document.cast("string"), skill, *place)
    return F.concat(F.lit("chunk-"), F.left(F.sha1(raw.cast("binary")), F.lit(16)))


def surface_pattern(c: Column) -> Column:
    tokens = F.filter(F.split(squeeze(c), " "), lambda t: t != "")
    shape = F.transform(tokens, lambda t: F.when(t.rlike(r"^\p{L}+$"), "WORD").otherwise("TOKEN"))
    return F.array_join(shape, " ")


def token_set(*parts: Column) -> Column:
    joined = F.concat_ws(" ", *[canonical(p) for p in parts])
    return F.array_distinct(F.filter(F.split(joined, " "), lambda t: t != ""))


def _overlap(tokens: Column, vocabulary) -> Column:
    return F.size(F.array_intersect(tokens, literal_array(vocabulary)))


def _points(condition: Column, points: int) -> Column:
    return F.when(condition, points).otherwise(0)


def classify(skill: Column, mention: Column | None = None, context: Column | None = None,
             source: Column | None = None) -> Column:
    """STRUCT<skill_type, tier, technical, soft, business, domain> of a skill name and its evidence."""
    empty = F.lit("")
    tokens = token_set(skill, empty if mention is None else mention, empty if context is None else context)
    mined = F.lit(False) if source is None else source.eqNullSafe("noun_chunk")

    def scored(e):
        tk, phrase = e["tokens"], e["phrase"]

        def has(*terms):
            return F.arrays_overlap(tk, literal_array(terms))

        signs = phrase.rlike("[#+]")
        led = phrase.rlike("(project|stakeholder|change) management")
        technical = _overlap(tk, K.TECHNICAL_TERMS) + _points(has("data", "software", "technical"), 2) + _points(signs, 2)
        soft = (
            _overlap(tk, K.SOFT_TERMS) + _points(phrase.rlike("problem solving|critical thinking"), 3) + _points(led, 1)
            + _points(has("leadership", "communication", "teamwork"), 3)
        )
        business = _overlap(tk, K.BUSINESS_TERMS) + _points(led, 2)
        return F.struct(
            technical.alias("technical"), soft.alias("soft"), business.alias("business"),
            has("management").alias("managed"), (has(*K.TOOL_TERMS) | signs).alias("tool"),
            has(*K.METHOD_TERMS).alias("method"), (F.size(tk) >= 4).alias("long"))

    def ranked(s):
        business = s["business"] + _points(s["managed"] & (s["technical"] == 0), 1)
        best = F.greatest(s["technical"], s["soft"], business)
        kind = (
            F.when(best == 0, "domain").when(s["technical"] == best, "technical")
            .when(s["soft"] == best, "soft").otherwise("business")
        )
        return F.struct(s.alias("s"), business.alias("business"), kind.alias("kind"))

    def shaped(r):
        s = r["s"]
        tier = (
            F.when(s["tool"], "tool").when(s["method"], "method").when(r["kind"] == "soft", "transferable")
            .when(mined, "candidate").when(s["long"], "specialized").otherwise("capability")
        )
        return F.struct(
            r["kind"].alias("skill_type"), tier.alias("tier"), s["technical"].alias("technical"),
            s["soft"].alias("soft"), r["business"].alias("business"), F.lit(0).alias("domain"))

    evidence = F.struct(tokens.alias("tokens"), canonical(skill).alias("phrase"))
    return let(let(let(evidence, scored), ranked), shaped)


def is_excluded(c: Column) -> Column:
    return canonical(c).isin(*K.EXCLUDED_TERMS)


def refined_label(c: Column) -> Column:
    """Business label of a skill; null when the skill is purely technical."""
    key = F.lower(F.trim(c))
    labels = F.create_map(*[F.lit(v) for pair in K.REFINE_LABELS.items() for v in pair])
    return F.when(~key.isin(*K.REFINE_DROP), F.coalesce(F.try_element_at(labels, key), c))


def clean_sector(c: Column) -> Column:
    name = squeeze(c)
    return F.when(F.lower(name).isin(*K.MISSING_SECTORS), "").otherwise(name)


def infer_sector(*parts: Column, whole_words: bool = False) -> Column:
    """Sector with most keywords inside the joined text ('' when none); ties go to the larger name."""
    table = F.array(*[
        F.struct(F.lit(sector).alias("sector"), literal_array(words).alias("words"))
        for sector, words in K.SECTOR_KEYWORDS.items()
    ])

    def hit(text, word):
        if whole_words:
            return F.regexp_like(text, F.concat(F.lit(r"\b"), word, F.lit(r"\b")))
        return text.contains(word)

    def rank(text):
        return F.array_max(F.transform(table, lambda row: F.struct(
            F.size(F.filter(row["words"], lambda w: hit(text, w))).alias("score"), row["sector"].alias("sector"))))

    text = F.lower(F.concat_ws(" ", *[text_or_empty(p) for p in parts]))
    return let(let(text, rank), lambda best: F.when(best["score"] > 0, best["sector"]).otherwise(""))


def skill_tokens(c: Column) -> Column:
    """Letters, digits, + and # kept; stop words removed; repeats kept."""
    flat = F.lower(F.regexp_replace(text_or_empty(c), r"[^\p{L}\p{N}+#]", " "))
    return F.filter(F.split(flat, " +"), lambda t: (t != "") & ~t.isin(*K.SKILL_STOP_WORDS))


def retrieval_tokens(c: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit("([a-z0-9+#]+)"), F.lit(1))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*K.RETRIEVAL_STOP_WORDS))
