"""Review of skill entities and upkeep of aliases, as batch merges on flat entity rows.

An entity row is (owner, pos, entity_id, chunk_id, skill, label, tier, skill_type, source, confidence,
mention_count, text, label_status); ``pos`` only orders the entities of an owner. Rows stay flat so that
an owner with very many entities is no hot group; ``collect_entities`` nests them for a document store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skillgrid.functions import constants as K
from skillgrid.functions import skills, text

ENTITY = ("entity_id", "chunk_id", "skill", "label", "tier", "skill_type", "source", "confidence",
          "mention_count", "text", "label_status")
APPENDED = 1_000_000_000  # appended entities sort behind all stored positions


def collect_entities(rows: DataFrame, owner: str, mentions: bool = True) -> DataFrame:
    """One ordered entity array per owner."""
    fields = [F.col(c) for c in ("pos", *ENTITY)]
    if mentions:
        own = F.struct(F.col("text"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
        fields.append(F.array(own).alias("mentions"))
    return rows.groupBy(owner).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("entities"))


def is_active() -> Column:
    excluded = F.col("label").eqNullSafe("exclude") | F.col("skill_type").eqNullSafe("exclude")
    return ~F.col("label_status").eqNullSafe("candidate") & ~excluded


def active_skills(rows: DataFrame, owner: str) -> DataFrame:
    """Sorted distinct skills of the entities that count, per owner."""
    return rows.filter(is_active() & (F.col("skill") != "")).groupBy(owner).agg(
        F.array_sort(F.collect_set("skill")).alias("skills"))


def _new_rows(names: DataFrame, owner: str, chunk: Column, pos: Column, source: Column, status: str,
              confidence: Column, tier: Column | None = None) -> DataFrame:
    k = names.withColumn("_k", skills.classify(F.col("skill"), F.col("skill")))
    return k.select(
        owner, pos.cast("bigint").alias("pos"), skills.entity_id(F.col("skill")).alias("entity_id"), chunk.alias("chunk_id"),
        "skill", F.lit("SKILL").alias("label"), (F.col("_k.tier") if tier is None else tier).alias("tier"),
        F.col("_k.skill_type").alias("skill_type"), source.alias("source"), confidence.cast("double").alias("confidence"),
        F.lit(1).alias("mention_count"), F.col("skill").alias("text"), F.lit(status).alias("label_status"))


def _core(rows: DataFrame, owner: str) -> DataFrame:
    return rows.select(owner, F.col("pos").cast("bigint").alias("pos"), *ENTITY)


def hydrate(rows: DataFrame, listed: DataFrame, owner: str, source_type: str) -> DataFrame:
    """Adds a legacy entity for every listed skill (owner, pos, skill) that no entity covers."""
    name = skills.canonical(F.col("skill"))
    have = rows.select(owner, name.alias("_c")).distinct()
    first = listed.withColumn("_c", name).filter("_c <> ''").groupBy(owner, "_c").agg(
        F.min("pos").alias("pos"), F.min_by("skill", "pos").alias("skill"))
    todo = first.join(have, [owner, "_c"], "left_anti")
    chunk = F.concat(F.lit(source_type + "-"), F.col(owner).cast("string"), F.lit("-"), skills.entity_id(F.col("skill")))
    new = _new_rows(todo, owner, chunk, F.col("pos") + APPENDED, F.lit("legacy"), "legacy", F.lit(None))
    return _core(rows, owner).unionByName(new)


def match_targets(rows: DataFrame, requests: DataFrame, owner: str) -> DataFrame:
    """First entity of the owner whose chunk id or entity id is asked for: (request_id, owner, pos)."""
    ids = rows.select(owner, "pos", "chunk_id", "entity_id")
    by_chunk = requests.select("request_id", owner, "chunk_id").join(ids.drop("entity_id"), [owner, "chunk_id"])
    by_id = requests.select("request_id", owner, "entity_id").join(ids.drop("chunk_id"), [owner, "entity_id"])
    hits = by_chunk.select("request_id", owner, "pos").unionByName(by_id.select("request_id", owner, "pos"))
    return hits.groupBy("request_id", owner).agg(F.min("pos").alias("pos"))


def apply_edits(rows: DataFrame, edits: DataFrame, owner: str) -> DataFrame:
    """Reviewed edits: blank values are ignored, the entity becomes reviewed; the last edit of an entity wins.

    ``edits``: request_id, owner, entity_id, chunk_id and the new skill, label, tier, skill_type, text, source.
    """
    given = {
        "skill": F.trim("skill"),
        "label": text.first_filled(F.trim("label"), F.lit("SKILL")),
        "tier": text.first_filled(F.trim("tier"), F.lit("reviewed")),
        "skill_type": text.first_filled(F.trim("skill_type"), F.lit("domain")),
        "text": F.trim("text"),
        "source": F.trim("source"),
    }
    target = match_targets(rows, edits, owner)
    values = edits.select("request_id", *[v.alias("_" + k) for k, v in given.items()])
    last = target.join(values, "request_id").groupBy(owner, "pos").agg(
        F.max_by(F.struct(*["_" + k for k in given]), "request_id").alias("e"))
    merged = _core(rows, owner).join(last, [owner, "pos"], "left")
    for k in given:
        merged = merged.withColumn(k, F.coalesce(text.blank_to_null(F.col("e._" + k)), F.col(k)))
    merged = merged.withColumn("label_status", F.when(F.col("e").isNotNull(), "reviewed").otherwise(F.col("label_status")))
    return merged.drop("e")


def add_entities(rows: DataFrame, additions: DataFrame, owner: str, source_type: str) -> DataFrame:
    """Manual entities with a chunk id of their own: -2, -3 ... is appended while the id is taken.

    ``additions``: request_id, owner, skill. The n requests of one base id get the n smallest free numbers.
    """
    entity = skills.entity_id(F.col("skill"))
    base = F.concat(F.lit(source_type + "-"), F.col(owner).cast("string"), F.lit("-manual-"), entity)
    asked = additions.withColumn("skill", F.trim("skill")).filter("skill <> ''").withColumn("_base", base)
    asked = asked.withColumn("_n", F.row_number().over(W.partitionBy(owner, "_base").orderBy("request_id")))
    stem = F.regexp_extract("chunk_id", r"^(.*?)(-(\d+))?$", 1)
    number = F.coalesce(F.regexp_extract("chunk_id", r"-(\d+)$", 1).try_cast("int"), F.lit(1))
    stored = rows.select(owner, "chunk_id").distinct()
    taken = stored.select(owner, stem.alias("_base"), number.alias("_free")).unionByName(
        stored.select(owner, F.col("chunk_id").alias("_base"), F.lit(1).alias("_free"))).distinct()
    size = asked.groupBy(owner, "_base").agg(F.count("*").alias("asked"))
    used = taken.groupBy(owner, "_base").agg(F.count("*").alias("used"))
    room = size.join(used, [owner, "_base"], "left").withColumn("_free", F.explode(
        F.sequence(F.lit(1), (F.col("asked") + F.coalesce("used", F.lit(0))).cast("int"))))
    free = room.join(taken, [owner, "_base", "_free"], "left_anti").withColumn(
        "_n", F.row_number().over(W.partitionBy(owner, "_base").orderBy("_free"))).select(owner, "_base", "_free", "_n")
    numbered = asked.join(free, [owner, "_base", "_n"])
    chunk = F.when(F.col("_free") == 1, F.col("_base")).otherwise(F.concat_ws("-", "_base", F.col("_free").cast("string")))
    new = _new_rows(numbered, owner, chunk, F.col("request_id") + 2 * APPENDED, F.lit("human"), "reviewed", F.lit(None), F.lit("reviewed"))
    return _core(rows, owner).unionByName(new)


def remove_entities(rows: DataFrame, requests: DataFrame, owner: str) -> DataFrame:
    """Drops every entity whose chunk id or entity id is asked for."""
    kept = rows.join(requests.select(owner, "chunk_id").distinct(), [owner, "chunk_id"], "left_anti")
    return kept.join(requests.select(owner, "entity_id").distinct(), [owner, "entity_id"], "left_anti").select(rows.columns)


def is_approvable() -> Column:
    excluded = F.col("label").eqNullSafe("exclude") | F.col("skill_type").eqNullSafe("exclude")
    return (F.col("label_status") == "candidate") & ~excluded


def approve_candidates(rows: DataFrame) -> DataFrame:
    hit = is_approvable()
    return (
        rows.withColumn("tier", F.when(hit & (F.coalesce("tier", F.lit("candidate")) == "candidate"), "reviewed").otherwise(F.col("tier")))
        .withColumn("label", F.when(hit, text.first_filled(F.col("label"), F.lit("SKILL"))).otherwise(F.col("label")))
        .withColumn("label_status", F.when(hit, "reviewed").otherwise(F.col("label_status")))
    )


def approval_counts(rows: DataFrame, owner: str) -> DataFrame:
    """Approved entities and touched documents; documents are counted from per-owner partial counts."""
    per = rows.filter(is_approvable()).groupBy(owner).agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("approved"), F.count("*").alias("documents"))


# ---- aliases -----------------------------------------------------------------------------------

def is_alias_pair(skill: Column, alias: Column) -> Column:
    a, b = skills.canonical(skill), skills.canonical(alias)
    return (a != "") & (b != "") & (a != b) & (F.length(b) >= 2) & ~b.isin(*K.EXCLUDED_TERMS)


def alias_evidence(rows: DataFrame) -> DataFrame:
    """Canonical (canonical_skill, alias) of rows that may become an alias; other columns stay."""
    return rows.filter(is_alias_pair(F.col("skill"), F.col("text"))).withColumn(
        "canonical_skill", skills.canonical(F.col("skill"))).withColumn("alias", skills.canonical(F.col("text")))


def upsert_aliases(stored: DataFrame, evidence: DataFrame, source: str = "evidence", status: str = "candidate",
                   increment: bool = True) -> DataFrame:
    """Stored aliases merged with new evidence (canonical_skill, alias, confidence, doc_id, seq).

    Counts add up, the larger confidence stays, the first text and document stay, an approval beats any other
    status and a rejection never beats an approval. Evidence is grouped per pair before the join, so a pair
    seen in a third of all documents is summed on the map side first.
    """
    new = evidence.groupBy("canonical_skill", "alias").agg(
        F.count("*").alias("seen"), F.max(F.coalesce("confidence", F.lit(0.0))).alias("new_confidence"),
        F.min_by("doc_id", "seq").alias("new_doc"))
    m = stored.join(new, ["canonical_skill", "alias"], "full")
    fresh, hit = F.col("status").isNull(), F.col("seen").isNotNull()
    seen = F.col("seen") if increment else F.lit(0)
    if status == "approved":
        changed = hit & (F.col("status") != "approved")
    elif status == "rejected":
        changed = hit & ~F.col("status").isin("approved", "rejected")
    else:
        changed = F.lit(False)
    return m.select(
        "canonical_skill", "alias",
        F.when(fresh, status).when(changed, status).otherwise(F.col("status")).alias("status"),
        F.when(fresh, source).when(changed & F.lit(status == "approved"), source).otherwise(F.col("source")).alias("source"),
        F.greatest(F.coalesce("confidence", F.lit(0.0)), F.coalesce("new_confidence", F.lit(0.0))).alias("confidence"),
        F.when(fresh, F.col("seen") if increment else F.lit(1)).when(hit, F.greatest(F.lit(1), F.col("evidence_count") + seen))
        .otherwise(F.col("evidence_count")).alias("evidence_count"),
        F.when(fresh, F.col("new_doc")).otherwise(text.first_filled(F.col("first_doc"), F.col("new_doc"))).alias("first_doc"))


def alias_candidates(rows: DataFrame, stored: DataFrame, limit: int | None = None) -> DataFrame:
    """Pairs seen in active evidence that are not stored yet; with ``limit`` the first in evidence order (``seq``)."""
    active = rows.filter(is_active())
    pairs = alias_evidence(active).groupBy("canonical_skill", "alias").agg(
        F.min("seq").alias("seq"), F.max(F.coalesce("confidence", F.lit(0.0))).alias("confidence"))
    new = pairs.join(stored.select("canonical_skill", "alias"), ["canonical_skill", "alias"], "left_anti")
    return new.orderBy("seq", "canonical_skill", "alias").limit(limit) if limit else new


def review_aliases(stored: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions (canonical_skill, alias, decision, new_skill, new_alias) on stored aliases.

    An approved alias may be renamed; when that meets another row, the two become one approved row with the
    larger evidence plus one.
    """
    d = decisions.select("canonical_skill", "alias", "decision", F.col("new_skill"), F.col("new_alias"))
    m = stored.join(d, ["canonical_skill", "alias"], "left")
    ok, no = F.col("decision") == "approve", F.col("decision") == "reject"
    renamed = m.select(
        F.when(ok, text.first_filled(skills.canonical(F.col("new_skill")), F.col("canonical_skill"))).otherwise(F.col("canonical_skill")).alias("canonical_skill"),
        F.when(ok, text.first_filled(skills.canonical(F.col("new_alias")), F.col("alias"))).otherwise(F.col("alias")).alias("alias"),
        F.when(ok, "approved").when(no, "rejected").otherwise(F.col("status")).alias("status"),
        F.when(ok, "human_review").otherwise(F.col("source")).alias("source"),
        "confidence", "evidence_count", F.coalesce(ok, F.lit(False)).alias("reviewed"))
    g = renamed.groupBy("canonical_skill", "alias").agg(
        F.count("*").alias("rows"), F.max("reviewed").alias("reviewed"),
        F.max_by(F.struct("status", "source"), F.struct("reviewed", "status", "source")).alias("s"),
        F.max("confidence").alias("confidence"), F.max("evidence_count").alias("evidence_count"))
    merged = (F.col("rows") > 1) & F.col("reviewed")
    return g.select("canonical_skill", "alias", "s.status", "s.source", "confidence",
                    F.when(merged, F.col("evidence_count") + 1).otherwise(F.col("evidence_count")).alias("evidence_count"))


def alias_counts(stored: DataFrame) -> DataFrame:
    is_ = F.col("status")
    return stored.agg(*[F.count_if(is_ == s).alias(s) for s in ("candidate", "approved", "rejected")], F.count("*").alias("total"))


def alias_queue(stored: DataFrame, status: str = "candidate", limit: int = 40) -> DataFrame:
    return stored.filter(F.col("status") == status).orderBy(F.desc("evidence_count"), "canonical_skill", "alias").limit(limit)


# ---- module skills -----------------------------------------------------------------------------

def enhance_skills(rows: DataFrame, requests: DataFrame, owner: str, source_type: str = "module") -> DataFrame:
    """Typed skills (owner, typed): known ones become reviewed, new ones are added with full confidence."""
    wanted = requests.select(owner, F.posexplode(text.typed_list(F.col("typed"), skills.canonical)).alias("i", "skill"))
    wanted = wanted.groupBy(owner, "skill").agg(F.min("i").alias("i"))
    known = rows.withColumn("_c", skills.canonical(F.col("skill"))).filter("_c <> ''")
    # one entity per name: the last stored one stays
    last = known.groupBy(owner, "_c").agg(F.max_by(F.struct("pos", *ENTITY), "pos").alias("e")).select(owner, "_c", "e.*")
    marked = last.join(wanted.select(owner, F.col("skill").alias("_c"), F.lit(True).alias("_w")), [owner, "_c"], "left")
    marked = marked.withColumn("label_status", F.when(F.col("_w"), "reviewed").otherwise(F.col("label_status")))
    todo = wanted.join(last.select(owner, F.col("_c").alias("skill")), [owner, "skill"], "left_anti")
    chunk = skills.chunk_id(F.concat(F.lit(source_type + "-"), F.col(owner).cast("string")), F.col("skill"), F.lit(None), F.lit(None))
    new = _new_rows(todo, owner, chunk, F.col("i") + APPENDED, F.lit("manual_enhancement"), "reviewed", F.lit(1.0))
    return _core(marked, owner).unionByName(new)


def remove_skill(rows: DataFrame, requests: DataFrame, owner: str) -> DataFrame:
    """Drops all entities whose canonical name is asked for: (owner, skill)."""
    gone = requests.select(owner, skills.canonical(F.col("skill")).alias("_c")).filter("_c <> ''").distinct()
    name = skills.canonical(text.first_filled(F.col("skill"), F.col("text")))
    return rows.withColumn("_c", name).join(gone, [owner, "_c"], "left_anti").drop("_c")


def save_candidates(rows: DataFrame, suggestions: DataFrame, owner: str, source_type: str) -> DataFrame:
    """Suggested skills (owner, skill) that no entity has yet, as candidates of confidence 0.55."""
    have = rows.select(owner, skills.canonical_loose(text.first_filled(F.col("skill"), F.col("text"))).alias("skill")).distinct()
    new = suggestions.select(owner, skills.canonical_loose(F.col("skill")).alias("skill")).filter("skill <> ''").distinct()
    new = new.join(have, [owner, "skill"], "left_anti")
    chunk = F.concat(F.lit(source_type + "-"), F.col(owner).cast("string"), F.lit("-candidate-"), skills.entity_id(F.col("skill")))
    order = F.lit(3 * APPENDED)
    return _new_rows(new, owner, chunk, order, F.lit("model_verification"), "candidate", F.lit(0.55), F.lit("candidate"))


def import_entity(skill: Column, mention: Column, given_id: Column, source: Column, default_source: str = "notebook-import") -> Column:
    """STRUCT<skill, entity_id, source> of an imported entity; null when it names no skill."""
    name = skills.canonical(text.first_filled(skill, mention))
    return F.when(name != "", F.struct(
        name.alias("skill"),
        F.coalesce(given_id, skills.entity_id(name)).alias("entity_id"),
        F.coalesce(source, F.lit(default_source)).alias("source")))
