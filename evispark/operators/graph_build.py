"""Graph construction: candidate checks and grouping, entity resolution, edge dedup, upserts and generation swap.

Order that the studied system takes from lists is carried in an explicit `pos` column; groups are formed by
partially aggregated minima and maxima, and lists that an operator cuts are cut by a window before they are collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import entity_id, identity_key, relationship_id, spaced, strip
from ..schemas import ENTITY_TYPES, ONTOLOGY, RELATIONSHIPS

ALIASES_MOST, QUOTES_MOST = 20, 5


def entity_rejection(kind: str = "entity_type", name: str = "name", confidence: str = "confidence") -> Column:
    """Why an entity candidate is refused, or null."""
    return F.when(~F.coalesce(F.lower(spaced(kind)).isin(ENTITY_TYPES), F.lit(False)), "unknown_entity_type").when(F.coalesce(spaced(name), F.lit("")) == "", "blank_name").when(~F.coalesce(F.col(confidence).between(0, 1), F.lit(False)), "confidence_out_of_range")


def validated_relationships(raw: DataFrame) -> DataFrame:
    """raw(relationship_type, source_type, target_type, source_name, target_name, confidence, usage, quote, text) with reject_reason, quote and quote_warning.

    A quote that the text doesn't hold (any case, any white space) is emptied with a warning; the edge stays.
    """
    kind = F.lower(spaced("relationship_type"))
    source, target = F.lower(spaced("source_type")), F.lower(spaced("target_type"))
    fits = F.lit(False)
    for r, a, b in ONTOLOGY:
        fits = fits | ((kind == r) & (source == a) & (target == b))
    not_in = lambda c, values: ~F.coalesce(c.isin(values), F.lit(False))
    blank = lambda c: F.coalesce(spaced(c), F.lit("")) == ""
    reason = (
        F.when(not_in(kind, RELATIONSHIPS), "unknown_relationship_type")
        .when(not_in(source, ENTITY_TYPES) | not_in(target, ENTITY_TYPES), "unknown_endpoint_type")
        .when(~fits, "ontology_mismatch")
        .when(blank("source_name") | blank("target_name"), "blank_name")
        .when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence_out_of_range")
        .when(kind.isin("uses_method", "evaluated_on") & (F.coalesce(F.col("usage"), F.lit("")) != "used_by_this_paper"), "not_used_by_this_paper")
    )
    found = F.contains(F.lower(spaced("text")), F.lower(spaced("quote")))
    lost = F.col("quote").isNotNull() & ~F.coalesce(found, F.lit(False))
    return raw.withColumn("reject_reason", reason).withColumn("quote_warning", reason.isNull() & lost).withColumn("quote", F.when(~lost, F.col("quote")))


def group_entities(candidates: DataFrame, ascii_only: bool = False) -> DataFrame:
    """candidates(entity_type, name, confidence, chunk_id, quote, pos) by type and identity key: first name, greatest confidence, number of chunks, first quotes.

    Chunks stay rows, of entity_supports(): an entity that a third of all chunks name is no row that holds them.
    """
    rows = candidates.withColumn("key", identity_key("name", ascii_only))
    by = ["entity_type", "key"]
    groups = rows.groupBy(*by).agg(F.min_by("name", "pos").alias("name"), F.max("confidence").alias("confidence"), F.count_distinct("chunk_id").alias("n_chunks"), F.min("pos").alias("pos"))
    nth = F.row_number().over(Window.partitionBy(*by).orderBy("pos", "quote"))
    quotes = rows.where("quote is not null").withColumn("nth", nth).where(F.col("nth") <= QUOTES_MOST).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "quote"))), lambda q: q["quote"]).alias("quotes"))
    out = groups.join(quotes, by, "left").withColumn("quotes", F.coalesce("quotes", F.array().cast("array<string>")))
    return out.withColumn("entity_id", entity_id("entity_type", "key", True))


def entity_supports(candidates: DataFrame, ascii_only: bool = False) -> DataFrame:
    """(entity_type, key, chunk_id): each chunk that names an entity, once."""
    return candidates.select("entity_type", identity_key("name", ascii_only).alias("key"), "chunk_id").where("chunk_id is not null").distinct()


def with_supports(groups: DataFrame, supports: DataFrame, most: int | None = None) -> DataFrame:
    """groups with `chunk_ids`, sorted: what an artifact or a page shows; `most` cuts each list before it is collected."""
    by = ["entity_type", "key"]
    if most is not None:
        supports = supports.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("chunk_id"))).where(F.col("nth") <= most)
    lists = supports.groupBy(*by).agg(F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids"))
    return groups.join(lists, by, "left").withColumn("chunk_ids", F.coalesce("chunk_ids", F.array().cast("array<string>")))


def group_relationships(candidates: DataFrame, entities: DataFrame, ascii_only: bool = False) -> DataFrame:
    """candidates(paper_id, relationship_type, target_type, target_name, confidence, chunk_id) by paper, type and target; `implicit` marks targets without an entity candidate."""
    rows = candidates.withColumn("target_key", identity_key("target_name", ascii_only))
    groups = rows.groupBy("paper_id", "relationship_type", "target_type", "target_key").agg(F.max("confidence").alias("confidence"), F.min("chunk_id").alias("source_chunk_id"), F.array_sort(F.collect_set("chunk_id")).alias("supporting_chunk_ids"))
    known = entities.select(F.col("entity_type").alias("target_type"), F.col("key").alias("target_key"), F.lit(True).alias("known"))
    out = groups.join(known, ["target_type", "target_key"], "left").withColumn("implicit", F.col("known").isNull()).drop("known")
    target = entity_id("target_type", "target_key", True)
    return out.withColumn("target_entity_id", target).withColumn("relationship_id", relationship_id("paper_id", "relationship_type", target))


def resolve_entities(entities: DataFrame, aliases: DataFrame, ascii_only: bool = False) -> DataFrame:
    """entities(entity_id, entity_type, name, ...) with new_id, new_name, tier and the old name as alias where a registered alias retargets it.

    aliases(entity_type, alias_key, canonical_name) is a registry; Spark broadcasts it by its size.
    """
    registry = aliases.select(F.col("entity_type").alias("a_type"), "alias_key", F.col("canonical_name").alias("a_name"))
    met = entities.withColumn("key", identity_key("name", ascii_only)).join(registry, (F.col("entity_type") == F.col("a_type")) & (F.col("key") == F.col("alias_key")) & (F.col("entity_type") != "paper"), "left")
    tier = F.when(F.col("entity_type") == "paper", "paper").when(F.col("a_name").isNotNull(), "explicit_alias").when(F.col("entity_type") == "author", "trusted").otherwise("exact")
    new_name = F.coalesce("a_name", "name")
    new_id = F.when(F.col("a_name").isNull(), F.col("entity_id")).otherwise(entity_id("entity_type", "a_name", ascii_only))
    renamed = F.col("a_name").isNotNull() & (F.col("a_name") != F.col("name"))
    out = met.withColumn("tier", tier).withColumn("new_name", new_name).withColumn("new_id", new_id).withColumn("added_alias", F.when(renamed, F.col("name")))
    return out.drop("a_type", "alias_key", "a_name", "key")


def dedup_entities(resolved: DataFrame) -> DataFrame:
    """resolved(new_id, new_name, added_alias, pos) by id: first name, aliases in first-seen order, at most ALIASES_MOST."""
    names = resolved.groupBy("new_id").agg(F.min_by("new_name", "pos").alias("canonical_name"), F.min("pos").alias("pos"))
    first = resolved.where("added_alias is not null").groupBy("new_id", "added_alias").agg(F.min("pos").alias("at"))
    first = first.withColumn("nth", F.row_number().over(Window.partitionBy("new_id").orderBy("at", "added_alias"))).where(F.col("nth") <= ALIASES_MOST)
    aliases = first.groupBy("new_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "added_alias"))), lambda a: a["added_alias"]).alias("aliases"))
    return names.join(aliases, "new_id", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def remap_edges(edges: DataFrame, remap: DataFrame) -> DataFrame:
    """Endpoints through remap(old_id, new_id), identity where absent; then one edge for each (source, type, target).

    Supporting chunks: the sorted set of supporting and source chunks; the source chunk is the first non-null by pos.
    """
    a = remap.select(F.col("old_id").alias("source_entity_id"), F.col("new_id").alias("new_source"))
    b = remap.select(F.col("old_id").alias("target_entity_id"), F.col("new_id").alias("new_target"))
    rows = edges.join(a, "source_entity_id", "left").join(b, "target_entity_id", "left").select(F.coalesce("new_source", "source_entity_id").alias("source_entity_id"), "relationship_type", F.coalesce("new_target", "target_entity_id").alias("target_entity_id"), "confidence", "source_chunk_id", "supporting_chunk_ids", "pos")
    by = ["source_entity_id", "relationship_type", "target_entity_id"]
    return merged_edges(rows, by).withColumn("relationship_id", relationship_id(*by))


def merged_edges(rows: DataFrame, by: list[str]) -> DataFrame:
    """One edge for each `by`, ids or shorter keys that stand for them: greatest confidence, first source chunk by pos, sorted set of all chunks."""
    chunk = F.explode_outer(F.array_distinct(F.concat(F.coalesce("supporting_chunk_ids", F.array().cast("array<string>")), F.array("source_chunk_id"))))
    each = rows.select(*by, "confidence", "source_chunk_id", "pos", chunk.alias("chunk"))
    return each.groupBy(*by).agg(F.max("confidence").alias("confidence"), F.min_by("source_chunk_id", F.when(F.col("source_chunk_id").isNotNull(), F.col("pos"))).alias("source_chunk_id"), F.array_sort(F.collect_set("chunk")).alias("supporting_chunk_ids"))


def citation_targets(citations: DataFrame, papers: DataFrame) -> DataFrame:
    """citations(source_id, target_paper_id, target_source, target_source_id): known papers as they are, unknown ones as placeholders."""
    known = papers.select(F.col("paper_id").alias("target_paper_id"), "title")
    met = citations.select("target_paper_id", "target_source", "target_source_id").distinct().join(known, "target_paper_id", "left")
    return met.select(F.col("target_paper_id").alias("entity_id"), F.coalesce("title", F.concat_ws(":", "target_source", "target_source_id")).alias("canonical_name"), F.col("title").isNull().alias("is_placeholder"))


def node_properties(kind: Column, source: Column, source_id: Column, published: Column, title: Column) -> Column:
    """Papers alone carry properties: source, source_id, published_at, and a title or a placeholder mark."""
    text = F.create_map(F.lit("source"), source, F.lit("source_id"), source_id, F.lit("published_at"), published, F.lit("title"), title, F.lit("is_placeholder"), F.when(title.isNull(), F.lit("true")))
    return F.when(kind == "paper", F.map_filter(text, lambda _, v: v.isNotNull())).otherwise(F.create_map().cast("map<string,string>"))


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """By (entity_type, entity_id): a match keeps its canonical name, gains new aliases and has its properties overlaid."""
    key = ["entity_type", "entity_id"]
    a = old.select(*key, *[F.col(c).alias(f"o_{c}") for c in ("canonical_name", "aliases", "properties")])
    b = new.select(*key, *[F.col(c).alias(f"n_{c}") for c in ("canonical_name", "aliases", "properties")])
    none, empty = F.array().cast("array<string>"), F.create_map().cast("map<string,string>")
    overlay = F.map_concat(F.map_filter(F.coalesce("o_properties", empty), lambda k, _: ~F.coalesce(F.array_contains(F.map_keys("n_properties"), k), F.lit(False))), F.coalesce("n_properties", empty))
    return a.join(b, key, "full").select(*key, F.coalesce("o_canonical_name", "n_canonical_name").alias("canonical_name"), F.array_distinct(F.concat(F.coalesce("o_aliases", none), F.coalesce("n_aliases", none))).alias("aliases"), overlay.alias("properties"))


def upsert_edges(old: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """new rows (with `pos` as the order of writes) over old ones by (source, type, target, id): the last write owns the edge; edges without both endpoints are left out silently."""
    key = ["source_entity_id", "relationship_type", "target_entity_id", "relationship_id"]
    rest = [c for c in old.columns if c not in key]
    rows = old.withColumn("pos", F.lit(-1).cast("long")).select(*key, *rest, "pos").union(new.select(*key, *rest, F.col("pos").cast("long")))
    return upserted_edges(rows, nodes, key)


def upserted_edges(rows: DataFrame, nodes: DataFrame, key: list[str]) -> DataFrame:
    """What upsert_edges() leaves of stored rows (pos below 0) and writes; source, target and nodes' entity_id are ids or shorter keys that stand for them.

    Writes of one edge have the same endpoints, so the last one alone meets the nodes.
    """
    rest = F.struct(*[c for c in rows.columns if c not in (*key, "pos")])
    last = lambda which: F.max_by(rest, F.when(which, F.col("pos")))
    out = rows.groupBy(*key).agg(last(F.col("pos") < 0).alias("stored"), last(F.col("pos") >= 0).alias("last"))
    ids = nodes.select("entity_id").distinct()
    for end in ("source", "target"):
        there = ids.select(F.col("entity_id").alias(f"{end}_entity_id"), F.lit(True).alias(f"{end}_there"))
        out = out.join(there, f"{end}_entity_id", "left")
    own = F.when(F.col("source_there") & F.col("target_there") & F.col("last").isNotNull(), F.col("last")).otherwise(F.col("stored"))
    return out.withColumn("own", own).where("own is not null").select(*key, "own.*")


def generation_ids(edges: DataFrame, version: str, generation: str) -> DataFrame:
    return edges.where((F.col("paper_version_id") == version) & (F.col("graph_index_generation_fingerprint") == generation)).select("relationship_id")


def swap_generation(edges: DataFrame, current: DataFrame) -> DataFrame:
    """edges without those of a version in current(paper_version_id, generation) whose generation is another; null generations stay."""
    now = current.select("paper_version_id", F.col("generation").alias("current_generation"))
    none = F.col("graph_index_generation_fingerprint").isNull()
    met = edges.where(~none).join(now, "paper_version_id", "left")
    stale = F.coalesce(F.col("graph_index_generation_fingerprint") != F.col("current_generation"), F.lit(False))
    return met.where(~stale).select(*edges.columns).union(edges.where(none))


def verify_generation(written: DataFrame, expected: DataFrame) -> None:
    """Both id sets must be equal before a generation is published."""
    if not (written.exceptAll(expected).isEmpty() and expected.exceptAll(written).isEmpty()):
        raise ValueError("the written edges are not the expected ones")


def schema_violations(nodes: DataFrame) -> DataFrame:
    """(entity_type, entity_id, violation): what a graph store's constraints would refuse: unknown types, missing ids, an id twice in a type."""
    kind = F.when(~F.coalesce(F.col("entity_type").isin(ENTITY_TYPES), F.lit(False)), "unknown_type").when(F.coalesce(strip("entity_id"), F.lit("")) == "", "missing_id").when(F.col("n") > 1, "repeated_id")
    return nodes.groupBy("entity_type", "entity_id").agg(F.count("*").alias("n")).withColumn("violation", kind).where("violation is not null").select("entity_type", "entity_id", "violation")


def edge_rows(edges: DataFrame) -> DataFrame:
    """edges as a graph store holds them: authorship comes from metadata, all else from chunks."""
    kind = F.when(F.col("relationship_type") == "authored_by", "metadata").otherwise("chunk")
    return edges.withColumn("provenance_type", kind).withColumn("supporting_chunk_ids", F.coalesce("supporting_chunk_ids", F.array().cast("array<string>")))


def citation_edges(resolved: DataFrame) -> DataFrame:
    """resolved(paper_id, target_paper_id, ...): one edge row of confidence 1 for each resolved reference; duplicates stay."""
    return resolved.where("target_paper_id is not null").select(F.col("paper_id").alias("source_entity_id"), F.lit("cites").alias("relationship_type"), F.col("target_paper_id").alias("target_entity_id"), F.lit(1.0).alias("confidence"), relationship_id("paper_id", F.lit("cites"), "target_paper_id").alias("relationship_id"))


def author_facts(papers: DataFrame) -> DataFrame:
    """papers(paper_id, authors): one authored_by edge for each author key, first surface form, confidence 1, no chunk."""
    each = papers.select("paper_id", F.posexplode("authors").alias("pos", "name")).withColumn("key", identity_key("name")).where("key <> ''")
    one = each.groupBy("paper_id", "key").agg(F.min_by("name", "pos").alias("name"), F.min("pos").alias("pos"))
    target = entity_id(F.lit("author"), "key", True)
    return one.select("paper_id", "name", "pos", F.lit("authored_by").alias("relationship_type"), target.alias("target_entity_id"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("source_chunk_id"), relationship_id("paper_id", F.lit("authored_by"), target).alias("relationship_id"))


#: Sections whose text is asked for knowledge.
EXTRACTED_SECTIONS = ["abstract", "introduction", "methodology", "experiments", "results", "discussion", "conclusion", "other"]


def extractable(sections: DataFrame) -> DataFrame:
    return sections.where(F.col("section_type").isin(EXTRACTED_SECTIONS))
