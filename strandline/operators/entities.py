"""Entities, relationships, chunks and memories: filters, lookups and the upsert fold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fields, sqlite_like


def check_limit(limit: int) -> int:
    if limit < 0:
        raise ValueError("limit must not be negative")
    return limit


def find_entities(entities: DataFrame, type: str | None = None, name_like: str | None = None, source: str | None = None) -> DataFrame:
    """Entities that satisfy all given predicates; all of them if none is given."""
    tests = []
    if type:
        tests.append(F.col("type") == type)
    if name_like:
        tests.append(sqlite_like(F.col("name"), name_like))
    if source:
        tests.append(F.col("source") == source)
    return entities.where(reduce(lambda a, b: a & b, tests)) if tests else entities


def get_entity(entities: DataFrame, id: str) -> DataFrame:
    return entities.where(F.col("id") == id)


def upsert_entities(log: DataFrame, seq: str = "seq") -> DataFrame:
    """Latest state per (name, type): first id and created_at, last attributes and source."""
    return log.groupBy("name", "type").agg(
        F.min_by("id", seq).alias("id"),
        F.max_by("attributes", seq).alias("attributes"),
        F.max_by("source", seq).alias("source"),
        F.min("created_at").alias("created_at"),
        F.max("updated_at").alias("updated_at"),
    )


def relationships_of(relationships: DataFrame, ids: DataFrame | str, types: list[str] | None = None) -> DataFrame:
    """Relationships with either end in ``ids`` (one id, or a DataFrame with column ``id``).

    In bulk, one row per (``entity_id``, relationship): both ends are exploded and joined."""
    rel = relationships.where(F.col("type").isin(types)) if types else relationships
    if isinstance(ids, str):
        return rel.where((F.col("source_id") == ids) | (F.col("target_id") == ids))
    ends = rel.withColumn("entity_id", F.explode(F.array_distinct(F.array("source_id", "target_id"))))
    return ends.join(ids.select(F.col("id").alias("entity_id")).distinct(), "entity_id", "left_semi")


def dangling_relationships(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """Relationships with an end that is no entity.  They are read once: their ends, not the relationships, are two rows each."""
    ends = relationships.withColumn("_end", F.explode(F.array_distinct(F.array("source_id", "target_id"))))
    ids = entities.select(F.col("id").alias("_end"))
    return ends.join(ids, "_end", "left_anti").select(*relationships.columns).dropDuplicates(["id"])


def with_links(memories: DataFrame, links: DataFrame) -> DataFrame:
    """Memories with ``entity_ids``, sorted; empty if there are none."""
    lists = links.groupBy("memory_id").agg(F.sort_array(F.collect_list("entity_id")).alias("entity_ids"))
    joined = memories.join(lists, memories["id"] == lists["memory_id"], "left").drop("memory_id")
    return joined.withColumn("entity_ids", F.coalesce("entity_ids", F.array().cast("array<string>")))


def memories_by_entity(memories: DataFrame, links: DataFrame, entity_id: str) -> DataFrame:
    hits = links.where(F.col("entity_id") == entity_id).select("memory_id").distinct()
    found = memories.join(hits, memories["id"] == hits["memory_id"], "left_semi")
    return with_links(found, links.join(hits, "memory_id", "left_semi"))


def search_memories(memories: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Memories with any word of ``query`` as a substring (LIKE), oldest first."""
    words = fields(query)
    check_limit(limit)
    if not words:
        return memories.limit(0)
    hit = reduce(lambda a, b: a | b, [sqlite_like(F.col("content"), f"%{w}%") for w in words])
    return memories.where(hit).orderBy("created_at", "id").limit(limit)
