"""Cascading deletes, set-based: each returns what is left of every relation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Relations = dict[str, DataFrame]
RELATIONS = ("entities", "relationships", "chunks", "memories", "memory_entities", "embeddings")


def _without(df: DataFrame, column: str, doomed: DataFrame) -> DataFrame:
    keys = doomed.select(F.col(doomed.columns[0]).alias("_gone"))
    return df.join(keys, F.col(column) == F.col("_gone"), "left_anti")


def orphan_memories(memories: DataFrame, links: DataFrame) -> DataFrame:
    """Memories without any link, whether they ever had one or not."""
    return memories.join(links, memories["id"] == links["memory_id"], "left_anti")


def _cascade(r: Relations, doomed: DataFrame, strict_source: str | None = None) -> Relations:
    """``doomed``: the ids of the entities to forget."""
    out = dict(r)
    chunks = r["chunks"].join(doomed.select(F.col("id").alias("_gone")), F.col("entity_id") == F.col("_gone"), "left_semi").select("id")
    if strict_source is not None:
        chunks = chunks.union(r["chunks"].where(F.get_json_object("metadata", "$.source") == strict_source).select("id"))
    links = _without(r["memory_entities"], "entity_id", doomed)
    memories = r["memories"]
    if strict_source is not None:
        memories = memories.where(~F.col("source").eqNullSafe(strict_source))
        links = links.join(memories.select(F.col("id").alias("memory_id")), "memory_id", "left_semi")
    orphans = orphan_memories(memories, links).select("id")
    dead = chunks.select("id", F.lit("chunk").alias("t")).union(r["memories"].join(memories.join(orphans, "id", "left_anti").select("id"), "id", "left_anti").select("id", F.lit("memory").alias("t")))
    out["embeddings"] = r["embeddings"].join(dead.withColumnRenamed("id", "_i"), (F.col("ref_id") == F.col("_i")) & (F.col("ref_type") == F.col("t")), "left_anti")
    out["chunks"] = _without(r["chunks"], "id", chunks)
    out["memory_entities"] = links
    out["memories"] = memories.join(orphans, "id", "left_anti")
    rel = _without(_without(r["relationships"], "source_id", doomed), "target_id", doomed)
    out["relationships"] = rel.where(~F.col("source").eqNullSafe(strict_source)) if strict_source is not None else rel
    out["entities"] = r["entities"].join(doomed.select("id"), "id", "left_anti")
    return out


def forget_entity(r: Relations, entity_id: str) -> Relations:
    return _cascade(r, r["entities"].where(F.col("id") == entity_id).select("id"))


def forget_source(r: Relations, source: str, strict_source: bool = False) -> Relations:
    """Forget all entities of a source.  By default chunks, memories and relationships go only
    through those entities; ``strict_source`` also drops the ones of that source."""
    return _cascade(r, r["entities"].where(F.col("source") == source).select("id"), source if strict_source else None)


def doomed_keys(r: Relations, entity_id: str | None = None, source: str | None = None, strict_source: bool = False, write=lambda df, name: df) -> Relations:
    """The keys that a forget takes from each relation, found from the forgotten entities outwards.

    No relation is compared with what is left of it: entities lead to their relationships, chunks and links, links to
    memories, and of memories and links only keys are read.  ``write`` (of a DataFrame and a name) may write keys that are
    used again."""
    if entity_id:
        strict_source = False
        own = r["entities"].where(F.col("id") == entity_id).select("id")
    elif source:
        own = r["entities"].where(F.col("source") == source).select("id")
    else:
        raise ValueError("forget needs an entity or a source")
    entities = write(own, "entities")
    gone = entities.select(F.col("id").alias("_gone"))
    of = lambda df, column: df.join(gone, F.col(column) == F.col("_gone"), "left_semi")
    relationships = of(r["relationships"], "source_id").select("id").union(of(r["relationships"], "target_id").select("id"))
    chunks = of(r["chunks"], "entity_id").select("id")
    links = of(r["memory_entities"], "entity_id").select("memory_id", "entity_id")
    if strict_source:
        relationships = relationships.union(r["relationships"].where(F.col("source") == source).select("id"))
        chunks = chunks.union(r["chunks"].where(F.get_json_object("metadata", "$.source") == source).select("id"))
        told = r["memories"].where(F.col("source") == source).select("id")
        links = links.union(r["memory_entities"].join(told.select(F.col("id").alias("memory_id")), "memory_id", "left_semi").select("memory_id", "entity_id"))
    links, chunks = write(links.distinct(), "links"), write(chunks.distinct(), "chunks")
    left = r["memory_entities"].select("memory_id", "entity_id").join(links, ["memory_id", "entity_id"], "left_anti").select("memory_id")
    # Memories without any link go too, whether they ever had one or not: keys alone are read.
    memories = r["memories"].select("id").join(left, F.col("id") == F.col("memory_id"), "left_anti")
    memories = write(memories.union(told) if strict_source else memories, "memories").distinct()
    dead = chunks.select("id", F.lit("chunk").alias("t")).union(memories.select("id", F.lit("memory")))
    embeddings = r["embeddings"].join(dead.select(F.col("id").alias("_i"), "t"), (F.col("ref_id") == F.col("_i")) & (F.col("ref_type") == F.col("t")), "left_semi").select("id")
    return {"entities": entities.distinct(), "relationships": relationships.distinct(), "chunks": chunks, "memories": memories, "memory_entities": links, "embeddings": embeddings.distinct()}


def forget(r: Relations, entity_id: str | None = None, source: str | None = None, strict_source: bool = False) -> Relations:
    """An entity wins over a source; neither is an error."""
    if entity_id:
        return forget_entity(r, entity_id)
    if source:
        return forget_source(r, source, strict_source)
    raise ValueError("forget needs an entity or a source")
