"""Hybrid recall: planned sub-queries, ranked lists, reciprocal rank fusion."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..staging import staged
from . import entities as E
from . import graph, search

RRF_K = 60
LIMIT = 20


def rrf_merge(ranked: DataFrame, k: int = RRF_K) -> DataFrame:
    """(id, score) of (list_id, id, rank) rows, rank from 0: the sum of 1 / (k + rank + 1)."""
    return ranked.groupBy("id").agg(F.sum(1.0 / (F.lit(k) + F.col("rank") + 1)).alias("score"))


@dataclass
class Sources:
    """The relations that recall reads; any may be missing."""

    spark: SparkSession
    entities: DataFrame | None = None
    relationships: DataFrame | None = None
    chunks: DataFrame | None = None
    memories: DataFrame | None = None
    memory_entities: DataFrame | None = None
    embeddings: DataFrame | None = None
    index: DataFrame | None = None
    stats: DataFrame | None = None


def plan(query: str, model=None) -> list[dict]:
    """Sub-queries from the model; keyword and memory search of the text without a usable plan."""
    fallback = [{"type": kind, "params": {"query": query}} for kind in ("keyword", "memory")]
    if model is None:
        return fallback
    try:
        return list(model.decompose(query)) or fallback
    except Exception:  # a model may fail in any way; recall goes on without it
        return fallback


def _ranked(df: DataFrame, order: list) -> DataFrame:
    """0-based ranks; ``df`` is already cut to the limit, so one partition is enough."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - 1)


def ranked_whole(df: DataFrame, order: list) -> DataFrame:
    """0-based ranks of any number of rows: ranges of the order are sorted apart, and each starts
    after the rows of those before it (one row per range)."""
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = staged(sorted_rows, "ranked").withColumn("_part", F.shiftright("_at", 33))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_part").withColumn("rank", F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_at", "_start")


def _result(df: DataFrame, kind: str, prefix: str, content, ids, source, metadata) -> DataFrame:
    return df.select(F.lit(kind).alias("result_type"), F.concat(F.lit(prefix), F.col("id")).alias("key"), content.alias("content"), ids.alias("entity_ids"), source.alias("source"), metadata.alias("metadata"), "rank")


def recall_memory(s: Sources, query: str, limit: int) -> DataFrame:
    hits = E.search_memories(s.memories, query, limit)
    if s.memory_entities is not None:
        hits = E.with_links(hits, s.memory_entities)
    else:
        hits = hits.withColumn("entity_ids", F.array().cast("array<string>"))
    return _result(_ranked(hits, ["created_at", "id"]), "memory", "mem:", F.col("content"), F.col("entity_ids"), F.col("source"), F.lit(None).cast("string"))


def _chunk_result(df: DataFrame) -> DataFrame:
    ids = F.when(F.col("entity_id").isNull(), F.array().cast("array<string>")).otherwise(F.array("entity_id"))
    return _result(df, "chunk", "chunk:", F.col("content"), ids, F.coalesce(F.get_json_object("metadata", "$.source"), F.lit("")), F.col("metadata"))


def recall_keyword(s: Sources, query: str, limit: int) -> DataFrame:
    hits = search.search_keyword(s.chunks, query, limit, strict=False, index=s.index, stats=s.stats, digits=6)
    return _chunk_result(_ranked(hits, [F.col("score").desc(), "id"]))


def recall_vector(s: Sources, query, limit: int, embedder=None) -> DataFrame:
    hits = search.search_vector(s.embeddings, s.chunks, query, limit, embedder, digits=6)
    return _chunk_result(_ranked(hits, [F.col("similarity").desc(), "id"]))


def recall_graph(s: Sources, query: str, limit: int = LIMIT, edge: str | None = None) -> DataFrame:
    """The first entity whose name contains ``query`` and its neighbours, with the types of
    the relationships between them."""
    first = E.find_entities(s.entities, name_like=f"%{query}%").orderBy("created_at", "id").limit(1)
    row = first.select("id").collect()  # one row at most
    if not row:
        return _result(s.entities.limit(0).withColumn("rank", F.lit(0)), "entity", "entity:", F.lit(""), F.array().cast("array<string>"), F.col("source"), F.lit(None).cast("string"))
    nodes, edges = graph.traverse(s.entities, s.relationships, row[0]["id"], 1, [edge] if edge else None)
    # The whole neighbourhood is ranked: a source filter and other graph lists come after it.
    E.check_limit(limit)
    ends = edges.withColumn("node", F.explode(F.array_distinct(F.array("source_id", "target_id"))))
    incident = ends.groupBy("node").agg(F.array_join(F.sort_array(F.collect_list("type")), ", ").alias("rels"))
    near = ranked_whole(nodes.select("id", "type", "name", "source", "level"), ["level", "id"])
    ranked = near.join(incident, near["id"] == incident["node"], "left")
    content = F.concat(F.col("name"), F.lit(" ("), F.col("type"), F.lit(")"), F.when(F.col("rels").isNull(), F.lit("")).otherwise(F.concat(F.lit(" ["), F.col("rels"), F.lit("]"))))
    return _result(ranked, "entity", "entity:", content, F.array("id"), F.col("source"), F.lit(None).cast("string"))


def execute(s: Sources, sub: dict, limit: int, embedder=None) -> DataFrame | None:
    """One sub-query as a lazy ranked list; None if it asks for nothing that can be answered."""
    params = sub.get("params") or {}
    query = params.get("query") or params.get("entity")
    if not isinstance(query, str) or not query:
        return None
    kind = sub.get("type")
    if kind == "memory" and s.memories is not None:
        return recall_memory(s, query, limit)
    if kind == "keyword" and s.chunks is not None:
        return recall_keyword(s, query, limit)
    if kind == "vector" and s.embeddings is not None and s.chunks is not None:
        if params.get("vector") is not None:
            return recall_vector(s, params["vector"], limit)
        return recall_vector(s, query, limit, embedder) if embedder is not None else None
    if kind == "graph" and s.entities is not None and s.relationships is not None:
        return recall_graph(s, query, limit, params.get("edge"))
    return None


def fuse(lists: list[DataFrame], limit: int, source: str | None = None, type_weights: dict[str, float] | None = None, k: int = RRF_K) -> DataFrame:
    """Fused results.  A key's payload is the same in every list that has it."""
    union = lists[0].withColumn("list_id", F.lit(0))
    for i, ranked in enumerate(lists[1:], 1):
        union = union.unionByName(ranked.withColumn("list_id", F.lit(i)))
    if source:
        union = union.where(F.col("source") == source)
    weight = F.lit(1.0)
    for kind, w in (type_weights or {}).items():
        weight = F.when(F.col("result_type") == kind, F.lit(float(w))).otherwise(weight)
    payload = F.min_by(F.struct("content", "entity_ids", "source", "metadata"), "list_id")
    merged = union.groupBy("result_type", "key").agg(F.sum(weight / (F.lit(float(k)) + F.col("rank") + 1)).alias("score"), payload.alias("p"))
    merged = merged.withColumn("score", F.round("score", 9))
    return merged.orderBy(F.col("score").desc(), "key").limit(E.check_limit(limit)).select("result_type", "key", "p.content", "score", "p.entity_ids", "p.source", "p.metadata")


def recall(s: Sources, query: str, limit: int = LIMIT, model=None, embedder=None, source: str | None = None, type_weights: dict[str, float] | None = None, subqueries: list[dict] | None = None) -> DataFrame:
    lists = [r for r in (execute(s, sub, limit, embedder) for sub in (subqueries if subqueries is not None else plan(query, model))) if r is not None]
    return fuse(lists, limit, source, type_weights) if lists else s.spark.createDataFrame([], schemas.RESULT)
