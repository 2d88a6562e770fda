"""The ingest pipeline: documents -> extraction -> entities, relationships, chunks, memories, embeddings.

A batch of documents goes through one set-based plan.  Names are resolved to identifiers
within their document; nothing is collected.  All identifiers are hashes of content, so
ingesting the same document again changes nothing."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extract, vectors
from ..functions.text import chunked, stable_id
from ..providers import EXTRACTION_PROMPT
from ..staging import staged


def ask_model(docs: DataFrame, model, content: str = "content", prompt: str = EXTRACTION_PROMPT) -> DataFrame:
    """``docs`` with ``answer``, the model's raw reply (Arrow batches; one call per document)."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(answer=[model.extract(t or "", prompt) for t in batch[content]])

    return docs.mapInPandas(run, f"{fields}, answer string")


def ask_extractor(docs: DataFrame, extractor, content: str = "content", content_type: str = "") -> DataFrame:
    """``docs`` with ``extraction``, what the given extractor alone finds (one call per document)."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(answer=[json.dumps(extractor.extract(t or "", content_type)) for t in batch[content]])

    found = docs.mapInPandas(run, f"{fields}, answer string")
    return found.withColumn("extraction", extract.model_json(F.col("answer"))).drop("answer")


def extraction_of(docs: DataFrame, model=None, content: str = "content", extractor=None, kept=None) -> DataFrame:
    """``docs`` with ``extraction``: deterministic, hybrid when there is a model or a column
    ``answer``, or what an ``extractor`` finds.  With ``kept`` answers each distinct text is asked once, ever."""
    if extractor is not None:
        return ask_extractor(docs, extractor, content)
    if model is not None:
        docs = ask_model(docs, model, content) if kept is None else kept.answers(docs, model, content, EXTRACTION_PROMPT)
    if "answer" in docs.columns:
        # The answer is parsed once, in a projection of its own.
        parsed = docs.withColumn("_own", extract.deterministic(F.col(content))).withColumn("_model", extract.model_json(F.col("answer")))
        return parsed.withColumn("extraction", extract.joined(F.col("_own"), F.col("_model"))).drop("_own", "_model")
    none = F.struct(extract.deterministic(F.col(content)).alias("entities"), F.array().cast("array<struct<source: string, target: string, type: string, attributes: string>>").alias("relationships"), F.array().cast("array<struct<content: string>>").alias("memories"))
    return docs.withColumn("extraction", none)


def entity_id(kind: Column, name: Column) -> Column:
    return stable_id("entity", kind, name)


def extracted_entities(docs: DataFrame, key: str = "doc_id", source: str | None = None) -> DataFrame:
    """(key, pos, id, type, name, attributes, source) of every extracted entity."""
    rows = docs.select(key, F.posexplode("extraction.entities").alias("pos", "e"))
    own = F.coalesce(F.nullif("e.source", F.lit("")), F.lit(source or ""))
    return rows.select(key, "pos", entity_id(F.col("e.type"), F.col("e.name")).alias("id"), F.col("e.type").alias("type"), F.col("e.name").alias("name"), F.coalesce("e.attributes", F.lit("{}")).alias("attributes"), own.alias("source"))


def names_of(entities: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, name, id): the last entity of a name in its document."""
    return entities.groupBy(key, "name").agg(F.max_by("id", "pos").alias("id"))


def resolve_relationships(docs: DataFrame, names: DataFrame, key: str = "doc_id") -> DataFrame:
    """Extracted relationships with both ends resolved; those with an unknown end are dropped."""
    rel = docs.select(key, F.posexplode("extraction.relationships").alias("pos", "r")).select(key, "pos", F.col("r.source").alias("source_name"), F.col("r.target").alias("target_name"), F.col("r.type").alias("type"), F.coalesce("r.attributes", F.lit("{}")).alias("attributes"))
    a = names.select(key, F.col("name").alias("source_name"), F.col("id").alias("source_id"))
    b = names.select(key, F.col("name").alias("target_name"), F.col("id").alias("target_id"))
    return rel.join(a, [key, "source_name"]).join(b, [key, "target_name"])


def split_chunks(docs: DataFrame, limit: int, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(key, part, parts, content) with ``part`` from 1; empty pieces are kept as the splitter gives them."""
    parts = chunked(F.col(content), limit) if limit > 0 else F.array(F.col(content))
    rows = docs.select(key, parts.alias("p")).select(key, F.size("p").alias("parts"), F.posexplode("p").alias("i", "content"))
    return rows.select(key, (F.col("i") + 1).alias("part"), "parts", "content")


#: So many extracted entities, relationships and memories a task groups and joins at once (some 100 MB).
SLICE = 400_000


def by_key(done: DataFrame, key: str) -> DataFrame:
    """Extractions dealt by document, in as many slices as their number asks for: what a task sorts doesn't grow with the input."""
    sizes = [F.greatest(F.size(f"extraction.{part}"), F.lit(0)) for part in ("entities", "relationships", "memories")]
    items = done.agg(F.sum((sizes[0] + sizes[1] + sizes[2]).cast("long"))).first()[0] or 0
    return done.select(key, "extraction").repartition(max(1, -(-items // SLICE)), F.col(key))


def with_known_ids(found: DataFrame, known: DataFrame) -> DataFrame:
    """Extracted entities with the identifiers that the store already has for their (type, name)."""
    wanted = found.select("type", "name").distinct()
    stored = known.join(wanted, ["type", "name"], "left_semi").groupBy("type", "name").agg(F.min("id").alias("_stored"))
    return found.join(stored, ["type", "name"], "left").withColumn("id", F.coalesce("_stored", "id")).drop("_stored")


def remember(docs: DataFrame, key: str = "doc_id", content: str = "content", source: str | None = None, max_chunk_bytes: int = 0, model=None, embed=None, link_wikilinks: bool = False, extractor=None, known: DataFrame | None = None, kept=None) -> dict[str, DataFrame]:
    """The rows that a batch of documents adds to each relation.

    The extraction is written once, so a model is asked once per document and all relations
    come from the same answer; the rest is lazy.  Documents are dealt by key first, so that a table of one row group
    isn't one task's work.  ``embed`` is an embedder (True: the offline one;
    None or False: no vectors).  Names resolve to the ids of ``known`` entities where there are any.
    Wikilinks become entities; with ``link_wikilinks`` the frontmatter entity also gets a
    ``mentions`` edge to each.  Memories are linked to all entities of their document.
    ``documents`` (doc) and ``origins`` (doc, relation, id) say which document a row came from.
    ``kept`` (see ``operators.kept``) keeps the answers and vectors of a model and an embedder."""
    now = F.current_timestamp()
    own = F.lit(source or "")
    rows = docs.select(F.col(key), F.col(content), *(["answer"] if "answer" in docs.columns else [])).repartition(F.col(key))
    done = staged(extraction_of(rows, model, content, extractor, kept).select(key, F.col(content), "extraction"), "extraction")
    dealt = by_key(done, key)
    found = extracted_entities(dealt, key, source)
    found = found if known is None else staged(with_known_ids(found, known), "found")
    names = names_of(found, key)
    entities = found.groupBy("name", "type").agg(F.first("id").alias("id"), F.max_by("attributes", F.struct(key, "pos")).alias("attributes"), F.max_by("source", F.struct(key, "pos")).alias("source"))
    entities = entities.select("id", "type", "name", "attributes", "source", now.alias("created_at"), now.alias("updated_at"))

    rel = resolve_relationships(dealt, names, key)
    if link_wikilinks:
        fm = found.where("source = 'frontmatter'").select(key, F.col("id").alias("source_id"))
        links = found.where("source = 'markdown'").select(key, F.col("id").alias("target_id"))
        more = fm.join(links, key).select(key, F.lit(-1).alias("pos"), F.lit("").alias("source_name"), F.lit("").alias("target_name"), F.lit("mentions").alias("type"), F.lit("{}").alias("attributes"), "source_id", "target_id")
        rel = rel.unionByName(more)
    doc = stable_id("doc", F.col(key), own).alias("doc")
    rel = rel.select(doc, stable_id("rel", F.col(key), own, F.col("pos"), F.col("source_id"), F.col("target_id"), F.col("type")).alias("id"), "source_id", "target_id", "type", "attributes", own.alias("source"), now.alias("created_at")).dropDuplicates(["id"])

    parts = split_chunks(done, max_chunk_bytes, key, content)
    meta = F.to_json(F.struct(F.when(F.col("parts") > 1, F.col("part")).alias("part"), F.when(F.col("parts") > 1, F.col("parts")).alias("parts"), F.lit(source or None).cast("string").alias("source")))
    pieces = parts.select(doc, stable_id("chunk", F.col(key), own, F.col("part")).alias("id"), F.lit(None).cast("string").alias("entity_id"), "content", meta.alias("metadata"), now.alias("created_at"))
    chunks = pieces.drop("doc")

    facts = dealt.select(key, F.posexplode("extraction.memories").alias("pos", "m")).select(key, doc, F.col("m.content").alias("content"), stable_id("memory", F.col(key), own, F.col("pos")).alias("id"))
    memories = facts.select("id", "content", own.alias("source"), now.alias("created_at"), now.alias("updated_at"))
    memory_entities = facts.select(key, F.col("id").alias("memory_id")).join(names.select(key, F.col("id").alias("entity_id")), key).select("memory_id", "entity_id").distinct()

    came = lambda df, relation: df.select("doc", F.lit(relation).alias("relation"), "id")
    out = {"entities": entities, "relationships": rel.drop("doc"), "chunks": chunks, "memories": memories, "memory_entities": memory_entities}
    out["documents"] = done.select(doc).distinct()
    out["origins"] = came(pieces, "chunks").unionByName(came(facts, "memories")).unionByName(came(rel, "relationships"))
    if embed:
        refs = chunks.select(F.col("id").alias("ref_id"), F.lit("chunk").alias("ref_type"), "content").union(memories.select("id", F.lit("memory"), "content"))
        if kept is not None and embed is not True:
            placed = kept.vectors(refs, embed)
        else:
            placed = refs.withColumn("vector", (vectors.embed if embed is True else vectors.embed_with(embed))(F.col("content")))
        out["embeddings"] = placed.select(stable_id("emb", F.col("ref_type"), F.col("ref_id")).alias("id"), "ref_id", "ref_type", "vector", now.alias("created_at"))
    return out
