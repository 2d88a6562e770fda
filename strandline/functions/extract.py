"""Extraction as Column expressions: frontmatter, wikilinks, model JSON, and their union."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import canonical_json, trim

# Field names of entities, relationships and memories, and the wikilink pattern below.
ENTITY = "struct<type: string, name: string, attributes: string, source: string>"
NO_ENTITIES = f"array<{ENTITY}>"


def _entity(kind: Column, name: Column, attributes: Column, source: str) -> Column:
    return F.struct(kind.alias("type"), name.alias("name"), attributes.alias("attributes"), F.lit(source).alias("source"))


def frontmatter(content: Column) -> Column:
    """The entity of a leading ``---`` block, or null.

    The block is what stands between the first two ``---``; a line's key ends at its first
    colon; of repeated keys the last counts; ``name`` and ``type`` are lifted, the rest are
    string attributes.  A block with neither name nor type is no entity."""
    opens = F.startswith(trim(content), F.lit("---"))
    parts = F.split(content, "---", 3)
    block = F.when(opens & (F.size(parts) == 3), trim(F.try_element_at(parts, F.lit(2))))
    lines = F.filter(F.transform(F.split(block, "\n"), trim), lambda s: F.contains(s, F.lit(":")))
    pair = lambda s: F.struct(trim(F.substring_index(s, ":", 1)).alias("k"), trim(F.regexp_replace(s, r"(?s)\A[^:]*:", "")).alias("v"))
    # Folded from the left: a later pair replaces the earlier one of its key.
    empty = F.array().cast("array<struct<k: string, v: string>>")
    last = F.aggregate(F.transform(lines, pair), empty, lambda kept, p: F.concat(F.filter(kept, lambda q: q["k"] != p["k"]), F.array(p)))
    of = lambda kept, key: F.coalesce(F.try_element_at(F.transform(F.filter(kept, lambda p: p["k"] == key), lambda p: p["v"]), F.lit(1)), F.lit(""))

    def entity(kept: Column) -> Column:
        rest = F.filter(kept, lambda p: ~p["k"].isin("name", "type"))
        attributes = canonical_json(F.map_from_entries(F.transform(rest, lambda p: F.struct(p["k"], p["v"]))))
        return F.when((of(kept, "name") != "") | (of(kept, "type") != ""), _entity(of(kept, "type"), of(kept, "name"), attributes, "frontmatter"))

    # One element: a lambda's variable holds the pairs, so they are computed once.
    return F.get(F.transform(F.array(last), entity), 0)


def wikilinks(content: Column) -> Column:
    """Entities of all ``[[name]]``, each name once, in order."""
    names = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(content, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1)), trim), lambda s: s != ""))
    return F.transform(names, lambda n: _entity(F.lit("document"), n, F.lit("{}"), "markdown"))


def deterministic(content: Column) -> Column:
    """Frontmatter's entity and the wikilinks."""
    first = F.filter(F.array(frontmatter(content)), lambda e: e.isNotNull()).cast(NO_ENTITIES)
    return F.concat(first, F.coalesce(wikilinks(content), F.array().cast(NO_ENTITIES)).cast(NO_ENTITIES))


def strip_fence(raw: Column) -> Column:
    """Without the first and last line of a code fence of more than two lines."""
    text = trim(raw)
    lines = F.split(text, "\n")
    fenced = F.startswith(text, F.lit("```")) & (F.size(lines) > 2)
    return F.when(fenced, F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0))), "\n")).otherwise(text)


_MODEL = (
    "struct<entities: array<struct<type: string, name: string, attributes: string>>, "
    "relationships: array<struct<source: string, target: string, source_id: string, target_id: string, type: string, attributes: string>>, "
    "memories: array<string>>"
)


def model_json(raw: Column) -> Column:
    """A model's answer as an extraction struct; null if it is no JSON object.

    Relationship ends may be called source/target or source_id/target_id.  A memory is an object
    with ``content`` or a bare string; empty ones are dropped."""
    # A string field keeps a nested object as its JSON text, so both shapes of a memory arrive as text.
    parsed = F.from_json(strip_fence(raw), _MODEL, {"mode": "PERMISSIVE"})
    broken = F.try_parse_json(strip_fence(raw)).isNull()
    none = lambda kind: F.array().cast(f"array<{kind}>")
    entities = F.transform(parsed["entities"], lambda e: F.struct(F.coalesce(e["type"], F.lit("")).alias("type"), F.coalesce(e["name"], F.lit("")).alias("name"), F.coalesce(e["attributes"], F.lit("{}")).alias("attributes"), F.lit("").alias("source")))
    ends = F.transform(
        parsed["relationships"],
        lambda r: F.struct(F.coalesce(r["source"], r["source_id"], F.lit("")).alias("source"), F.coalesce(r["target"], r["target_id"], F.lit("")).alias("target"), F.coalesce(r["type"], F.lit("")).alias("type"), F.coalesce(r["attributes"], F.lit("{}")).alias("attributes")),
    )
    content = F.transform(parsed["memories"], lambda m: F.when(F.startswith(F.ltrim(m), F.lit("{")), F.coalesce(F.get_json_object(m, "$.content"), F.lit(""))).otherwise(m))
    memories = F.transform(F.filter(content, lambda c: c.isNotNull() & (c != "")), lambda c: F.struct(c.alias("content")))
    relation = "struct<source: string, target: string, type: string, attributes: string>"
    whole = F.struct(
        F.coalesce(entities, none(ENTITY)).alias("entities"),
        F.coalesce(ends, none(relation)).alias("relationships"),
        F.coalesce(memories, none("struct<content: string>")).alias("memories"),
    )
    return F.when(broken, F.lit(None)).otherwise(whole)


def joined(own: Column, model: Column) -> Column:
    """The deterministic entities, then the model's; nothing is merged."""
    return F.struct(F.concat(own, F.coalesce(model["entities"], F.array().cast(NO_ENTITIES))).alias("entities"), model["relationships"].alias("relationships"), model["memories"].alias("memories"))


def hybrid(content: Column, answer: Column) -> Column:
    return joined(deterministic(content), model_json(answer))
