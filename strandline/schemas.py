"""Schemas of the stored relations."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT, _TIME, _TEXTS, _FLOATS = T.StringType(), T.TimestampType(), T.ArrayType(T.StringType()), T.ArrayType(T.FloatType())


def _schema(texts: str, **others: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, _TEXT) for n in texts.split()] + [T.StructField(n, t) for n, t in others.items()])


TABLES: dict[str, T.StructType] = {
    "entities": _schema("id type name attributes source", created_at=_TIME, updated_at=_TIME),
    "relationships": _schema("id source_id target_id type attributes source", created_at=_TIME),
    "chunks": _schema("id entity_id content metadata", created_at=_TIME),
    "memories": _schema("id content source", created_at=_TIME, updated_at=_TIME),
    "memory_entities": _schema("memory_id entity_id"),
    "embeddings": _schema("id ref_id ref_type", vector=_FLOATS, created_at=_TIME),
    "sync_state": _schema("connector state", updated_at=_TIME),
    # The search index, and which document (of which source) a row came from.
    "postings": _schema("term chunk_id", tf=T.LongType(), dl=T.IntegerType(), positions=T.ArrayType(T.IntegerType())),
    # The term dictionary and the totals, as increments; and the trigrams of names and memories.
    "terms": _schema("term", df=T.LongType(), occurrences=T.LongType()),
    "totals": _schema("", n_chunks=T.LongType(), n_tokens=T.LongType()),
    "grams": _schema("relation gram bucket", ids=_TEXTS),
    "origins": _schema("doc relation id"),
}

#: What every retrieval operator returns.
RESULT = _schema("result_type key content", score=T.DoubleType(), entity_ids=_TEXTS, source=_TEXT, metadata=_TEXT)
