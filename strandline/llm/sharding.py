"""Sharding by weighted rendezvous hashing (DataFrame functions only).

Every (record key, shard) pair gets a pseudo-random cost ``-ln(u) / weight``
with ``u`` uniform in (0, 1) from a 64-bit hash; the record goes to the shard
of least cost.  A further shard can only lower the minimum of the records it
takes, so growing the shard set moves rows into the new shard alone, and a
shard's expected share is proportional to its weight.

No shuffle is needed to place a row.  Slots (gapless numbers inside a shard)
are assigned in two levels, so that no task ever sorts a whole shard: rows are
counted per (shard, bucket), the counts are summed up to offsets, and rows are
numbered inside their bucket.

Defined results: a null key is a key of its own (all its rows share a shard but
not a bucket); a null text has no bytes; equal rows get different slots in no
particular order; an empty table gives an empty result; other columns are left
out, or with ``keep`` come along whatever they are called.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import fresh, staged

ROW_OVERHEAD = 16


def text_bytes(text: str | Column) -> Column:
    return F.coalesce(F.octet_length(F.col(text) if isinstance(text, str) else text), F.lit(0)).cast("long")


def _cost(key: Column, shard: Column, weight: Column) -> Column:
    draw = F.shiftrightunsigned(F.xxhash64(key, shard), 11)
    return -F.log((draw.cast("double") + 0.5) / F.lit(float(1 << 53))) / weight


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (index into ``weights``) of each key; weights must be positive."""
    if not weights or min(weights) <= 0:
        raise ValueError("shards need positive weights")
    shards = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights)])
    costs = F.transform(shards, lambda s: F.struct(_cost(key, s["shard"], s["weight"]).alias("cost"), s["shard"].alias("shard")))
    return F.array_min(costs)["shard"]


def with_shards(df: DataFrame, key: str, weights: Sequence[float], into: str = "shard") -> DataFrame:
    return df.withColumn(into, rendezvous(F.col(key), weights))


#: Columns that ``with_slots`` makes and drops again.
INNER = ["_bucket", "_shard", "_b", "_n", "_offset", "_rank"]


def with_slots(df: DataFrame, shard: str, order: Sequence[str], n_shards: int, into: str = "slot", buckets: int = 64) -> DataFrame:
    """Number the rows of each shard from 0 without gaps.  ``order`` makes the
    numbering repeatable.  The offsets are a table of at most
    ``n_shards * buckets`` rows, which bounds the broadcast; raise ``buckets``
    with the input (tasks number about rows / (n_shards * buckets) rows each)."""
    if n_shards * buckets > 1_000_000:
        raise ValueError("the offsets would be too many to broadcast")
    spread = df.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(7), *[F.col(c) for c in order]), F.lit(buckets)).cast("int"))
    sizes = spread.groupBy(F.col(shard).alias("_shard"), F.col("_bucket").alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_shard", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(shard, "_bucket").orderBy(*order)
    numbered = spread.withColumn("_rank", F.row_number().over(inside))
    joined = numbered.join(F.broadcast(offsets), (F.col(shard) == F.col("_shard")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn(into, (F.col("_offset") + F.col("_rank") - 1).cast("long")).drop("_shard", "_b", "_bucket", "_offset", "_rank")


RESULTS = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def shard_documents(docs: DataFrame, n_shards: int = 40, weights: Sequence[float] | None = None, key: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """One row per document: key, size, text_crc32, law, shard, slot and grown_shard
    (its shard once another shard of mean weight joins).

    With ``keep`` the documents' other columns follow, and the rows go to their shards with
    them; a result whose name the documents have is called ``out_<name>``."""
    weights = list(weights or [1.0] * n_shards)
    extra = sum(weights) / len(weights)
    late = {name: fresh(docs.columns, f"_own_{name}") for name in [*RESULTS, *INNER] if name in docs.columns and name != key}
    others = [c for c in docs.columns if c != key] if keep else []
    placed = docs.select(
        F.col(key),
        (text_bytes(text) + ROW_OVERHEAD).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col(key), weights).alias("shard"),
        *[F.col(c).alias(late.get(c, c)) for c in others],
    )
    late_cost, own = _cost(F.col(key), F.lit(len(weights)), F.lit(extra)), F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("shard") + 1)
    grown = placed.withColumn("grown_shard", F.when(late_cost < _cost(F.col(key), F.col("shard"), own), F.lit(len(weights))).otherwise(F.col("shard")))
    numbered = with_slots(staged(grown, "shards"), "shard", [key, "text_crc32", "size"], len(weights))
    clash = lambda name: f"out_{name}" if keep and name in late else name
    return numbered.select(F.col(key), *[F.col(name).alias(clash(name)) for name in RESULTS], *[F.col(late.get(c, c)).alias(c) for c in others])
