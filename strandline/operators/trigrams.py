"""Substring search by trigrams: packed posting lists per trigram, intersected, then the exact LIKE.

The index of a text column has a row for each (gram, bucket): the identifiers of the texts of that bucket with
that gram.  Rows of a bucket are few (``BUCKET_ROWS``), so a list is bounded however common its gram is, and
lists of one bucket are intersected where they meet.  A text is followed by two NULs, so a gram begins at each of its
characters, and a literal of one or two characters is a prefix of a gram: also a word under three characters is
a range of the index, which is sorted by gram.

Grams ignore the case of ASCII letters, as LIKE does.  Wildcards cut a pattern into literals; a pattern without
any literal can't be narrowed down and reads all rows."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fields, sqlite_like
from . import lookup
from .entities import check_limit, find_entities

BUCKET_ROWS = 1 << 14
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _low(text: str) -> str:
    return text.translate(str.maketrans(UPPER, LOWER))


def grams(rows: DataFrame, text: str, id: str = "id", buckets: int | None = None, tag: str = "") -> DataFrame:
    """(gram, bucket, ids).  ``tag`` keeps apart the buckets of indexes that are read together."""
    n = buckets or max(1, -(-rows.count() // BUCKET_ROWS))
    padded = F.concat(F.translate(F.col(text), UPPER, LOWER), F.lit("\0\0"))
    found = F.array_distinct(F.regexp_extract_all(padded, F.lit("(?s)(?=(...))"), F.lit(1)))
    each = rows.where(F.col(text) != "").select(F.col(id).alias("_id"), F.concat(F.lit(tag), F.pmod(F.xxhash64(id), F.lit(n)).cast("string")).alias("bucket"), F.explode(found).alias("gram"))
    return each.groupBy("gram", "bucket").agg(F.sort_array(F.collect_list("_id")).alias("ids"))


@dataclass(frozen=True)
class Needs:
    """What the index must have for a text to match a pattern: whole grams, and beginnings of grams."""

    grams: tuple[str, ...]
    starts: tuple[str, ...]


def needs(pattern: str) -> Needs:
    literals = [_low(x) for x in re.split("[%_]+", pattern) if x]
    whole = {x[i : i + 3] for x in literals for i in range(len(x) - 2)}
    starts = {x for x in literals if len(x) < 3}
    return Needs(tuple(sorted(whole)), tuple(sorted(s for s in starts if not any(g.startswith(s) for g in whole))))


def candidates(index: DataFrame, patterns: Sequence[str]) -> DataFrame | None:
    """``_id`` of all rows that could match any of the patterns, from the lists of their grams alone; None if
    a pattern has no literal, so that any row could."""
    asked = [needs(p) for p in dict.fromkeys(patterns)]
    if any(not a.grams and not a.starts for a in asked):
        return None
    whole, starts = sorted({g for a in asked for g in a.grams}), sorted({s for a in asked for s in a.starts})
    test = reduce(lambda a, b: a | b, [F.startswith("gram", F.lit(s)) for s in starts], lookup.one_of("gram", whole))
    named = F.array_compact(F.array(F.when(F.col("gram").isin(whole), F.concat(F.lit("="), F.col("gram"))), *[F.when(F.startswith("gram", F.lit(s)), F.lit(f"^{s}")) for s in starts]))
    read = index.where(test).select("bucket", F.explode(named).alias("need"), "ids")
    lists = read.groupBy("bucket", "need").agg(F.flatten(F.collect_list("ids")).alias("ids"))
    per = lists.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("need", "ids"))).alias("at"))
    none = F.array().cast("array<string>")

    def both(a: Needs) -> Column:
        keys = [f"={g}" for g in a.grams] + [f"^{s}" for s in a.starts]
        return reduce(F.array_intersect, [F.coalesce(F.try_element_at("at", F.lit(k)), none) for k in keys])

    found = reduce(F.array_union, [F.array_distinct(both(a)) for a in asked])
    return per.select(F.explode(found).alias("_id"))


def matching(rows: DataFrame, index: DataFrame, text: str, patterns: Sequence[str], id: str = "id") -> DataFrame:
    """The rows whose ``text`` is LIKE any of the patterns."""
    exact = reduce(lambda a, b: a | b, [sqlite_like(F.col(text), p) for p in patterns])
    found = candidates(index, patterns)
    # Identifiers are distinct in one index; a row that was put again may be in several.
    return (rows if found is None else lookup.semi(rows, found.distinct(), id)).where(exact)


def find_entities_indexed(entities: DataFrame, index: DataFrame, name_like: str, type: str | None = None, source: str | None = None) -> DataFrame:
    """``find_entities`` with a name pattern, through the trigrams of ``name``."""
    return find_entities(matching(entities, index, "name", [name_like]), type=type, source=source)


def search_memories_indexed(memories: DataFrame, index: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """``search_memories`` through the trigrams of ``content``."""
    words = fields(query)
    check_limit(limit)
    if not words:
        return memories.limit(0)
    return matching(memories, index, "content", [f"%{w}%" for w in words]).orderBy("created_at", "id").limit(limit)
