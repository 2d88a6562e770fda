"""Rows by identifier, as values that reach the scan.

The best few rows of a ranking are known to the driver before their texts are read.  Their identifiers go
into the scan as predicates, so a table whose files are sorted by identifier gives only the row groups
that hold them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: So many identifiers at most go to the driver and into a predicate; beyond it the rows are joined.
PUSHED = 1000
#: Parquet's reader tests a list of up to so many values on a row group's statistics one by one; of a
#: longer one it only takes the smallest and the largest.
LISTED = 10


def one_of(column: str | Column, values: Sequence) -> Column:
    """``column IN values``, in lists short enough to prune row groups."""
    column = F.col(column) if isinstance(column, str) else column
    values = sorted({v for v in values if v is not None})
    test = F.lit(False)
    for i in range(0, len(values), LISTED):
        test = test | column.isin(values[i : i + LISTED])
    return test


def clustered(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with its rows in the order of ``columns`` over all files, so that statistics tell files and row groups apart."""
    return df.repartitionByRange(*columns).sortWithinPartitions(*columns)


def join_top(rows: DataFrame, top: DataFrame, ref: str, limit: int, id: str = "id") -> DataFrame:
    """``rows`` that the ranking ``top`` (at most ``limit`` rows, its column ``ref`` unique) refers to, with the ranking's other columns."""
    if limit > PUSHED:
        return rows.join(top, F.col(id) == F.col(ref)).drop(ref)
    found = top.collect()
    local = top.sparkSession.createDataFrame(found, top.schema)
    return rows.where(one_of(id, [r[ref] for r in found])).join(F.broadcast(local), F.col(id) == F.col(ref)).drop(ref)


def semi(rows: DataFrame, ids: DataFrame, id: str = "id") -> DataFrame:
    """``rows`` whose identifier is in ``ids`` (one column, distinct): by value if they are few, else by a join."""
    few = ids.limit(PUSHED + 1).collect()
    if len(few) <= PUSHED:
        return rows.where(one_of(id, [r[0] for r in few]))
    return rows.join(ids.toDF(id), id, "left_semi")


#: So many identifiers at most are broadcast at once.
SLICE = 1 << 18


def slices(ids: DataFrame, id: str = "id") -> list[tuple]:
    """Ranges (first, last) of ``ids`` (one column, distinct) with some ``SLICE`` of them each."""
    n = ids.count() // SLICE + 1
    ends = ids.repartitionByRange(n, id).groupBy(F.spark_partition_id().alias("_p")).agg(F.min(id).alias("first"), F.max(id).alias("last"))
    return [(r["first"], r["last"]) for r in ends.collect()]


def sliced(rows: DataFrame, ids: DataFrame, id: str = "id") -> list[DataFrame]:
    """``rows`` whose identifier is in ``ids`` (one column, distinct), by ranges of it.

    ``rows`` are large and sorted by ``id``: a range reads its own row groups, and what is broadcast is the range's ids, so
    no row is shuffled and nothing broadcast grows with the number of ids."""
    within = lambda df, a, b: df.where(F.col(id).between(a, b))
    return [within(rows, a, b).join(F.broadcast(within(ids, a, b)), id, "left_semi") for a, b in slices(ids, id)]
