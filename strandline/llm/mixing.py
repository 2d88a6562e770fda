"""Mixing sources to target weights by hierarchical budgeting.

Documents hang in a tree, by default domain > lang > source.  A token budget
enters at the root and is propagated downwards; every node hands what it got to
its children by their weights, as far as they can take it.  A subtree can take
``max_epochs`` times the tokens it holds.  What a child can't take goes to its
siblings by their weights, and since a parent is only given what its subtree
can take, a shortage reaches other branches only when all siblings are full:
siblings come before ancestors.

That division is a water filling with a closed form: sort the children by
capacity / weight; the first ones are full, the others share the rest by
weight.  It needs two windows per level over the table of nodes, in exact
integers, so shares are rounded down to whole tokens.

Each leaf then takes a prefix of its own token stream: whole epochs first, each
in an order seeded by (seed, epoch, document), then the part of the last epoch
that fills its share.  Where that part ends is found on a slim table of counts: prefix sums
over buckets of the order key (as many as keep a bucket small in the largest leaf), then inside
the one bucket where the share ends.  Every document compares its order key with that one row
of its leaf, so no task ever sorts a whole leaf and texts are not shuffled.

Defined results: null level values are nodes named ``(none)``; documents without
tokens (null, empty) are never taken, for they fill nothing; equal rows are
separate documents; an empty table gives an empty result; weights not given
are 1, and nodes of weight 0 get nothing; the output columns ``epoch``,
``n_tokens`` and ``take_tokens`` replace input columns of these names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcore
from .staging import staged

WORD = r"[^\x20\x09-\x0D]+"
NONE = "(none)"
BIG = "decimal(38,0)"
BROADCAST_LEAVES = 20_000
SALTS = 64
BUCKET_ROWS = 100_000


def count_words(text: str) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def _weight(column: str, weights: Mapping[str, int]) -> Column:
    w = F.lit(1)
    for name, value in weights.items():
        w = F.when(F.col(column) == name, F.lit(int(value))).otherwise(w)
    return w.cast("long")


def divide(nodes: DataFrame, parent: Sequence[str], name: str, budget: str, capacity: str, weight: str, into: str) -> DataFrame:
    """Divide each parent's ``budget`` among its rows by water filling (whole tokens)."""
    ratio = (F.col(capacity) / F.nullif(F.col(weight), F.lit(0))).cast("double")
    order = [F.col("_ratio").asc_nulls_last(), F.col(name)]
    keys = [F.col(p) for p in parent] or [F.lit(0)]
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.partitionBy(*keys).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(*keys)
    big = lambda c: c.cast(BIG)
    x = nodes.withColumn("_ratio", ratio)
    x = x.withColumn("_before", F.coalesce(F.sum(capacity).over(before), F.lit(0))).withColumn("_onward", F.sum(weight).over(onward))
    full = (F.col(weight) > 0) & (big(F.col(capacity)) * F.col("_onward") <= big(F.col(budget) - F.col("_before")) * F.col(weight))
    x = x.withColumn("_full", full)
    x = x.withColumn("_used", F.sum(F.when(F.col("_full"), F.col(capacity)).otherwise(0)).over(whole))
    x = x.withColumn("_open", F.sum(F.when(F.col("_full"), 0).otherwise(F.col(weight))).over(whole))
    share = F.expr(f"CAST(CAST({budget} - _used AS decimal(20,0)) * CAST({weight} AS decimal(18,0)) div CAST(_open AS decimal(18,0)) AS bigint)")
    got = F.when(F.col("_full"), F.col(capacity)).when((F.col(weight) == 0) | (F.col("_open") == 0), F.lit(0)).otherwise(share)
    return x.withColumn(into, got.cast("long")).drop("_ratio", "_before", "_onward", "_full", "_used", "_open")


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], tokens: str, weights: Mapping[str, Mapping[str, int]], max_epochs: int, share: tuple[int, int] | None, budget: int | None) -> DataFrame:
    """``leaves`` (a row per leaf with its tokens) with ``_take``, the tokens it is to give.

    The budget is ``budget`` tokens, or the fraction ``share`` = (a, b) of all tokens."""
    if budget is None:
        budget = int(leaves.agg(F.sum(tokens)).first()[0] or 0) * int(share[0]) // int(share[1])
    x = leaves.withColumn("_cap", F.col(tokens) * max_epochs).withColumn("_got", F.lit(int(budget)).cast("long"))
    for depth, level in enumerate(levels):
        above, path = list(levels[:depth]), list(levels[: depth + 1])
        nodes = x.groupBy(*path).agg(F.sum("_cap").alias("_ncap"), F.first("_got").alias("_nbudget"))
        nodes = nodes.withColumn("_w", _weight(level, weights.get(level, {})))
        given = divide(nodes, above, level, "_nbudget", "_ncap", "_w", "_next").select(*path, "_next")
        x = x.join(given, path).withColumn("_got", F.col("_next")).drop("_next")
    return x.withColumnRenamed("_got", "_take").drop("_cap")


def _counted(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index(name)
            counts = [np.diff(textcore.word_spans(data, off, textcore.SPACE)[2]) for _, _, data, off in textcore.slices(batch.column(at))]
            n = pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([n if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return textcore.tidy(run)


def _with_shares(rows: DataFrame, shares: DataFrame, path: Sequence[str], spread: Sequence[str], leaves: int) -> DataFrame:
    """Rows with their leaf's share.  Up to BROADCAST_LEAVES leaves are broadcast; beyond
    that, rows join by leaf and salt, for a leaf can hold a third of all rows."""
    if leaves <= BROADCAST_LEAVES:
        return rows.join(F.broadcast(shares), list(path))
    salted = shares.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")).join(salted, [*path, "_salt"]).drop("_salt")


def mix(
    docs: DataFrame,
    levels: Sequence[str] = ("domain", "lang", "source"),
    weights: Mapping[str, Mapping[str, int]] | None = None,
    share: tuple[int, int] = (3, 5),
    budget: int | None = None,
    max_epochs: int = 2,
    seed: int = 0,
    key: str = "doc_id",
    text: str = "text",
    tokens: Column | None = None,
    bucket_digits: int | None = None,
) -> DataFrame:
    """The chosen documents, once per epoch, with ``epoch``, ``n_tokens`` and
    ``take_tokens`` (less than ``n_tokens`` only where a leaf's share ends).

    ``tokens`` counts a document's tokens; by default they are the words of ``text``.  Shares and
    cuts come from a slim table of counts; then every document knows from its leaf's row and the
    bucket of its order key whether it is taken, and only the bucket in which a leaf's share ends
    is put in order."""
    levels, weights = list(levels), weights or {}
    path = [f"_level_{c}" for c in levels]
    # The documents' own columns go by numbers, so that none is named like an inner one.
    own = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    named = {v: F.coalesce(F.col(own[c]).cast("string"), F.lit(NONE)) for c, v in zip(levels, path, strict=True)}
    base = docs.select(*[F.col(f"`{c}`").alias(v) for c, v in own.items()], *([] if tokens is None else [tokens.alias("n_tokens")]))
    key, text = own[key], own.get(text)
    base = base.withColumns(named)
    if tokens is None:
        plain = base.select(*path, F.col(key).alias("_id"), F.col(text).alias("_n"))
        slim = plain.mapInArrow(_counted("_n"), T.StructType([*plain.schema.fields[:-1], T.StructField("_n", T.LongType())]))
        base = base.where(F.col(text).rlike(WORD)).withColumn("n_tokens", count_words(text))
    else:
        slim = base.select(*path, F.col(key).alias("_id"), F.col("n_tokens").cast("long").alias("_n"))
        base = base.where(F.col("n_tokens") > 0)
    slim = staged(slim.where(F.col("_n") > 0), "counts")

    leaves = staged(slim.groupBy(*path).agg(F.sum("_n").alias("_leaf"), F.count(F.lit(1)).alias("_rows")), "leaves")
    if bucket_digits is None:
        rows = leaves.agg(F.max("_rows")).first()[0] or 1
        bucket_digits = max(2, math.ceil(math.log(max(1, rows / BUCKET_ROWS), 16)))
    shares = leaf_budgets(leaves, path, "_leaf", {v: weights.get(c, {}) for c, v in zip(levels, path, strict=True)}, max_epochs, share, budget).where(F.col("_take") > 0)
    shares = staged(shares.withColumn("_whole", F.expr("CAST(_take div _leaf AS int)")).withColumn("_rest", F.expr("CAST(_take % _leaf AS bigint)")), "shares")
    n = shares.count()

    def order_key(column: Column) -> Column:
        return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_whole").cast("string"), F.coalesce(column.cast("string"), F.lit(""))).cast("binary"))

    # Where each leaf's share ends: the bucket of the order key, and the tokens before it.
    counted = _with_shares(slim, shares.where(F.col("_rest") > 0), path, ["_id", "_n"], n)
    sums = counted.groupBy(*path, F.substring(order_key(F.col("_id")), 1, bucket_digits).alias("_cut")).agg(F.sum("_n").alias("_sum"), F.first("_rest").alias("_rest"))
    ahead = Window.partitionBy(*path).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_ahead", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)))
    ends = sums.where((F.col("_ahead") < F.col("_rest")) & (F.col("_ahead") + F.col("_sum") >= F.col("_rest"))).select(*path, "_cut", "_ahead", "_rest")
    inside = _with_shares(slim, staged(ends.join(shares.select(*path, "_whole"), path), "ends"), path, ["_id", "_n"], n).withColumn("_key", order_key(F.col("_id")))
    inside = inside.where(F.substring("_key", 1, bucket_digits) == F.col("_cut"))
    upto = Window.partitionBy(*path).orderBy("_key", "_id", "_n").rowsBetween(Window.unboundedPreceding, -1)
    last = inside.withColumn("_begin", F.col("_ahead") + F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    # The row in which the share ends; equal rows before it are told apart by their number below.
    same = Window.partitionBy(*path, "_key", "_id", "_n")
    last = last.withColumn("_first", F.min("_begin").over(same)).where((F.col("_begin") < F.col("_rest")) & (F.col("_begin") + F.col("_n") >= F.col("_rest")))
    last = last.select(*path, F.struct(F.col("_key").alias("k"), F.col("_id").alias("i"), F.col("_n").alias("n")).alias("_last"), F.col("_first"))
    plan = staged(shares.join(last, path, "left"), "plan")

    x = _with_shares(base, plan, path, [key], n)
    x = x.withColumn("_here", F.struct(order_key(F.col(key)).alias("k"), F.col(key).alias("i"), F.col("n_tokens").cast("long").alias("n")))
    in_last = F.coalesce(F.col("_here") <= F.col("_last"), F.lit(False))
    x = x.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_whole")))).where((F.col("epoch") < F.col("_whole")) | in_last)
    at_end = (F.col("epoch") == F.col("_whole")) & F.coalesce(F.col("_here") == F.col("_last"), F.lit(False))
    done = x.where(~at_end).withColumn("take_tokens", F.col("n_tokens"))
    # One row of each leaf, or equal rows: the first ones fill the rest.
    nth = F.row_number().over(Window.partitionBy(*path).orderBy(F.lit(0))) - 1
    part = x.where(at_end).withColumn("_begin", F.col("_first") + nth * F.col("n_tokens")).where(F.col("_begin") < F.col("_rest"))
    part = part.withColumn("take_tokens", F.least(F.col("n_tokens"), F.col("_rest") - F.col("_begin")))
    out = [*[F.col(v).alias(c) for c, v in own.items() if c not in ("epoch", "n_tokens", "take_tokens")], "epoch", "n_tokens", "take_tokens"]
    return done.select(*out).unionByName(part.select(*out))
