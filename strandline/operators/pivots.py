"""Exact vector search over a metric index: vectors laid out by their nearest pivot.

The angle between vectors is a metric, so with a query at angle d of a pivot, a vector at angle r of the pivot
is at an angle of |d - r| at least.  The index is partitioned by pivot and sorted by r.  A search first reads the
partitions that could be nearest, and with the k-th similarity found only those rows of other partitions whose r
lies in reach: whole partitions are left out by their radii, row groups by r.

Pivots are vectors of a bounded, seeded sample; they decide what is read, never what is found.  Vectors without a
direction (empty, zero) and those of another length have similarity 0 and a partition of their own."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import staged
from .entities import check_limit
from .search import vector_topk

PIVOTS = 64
SAMPLE = 4096
#: Partitions that are read first.
FIRST = 4
#: Similarities are single precision and angles are computed twice; this is far more than both errors.
SLACK = 1e-3


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=-1, keepdims=True)


def choose_pivots(embeddings: DataFrame, n: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Pivots far from each other, out of a sample of at most ``sample`` vectors (those of least hash)."""
    rows = embeddings.select("ref_id", "vector").where("vector IS NOT NULL").orderBy(F.xxhash64("ref_id"), "ref_id").limit(sample).collect()
    sizes = [len(r["vector"]) for r in rows]
    common = max(set(sizes), key=sizes.count) if sizes else 0
    if not common:
        return np.zeros((0, 0))
    found = np.array([r["vector"] for r in rows if len(r["vector"]) == common], np.float64)
    found = _unit(found[np.linalg.norm(found, axis=1) > 0])
    if not len(found):
        return found
    chosen, nearest = [0], found @ found[0]
    while len(chosen) < min(n, len(found)):  # each next pivot is the vector farthest from all
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, found @ found[chosen[-1]])
    return found[chosen]


def laid_out(embeddings: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``embeddings`` with ``pivot`` (-1 without a direction or of another length) and ``r``, the angle to it."""

    @F.pandas_udf("pivot int, r double")
    def place(vectors: pd.Series) -> pd.DataFrame:
        pivot, r = np.full(len(vectors), -1, np.int32), np.zeros(len(vectors))
        if len(pivots):
            ok = [i for i, v in enumerate(vectors) if v is not None and len(v) == pivots.shape[1] and np.any(v)]
            if ok:
                sims = _unit(np.array([vectors.iloc[i] for i in ok], np.float64)) @ pivots.T
                pivot[ok] = sims.argmax(1)
                r[ok] = np.arccos(np.clip(sims.max(1), -1, 1))
        return pd.DataFrame({"pivot": pivot, "r": r})

    return embeddings.withColumn("_p", place("vector")).select("*", "_p.pivot", "_p.r").drop("_p")


class PivotIndex:
    """``path`` has the vectors by pivot; ``radii`` (pivot, low, high, n) is a row for each pivot."""

    def __init__(self, rows: DataFrame, pivots: np.ndarray):
        self.rows, self.pivots = rows, pivots
        self.radii = [r.asDict() for r in rows.groupBy("pivot").agg(F.min("r").alias("low"), F.max("r").alias("high"), F.count(F.lit(1)).alias("n")).collect()]
        #: Of the last search: rows of the partitions and ranges that it read.
        self.n_read = 0

    @classmethod
    def build(cls, embeddings: DataFrame, path: str, pivots: np.ndarray | None = None) -> PivotIndex:
        pivots = choose_pivots(embeddings) if pivots is None else pivots
        # A hot pivot's rows go to several files, by r.
        placed = laid_out(embeddings, pivots)
        placed.repartitionByRange("pivot", "r").sortWithinPartitions("pivot", "r").write.partitionBy("pivot").parquet(path)
        return cls(embeddings.sparkSession.read.schema(placed.schema).parquet(path), pivots)

    def topk(self, vector, limit: int = 10, ref_type: str | None = "chunk", digits: int | None = None) -> DataFrame:
        """(ref_id, similarity), equal to :func:`vector_topk` over all vectors."""
        check_limit(limit)
        query = np.asarray(vector, np.float64)
        if not len(self.pivots) or len(query) != self.pivots.shape[1] or not np.any(query):
            self.n_read = sum(p["n"] for p in self.radii)
            return vector_topk(self.rows, vector, limit, ref_type, digits)
        to = np.arccos(np.clip(self.pivots @ _unit(query), -1, 1))
        bound = {p["pivot"]: max(0.0, to[p["pivot"]] - p["high"], p["low"] - to[p["pivot"]]) if p["pivot"] >= 0 else np.pi / 2 for p in self.radii}
        order = sorted(bound, key=lambda p: (bound[p], to[p] if p >= 0 else np.pi))
        first, rest = order[:FIRST], order[FIRST:]
        size = {p["pivot"]: p["n"] for p in self.radii}
        near = staged(vector_topk(self.rows.where(F.col("pivot").isin(first)), vector, limit, ref_type, digits), "near")
        got = near.agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("least")).first()
        reach = np.pi
        if got["n"] == limit and limit:
            reach = float(np.arccos(np.clip(got["least"] - (10.0 ** -digits if digits is not None else 0), -1, 1))) + SLACK
        rest = [p for p in rest if bound[p] <= reach]
        self.n_read = sum(size[p] for p in first)
        if rest and limit:
            test = F.lit(False)
            for p in rest:  # a test for each pivot: partitions by value, row groups by the range of r
                test = test | ((F.col("pivot") == p) & (F.col("r").between(float(to[p] - reach), float(to[p] + reach)) if p >= 0 else F.lit(True)))
            others = self.rows.where(test)
            self.n_read += others.select("r").count()
            near = near.unionByName(vector_topk(others, vector, limit, ref_type, digits))
        return near.orderBy(F.col("similarity").desc(), "ref_id").limit(limit)
