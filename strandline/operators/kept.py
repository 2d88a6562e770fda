"""Answers and vectors that are kept: each distinct text goes to a model once.

Answers are keyed by (model, prompt, content hash).  A request takes the distinct texts of its rows that have no answer
yet, asks for them (a bounded number of calls at a time, each repeated after a failure), adds the answers to the table,
and joins them to all rows; so equal texts, a second run and a batch that is repeated cost no call.  An answer of a
text that two writers asked for at the same time is in the table twice; one is taken."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CALLS = 8
ATTEMPTS = 4
FIRST_PAUSE = 0.5
SCHEMA = "model string, prompt string, hash string, answer string, vector array<float>"


def name_of(provider) -> str:
    """What tells models apart: the name that a provider gives itself (``model``), else its class."""
    return str(getattr(provider, "model", "") or type(provider).__qualname__)


def persistent(call: Callable, attempts: int = ATTEMPTS, pause: float = FIRST_PAUSE):
    """``call``, again after a failure, with pauses that double; the last failure is raised."""

    def repeated(*args):
        for k in range(attempts):
            try:
                return call(*args)
            except Exception:
                if k == attempts - 1:
                    raise
                time.sleep(pause * 2**k)

    return repeated


class KeptAnswers:
    """The answers below ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, calls: int = CALLS, attempts: int = ATTEMPTS, pause: float = FIRST_PAUSE):
        self.spark, self.path, self.calls, self.attempts, self.pause = spark, path.rstrip("/"), calls, attempts, pause
        self.table().limit(0).write.mode("append").parquet(self.path)

    def table(self) -> DataFrame:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        there = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(SCHEMA).parquet(self.path) if there else self.spark.createDataFrame([], SCHEMA)

    def _known(self, model: str, prompt: str) -> DataFrame:
        return self.table().where((F.col("model") == model) & (F.col("prompt") == prompt))

    def _hashed(self, rows: DataFrame, content: str) -> DataFrame:
        return rows.withColumn("_hash", F.sha2(F.coalesce(F.col(content), F.lit("")), 256))

    def _fill(self, rows: DataFrame, content: str, model: str, prompt: str, ask: Callable[[list[str]], tuple[list, list]]) -> DataFrame:
        """``rows`` with ``_hash``, after all their texts have an answer."""
        rows = self._hashed(rows, content)
        texts = rows.groupBy("_hash").agg(F.first(F.coalesce(F.col(content), F.lit(""))).alias("text"))  # equal texts meet before they are asked
        open_ = texts.join(self._known(model, prompt).select(F.col("hash").alias("_hash")), "_hash", "left_anti").select(F.col("_hash").alias("hash"), "text")

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                answers, vectors = ask(frame["text"].tolist())
                yield pd.DataFrame({"model": model, "prompt": prompt, "hash": frame["hash"], "answer": answers, "vector": vectors})

        open_.mapInPandas(run, SCHEMA).write.mode("append").parquet(self.path)
        return rows

    def answers(self, rows: DataFrame, model, content: str = "content", prompt: str = "") -> DataFrame:
        """``rows`` with ``answer``, the model's reply to each text."""
        name, key = name_of(model), hashlib.sha256(prompt.encode()).hexdigest()
        call, calls = persistent(lambda text: model.extract(text, prompt), self.attempts, self.pause), self.calls

        def ask(texts: list[str]) -> tuple[list, list]:
            with ThreadPoolExecutor(calls) as pool:
                return list(pool.map(call, texts)), [None] * len(texts)

        rows = self._fill(rows, content, name, key, ask)
        known = self._known(name, key).groupBy("hash").agg(F.min("answer").alias("answer"))
        return rows.join(known, F.col("_hash") == F.col("hash"), "left").drop("_hash", "hash")

    def vectors(self, rows: DataFrame, embedder, content: str = "content", into: str = "vector", batch: int = 64) -> DataFrame:
        """``rows`` with a vector of each text; a call gets up to ``batch`` texts."""
        name, calls = name_of(embedder), self.calls
        call = persistent(lambda texts: [[float(x) for x in v] for v in embedder.embed(texts)], self.attempts, self.pause)

        def ask(texts: list[str]) -> tuple[list, list]:
            with ThreadPoolExecutor(calls) as pool:
                parts = pool.map(call, [texts[i : i + batch] for i in range(0, len(texts), batch)])
                return [None] * len(texts), [v for part in parts for v in part]

        rows = self._fill(rows, content, name, "embedding", ask)
        known = self._known(name, "embedding").groupBy("hash").agg(F.min("vector").alias(into))
        return rows.join(known, F.col("_hash") == F.col("hash"), "left").drop("_hash", "hash")
