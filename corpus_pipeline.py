"""The corpus pipeline: language ID, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``.  Every stage works on all that
its predecessor kept, and all but the last return the columns of ``documents``.

* ``language_id`` drops documents without a letter and those that no language compresses clearly
  best, by one margin for all lengths; a null ``lang`` gets the predicted one.
* ``near_duplicates`` keeps the smallest doc_id of every class of near duplicates (five-word
  shingles, similarity 0.8).
* ``decontaminate`` cuts benchmark passages out of texts and drops documents that are mostly
  such passages; ``n_chars`` follows the text.
* ``mix`` takes whole documents from each source's seeded order up to its share.
* ``shard`` deals the rest to shards and numbers them; the corpus' own columns come with it.

Columns of ``documents`` that are named like a result of an operator pass through unchanged; beside
them the last stage's result of that name is called ``out_<name>``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import decontaminate as decontamination
from strandline.llm import jaccard_join, langid, mixing, sharding
from strandline.llm.queries import DOMAIN_SQL, MIX_SEED, MIX_WEIGHTS
from strandline.llm.staging import fresh, staged, table

SHARE = (4, 5)
SHARDS = 40


def _aside(docs: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns of these names renamed, and how to name them back."""
    away = {name: fresh(docs.columns, f"_own_{name}") for name in names if name in docs.columns}
    return docs.withColumnsRenamed(away), {v: k for k, v in away.items()}


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, back = _aside(docs, ["lang_pred", "lang_score", "lang_margin", "lang_rejected"])
    kept = langid.classify(rows, langid.train(docs)).where(~F.col("lang_rejected"))
    named = kept.withColumn("lang", F.coalesce("lang", "lang_pred")).drop("lang_pred", "lang_score", "lang_margin", "lang_rejected")
    return named.withColumnsRenamed(back).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, back = _aside(docs, ["domain", "epoch", "n_tokens", "take_tokens"])
    placed = rows.withColumn("domain", F.expr(DOMAIN_SQL))
    mixed = mixing.mix(placed, weights=MIX_WEIGHTS, share=SHARE, max_epochs=1, seed=MIX_SEED)
    return mixed.drop("domain", "epoch", "n_tokens", "take_tokens").withColumnsRenamed(back).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(docs, n_shards=SHARDS, keep=True)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

#: SQL can't express compression, suffix automata or exact similarity classes at this size.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
