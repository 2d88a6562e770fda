"""Graph, text and vector relations projected from the star schema and the corpora.

The SQL is plain enough for Spark and for the oracle engine alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _id(kind: str, column: str) -> str:
    return f"'{kind}:' || CAST({column} AS STRING)"


SQL = {
    "entities": " UNION ALL ".join(
        f"SELECT {_id(kind, key)} AS id, '{kind}' AS type, {name} AS name, '{{}}' AS attributes, {source} AS source FROM {{{table}}}"
        for kind, key, name, source, table in [
            ("region", "r_regionkey", "r_name", "'geo'", "region"),
            ("nation", "n_nationkey", "n_name", "'geo'", "nation"),
            ("customer", "c_custkey", "c_name", "'tpch'", "customer"),
            ("supplier", "s_suppkey", "s_name", "'tpch'", "supplier"),
            ("part", "p_partkey", "p_name", "'tpch'", "part"),
            ("document", "doc_id", "'doc-' || CAST(doc_id AS STRING)", "source", "documents"),
        ]
    )
    + " UNION ALL SELECT 'conversation:' || CAST(conv_id AS STRING), 'conversation', 'talk-' || CAST(conv_id AS STRING), '{}', 'chat' || CAST(conv_id % 3 AS STRING) FROM (SELECT DISTINCT conv_id FROM {conversations}) c",
    "relationships": "SELECT type || ':' || source_id || '>' || target_id AS id, source_id, target_id, type, '{}' AS attributes, 'tpch' AS source FROM ("
    + " UNION ALL ".join(
        f"SELECT {_id(a, x)} AS source_id, {_id(b, y)} AS target_id, '{kind}' AS type FROM {table}"
        for a, x, kind, b, y, table in [
            ("nation", "n_nationkey", "part_of", "region", "n_regionkey", "{nation}"),
            ("customer", "c_custkey", "located_in", "nation", "c_nationkey", "{customer}"),
            ("supplier", "s_suppkey", "located_in", "nation", "s_nationkey", "{supplier}"),
            ("supplier", "l_suppkey", "supplies", "part", "l_partkey", "(SELECT DISTINCT l_suppkey, l_partkey FROM {lineitem}) s"),
            ("customer", "o_custkey", "bought", "part", "l_partkey", "(SELECT DISTINCT o_custkey, l_partkey FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey) b"),
        ]
    )
    + ") r",
    "chunks": "SELECT 'chunk:' || CAST(doc_id AS STRING) AS id, 'document:' || CAST(doc_id AS STRING) AS entity_id, text AS content, '{{\"source\":\"' || source || '\"}}' AS metadata, source FROM {documents}",
    "memories": "SELECT 'memory:' || CAST(conv_id AS STRING) || ':' || CAST(turn AS STRING) AS id, text AS content, role AS source FROM {conversations}",
    "memory_entities": "SELECT 'memory:' || CAST(conv_id AS STRING) || ':' || CAST(turn AS STRING) AS memory_id, 'conversation:' || CAST(conv_id AS STRING) AS entity_id FROM {conversations}",
    "refs": "SELECT 'emb:' || CAST(vec_id AS STRING) AS id, 'chunk:' || CAST(vec_id AS STRING) AS ref_id, 'chunk' AS ref_type FROM {embeddings} UNION ALL SELECT 'emb:m:' || CAST(conv_id AS STRING) || ':' || CAST(turn AS STRING), 'memory:' || CAST(conv_id AS STRING) || ':' || CAST(turn AS STRING), 'memory' FROM {conversations}",
    "notes": "SELECT c_custkey AS doc_id, '---' || chr(10) || 'type: customer' || chr(10) || 'name: ' || c_name || chr(10) || 'segment: ' || c_mktsegment || chr(10) || 'balance: ' || CAST(CAST(floor(c_acctbal) AS INT) AS STRING) || chr(10) || '---' || chr(10) || 'In [[' || n_name || ']] with [[ ' || c_mktsegment || ' ]] and [[' || n_name || ']].' AS content FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey",
    "answers": "SELECT c_custkey AS doc_id, 'note ' || CAST(c_custkey AS STRING) AS content, CASE WHEN c_custkey % 2 = 0 THEN '```json' || chr(10) ELSE '' END || '{{\"entities\":[{{\"type\":\"customer\",\"name\":\"' || c_name || '\"}},{{\"type\":\"nation\",\"name\":\"' || n_name || '\"}}],\"relationships\":[{{\"source\":\"' || c_name || '\",\"target\":\"' || n_name || '\",\"type\":\"located_in\"}},{{\"source\":\"' || c_name || '\",\"target\":\"Nowhere\",\"type\":\"lost\"}}],\"memories\":[{{\"content\":\"' || c_name || ' lives in ' || n_name || '\"}},\"segment ' || c_mktsegment || '\",\"\"]}}' || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || '```' ELSE '' END AS answer FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey",
    "scripts": "SELECT 'chunk:' || CAST(c_custkey AS STRING) AS id, c_custkey % 7 AS kind, CASE c_custkey % 7 WHEN 0 THEN 'Đường Việt Nam' WHEN 1 THEN '한국 사람' WHEN 2 THEN 'Йод и йод' WHEN 3 THEN 'かな カナ' WHEN 4 THEN 'Café' WHEN 5 THEN 'Η ΟΔΟΣ' ELSE 'иод viet οδός' END AS content FROM {customer}",
    "files": "SELECT doc_id, 'dir/' || source || '/f' || CAST(doc_id AS STRING) || CASE doc_id % 13 WHEN 0 THEN '.md' WHEN 1 THEN '.CSV' WHEN 2 THEN '.tsv' WHEN 3 THEN '.yaml' WHEN 4 THEN '.yml' WHEN 5 THEN '.Json' WHEN 6 THEN '.txt' WHEN 7 THEN '.xml' WHEN 8 THEN '.toml' WHEN 9 THEN '.log' WHEN 10 THEN '.png' WHEN 11 THEN '.tar.exe' ELSE '' END AS path FROM {documents}",
}
SQL["entities"] = SQL["entities"].replace("'{}'", "'{{}}'")
SQL["relationships"] = SQL["relationships"].replace("'{}'", "'{{}}'")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A projected relation; entities, relationships and memories get a constant created_at."""
    used = {t: load(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in SQL[name]}
    df = spark.sql(SQL[name], **used)
    if name in ("entities", "relationships", "memories", "chunks"):
        df = df.withColumn("created_at", F.timestamp_seconds(F.lit(0)))
    return df.withColumn("updated_at", F.col("created_at")) if name in ("entities", "memories") else df


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select(F.concat(F.lit("emb:"), F.col("vec_id").cast("string")).alias("id"), F.concat(F.lit("chunk:"), F.col("vec_id").cast("string")).alias("ref_id"), F.lit("chunk").alias("ref_type"), F.col("embedding").alias("vector"))


def with_sql(*names: str, recursive: bool = False) -> str:
    """``WITH name AS (...)`` for the oracle engine."""
    parts = [f"{n} AS ({SQL[n].format(**{t: t for t in TABLES})})" for n in names]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(parts)
