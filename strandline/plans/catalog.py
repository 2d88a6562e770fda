"""The registered queries with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract, vectors
from ..functions.text import sentences
from ..operators import entities as E
from ..operators import forget, graph, ingest, recall, search
from ..sources import connectors
from ..sources.store import KnowledgeStore
from ..staging import shared_folder, staged
from . import fixtures as X
from .fixtures import view, with_sql
from .splitting import split_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


# Scans, lookups, filters

COLUMNS = ["id", "type", "name", "source"]
ENT = with_sql("entities")


@query("scan_entities", f"{ENT} SELECT id, type, name, source FROM entities")
def scan_entities(spark, d):
    return E.find_entities(view(spark, d, "entities")).select(*COLUMNS)


@query("get_entity", f"{ENT} SELECT id, type, name, source FROM entities WHERE id = 'customer:7'")
def get_entity(spark, d):
    return E.get_entity(view(spark, d, "entities"), "customer:7").select(*COLUMNS)


@query("find_entities_type", f"{ENT} SELECT id, type, name, source FROM entities WHERE type = 'nation'")
def find_entities_type(spark, d):
    return E.find_entities(view(spark, d, "entities"), type="nation").select(*COLUMNS)


@query("find_entities_name_like", f"{ENT} SELECT id, type, name, source FROM entities WHERE name ILIKE '%C%0_1%'")
def find_entities_name_like(spark, d):
    return E.find_entities(view(spark, d, "entities"), name_like="%C%0_1%").select(*COLUMNS)


@query("find_entities_source", f"{ENT} SELECT id, type, name, source FROM entities WHERE source = 'geo'")
def find_entities_source(spark, d):
    return E.find_entities(view(spark, d, "entities"), source="geo").select(*COLUMNS)


@query("find_entities_combined", f"{ENT} SELECT id, type, name, source FROM entities WHERE type = 'nation' AND name ILIKE '%a%' AND source = 'geo'")
def find_entities_combined(spark, d):
    return E.find_entities(view(spark, d, "entities"), type="nation", name_like="%A%", source="geo").select(*COLUMNS)


# Relationships and traversal

REL = with_sql("relationships")
EDGE = ["id", "source_id", "target_id", "type"]
PLACES = ["located_in", "part_of"]


@query("relationships_of_entity", f"{REL} SELECT id, source_id, target_id, type FROM relationships WHERE source_id = 'nation:3' OR target_id = 'nation:3'")
def relationships_of_entity(spark, d):
    return E.relationships_of(view(spark, d, "relationships"), "nation:3").select(*EDGE)


@query("relationships_by_type", f"{REL} SELECT id, source_id, target_id, type FROM relationships WHERE (source_id = 'nation:3' OR target_id = 'nation:3') AND type = 'part_of'")
def relationships_by_type(spark, d):
    return E.relationships_of(view(spark, d, "relationships"), "nation:3", ["part_of"]).select(*EDGE)


@query(
    "relationships_of_many",
    f"{REL} SELECT entity_id, count(*) AS n_relationships FROM (SELECT source_id AS entity_id, id FROM relationships UNION SELECT target_id, id FROM relationships) x WHERE entity_id LIKE 'nation:%' GROUP BY entity_id",
)
def relationships_of_many(spark, d):
    ids = view(spark, d, "entities").where("type = 'nation'").select("id")
    return E.relationships_of(view(spark, d, "relationships"), ids).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_relationships"))


@query(
    "relationship_fk_check",
    with_sql("entities", "relationships") + " SELECT id FROM relationships r WHERE NOT EXISTS (SELECT 1 FROM entities e WHERE e.id = r.source_id AND e.type <> 'supplier') OR NOT EXISTS (SELECT 1 FROM entities e WHERE e.id = r.target_id AND e.type <> 'supplier')",
)
def relationship_fk_check(spark, d):
    known = view(spark, d, "entities").where("type <> 'supplier'")
    return E.dangling_relationships(view(spark, d, "relationships"), known).select("id")


def _reach_sql(depth: int, types: list[str]) -> str:
    listed = ", ".join(f"'{t}'" for t in types)
    return (
        with_sql("relationships", "entities", recursive=True)
        + f", rel AS (SELECT * FROM relationships WHERE type IN ({listed})), und AS (SELECT source_id AS a, target_id AS b FROM rel UNION SELECT target_id, source_id FROM rel), "
        + f"walk(id, level) AS (SELECT 'customer:0', 0 UNION SELECT b, level + 1 FROM walk JOIN und ON a = walk.id WHERE level < {depth}), reach AS (SELECT id, CAST(min(level) AS INTEGER) AS level FROM walk GROUP BY id) "
    )


def _edges_sql(depth: int, types: list[str]) -> str:
    return _reach_sql(depth, types) + f"SELECT id, source_id, target_id, type FROM rel WHERE source_id IN (SELECT id FROM reach WHERE level < {depth}) OR target_id IN (SELECT id FROM reach WHERE level < {depth})"


def _walk(spark, d, depth, types=PLACES, **options):
    # The fixtures' edges are joins and distincts over the star schema; a graph's own are a table.
    return graph.traverse(view(spark, d, "entities"), staged(view(spark, d, "relationships"), "relationships"), "customer:0", depth, types, **options)


@query("traverse_depth0", _reach_sql(0, PLACES) + "SELECT e.id, e.name, level FROM reach JOIN entities e ON e.id = reach.id")
def traverse_depth0(spark, d):
    return _walk(spark, d, 0)[0].select("id", "name", "level")


@query("traverse_depth1", _edges_sql(1, PLACES))
def traverse_depth1(spark, d):
    return _walk(spark, d, 1)[1].select(*EDGE)


@query("traverse_depth2", _edges_sql(2, PLACES))
def traverse_depth2(spark, d):
    return _walk(spark, d, 2)[1].select(*EDGE)


@query("traverse_edge_types", _edges_sql(2, ["located_in"]))
def traverse_edge_types(spark, d):
    return _walk(spark, d, 2, ["located_in"])[1].select(*EDGE)


@query("traverse_nodes", _reach_sql(2, PLACES) + "SELECT e.id, e.type, e.name, level FROM reach JOIN entities e ON e.id = reach.id")
def traverse_nodes(spark, d):
    return _walk(spark, d, 2)[0].select("id", "type", "name", "level")


@query("traverse_levels", _reach_sql(4, PLACES) + "SELECT level, count(*) AS n_nodes FROM reach GROUP BY level")
def traverse_levels(spark, d):
    return graph.levels(view(spark, d, "relationships"), "customer:0", 4, PLACES).groupBy("level").agg(F.count(F.lit(1)).alias("n_nodes"))


@query(
    "traverse_multiset",
    _reach_sql(2, PLACES) + "SELECT id, CAST((source_id IN (SELECT id FROM reach WHERE level < 2))::INT + (target_id <> source_id AND target_id IN (SELECT id FROM reach WHERE level < 2))::INT AS BIGINT) AS times FROM rel WHERE source_id IN (SELECT id FROM reach WHERE level < 2) OR target_id IN (SELECT id FROM reach WHERE level < 2)",
)
def traverse_multiset(spark, d):
    return _walk(spark, d, 2, edge_multiplicity="reference")[1].groupBy("id").agg(F.count(F.lit(1)).alias("times"))


# Keyword search

TOKENS = "tok AS (SELECT doc_id, list_transform(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda t: strip_accents(t)) AS toks FROM documents), pst AS (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term, unnest(range(len(toks))) AS pos FROM tok), st AS (SELECT count(*)::DOUBLE AS n, avg(len(toks)) AS avgdl FROM tok)"


@query("postings", f"WITH {TOKENS} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS occurrences, min(pos) AS first_pos FROM pst GROUP BY term")
def postings(spark, d):
    index = search.postings(view(spark, d, "chunks"))
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("occurrences"), F.min(F.col("positions")[0]).cast("long").alias("first_pos"))


@query("bm25_stats", f"WITH {TOKENS} SELECT count(*) AS n_chunks, CAST(sum(len(toks)) AS BIGINT) AS n_tokens, round(avg(len(toks)), 6) AS avgdl FROM tok")
def bm25_stats(spark, d):
    return search.corpus_stats(view(spark, d, "chunks")).withColumn("avgdl", F.round("avgdl", 6))


def _bm25_ctes(phrases: list[tuple[list[str], bool]], holds: str, freqs: list[str] | None = None) -> str:
    """``hit(doc_id, score)`` for phrases (terms, is prefix) under a condition over f0, f1, ..."""
    parts = []
    for i, (terms, prefix) in enumerate(phrases):
        test = lambda a, t, last: f"starts_with({a}.term, '{t}')" if prefix and last else f"{a}.term = '{t}'"  # noqa: E731, B023
        joins = "".join(f" JOIN pst p{k} ON p{k}.doc_id = p0.doc_id AND p{k}.pos = p0.pos + {k} AND {test(f'p{k}', t, k == len(terms) - 1)}" for k, t in enumerate(terms) if k)
        parts.append(f"ph{i} AS (SELECT p0.doc_id, count(*)::DOUBLE AS f FROM pst p0{joins} WHERE {test('p0', terms[0], len(terms) == 1)} GROUP BY p0.doc_id)")
    cols = ", ".join(f"{freqs[i] if freqs else f'coalesce(ph{i}.f, 0)'} AS f{i}" for i in range(len(phrases)))
    joins = "".join(f" LEFT JOIN ph{i} ON ph{i}.doc_id = tok.doc_id" for i in range(len(phrases)))
    idf = [f"(SELECT CASE WHEN ln((st.n - count(*) + 0.5) / (count(*) + 0.5)) <= 0 THEN 1e-6 ELSE ln((st.n - count(*) + 0.5) / (count(*) + 0.5)) END FROM ph{i}, st GROUP BY st.n)" for i in range(len(phrases))]
    score = " + ".join(f"coalesce({idf[i]}, 0) * (f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / st.avgdl)))" for i in range(len(phrases)))
    return f"{TOKENS}, {', '.join(parts)}, per AS (SELECT tok.doc_id, len(toks) AS dl, {cols} FROM tok{joins}), hit AS (SELECT doc_id, round({score}, 6) AS score FROM per, st WHERE {holds})"


def _keyword_sql(phrases, holds, limit=10, freqs=None) -> str:
    return f"WITH {_bm25_ctes(phrases, holds, freqs)} SELECT 'chunk:' || doc_id AS id, score FROM hit ORDER BY score DESC, 'chunk:' || doc_id LIMIT {limit}"


def _keyword(spark, d, text, limit=10):
    return search.search_keyword(view(spark, d, "chunks"), text, limit, digits=6).select("id", "score")


@query("search_keyword", _keyword_sql([(["licensed"], False), (["apache"], False)], "f0 > 0 AND f1 > 0"))
def search_keyword(spark, d):
    return _keyword(spark, d, "licensed Apache")


@query("search_keyword_or", _keyword_sql([(["idiot"], False), (["mit"], False)], "f0 > 0 OR f1 > 0", 20))
def search_keyword_or(spark, d):
    return _keyword(spark, d, "idiot OR mit", 20)


@query("search_keyword_not", _keyword_sql([(["licensed"], False), (["apache"], False)], "f0 > 0 AND NOT f1 > 0"))
def search_keyword_not(spark, d):
    return _keyword(spark, d, "licensed NOT apache")


@query("search_keyword_mixed", _keyword_sql([(["licensed"], False), (["apache"], False), (["the"], False)], "f0 > 0 AND NOT f1 > 0 AND f2 > 0", 20))
def search_keyword_mixed(spark, d):
    return _keyword(spark, d, "licensed NOT apache AND the", 20)


@query("search_keyword_scripts", with_sql("scripts") + " SELECT id FROM scripts WHERE kind IN (0, 1, 2, 4, 5)")
def search_keyword_scripts(spark, d):
    found = search.search_keyword(view(spark, d, "scripts"), '"việt nam" OR 한국 OR ЙОД OR cafe OR "η οδοσ"', 1_000_000)
    return found.select("id")


@query("search_keyword_prefix", _keyword_sql([(["licens"], True), (["work"], False)], "f0 > 0 AND f1 > 0"))
def search_keyword_prefix(spark, d):
    return _keyword(spark, d, "licens* work")


@query("search_keyword_phrase", _keyword_sql([(["general", "public", "license"], False)], "f0 > 0"))
def search_keyword_phrase(spark, d):
    return _keyword(spark, d, '"general public license"')


def _near_sql(word: str, other: str) -> str:
    return f"(SELECT count(DISTINCT a.pos)::DOUBLE FROM pst a JOIN pst b ON a.doc_id = b.doc_id AND abs(b.pos - a.pos) - 1 <= 3 WHERE a.doc_id = tok.doc_id AND a.term = '{word}' AND b.term = '{other}')"


@query("search_keyword_near", _keyword_sql([(["released"], False), (["license"], False)], "f0 > 0 AND f1 > 0", freqs=[_near_sql("released", "license"), _near_sql("license", "released")]))
def search_keyword_near(spark, d):
    return _keyword(spark, d, "NEAR(released license, 3)")


# Vectors


def _vector(spark, d, vec_id):
    row = X.load(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row[0])


def _cosine_sql(a: str, b: str) -> str:
    return f"round(CAST(CAST(list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]) AS FLOAT) AS DOUBLE), 6)"


def _topk_sql(vec_id: int, limit: int) -> str:
    return f"SELECT 'chunk:' || e.vec_id AS ref_id, {_cosine_sql('e.embedding', 'q.embedding')} AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {vec_id}) q ORDER BY similarity DESC, ref_id LIMIT {limit}"


@query("vector_topk", _topk_sql(0, 10))
def vector_topk(spark, d):
    return search.vector_topk(X.embeddings(spark, d), _vector(spark, d, 0), 10, digits=6)


@query("vector_cosine_pairs", f"SELECT a.vec_id, {_cosine_sql('a.embedding', 'b.embedding')} AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_cosine_pairs(spark, d):
    a = X.load(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return a.join(b, "vec_id").select("vec_id", F.round(vectors.cosine(F.col("v"), F.col("w")).cast("float").cast("double"), 6).alias("similarity"))


@query("search_vector", f"{with_sql('chunks')}, top AS ({_topk_sql(3, 10)}) SELECT id, entity_id, similarity FROM top JOIN chunks ON id = ref_id")
def search_vector(spark, d):
    return search.search_vector(X.embeddings(spark, d), view(spark, d, "chunks"), _vector(spark, d, 3), 10, digits=6).select("id", "entity_id", "similarity")


BYTES = "SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS h FROM documents"


@query(
    "embed_chunks",
    f"WITH b AS ({BYTES}), u AS (SELECT doc_id, unnest(h) AS x, unnest(range(len(h))) % 8 AS k FROM b), s AS (SELECT doc_id, k, sum(CAST('0x' || x AS INTEGER))::DOUBLE AS v FROM u GROUP BY ALL), n AS (SELECT doc_id, sqrt(sum(v * v)) AS norm FROM s GROUP BY doc_id), "
    "g AS (SELECT doc_id, k FROM documents, range(8) r(k)) SELECT doc_id, string_agg(CAST(CAST(floor(CAST(CAST(coalesce(v / norm, 0) AS FLOAT) AS DOUBLE) * 1e6) AS BIGINT) AS VARCHAR), ' ' ORDER BY k) AS vector FROM g LEFT JOIN s USING (doc_id, k) LEFT JOIN n USING (doc_id) GROUP BY doc_id",
)
def embed_chunks(spark, d):
    return X.load(spark, d, "documents").select("doc_id", F.array_join(F.transform(vectors.embed("text"), lambda x: F.floor(x.cast("double") * 1e6).cast("string")), " ").alias("vector"))


@query("vector_codec", "SELECT vec_id, CAST(4 * len(embedding) AS INTEGER) AS n_bytes, true AS same FROM embeddings")
def vector_codec(spark, d):
    raw = X.load(spark, d, "embeddings").withColumn("raw", vectors.encode_floats("embedding"))
    return raw.select("vec_id", F.length("raw").alias("n_bytes"), (vectors.decode_floats(F.concat("raw", F.unhex(F.lit("00FF")))) == F.col("embedding")).alias("same"))


# Memories

MEM = with_sql("memories", "memory_entities")


@query("search_memories", f"{MEM} SELECT id, source FROM memories WHERE content ILIKE '%thly%' OR content ILIKE '%er_ha%' ORDER BY id LIMIT 10")
def search_memories(spark, d):
    return E.search_memories(view(spark, d, "memories"), " Thly  er_ha ", 10).select("id", "source")


LINKED = "SELECT m.id, m.source, coalesce(string_agg(entity_id, ',' ORDER BY entity_id), '') AS entity_ids FROM memories m LEFT JOIN memory_entities l ON l.memory_id = m.id"


@query("memories_by_entity", f"{MEM} {LINKED} WHERE m.id IN (SELECT memory_id FROM memory_entities WHERE entity_id = 'conversation:5') GROUP BY m.id, m.source")
def memories_by_entity(spark, d):
    found = E.memories_by_entity(view(spark, d, "memories"), view(spark, d, "memory_entities"), "conversation:5")
    return found.select("id", "source", F.array_join("entity_ids", ",").alias("entity_ids"))


@query("memories_with_links", f"{MEM} {LINKED} GROUP BY m.id, m.source")
def memories_with_links(spark, d):
    return E.with_links(view(spark, d, "memories"), view(spark, d, "memory_entities")).select("id", "source", F.array_join("entity_ids", ",").alias("entity_ids"))


@query("orphan_memories", f"{MEM} SELECT id FROM memories WHERE id NOT IN (SELECT memory_id FROM memory_entities WHERE entity_id NOT LIKE '%7')")
def orphan_memories(spark, d):
    return forget.orphan_memories(view(spark, d, "memories"), view(spark, d, "memory_entities").where("entity_id NOT LIKE '%7'")).select("id")


# Recall

RANKED = "SELECT c_custkey AS id, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS rank, 0 AS list_id FROM customer UNION ALL SELECT o_custkey, row_number() OVER (ORDER BY sum(CAST(round(o_totalprice * 100) AS BIGINT)) DESC, o_custkey) - 1, 1 FROM orders GROUP BY o_custkey"


@query("rrf_merge", f"SELECT id, round(sum(1.0::DOUBLE / (60 + rank + 1)), 9) AS score FROM ({RANKED}) r GROUP BY id")
def rrf_merge(spark, d):
    ranked = lambda df, i: recall.ranked_whole(df, [F.col("x").desc(), F.col("id")]).select("id", "rank", F.lit(i).alias("list_id"))
    rich = X.load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"))
    busy = X.load(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("x"))
    return recall.rrf_merge(ranked(rich, 0).unionByName(ranked(busy, 1))).withColumn("score", F.round("score", 9))


def _sources(spark, d, edges: bool = False) -> recall.Sources:
    relationships = view(spark, d, "relationships") if edges else None
    return recall.Sources(spark, view(spark, d, "entities"), relationships, *[view(spark, d, n) for n in ("chunks", "memories", "memory_entities")], X.embeddings(spark, d))



def _results(df: DataFrame) -> DataFrame:
    return df.select("result_type", "key", "content", "score", F.array_join("entity_ids", ",").alias("entity_ids"), "source")


def _memory_list(words: list[str], limit: int = 20) -> str:
    test = " OR ".join(f"content ILIKE '%{w}%'" for w in words)
    return f"SELECT 'memory' AS result_type, 'mem:' || m.id AS key, content, (SELECT string_agg(entity_id, ',' ORDER BY entity_id) FROM memory_entities l WHERE l.memory_id = m.id) AS entity_ids, source, row_number() OVER (ORDER BY m.id) - 1 AS rank FROM (SELECT * FROM memories WHERE {test} ORDER BY id LIMIT {limit}) m"


def _chunk_list(ranked: str) -> str:
    """``ranked`` gives (id, score)."""
    return f"SELECT 'chunk' AS result_type, 'chunk:' || c.id AS key, content, entity_id AS entity_ids, source, row_number() OVER (ORDER BY h.score DESC, c.id) - 1 AS rank FROM ({ranked}) h JOIN chunks c ON c.id = h.id"


def _keyword_list(limit: int = 20) -> str:
    return _chunk_list(f"SELECT 'chunk:' || doc_id AS id, score FROM hit ORDER BY score DESC, 'chunk:' || doc_id LIMIT {limit}")


def _vector_list(vec_id: int, limit: int = 20) -> str:
    return _chunk_list(f"SELECT ref_id AS id, similarity AS score FROM ({_topk_sql(vec_id, limit)}) v")


GRAPH_LIST = (
    "SELECT 'entity' AS result_type, 'entity:' || n.id AS key, n.name || ' (' || n.type || ')' || coalesce(' [' || (SELECT string_agg(r.type, ', ' ORDER BY r.type) FROM relationships r WHERE (r.source_id = f.id OR r.target_id = f.id) AND (r.source_id = n.id OR r.target_id = n.id)) || ']', '') AS content, n.id AS entity_ids, n.source, "
    "CASE WHEN n.id = f.id THEN 0 ELSE row_number() OVER (ORDER BY n.id <> f.id, n.id) - 1 END AS rank FROM (SELECT id FROM entities WHERE name ILIKE '%{name}%' ORDER BY id LIMIT 1) f "
    "JOIN entities n ON n.id = f.id OR n.id IN (SELECT source_id FROM relationships r WHERE r.target_id = f.id UNION SELECT target_id FROM relationships r WHERE r.source_id = f.id)"
)


def _fused(prelude: str, lists: list[str], limit: int = 20, where: str = "true") -> str:
    union = " UNION ALL ".join(f"SELECT * FROM ({x}) l{i}" for i, x in enumerate(lists))
    return f"{prelude}, uni AS ({union}) SELECT result_type, key, any_value(content) AS content, round(sum(1.0::DOUBLE / (60.0 + rank + 1)), 9) AS score, any_value(entity_ids) AS entity_ids, any_value(source) AS source FROM uni WHERE {where} GROUP BY result_type, key ORDER BY score DESC, key LIMIT {limit}"


IDIOT = _bm25_ctes([(["idiot"], False), (["the"], False)], "f0 > 0 AND f1 > 0")


@query("recall_memory", _fused(MEM, [_memory_list(["thly"])]))
def recall_memory(spark, d):
    return _results(recall.recall(_sources(spark, d), "", subqueries=[{"type": "memory", "params": {"query": "thly"}}]))


@query("recall_keyword", _fused(f"{with_sql('chunks')}, {IDIOT}", [_keyword_list()]))
def recall_keyword(spark, d):
    return _results(recall.recall(_sources(spark, d), "", subqueries=[{"type": "keyword", "params": {"query": "the idiot?"}}]))


@query("recall_vector", _fused(with_sql("chunks"), [_vector_list(3)]))
def recall_vector(spark, d):
    return _results(recall.recall(_sources(spark, d), "", subqueries=[{"type": "vector", "params": {"query": "x", "vector": _vector(spark, d, 3)}}]))


@query("recall_graph", _fused(with_sql("entities", "relationships"), [GRAPH_LIST.format(name="europe")]))
def recall_graph(spark, d):
    return _results(recall.recall(_sources(spark, d, True), "", subqueries=[{"type": "graph", "params": {"entity": "europe"}}]))


@query("recall_fallback", _fused(f"{with_sql('chunks', 'memories', 'memory_entities')}, {IDIOT}", [_keyword_list(), _memory_list(["the", "idiot"])]))
def recall_fallback(spark, d):
    return _results(recall.recall(_sources(spark, d), "the idiot"))


@query(
    "recall_hybrid",
    _fused(f"{with_sql('chunks', 'memories', 'memory_entities', 'entities', 'relationships')}, {IDIOT}", [_keyword_list(), _memory_list(["the", "idiot"]), _vector_list(3), GRAPH_LIST.format(name="asia")]),
)
def recall_hybrid(spark, d):
    text = {"query": "the idiot"}
    subs = [{"type": "keyword", "params": text}, {"type": "memory", "params": text}, {"type": "vector", "params": {"query": "x", "vector": _vector(spark, d, 3)}}, {"type": "graph", "params": {"entity": "asia"}}]
    return _results(recall.recall(_sources(spark, d, True), "", subqueries=subs))


@query("recall_source_filter", _fused(f"{with_sql('chunks', 'memories', 'memory_entities')}, {IDIOT}", [_keyword_list(), _memory_list(["the", "idiot"])], where="source = 'user'"))
def recall_source_filter(spark, d):
    return _results(recall.recall(_sources(spark, d), "the idiot", source="user"))


# Extraction and ingest

NOTES = with_sql("notes")
ANSWERS = with_sql("answers")


@query(
    "extract_frontmatter",
    f"{NOTES} SELECT doc_id, regexp_extract(content, 'type: ([^\\n]*)', 1) AS type, regexp_extract(content, 'name: ([^\\n]*)', 1) AS name, '{{\"balance\":\"' || regexp_extract(content, 'balance: ([^\\n]*)', 1) || '\",\"segment\":\"' || regexp_extract(content, 'segment: ([^\\n]*)', 1) || '\"}}' AS attributes, 'frontmatter' AS source FROM notes",
)
def extract_frontmatter(spark, d):
    return view(spark, d, "notes").select("doc_id", extract.frontmatter(F.col("content")).alias("e")).where("e IS NOT NULL").select("doc_id", "e.type", "e.name", "e.attributes", "e.source")


LINKS = "SELECT doc_id, name, min(i) AS i FROM (SELECT doc_id, trim(unnest(m)) AS name, unnest(range(len(m))) AS i FROM (SELECT doc_id, regexp_extract_all(content, '\\[\\[([^\\]]+)\\]\\]', 1) AS m FROM notes) a) b WHERE name <> '' GROUP BY doc_id, name"


@query("extract_wikilinks", f"{NOTES} SELECT doc_id, string_agg(name, '|' ORDER BY i) AS names FROM ({LINKS}) l GROUP BY doc_id")
def extract_wikilinks(spark, d):
    return view(spark, d, "notes").select("doc_id", F.array_join(F.transform(extract.wikilinks(F.col("content")), lambda e: e["name"]), "|").alias("names"))


JSON = "js AS (SELECT doc_id, content, json(regexp_replace(regexp_replace(answer, '^```json\\n', ''), '\\n```$', '')) AS j FROM answers)"


@query(
    "extract_hybrid",
    f"{with_sql('notes', 'answers')}, {JSON} SELECT n.doc_id, 'customer:' || regexp_extract(n.content, 'name: ([^\\n]*)', 1) || '|' || (SELECT string_agg('document:' || name, '|' ORDER BY i) FROM ({LINKS}) l WHERE l.doc_id = n.doc_id) || '|' || (j->>'$.entities[0].type') || ':' || (j->>'$.entities[0].name') || '|' || (j->>'$.entities[1].type') || ':' || (j->>'$.entities[1].name') AS entities FROM notes n JOIN js ON js.doc_id = n.doc_id",
)
def extract_hybrid(spark, d):
    docs = view(spark, d, "notes").join(view(spark, d, "answers").select("doc_id", "answer"), "doc_id")
    found = ingest.extraction_of(docs).select("doc_id", F.col("extraction.entities").alias("e"))
    return found.select("doc_id", F.array_join(F.transform("e", lambda x: F.concat(x["type"], F.lit(":"), x["name"])), "|").alias("entities"))


@query(
    "parse_extraction",
    f"{ANSWERS}, {JSON} SELECT doc_id, json_array_length(j, '$.entities')::INTEGER AS n_entities, (j->>'$.relationships[0].source') || '>' || (j->>'$.relationships[0].target') || '|' || (j->>'$.relationships[1].source') || '>' || (j->>'$.relationships[1].target') AS ends, (j->>'$.memories[0].content') || '|' || (j->>'$.memories[1]') AS memories FROM js",
)
def parse_extraction(spark, d):
    parsed = view(spark, d, "answers").select("doc_id", extract.model_json(F.col("answer")).alias("x"))
    ends = F.array_join(F.transform("x.relationships", lambda r: F.concat(r["source"], F.lit(">"), r["target"])), "|")
    return parsed.select("doc_id", F.size("x.entities").alias("n_entities"), ends.alias("ends"), F.array_join(F.transform("x.memories", lambda m: m["content"]), "|").alias("memories"))


def _eid(kind: str, name: str) -> str:
    return f"'entity:' || substr(sha256({kind} || chr(31) || {name}), 1, 32)"


@query(
    "resolve_relationships",
    f"{ANSWERS}, {JSON} SELECT doc_id, j->>'$.relationships[0].source' AS source_name, j->>'$.relationships[0].target' AS target_name, j->>'$.relationships[0].type' AS type, {_eid(chr(39) + 'customer' + chr(39), '(j->>' + chr(39) + '$.entities[0].name' + chr(39) + ')')} AS source_id, {_eid(chr(39) + 'nation' + chr(39), '(j->>' + chr(39) + '$.entities[1].name' + chr(39) + ')')} AS target_id FROM js",
)
def resolve_relationships(spark, d):
    docs = ingest.extraction_of(view(spark, d, "answers"))
    names = ingest.names_of(ingest.extracted_entities(docs))
    return ingest.resolve_relationships(docs, names).select("doc_id", "source_name", "target_name", "type", "source_id", "target_id")


@query(
    "memory_entity_links",
    f"{ANSWERS}, {JSON}, mm AS (SELECT doc_id, unnest([0, 1]) AS pos, j FROM js) SELECT 'memory:' || substr(sha256(concat_ws(chr(31), doc_id, 'talk', pos)), 1, 32) AS memory_id, unnest([{_eid(chr(39) + 'customer' + chr(39), '(j->>' + chr(39) + '$.entities[0].name' + chr(39) + ')')}, {_eid(chr(39) + 'nation' + chr(39), '(j->>' + chr(39) + '$.entities[1].name' + chr(39) + ')')}]) AS entity_id FROM mm",
)
def memory_entity_links(spark, d):
    return ingest.remember(view(spark, d, "answers"), source="talk", embed=False)["memory_entities"]


@query(
    "upsert_entities",
    "SELECT 'cust-' || o_custkey AS name, 'customer' AS type, arg_min('log:' || o_orderkey, (o_orderdate, o_orderkey)) AS id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS attributes, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS source, CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR) AS created_on, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS updated_on FROM orders GROUP BY o_custkey",
)
def upsert_entities(spark, d):
    orders = X.load(spark, d, "orders")
    log = orders.select(F.concat(F.lit("cust-"), F.col("o_custkey").cast("string")).alias("name"), F.lit("customer").alias("type"), F.concat(F.lit("log:"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderstatus").alias("attributes"), F.col("o_orderpriority").alias("source"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"), F.struct("o_orderdate", "o_orderkey").alias("seq"))
    return E.upsert_entities(log).select("name", "type", "id", "attributes", "source", F.to_date("created_at").cast("string").alias("created_on"), F.to_date("updated_at").cast("string").alias("updated_on"))


NAME0, NAME1, NOTE_NAME = "(j->>'$.entities[0].name')", "(j->>'$.entities[1].name')", "regexp_extract(content, 'name: ([^\\n]*)', 1)"


@query(
    "remember_pipeline",
    f"{with_sql('notes', 'answers')}, {JSON}, lnk AS ({LINKS}), ent AS (SELECT 'customer' AS t, {NOTE_NAME} AS n FROM notes UNION SELECT 'document', name FROM lnk UNION SELECT j->>'$.entities[0].type', {NAME0} FROM js UNION SELECT j->>'$.entities[1].type', {NAME1} FROM js), "
    f"named AS (SELECT doc_id, name, arg_max(id, ord) AS id FROM (SELECT doc_id, name, {_eid(chr(39) + 'document' + chr(39), 'name')} AS id, 1 AS ord FROM lnk UNION ALL SELECT doc_id, {NAME0}, {_eid(chr(39) + 'customer' + chr(39), NAME0)}, 2 FROM js UNION ALL SELECT doc_id, {NAME1}, {_eid(chr(39) + 'nation' + chr(39), NAME1)}, 3 FROM js) q GROUP BY doc_id, name), "
    "mem AS (SELECT doc_id, 'memory:' || substr(sha256(concat_ws(chr(31), doc_id, 'talk', pos)), 1, 32) AS id, CASE pos WHEN 0 THEN j->>'$.memories[0].content' ELSE j->>'$.memories[1]' END AS content FROM js, range(2) r(pos)) "
    f"SELECT 'entities' AS relation, {_eid('t', 'n')} AS a, t AS b, n AS c FROM ent "
    f"UNION ALL SELECT 'relationships', {_eid(chr(39) + 'customer' + chr(39), NAME0)}, {_eid(chr(39) + 'nation' + chr(39), NAME1)}, j->>'$.relationships[0].type' FROM js "
    "UNION ALL SELECT 'chunks', 'chunk:' || substr(sha256(concat_ws(chr(31), doc_id, 'talk', 1)), 1, 32), content, '{\"source\":\"talk\"}' FROM notes "
    "UNION ALL SELECT 'memories', id, content, 'talk' FROM mem UNION ALL SELECT 'memory_entities', mem.id, named.id, '' FROM mem JOIN named USING (doc_id)",
)
def remember_pipeline(spark, d):
    docs = view(spark, d, "notes").join(view(spark, d, "answers").select("doc_id", "answer"), "doc_id")
    made = ingest.remember(docs, source="talk")
    columns = {"entities": ["id", "type", "name"], "relationships": ["source_id", "target_id", "type"], "chunks": ["id", "content", "metadata"], "memories": ["id", "content", "source"], "memory_entities": ["memory_id", "entity_id", None]}
    out = None
    for relation, names in columns.items():
        rows = made[relation].select(F.lit(relation).alias("relation"), *[(F.col(c) if c else F.lit("")).alias(x) for c, x in zip(names, "abc", strict=True)])
        out = rows if out is None else out.unionByName(rows)
    return out


# The store


def _store(spark) -> KnowledgeStore:
    return KnowledgeStore(spark, f"{shared_folder(spark)}/strandline/store-{uuid.uuid4().hex}")


def _old_new(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """All rows, then again those of even keys: what a second put replaces."""
    return df, df.where(F.col(key) % 2 == 0)


@query("store_entities", "SELECT 'a:' || c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS source, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '{}' END AS attributes FROM customer")
def store_entities(spark, d):
    """A second put of the same (name, type) keeps the first id and takes the later attributes."""
    store, now = _store(spark), F.timestamp_seconds(F.lit(0))
    old, new = _old_new(X.load(spark, d, "customer"), "c_custkey")
    row = lambda df, mark, attributes, source: df.select(F.concat(F.lit(mark), F.col("c_custkey").cast("string")).alias("id"), F.lit("customer").alias("type"), F.col("c_name").alias("name"), attributes.alias("attributes"), F.lit(source).alias("source"), now.alias("created_at"), now.alias("updated_at"))
    store.put_entities(row(old, "a:", F.lit("{}"), "old"))
    store.put_entities(row(new, "b:", F.col("c_mktsegment"), "new"))
    return store.find_entities(type="customer").select("id", "name", "source", "attributes")


@query("store_relationships", "SELECT 'r:' || c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'moved_to' ELSE 'located_in' END AS type FROM customer WHERE c_nationkey = 3")
def store_relationships(spark, d):
    store = _store(spark)
    store.put_entities(view(spark, d, "entities").where("type IN ('customer', 'nation')"))
    old, new = _old_new(X.load(spark, d, "customer"), "c_custkey")
    row = lambda df, kind: df.select(F.concat(F.lit("r:"), F.col("c_custkey").cast("string")).alias("id"), F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("source_id"), F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")).alias("target_id"), F.lit(kind).alias("type"), F.lit("{}").alias("attributes"), F.lit("").alias("source"), F.timestamp_seconds(F.lit(0)).alias("created_at"))
    store.put_relationships(row(old, "located_in"))
    store.put_relationships(row(new, "moved_to"))
    return store.get_relationships("nation:3").select("id", "type")


@query("store_search", _keyword_sql([(["licensed"], False), (["apache"], False)], "f0 > 0 AND f1 > 0"))
def store_search(spark, d):
    """Chunks put twice are one chunk in the stored index."""
    store = _store(spark)
    old, new = _old_new(view(spark, d, "chunks").withColumn("n", F.xxhash64("id")), "n")
    store.put_chunks(old.drop("n", "source"))
    store.put_chunks(new.drop("n", "source"))
    return store.search_keyword("licensed apache").select("id", F.round("score", 6).alias("score"))


@query("store_memories", "SELECT 'memory:' || conv_id || ':' || turn AS id, 'conversation:' || conv_id AS entity_ids FROM conversations WHERE conv_id = 5")
def store_memories(spark, d):
    store = _store(spark)
    store.put_memories(E.with_links(view(spark, d, "memories"), view(spark, d, "memory_entities")))
    return store.memories_by_entity("conversation:5").select("id", F.array_join("entity_ids", ",").alias("entity_ids"))


@query("store_vectors", _topk_sql(0, 10))
def store_vectors(spark, d):
    store = _store(spark)
    store.put_embeddings(X.embeddings(spark, d).withColumn("created_at", F.timestamp_seconds(F.lit(0))))
    return search.vector_topk(store.table("embeddings"), _vector(spark, d, 0), 10, digits=6)


@query("store_forget", with_sql("entities", "relationships") + " SELECT id FROM relationships WHERE type IN ('part_of', 'located_in') AND source_id <> 'nation:3' AND target_id <> 'nation:3'")
def store_forget(spark, d):
    store = _store(spark)
    store.put_entities(view(spark, d, "entities").where("type IN ('customer', 'supplier', 'nation', 'region')"))
    store.put_relationships(view(spark, d, "relationships").where("type IN ('part_of', 'located_in')"))
    store.forget(entity_id="nation:3")
    return store.table("relationships").select("id")


@query("store_sync_state", "SELECT event_type AS connector, arg_max(props, (ts, props)) AS state FROM events GROUP BY event_type")
def store_sync_state(spark, d):
    """Each kind of event is a connector and its events are states, put in two halves, the later one first."""
    store = _store(spark)
    states = X.load(spark, d, "events").select(F.col("event_type").alias("connector"), F.col("props").alias("state"), F.col("ts").cast("timestamp").alias("updated_at"))
    middle = states.agg(F.expr("percentile_approx(updated_at, 0.5)")).first()[0]
    store.put_sync_states(states.where(F.col("updated_at") > F.lit(middle)))
    store.put_sync_states(states.where(F.col("updated_at") <= F.lit(middle)))
    return store.table("sync_state").select("connector", "state")


@query("sentence_split", "SELECT doc_id, len(s) AS n_sentences, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \\n]', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(10) || chr(9) || chr(13))), lambda x: x <> '') AS s FROM documents) q")
def sentence_split(spark, d):
    cut = X.load(spark, d, "documents").select("doc_id", sentences(F.col("text")).alias("s"))
    return cut.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.md5(F.array_join("s", "|").cast("binary")).alias("digest"))


@query("conversation_threads", "SELECT conv_id, string_agg(coalesce(role, '') || ': ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn, text) AS content FROM conversations GROUP BY conv_id")
def conversation_threads(spark, d):
    return connectors.threads(X.load(spark, d, "conversations"))


THREADS = "SELECT conv_id, string_agg(coalesce(role, '') || ': ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn, text) AS content FROM conversations GROUP BY conv_id"


@query("chunk_split", split_sql(THREADS, "conv_id", 1000))
def chunk_split(spark, d):
    return ingest.split_chunks(connectors.threads(X.load(spark, d, "conversations")), 1000, "conv_id")


# Forget


def _relations(spark, d) -> dict[str, DataFrame]:
    r = {n: view(spark, d, n) for n in ("entities", "relationships", "chunks", "memories", "memory_entities")}
    return r | {"embeddings": view(spark, d, "refs")}


def _left_sql(relation: str, doomed: str) -> str:
    prelude = with_sql("entities", "relationships", "chunks", "memories", "memory_entities", "refs") + f", doomed AS (SELECT id FROM entities WHERE {doomed}), "
    prelude += "lnk AS (SELECT * FROM memory_entities WHERE entity_id NOT IN (SELECT id FROM doomed)), dead_chunks AS (SELECT id FROM chunks WHERE entity_id IN (SELECT id FROM doomed)), dead_memories AS (SELECT id FROM memories WHERE id NOT IN (SELECT memory_id FROM lnk)) "
    return (
        prelude
        + {
            "entities": "SELECT id FROM entities WHERE id NOT IN (SELECT id FROM doomed)",
            "relationships": "SELECT id FROM relationships WHERE source_id NOT IN (SELECT id FROM doomed) AND target_id NOT IN (SELECT id FROM doomed)",
            "chunks": "SELECT id FROM chunks WHERE id NOT IN (SELECT id FROM dead_chunks)",
            "memories": "SELECT id FROM memories WHERE id NOT IN (SELECT id FROM dead_memories)",
            "memory_entities": "SELECT memory_id, entity_id FROM lnk",
            "embeddings": "SELECT id FROM refs WHERE NOT (ref_type = 'chunk' AND ref_id IN (SELECT id FROM dead_chunks)) AND NOT (ref_type = 'memory' AND ref_id IN (SELECT id FROM dead_memories))",
        }[relation]
    )


ENTITY_OF = {"entities": "nation:3", "relationships": "nation:3", "chunks": "document:5", "embeddings": "document:5", "memories": "conversation:5", "memory_entities": "conversation:5"}
SOURCE_OF = {"entities": "geo", "relationships": "geo", "chunks": "src0", "embeddings": "src0", "memories": "chat1", "memory_entities": "chat1"}


def _register_forget() -> None:
    for relation in ENTITY_OF:
        columns = ["memory_id", "entity_id"] if relation == "memory_entities" else ["id"]

        def one(spark, d, relation=relation, columns=columns):
            return forget.forget(_relations(spark, d), entity_id=ENTITY_OF[relation])[relation].select(*columns)

        def many(spark, d, relation=relation, columns=columns):
            return forget.forget(_relations(spark, d), source=SOURCE_OF[relation])[relation].select(*columns)

        query(f"forget_entity_{relation}", _left_sql(relation, f"id = '{ENTITY_OF[relation]}'"))(one)
        query(f"forget_source_{relation}", _left_sql(relation, f"source = '{SOURCE_OF[relation]}'"))(many)


_register_forget()


# Connectors


@query("content_type_map", with_sql("files") + " SELECT doc_id, CASE lower(regexp_extract(path, '\\.([^./]*)$', 1)) WHEN 'md' THEN 'markdown' WHEN 'csv' THEN 'csv' WHEN 'tsv' THEN 'tsv' WHEN 'yaml' THEN 'yaml' WHEN 'yml' THEN 'yaml' WHEN 'json' THEN 'json' WHEN 'txt' THEN 'text' WHEN 'xml' THEN 'xml' WHEN 'toml' THEN 'toml' WHEN 'log' THEN 'log' ELSE '' END AS content_type FROM files")
def content_type_map(spark, d):
    return view(spark, d, "files").select("doc_id", connectors.content_type(F.col("path")).alias("content_type"))


@query("incremental_filter", "SELECT event_id FROM events WHERE ts > (SELECT ts FROM events WHERE event_id = 500)")
def incremental_filter(spark, d):
    events = X.load(spark, d, "events")
    mark = events.where("event_id = 500").select("ts").first()
    return connectors.changed_since(events, mark["ts"] if mark else None, "ts").select("event_id")


@query("sync_state_latest", "SELECT event_type AS connector, arg_max(props, (ts, event_id)) AS state FROM events GROUP BY event_type")
def sync_state_latest(spark, d):
    return X.load(spark, d, "events").groupBy(F.col("event_type").alias("connector")).agg(F.max_by("props", F.struct("ts", "event_id")).alias("state"))
