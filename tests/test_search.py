import math
import random
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from strandline.operators import entities as E
from strandline.operators import recall, search
from strandline.providers import OfflineEmbedder, ScriptedModel, parse_plan

TEXTS = [
    "Go is a compiled programming language",
    "Python is an interpreted programming language for data",
    "Rust is a systems language; programming in Rust is fast",
    "The weather is nice today, really nice",
    "Café culture and language in Paris",
    "data engineering with Spark and Python data frames",
    "",
    "snake_case and self-hosted things a.b",
]


@pytest.fixture(scope="module")
def chunks(spark):
    df = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(TEXTS)], "id string, content string")
    return df.withColumns({"entity_id": F.lit(None).cast("string"), "metadata": F.lit('{"source":"s"}'), "created_at": F.timestamp_seconds(F.lit(0))}).cache()


QUERIES = ["programming language", "python OR rust", "language NOT programming", '"programming language"', "prog*", "cafe", "data python", "NEAR(programming rust, 2)", "(go OR rust) AND language", "snake", "^data", "content: nice", '"programming lang" *', "nothing"]


@pytest.mark.parametrize("query", QUERIES)
def test_hits_and_scores_equal_sqlite(chunks, query):
    """SQLite's full-text index is a public engine with the same query language."""
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(content)")
    db.executemany("INSERT INTO f(rowid, content) VALUES (?, ?)", list(enumerate(TEXTS, 1)))
    want = {f"c{i - 1}": -s for i, s in db.execute("SELECT rowid, rank FROM f WHERE f MATCH ?", (query,))}
    got = {r["id"]: r["score"] for r in search.search_keyword(chunks, query, 50).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-6, abs=1e-9)


@pytest.mark.parametrize("query", ["who works at Stripe?", "What's up", "self-hosted", "a.b", "", "AND x", '"open', "(a"])
def test_bad_syntax(chunks, query):
    with pytest.raises(search.MatchSyntaxError):
        search.search_keyword(chunks, query)


WORDS = ["a", "b", "c", "d", "Việt", "한국", "йод", "Ελλάδα", "ελλαδα", "かな", "café", "cafe\u0301", "ΟΔΟΣ", "οδος", "naïve", "ſs", "İx", "x2", "straße", "ệ"]


def _expression(r, depth):
    word = lambda: r.choice(WORDS[:4] if r.random() < 0.7 else WORDS)
    kind = r.random()
    if depth == 0 or kind < 0.35:
        w = word()
        return r.choice([w, w, w, f'"{w}"', w + "*", f'"{w} {word()}"', f"^{w}", f"{w} + {word()}", f"NEAR({w} {word()}, {r.randrange(4)})", f"content: {w}", f"{w} {word()}", f"({w}) {word()}"])
    if kind < 0.9:
        return f"{_expression(r, depth - 1)} {r.choice(['AND', 'OR', 'NOT'])} {_expression(r, depth - 1)}"
    return f"({_expression(r, depth - 1)})"


def test_random_expressions_and_scripts_equal_sqlite(spark):
    """Operators in any order and nesting, over several scripts; errors are errors in both."""
    r = random.Random(11)
    texts = [" ".join(r.choice(WORDS[:4] if r.random() < 0.6 else WORDS) for _ in range(r.randrange(1, 9))) for _ in range(60)]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(content)")
    db.executemany("INSERT INTO f(rowid, content) VALUES (?, ?)", list(enumerate(texts)))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    index, stats = search.postings(df).cache(), search.corpus_stats(df).cache()
    for _ in range(40):
        query = _expression(r, r.randrange(4))
        try:
            want = {i: -s for i, s in db.execute("SELECT rowid, rank FROM f WHERE f MATCH ?", (query,))}
        except sqlite3.OperationalError:
            with pytest.raises(search.MatchSyntaxError):
                search.search_keyword(df, query)
            continue
        got = {x["id"]: x["score"] for x in search.search_keyword(df, query, 1000, index=index, stats=stats).collect()}
        assert got.keys() == want.keys(), query
        assert all(got[k] == pytest.approx(v, rel=1e-6, abs=1e-9) for k, v in want.items()), query


def test_postings_need_no_shuffle(chunks):
    assert "Exchange" not in search.postings(chunks.select("id", "content"))._jdf.queryExecution().executedPlan().toString()


def test_lenient_reading_and_limits(chunks):
    assert {r["id"] for r in search.search_keyword(chunks, "programming, language?", strict=False).collect()} == {"c0", "c1", "c2"}
    assert search.search_keyword(chunks, "?!", strict=False).isEmpty()
    assert search.search_keyword(chunks, "language", 0).isEmpty()
    with pytest.raises(ValueError):
        search.search_keyword(chunks, "language", -1)


def test_stored_index_gives_the_same(chunks):
    index, stats = search.postings(chunks), search.corpus_stats(chunks)
    a = search.search_keyword(chunks, "data", index=index, stats=stats).select("id", "score").collect()
    assert sorted(a) == sorted(search.search_keyword(chunks, "data").select("id", "score").collect())


@pytest.fixture(scope="module")
def embeddings(spark):
    vectors = OfflineEmbedder().embed(TEXTS)
    rows = [(f"e{i}", f"c{i}", "chunk", [float(x) for x in v]) for i, v in enumerate(vectors)] + [("ex", "gone", "chunk", [float(x) for x in vectors[3]]), ("em", "m0", "memory", [float(x) for x in vectors[3]])]
    return spark.createDataFrame(rows, "id string, ref_id string, ref_type string, vector array<float>").cache()


def test_vector_search(chunks, embeddings):
    top = search.vector_topk(embeddings, OfflineEmbedder().embed([TEXTS[3]])[0], 2, digits=6).collect()
    assert [r["ref_id"] for r in top] == ["c3", "gone"] and top[0]["similarity"] == pytest.approx(1.0)
    # The limit comes before the lookup, so a dangling reference costs a place.
    assert [r["id"] for r in search.search_vector(embeddings, chunks, TEXTS[3], 2, OfflineEmbedder(), digits=6).collect()] == ["c3"]
    with pytest.raises(ValueError):
        search.search_vector(embeddings, chunks, "text")
    with pytest.raises(ValueError):
        search.search_vector(embeddings, chunks, [])


@pytest.fixture(scope="module")
def sources(spark, chunks, embeddings):
    memories = spark.createDataFrame([("m0", "Alice likes tea", "chat"), ("m1", "Bob uses Python", "mail"), ("m2", "100% sure", "chat")], "id string, content string, source string").withColumn("created_at", F.timestamp_seconds(F.lit(0)))
    links = spark.createDataFrame([("m0", "a"), ("m0", "b")], "memory_id string, entity_id string")
    entities = spark.createDataFrame([("a", "person", "Alice", "chat"), ("b", "person", "Bob", "chat"), ("s", "company", "Stripe", "mail")], "id string, type string, name string, source string").withColumn("created_at", F.timestamp_seconds(F.lit(0)))
    rels = spark.createDataFrame([("r0", "a", "b", "knows"), ("r1", "a", "s", "works_at")], "id string, source_id string, target_id string, type string")
    return recall.Sources(spark, entities, rels, chunks, memories, links, embeddings)


def test_search_memories_any_word(sources):
    ids = lambda q, n=10: [r["id"] for r in E.search_memories(sources.memories, q, n).collect()]
    assert ids("tea PYTHON") == ["m0", "m1"] and ids("") == [] and ids("  ") == [] and ids("tea python", 1) == ["m0"]
    assert ids("1_0%") == ["m2"]


def test_recall_fallback_and_fusion(sources):
    rows = recall.recall(sources, "python").collect()
    assert {r["key"] for r in rows} == {"chunk:c1", "chunk:c5", "mem:m1"}
    assert rows[0]["score"] == pytest.approx(1 / 61, abs=1e-9)


def test_recall_uses_the_plan_and_survives_a_failing_model(sources):
    class Broken:
        def decompose(self, query):
            raise OSError("offline")

    model = ScriptedModel(plans={"q": [{"type": "memory", "params": {"query": "tea"}}, {"type": "bogus", "params": {"query": "x"}}, {"type": "memory", "params": {}}, {"type": "graph", "params": {"entity": "ali"}}]})
    keys = {r["key"]: r for r in recall.recall(sources, "q", model=model).collect()}
    assert set(keys) == {"mem:m0", "entity:a", "entity:b", "entity:s"}
    assert keys["entity:a"]["content"] == "Alice (person) [knows, works_at]" and keys["entity:s"]["content"] == "Stripe (company) [works_at]"
    assert keys["mem:m0"]["entity_ids"] == ["a", "b"]
    assert {r["key"] for r in recall.recall(sources, "python", model=Broken()).collect()} == {"chunk:c1", "chunk:c5", "mem:m1"}


def test_recall_empty_filter_weights(sources):
    assert recall.recall(sources, "q", subqueries=[{"type": "nope", "params": {"query": "x"}}]).collect() == []
    assert {r["key"] for r in recall.recall(sources, "python", source="mail").collect()} == {"mem:m1"}
    assert recall.recall(sources, "python", type_weights={"memory": 3.0}).first()["key"] == "mem:m1"
    hybrid = [{"type": "keyword", "params": {"query": "nice weather"}}, {"type": "vector", "params": {"query": TEXTS[3]}}]
    top = recall.recall(sources, "", subqueries=hybrid, embedder=OfflineEmbedder()).first()
    assert top["key"] == "chunk:c3" and top["score"] == pytest.approx(2 / 61, abs=1e-9)


def test_plan_json():
    assert parse_plan('{"queries": [{"type": "graph", "params": {"entity": "x"}}]}') == [{"type": "graph", "params": {"entity": "x"}}]
    with pytest.raises(ValueError):
        parse_plan("```json\n{}\n```")


def test_bm25_by_hand(chunks):
    docs = [re.findall(r"[^\W_]+", t.lower()) for t in TEXTS]
    avg, n = sum(map(len, docs)) / len(docs), sum("rust" in d for d in docs)
    idf = math.log((len(docs) - n + 0.5) / (n + 0.5))
    want = idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * len(docs[2]) / avg))
    assert search.search_keyword(chunks, "rust").first()["score"] == pytest.approx(want)


def test_index_is_computed_once_per_text(chunks):
    plan = search.postings(chunks)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
