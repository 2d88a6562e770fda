import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import entities as E
from strandline.operators import forget, graph, recall


def _entities(spark, *rows):
    return spark.createDataFrame([(i, k, n, "{}", s) for i, k, n, s in rows], "id string, type string, name string, attributes string, source string").withColumn("created_at", F.timestamp_seconds(F.lit(0))).withColumn("updated_at", F.col("created_at"))


def _rels(spark, *rows):
    return spark.createDataFrame([(f"r{i}", a, b, t, "{}", "test") for i, (a, t, b) in enumerate(rows)], "id string, source_id string, target_id string, type string, attributes string, source string").withColumn("created_at", F.timestamp_seconds(F.lit(0)))


@pytest.fixture(scope="module")
def people(spark):
    return _entities(spark, ("a", "person", "Alice Johnson", "test"), ("b", "person", "Alice Smith", "test"), ("c", "person", "Bob Brown", "other"), ("s", "company", "Stripe", "test"))


@pytest.fixture(scope="module")
def ring(spark):
    return _rels(spark, ("a", "knows", "b"), ("b", "knows", "c"), ("c", "knows", "a"), ("a", "works_at", "s"), ("s", "owns", "s"))


def _ids(df, column="id"):
    return sorted(r[0] for r in df.select(column).collect())


def test_filters(people):
    assert _ids(E.find_entities(people)) == ["a", "b", "c", "s"]
    assert _ids(E.find_entities(people, type="person", name_like="alice%")) == ["a", "b"]
    assert _ids(E.find_entities(people, source="other")) == ["c"]
    assert E.get_entity(people, "zz").isEmpty()


def test_relationships_of_either_end(people, ring):
    assert _ids(E.relationships_of(ring, "a")) == ["r0", "r2", "r3"]
    assert _ids(E.relationships_of(ring, "a", ["works_at"])) == ["r3"]
    bulk = E.relationships_of(ring, people.where("id IN ('a', 's')").select("id")).groupBy("entity_id").count().collect()
    assert {r["entity_id"]: r["count"] for r in bulk} == {"a": 3, "s": 2}


def test_dangling(spark, people):
    rels = _rels(spark, ("a", "knows", "x"), ("x", "knows", "y"), ("a", "knows", "b"))
    assert _ids(E.dangling_relationships(rels, people)) == ["r0", "r1"]


def test_dangling_reads_relationships_once(spark, people):
    rels = _rels(spark, ("a", "knows", None), ("x", "knows", "x"), (None, "knows", None), ("a", "knows", "b"))
    lost = E.dangling_relationships(rels.repartition(2, "type"), people)
    assert _ids(lost) == ["r0", "r1", "r2"] and lost.columns == rels.columns
    assert lost._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1


def test_traverse_depths(people, ring):
    nodes, edges = graph.traverse(people, ring, "a", 0)
    assert _ids(nodes) == ["a"] and _ids(edges) == []
    nodes, edges = graph.traverse(people, ring, "a", 1)
    assert _ids(nodes) == ["a", "b", "c", "s"] and _ids(edges) == ["r0", "r2", "r3"]  # b-c joins two last-level nodes
    nodes, edges = graph.traverse(people, ring, "a", 2)
    assert _ids(edges) == ["r0", "r1", "r2", "r3", "r4"]
    nodes, _ = graph.traverse(people, ring, "a", 3, ["works_at"])
    assert _ids(nodes) == ["a", "s"]


def test_traverse_multiset(people, ring):
    _, edges = graph.traverse(people, ring, "a", 2, edge_multiplicity="reference")
    assert {r["id"]: r["count"] for r in edges.groupBy("id").count().collect()} == {"r0": 2, "r1": 2, "r2": 2, "r3": 2, "r4": 1}


def test_levels_grow_by_one_and_stop(spark, people):
    chain = _rels(spark, *[(str(i), "n", str(i + 1)) for i in range(6)])
    got = {r["id"]: r["level"] for r in graph.levels(chain, "2", 10).collect()}
    assert got == {"2": 0, "1": 1, "3": 1, "0": 2, "4": 2, "5": 3, "6": 4}


@pytest.mark.parametrize("pushed", [1000, 1])
def test_traverse_reads_relationships_once_a_level(spark, monkeypatch, pushed):
    """Against a plain walk, with frontiers sought by value and joined; ends that are null, loops, repeated rows."""
    written = {}
    monkeypatch.setattr(graph, "PUSHED", pushed)
    monkeypatch.setattr(graph, "staged", lambda df, tag, of=graph.staged: written.setdefault(tag, []).append(df) or of(df, tag))
    rng = random.Random(5)
    rows = [(rng.choice("abcdefgh"), "n", rng.choice("abcdefgh")) for _ in range(9)] + [(None, "n", "a"), ("a", "n", None), ("a", "n", "a"), (None, "n", None)]
    rels = _rels(spark, *rows).repartition(2, "type")
    level, at = {"a": 0}, ["a"]
    for n in (1, 2):
        at = {y for s, _, t in rows for x, y in ((s, t), (t, s)) if x in at and y and y not in level}
        level |= dict.fromkeys(at, n)
    ends = {f"r{i}": len({x for x in (s, t) if level.get(x, 2) < 2}) for i, (s, _, t) in enumerate(rows)}
    people = _entities(spark, *[(x, "person", x, "test") for x in "abcdefgh"])
    for kind in ("set", "reference"):
        nodes, edges = graph.traverse(people, rels, "a", 2, edge_multiplicity=kind)
        assert {r["id"]: r["level"] for r in nodes.collect()} == level and edges.columns == rels.columns
        assert _ids(edges) == sorted(i for i, n in ends.items() for _ in range(min(n, 1) if kind == "set" else n))
    plan = written["explored"][0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Join" not in plan


def test_traverse_unknown_start(people, ring):
    with pytest.raises(LookupError):
        graph.traverse(people, ring, "zz")
    with pytest.raises(ValueError):
        graph.levels(ring, "a", -1)


def test_upsert_keeps_first_id_and_last_attributes(spark):
    log = spark.createDataFrame([("1", "person", "Bob", '{"age":25}', "x", 1), ("2", "person", "Bob", '{"age":26}', "y", 2), ("3", "dog", "Bob", "{}", "z", 1)], "id string, type string, name string, attributes string, source string, seq int")
    log = log.withColumn("created_at", F.timestamp_seconds("seq")).withColumn("updated_at", F.timestamp_seconds("seq"))
    rows = {r["type"]: r for r in E.upsert_entities(log).collect()}
    assert rows["person"]["id"] == "1" and rows["person"]["attributes"] == '{"age":26}' and rows["person"]["source"] == "y"
    assert rows["person"]["created_at"] < rows["person"]["updated_at"] and len(rows) == 2


def test_rrf_scores_and_order_independence(spark):
    lists = spark.createDataFrame([(0, "A", 0), (0, "B", 1), (1, "B", 0), (1, "C", 1), (2, "A", 0)], "list_id int, id string, rank int")
    got = {r["id"]: r["score"] for r in recall.rrf_merge(lists).collect()}
    assert got["A"] == pytest.approx(2 / 61) and got["B"] == pytest.approx(1 / 61 + 1 / 62) and got["C"] == pytest.approx(1 / 62)
    again = {r["id"]: r["score"] for r in recall.rrf_merge(lists.orderBy(F.col("rank").desc())).collect()}
    assert again == pytest.approx(got)


@pytest.fixture(scope="module")
def relations(spark, people, ring):
    chunks = spark.createDataFrame([("k1", "a", "t", '{"source":"test"}'), ("k2", None, "u", '{"source":"other"}'), ("k3", "c", "v", "{}")], "id string, entity_id string, content string, metadata string")
    memories = spark.createDataFrame([("m1", "x", "test"), ("m2", "y", "other"), ("m3", "z", "test")], "id string, content string, source string")
    links = spark.createDataFrame([("m1", "a"), ("m2", "a"), ("m2", "c")], "memory_id string, entity_id string")
    embeddings = spark.createDataFrame([("e1", "k1", "chunk"), ("e2", "m1", "memory"), ("e3", "m2", "memory"), ("e4", "k2", "chunk"), ("e5", "k1", "memory")], "id string, ref_id string, ref_type string")
    return {"entities": people, "relationships": ring, "chunks": chunks, "memories": memories, "memory_entities": links, "embeddings": embeddings}


def test_forget_entity_cascades(relations):
    left = forget.forget(relations, entity_id="a", source="ignored")
    assert _ids(left["entities"]) == ["b", "c", "s"]
    assert _ids(left["relationships"]) == ["r1", "r4"]
    assert _ids(left["chunks"]) == ["k2", "k3"]
    assert _ids(left["memories"]) == ["m2"]  # m1 was orphaned, m3 never had a link
    assert _ids(left["embeddings"]) == ["e3", "e4", "e5"]


def test_forget_source_default_and_strict(relations):
    left = forget.forget(relations, source="other")
    assert _ids(left["entities"]) == ["a", "b", "s"] and _ids(left["chunks"]) == ["k1", "k2"] and _ids(left["memories"]) == ["m1", "m2"]
    strict = forget.forget(relations, source="other", strict_source=True)
    assert _ids(strict["chunks"]) == ["k1"] and _ids(strict["memories"]) == ["m1"]


def test_forget_needs_a_filter(relations):
    with pytest.raises(ValueError):
        forget.forget(relations)


def test_recall_ranks_whole_neighbourhood(spark):
    leaves = [f"c{i:03}" for i in range(150)]
    hubs = [("h", "place", "Hub One", "x"), ("k", "place", "Other Two", "x")]
    entities = _entities(spark, *hubs, *[(i, "leaf", i, "x") for i in leaves], ("z", "leaf", "zed", "geo"))
    rels = _rels(spark, *[("h", "near", i) for i in [*leaves, "z"]], *[("k", "near", i) for i in [*leaves[100:], "z"]])
    sources = recall.Sources(spark, entities=entities, relationships=rels)
    one = {"type": "graph", "params": {"entity": "Hub One"}}
    two = {"type": "graph", "params": {"entity": "Other Two"}}
    ranks = {r["key"]: r["rank"] for r in recall.recall_graph(sources, "Hub One").collect()}
    assert ranks == {f"entity:{i}": n for n, i in enumerate(["h", *leaves, "z"])}
    geo = recall.recall(sources, "", subqueries=[one], source="geo").collect()
    assert [(r["key"], r["score"]) for r in geo] == [("entity:z", round(1 / (60 + 151 + 1), 9))]
    both = {r["key"]: r["score"] for r in recall.recall(sources, "", limit=200, subqueries=[one, two]).collect()}
    assert both["entity:c100"] == round(1 / (60 + 101 + 1) + 1 / (60 + 1 + 1), 9)
    assert recall.recall(sources, "", limit=1, subqueries=[one, two]).first()["key"] == "entity:c100"


def test_doomed_keys_equal_the_comparison(spark):
    """The keys that a forget finds from the entities outwards are those that a whole comparison finds."""
    r = random.Random(11)
    name = lambda kind, n: f"{kind}{r.randrange(n)}"
    make = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    sources = ["s0", "s1", None]
    t = {
        "entities": make([(f"e{i}", r.choice(sources)) for i in range(12)], "id string, source string"),
        "relationships": make([(f"r{i}", name("e", 14), name("e", 14), r.choice(sources)) for i in range(30)], "id string, source_id string, target_id string, source string"),
        "chunks": make([(f"c{i}", r.choice([name("e", 12), None]), r.choice(['{"source":"s0"}', "{}", None])) for i in range(20)], "id string, entity_id string, metadata string"),
        "memories": make([(f"m{i}", r.choice(sources)) for i in range(15)], "id string, source string"),
        "memory_entities": make(sorted({(name("m", 14), name("e", 12)) for _ in range(25)}), "memory_id string, entity_id string"),
        "embeddings": make([(f"v{i}", name(k, 20), {"c": "chunk", "m": "memory"}[k]) for i, k in enumerate("cm" * 15)], "id string, ref_id string, ref_type string"),
    }
    keys = {n: ["memory_id", "entity_id"] if n == "memory_entities" else ["id"] for n in t}
    for options in ({"entity_id": "e3"}, {"source": "s0"}, {"source": "s0", "strict_source": True}, {"source": "nobody"}, {"entity_id": "e1", "source": "s0", "strict_source": True}):
        after, gone = forget.forget(t, **options), forget.doomed_keys(t, **options)
        for n in t:
            want = {tuple(x) for x in t[n].select(*keys[n]).collect()} - {tuple(x) for x in after[n].select(*keys[n]).collect()}
            assert {tuple(x) for x in gone[n].select(*keys[n]).collect()} == want, (n, options)
    with pytest.raises(ValueError):
        forget.doomed_keys(t)
