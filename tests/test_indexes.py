"""Indexes: the same rows as a scan, and only what is asked for is read."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import entities as E
from strandline.operators import graph, lookup, pivots, ranked, search, trigrams
from strandline.sources.store import KnowledgeStore


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_read(df):
    """Rows that the scans of a plan gave, after it has run."""
    df.collect()
    return sum(int(n) for n in re.findall(r"rows read (\d+)", _metrics(df._jdf.queryExecution().executedPlan())))


def _metrics(node):
    out, todo = [], [node]
    while todo:
        p = todo.pop()
        for name in ("executedPlan", "plan"):
            if p.getClass().getSimpleName() in ("AdaptiveSparkPlanExec", "ShuffleQueryStageExec", "BroadcastQueryStageExec") and name in {m.getName() for m in p.getClass().getMethods()}:
                todo.append(getattr(p, name)())
        if "FileSourceScan" in p.getClass().getSimpleName():
            out.append(f"rows read {p.metrics().apply('numOutputRows').value()}")
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
    return " ".join(out)


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(2)
    letters = "aAbBcé_%x "
    rows = [(f"m{i:04}", "".join(r.choice(letters) for _ in range(r.randrange(12)))) for i in range(400)] + [("none", None), ("kelvin", "Kelvin ABC"), ("dot", "İab\nabc")]
    return spark.createDataFrame(rows, "id string, content string").withColumn("created_at", F.timestamp_seconds(F.lit(0))).cache()


def test_trigrams_equal_the_scan(texts):
    index = trigrams.grams(texts, "content", buckets=3).cache()
    r = random.Random(3)
    patterns = ["___", "a", "%a", "%ab%", "AB%", "%a_b%", "%k%", "%É%", "%i%", "%x_%_a%", "%\n%"] + ["".join(r.choice("aB%_cé") for _ in range(r.randrange(1, 7))) for _ in range(4)]
    named = texts.withColumnRenamed("content", "name").withColumns({"type": F.lit("t"), "source": F.lit("s")})
    for p in patterns:
        want = {r["id"] for r in E.find_entities(named, name_like=p).select("id").collect()}
        assert {r["id"] for r in trigrams.find_entities_indexed(named, index, p, type="t").select("id").collect()} == want, p
    for q in ("ab c", "a_b abc", "%", "é", " ", "xyz"):
        assert trigrams.search_memories_indexed(texts, index, q, 7).collect() == E.search_memories(texts, q, 7).collect(), q


def test_index_reads_only_the_grams_asked(spark, texts, tmp_path):
    path = str(tmp_path / "grams")
    lookup.clustered(trigrams.grams(texts, "content", buckets=1), "gram").write.option("parquet.block.size", 1024).option("parquet.page.size", 256).parquet(path)
    index = spark.read.parquet(path)
    found = trigrams.candidates(index, ["%abc%"])
    assert "In(gram" in plan(found) or "EqualTo(gram,abc)" in plan(found)
    lists = index.where(lookup.one_of("gram", ["abc"]))
    assert {r["gram"] for r in lists.collect()} == {"abc"}
    assert "StringStartsWith(gram,é)" in plan(trigrams.candidates(index, ["é"]))


def test_lookup_pushes_identifiers(spark, tmp_path):
    """A table of many row groups gives only those that hold the asked rows."""
    path = str(tmp_path / "rows")
    big = spark.range(20_000).select(F.format_string("k%06d", "id").alias("id"), F.sha2(F.col("id").cast("string"), 512).alias("content"))
    lookup.clustered(big, "id").write.option("parquet.block.size", 64 << 10).option("parquet.page.row.count.limit", 500).parquet(path)
    rows = spark.read.parquet(path)
    ids = [f"k{i:06}" for i in (3, 777, 19_999, 5, 10_000, 12, 13, 14, 15, 16, 17, 18, 400)]
    top = spark.createDataFrame([(i, float(k)) for k, i in enumerate(ids)], "ref string, score double")
    found = lookup.join_top(rows, top, "ref", 20)
    assert "PushedFilters: [" in plan(found) and "In(id" in plan(found)
    assert {r["id"] for r in found.collect()} == set(ids)
    assert rows_read(rows.where(lookup.one_of("id", ids))) < 10_000
    beyond = lookup.join_top(rows, top, "ref", lookup.PUSHED + 1)
    assert {r["id"] for r in beyond.collect()} == set(ids) and "In(id" not in plan(beyond)
    assert lookup.join_top(rows, top.limit(0), "ref", 5).isEmpty()


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    r = random.Random(8)
    words = [f"w{int(r.paretovariate(0.6))}" for _ in range(4000)]
    s = KnowledgeStore(spark, f"file://{tmp_path_factory.mktemp('store')}/s")
    rows = [(f"c{i:03}", None, " ".join(r.choice(words) for _ in range(r.randrange(1, 60))), "{}") for i in range(300)]
    chunks = spark.createDataFrame(rows, "id string, entity_id string, content string, metadata string").withColumn("created_at", F.timestamp_seconds(F.lit(0)))
    s.put_chunks(chunks)
    s.put_chunks(chunks.where("id < 'c050'").withColumn("content", F.concat("content", F.lit(" w1 again"))))
    s.put_embeddings(chunks.select(F.concat(F.lit("e"), "id").alias("id"), F.col("id").alias("ref_id"), F.lit("chunk").alias("ref_type"), F.array([F.lit(1.0), F.length("content").cast("double")]).cast("array<float>").alias("vector"), "created_at"))
    return s


def test_store_searches_read_identifiers_not_the_table(store):
    for found in (store.search_keyword("w1"), store.search_vector([1.0, 50.0])):
        scans = [x for x in re.findall(r"FileScan parquet [^\n]*", plan(found)) if "content" in x]
        assert scans and all("In(id" in x or "EqualTo(id" in x for x in scans)
        assert found.count() == 10
    plans = plan(store.search_keyword("w1")) + plan(store.snapshot().stats())
    assert "/lengths" not in plans


def test_dictionary_after_puts_and_deletes(store):
    recounted = lambda: ranked.dictionary(search.postings(store.table("chunks")))
    rows = lambda df: sorted(map(tuple, df.select("term", "df", "occurrences").collect()))
    assert rows(store.term_dictionary()) == rows(recounted())
    assert rows(store.term_dictionary("w1")) == [x for x in rows(recounted()) if x[0].startswith("w1")]
    assert "StringStartsWith(term,w1)" in plan(store.term_dictionary("w1"))
    total = store.snapshot().stats().first()
    assert tuple(total) == tuple(search.corpus_stats(store.table("chunks")).first())


def test_early_stop_is_exact_and_reads_less(store):
    chunks = store.table("chunks")
    postings, lengths = search.postings(chunks).cache(), search.lengths(chunks).cache()
    index = ranked.blocks(postings, lengths, block_chunks=2).cache()
    found = ranked.BlockSearch(index, ranked.dictionary(postings).cache(), search.stats_of(lengths))
    before, ranked.FIRST = ranked.FIRST, 8
    try:
        skipped = 0
        for query in ("w1", "w2 OR w3 OR w40", "w1 w2", "w1 OR nothing", "nothing"):
            for limit in (1, 400, 0) if query == "w1" else (1, 5):
                whole = search.keyword_hits(postings, search.stats_of(lengths), search.parse_match(query)).withColumn("score", F.round("score", 6)).orderBy(F.col("score").desc(), "chunk_id").limit(limit)
                assert found.topk(query, limit, digits=6).collect() == whole.collect(), (query, limit)
                skipped += found.n_blocks - found.n_read if limit == 1 else 0
        assert skipped > 20
    finally:
        ranked.FIRST = before
    for query in ("NOT a", '"a b"', "a*", "a NOT b", "a OR b c", "a a"):
        with pytest.raises(ValueError):
            found.topk(query)


def test_block_index_of_texts_shuffles_no_posting(spark, store):
    small = plan(ranked.block_index(spark.createDataFrame([("a", "b")], "id string, content string")))
    assert small.count("Exchange") == small.count("Exchange rangepartitioning") == 1 and "Join" not in small  # texts by length
    chunks = store.table("chunks").unionByName(store.table("chunks").limit(1).withColumns({"id": F.lit("none"), "content": F.lit(None).cast("string")}))
    postings, stats = search.postings(chunks).cache(), search.corpus_stats(chunks)
    made = ranked.block_index(chunks, block_chunks=7).cache()
    terms = ranked.dictionary_of(made).cache()
    entries = made.select("term", F.explode("entries").alias("e")).select("term", "e.*")
    assert sorted(map(tuple, entries.collect())) == sorted(map(tuple, postings.select("term", "chunk_id", "tf", "dl").collect()))
    assert made.where("df <> size(entries) OR df > 7 OR max_tf <> array_max(entries.tf) OR min_dl <> array_min(entries.dl)").isEmpty()
    assert made.select("term", "block").distinct().count() == made.count()
    assert sorted(map(tuple, terms.collect())) == sorted(map(tuple, ranked.dictionary(postings).collect()))
    found = ranked.BlockSearch(made, terms, ranked.totals_of(chunks, terms))
    for query in ("w1 OR w2 OR w3", "w1 w2"):
        whole = search.keyword_hits(postings, stats, search.parse_match(query)).withColumn("score", F.round("score", 6)).orderBy(F.col("score").desc(), "chunk_id").limit(9)
        assert found.topk(query, 9, digits=6).collect() == whole.collect()


def test_pivots_are_exact(spark, tmp_path):
    r = np.random.default_rng(4)
    centres = r.normal(size=(12, 6))
    vectors = [(f"v{i:04}", (centres[i % 12] + 0.1 * r.normal(size=6)).tolist()) for i in range(900)]
    vectors += [("zero", [0.0] * 6), ("none", None), ("short", [1.0, 2.0]), ("twin", vectors[0][1])]
    rows = spark.createDataFrame([(f"e{k}", k, "chunk", v) for k, v in vectors], "id string, ref_id string, ref_type string, vector array<float>")
    index = pivots.PivotIndex.build(rows, f"file://{tmp_path}/p", pivots.choose_pivots(rows, 12))
    for i, limit in ((0, 10), (5, 1), (7, 60), (9, 2000), (3, 0)):
        assert index.topk(vectors[i][1], limit, digits=6).collect() == search.vector_topk(rows, vectors[i][1], limit, digits=6).collect()
        if limit in (1, 10):
            assert index.n_read < 500
    for odd in ([0.0] * 6, [1.0], (-centres[0]).tolist()):
        assert index.topk(odd, 5, digits=6).collect() == search.vector_topk(rows, odd, 5, digits=6).collect()
    empty = pivots.PivotIndex.build(rows.limit(0), f"file://{tmp_path}/q")
    assert empty.topk([1.0], 5).isEmpty()


def test_many_starts_equal_one_by_one(spark):
    r = random.Random(6)
    edges = spark.createDataFrame([(f"n{r.randrange(90)}", f"n{r.randrange(90)}", r.choice("ab")) for _ in range(120)] + [("n1", "n1", "a")], "source_id string, target_id string, type string")
    starts = [f"n{i}" for i in range(70)] + ["n3", "lost"]
    got = {tuple(x) for x in graph.traverse_many(edges, spark.createDataFrame([(s,) for s in starts] + [(None,)], "id string"), 3, ["a"]).collect()}
    pairs = {(a, b) for s, t, k in edges.collect() if k == "a" for a, b in ((s, t), (t, s))}
    want = set()
    for s in set(starts):
        level = {s: 0}
        for depth in range(1, 4):
            level = {**{b: depth for a, b in pairs if level.get(a) == depth - 1 and b not in level}, **level}
        want |= {(s, n, k) for n, k in level.items()}
    assert got == want
    assert {tuple(x) for x in graph.traverse_many(edges, spark.createDataFrame([("n1",)], "id string"), 0).collect()} == {("n1", "n1", 0)}
    with pytest.raises(ValueError):
        graph.traverse_many(edges, edges.selectExpr("source_id AS id"), -1)


def test_many_starts_of_one_hub_share_masks(spark, monkeypatch):
    """Leaves of few hubs, all of them starts: a node has few groups, and the pairs of starts and nodes are not written."""
    leaves = [(f"leaf{i:04}", f"hub{i % 4}", "a") for i in range(1024)]
    edges = spark.createDataFrame(leaves, "source_id string, target_id string, type string")
    written = []
    monkeypatch.setattr(graph, "staged", lambda df, tag, of=graph.staged: written.append((tag, of(df, tag))) or written[-1][1])
    found = graph.traverse_many(edges, edges.selectExpr("source_id AS id"), 2)
    got = found.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("start", "id").alias("pairs")).collect()
    assert {r["level"]: (r["n"], r["pairs"]) for r in got} == {0: (1024, 1024), 1: (1024, 1024), 2: (1024 * 255, 1024 * 255)}
    assert found.where("substring(start, 8, 1) = '0' AND level = 2 AND id = 'leaf0004'").count() == sum(i % 4 == 0 and i % 10 == 0 for i in range(1024))
    assert sum(df.count() for tag, df in written if tag in ("frontier", "seen")) < 1024 + 4 * 16


def test_leaves_are_kept_beside_the_traversal(spark, monkeypatch):
    """No mask is written for the leaves of large hubs, whatever the depth."""
    edges = spark.createDataFrame([(f"leaf{i:04}", f"hub{i % 2}", "a") for i in range(800)] + [("hub0", "hub1", "a")], "source_id string, target_id string, type string")
    written = []
    monkeypatch.setattr(graph, "staged", lambda df, tag, of=graph.staged: written.append((tag, of(df, tag))) or written[-1][1])
    found = graph.traverse_many(edges, edges.selectExpr("source_id AS id").where("id < 'leaf0100'"), 3)
    assert {r["level"]: r["n"] for r in found.groupBy("level").agg(F.count_distinct("start", "id").alias("n")).collect()} == {0: 101, 1: 100 + 401, 2: 100 + 100 * 399 + 400, 3: 100 * 400}
    assert sum(df.count() for tag, df in written if tag == "frontier") < 20


def test_many_starts_with_leaves_of_any_hub(spark, monkeypatch):
    """Short lists and slices; leaves at nodes of any number of them, pairs that only have each other, starts among all kinds."""
    for name, value in (("LEAVES", 1), ("NAMES", 2), ("RECEIVERS", 2), ("ROWS", 8)):
        monkeypatch.setattr(graph, name, value)
    r = random.Random(7)
    pairs = [(f"n{r.randrange(12)}", f"n{r.randrange(12)}") for _ in range(11)] + [(f"n{r.randrange(12)}", f"x{i}") for i in range(30)] + [("p", "q"), ("v", "u"), ("n1", "n1"), ("x1", None)]
    edges = spark.createDataFrame([(*p, "a") for p in pairs], "source_id string, target_id string, type string")
    starts = ["q", "u", "v", "lost", "n0", "n3"] + [f"x{i}" for i in range(0, 30, 2)]
    both = {x for a, b in pairs if b for x in ((a, b), (b, a))}
    for depth in (1, 2, 4):
        got = [tuple(x) for x in graph.traverse_many(edges, spark.createDataFrame([(s,) for s in starts], "id string"), depth).collect()]
        want = set()
        for s in starts:
            level = {s: 0}
            for k in range(1, depth + 1):
                level = {**{b: k for a, b in both if level.get(a) == k - 1 and b not in level}, **level}
            want |= {(s, n, k) for n, k in level.items()}
        assert len(got) == len(want) and set(got) == want, depth
