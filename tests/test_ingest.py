import json
import re
import os
import time

import pytest
from pyspark.sql import functions as F

from strandline import api, cli, owner, remote
from strandline.functions import extract
from strandline.operators import ingest, lookup, search
from strandline.providers import OfflineEmbedder, ScriptedModel
from strandline.sources import connectors
from strandline.sources.store import ConcurrentCommit, KnowledgeStore
from strandline.streaming.sync import stream_directory

NOTE = "---\nname: Ilse Moor\ntype: sailor\nrank: mate: first\nrank: captain\nbad line\n---\nSee [[Ketch]] and [[ Ketch ]] and [[Harbour|north]] [[ ]]."
ANSWER = '```json\n{"entities":[{"type":"sailor","name":"Ilse Moor"},{"type":"ship","name":"Windrose"}],"relationships":[{"source":"Ilse Moor","target":"Windrose","type":"commands"},{"source_id":"Ilse Moor","target_id":"Windrose","type":"repaired"},{"source":"Ilse Moor","target":"Missing","type":"lost"}],"memories":[{"content":"Ilse Moor commands the Windrose"},"a bare string",{"content":""},""]}\n```'


def _one(spark, text, column):
    return spark.createDataFrame([(text,)], "v string").select(column(F.col("v"))).first()[0]


def test_frontmatter(spark):
    e = _one(spark, NOTE, extract.frontmatter)
    assert (e["type"], e["name"], e["source"]) == ("sailor", "Ilse Moor", "frontmatter")
    assert json.loads(e["attributes"]) == {"rank": "captain"}


@pytest.mark.parametrize("text", ["no block", "---\nname: x", "---\n\n---\nbody", "---\ncolor: red\n---\n", "", None])
def test_no_frontmatter(spark, text):
    assert _one(spark, text, extract.frontmatter) is None


def test_wikilinks_once_in_order(spark):
    assert [e["name"] for e in _one(spark, NOTE, extract.wikilinks)] == ["Ketch", "Harbour|north"]
    assert _one(spark, "none", extract.wikilinks) == []
    assert _one(spark, None, extract.deterministic) == []


def test_model_json(spark):
    x = _one(spark, ANSWER, extract.model_json)
    assert [(e["type"], e["name"]) for e in x["entities"]] == [("sailor", "Ilse Moor"), ("ship", "Windrose")]
    assert [(r["source"], r["target"], r["type"]) for r in x["relationships"]][1] == ("Ilse Moor", "Windrose", "repaired")
    assert [m["content"] for m in x["memories"]] == ["Ilse Moor commands the Windrose", "a bare string"]
    assert _one(spark, "not json", extract.model_json) is None
    assert _one(spark, "{}", extract.model_json)["entities"] == []


def test_hybrid_concatenates(spark):
    row = spark.createDataFrame([(NOTE, ANSWER)], "c string, a string").select(extract.hybrid(F.col("c"), F.col("a"))["entities"]).first()[0]
    assert [e["name"] for e in row] == ["Ilse Moor", "Ketch", "Harbour|north", "Ilse Moor", "Windrose"]


def test_remember_resolves_names_and_links(spark):
    docs = spark.createDataFrame([("d1", NOTE)], "doc_id string, content string")
    made = ingest.remember(docs, source="notes", model=ScriptedModel({NOTE: ANSWER}), embed=True)
    assert {(r["type"], r["name"]) for r in made["entities"].collect()} == {("sailor", "Ilse Moor"), ("document", "Ketch"), ("document", "Harbour|north"), ("ship", "Windrose")}
    ids = {r["name"]: r["id"] for r in made["entities"].collect()}
    assert {(r["source_id"], r["target_id"], r["type"]) for r in made["relationships"].collect()} == {(ids["Ilse Moor"], ids["Windrose"], "commands"), (ids["Ilse Moor"], ids["Windrose"], "repaired")}
    links = made["memory_entities"].groupBy("memory_id").count().collect()
    assert [r["count"] for r in links] == [4, 4]
    assert made["embeddings"].groupBy("ref_type").count().count() == 2
    mentions = ingest.remember(docs, link_wikilinks=True)["relationships"].collect()
    assert {r["type"] for r in mentions} == {"mentions"} and len(mentions) == 2


def test_last_entity_of_a_name_wins(spark):
    answer = '{"entities":[{"type":"a","name":"X"},{"type":"b","name":"X"}],"relationships":[{"source":"X","target":"X","type":"r"}]}'
    docs = spark.createDataFrame([("d", "t", answer)], "doc_id string, content string, answer string")
    made = ingest.remember(docs, embed=False)
    want = {r["type"]: r["id"] for r in made["entities"].collect()}["b"]
    assert made["relationships"].first()["source_id"] == want


def test_threads_and_content_types(spark):
    rows = spark.createDataFrame([(1, 1, "assistant", "hi"), (1, 0, "user", "hello"), (2, 0, None, None)], "conv_id int, turn int, role string, text string")
    got = {r["conv_id"]: r["content"] for r in connectors.threads(rows).collect()}
    assert got == {1: "user: hello\n\nassistant: hi", 2: ": "}
    paths = ["a.MD", "b.csv", "c.png", "d", "e.tar.yml", "x.d/readme"]
    kinds = spark.createDataFrame([(p,) for p in paths], "p string").select(connectors.content_type(F.col("p"))).collect()
    assert [r[0] for r in kinds] == ["markdown", "csv", "", "", "yaml", ""]


@pytest.fixture
def store(spark, tmp_path):
    return KnowledgeStore(spark, str(tmp_path / "store"), embedder=OfflineEmbedder())


def test_store_round_trip_and_reopen(spark, store):
    assert store.version() == 0 and store.table("entities").isEmpty()
    store.remember(NOTE, source="notes")
    again = KnowledgeStore(spark, store.path, embedder=OfflineEmbedder())
    ilse = again.find_entities(name_like="ilse%").first()
    assert ilse["source"] == "frontmatter" and again.get_entity(ilse["id"])["name"] == "Ilse Moor"
    with pytest.raises(LookupError):
        again.get_entity("nobody")
    before = {n: t.count() for n, t in again.tables().items()}
    again.remember(NOTE, source="notes")
    assert {n: t.count() for n, t in again.tables().items()} == before  # identifiers are stable
    assert again.search_keyword("see").count() == 1 and again.recall("see ketch").count() == 1
    again.forget(source="frontmatter")
    assert again.find_entities(name_like="ilse%").isEmpty() and not again.table("chunks").isEmpty()
    again.close()


def test_store_checks_references_and_versions(spark, store):
    rel = spark.createDataFrame([("r", "x", "y", "t", "{}", "")], "id string, source_id string, target_id string, type string, attributes string, source string").withColumn("created_at", F.current_timestamp())
    with pytest.raises(ValueError):
        store.put_relationships(rel)
    store.set_sync_state("c", "mark one")
    stale = store.snapshot()
    state = lambda text: spark.createDataFrame([("c", text, None)], "connector string, state string, updated_at timestamp")
    store.set_sync_state("d", "x")
    with pytest.raises(ConcurrentCommit):  # a plan made on an older version can't be committed
        store.commit(stale, [("add", "sync_state", state("mark two"))])
    assert store.get_sync_state("d") == "x"
    store.commit(store.snapshot(), [("del", "sync_state", state("x").select("connector"))])
    store.set_sync_state("c", "mark one")
    assert store.get_sync_state("c") == "mark one" and store.get_sync_state("e") == ""
    store.set_sync_state("c", "mark three")
    assert store.get_sync_state("c") == "mark three"


def test_store_memories(spark, store):
    rows = spark.createDataFrame([("m1", "likes tea", "chat", ["a", "b"])], "id string, content string, source string, entity_ids array<string>").withColumns({"created_at": F.current_timestamp(), "updated_at": F.current_timestamp()})
    store.put_memories(rows)
    assert store.search_memories("TEA").first()["entity_ids"] == ["a", "b"]
    assert store.memories_by_entity("b").first()["id"] == "m1" and store.memories_by_entity("z").isEmpty()


def test_directory_sync_is_incremental(store, tmp_path):
    root = tmp_path / "notes"
    (root / "sub").mkdir(parents=True)
    (root / "a.md").write_text(NOTE)
    (root / "sub" / "b.CSV").write_text("x,y\n1,2")
    (root / "c.png").write_bytes(b"\x89PNG")
    past = time.time() - 100
    for f in (root / "a.md", root / "sub" / "b.CSV"):
        os.utime(f, (past, past))
    connector = connectors.FilesConnector(str(root))
    connector.sync(store)
    assert store.table("chunks").count() == 2 and json.loads(store.get_sync_state(connector.key))["last_sync"] > past
    version = store.version()
    connector.sync(store)
    assert store.table("chunks").count() == 2 and store.version() == version + 1  # the mark alone
    (root / "d.txt").write_text("new")
    os.utime(root / "d.txt", (time.time() + 5, time.time() + 5))
    connector.sync(store)
    assert store.table("chunks").count() == 3


def test_conversation_connector(store):
    connectors.ConversationConnector([]).sync(store)
    assert store.version() == 0
    connectors.ConversationConnector([("user", "hello there"), ("assistant", "x" * 50)], max_chunk_bytes=40).sync(store)
    rows = store.table("chunks").collect()
    assert len(rows) == 3 and all(json.loads(r["metadata"])["source"] == "conversation" and json.loads(r["metadata"])["parts"] == 3 for r in rows)


def test_stream_sync(store, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "a.md").write_text("first [[A]]")
    stream_directory(store, str(root), str(tmp_path / "cp")).awaitTermination()
    (root / "b.md").write_text("second [[B]]")
    stream_directory(store, str(root), str(tmp_path / "cp")).awaitTermination()
    assert store.table("chunks").count() == 2 and {r["name"] for r in store.find_entities().collect()} == {"A", "B"}


def test_names_resolve_to_stored_ids(spark, store):
    now = {"created_at": F.timestamp_seconds(F.lit(7)), "updated_at": F.timestamp_seconds(F.lit(7))}
    store.put_entities(spark.createDataFrame([("my-ilse", "sailor", "Ilse Moor", "{}", "hand")], "id string, type string, name string, attributes string, source string").withColumns(now))
    store.model = ScriptedModel({NOTE: ANSWER})
    store.remember(NOTE, source="notes")
    rels = store.table("relationships").collect()
    assert {r["source_id"] for r in rels} == {"my-ilse"} and len(rels) == 2
    kept = store.get_entity("my-ilse")
    assert kept["created_at"].timestamp() == 7 and kept["updated_at"] > kept["created_at"] and store.find_entities(name_like="ilse%").count() == 1
    entities = {r["id"] for r in store.table("entities").collect()}
    assert {r["target_id"] for r in rels} | {r["entity_id"] for r in store.table("memory_entities").collect()} <= entities


def test_reingesting_replaces(spark, store):
    doc = lambda text: spark.createDataFrame([("d", text)], "doc_id string, content string")
    long = "first part here.\n\nsecond part here.\n\nthird part here."
    store.model = ScriptedModel({long: '{"entities":[{"type":"t","name":"N"}],"memories":["one","two"]}', "first part here.": '{"entities":[{"type":"t","name":"N"}],"memories":["one"]}'})
    store.remember(doc(long), source="s", max_chunk_bytes=20)
    store.remember(doc("another second"), source="other")
    count = lambda name: store.table(name).count()
    assert count("chunks") == 4 and count("memories") == 2 and count("embeddings") == 6 and store.search_keyword("second").count() == 2
    store.remember(doc("first part here."), source="s", max_chunk_bytes=20)
    assert count("chunks") == 2 and count("memories") == 1 and count("memory_entities") == 1 and count("embeddings") == 3
    assert [r["content"] for r in store.search_keyword("second").collect()] == ["another second"] and store.table("totals").first()["n_chunks"] == 2


class CountingModel(ScriptedModel):
    def __init__(self, folder):
        super().__init__()
        self.folder = folder

    def extract(self, text, prompt=""):
        with open(os.path.join(self.folder, "calls"), "a") as f:
            f.write("x")
        return ANSWER


def test_one_model_call_per_document(store, tmp_path):
    store.model = CountingModel(str(tmp_path))
    store.remember(NOTE, source="s")
    assert (tmp_path / "calls").read_text() == "x"


class FixedEmbedder:
    dimensions = 3

    def embed(self, texts):
        return [[1.0, float("ketch" in t.lower()), 0.0] for t in texts]


class FixedExtractor:
    def extract(self, text, content_type):
        return {"entities": [{"type": "word", "name": text.split()[0]}], "memories": ["noted " + text.split()[0]]}


def test_given_embedder_and_extractor_are_used(spark, tmp_path):
    store = KnowledgeStore(spark, str(tmp_path / "own"), embedder=FixedEmbedder(), extractor=FixedExtractor())
    store.remember("Ketch and [[Link]]")
    store.remember("plain words")
    assert {len(r["vector"]) for r in store.table("embeddings").collect()} == {3}
    assert store.search_vector("a ketch", 1).first()["similarity"] == pytest.approx(1.0)
    assert {r["name"] for r in store.find_entities().collect()} == {"Ketch", "plain"} and store.search_memories("noted").count() == 2


def test_puts_write_segments_and_compaction_keeps_rows(spark, store):
    row = lambda i, text: spark.createDataFrame([(f"c{i}", None, text, "{}", None)], "id string, entity_id string, content string, metadata string, created_at timestamp")
    for i in range(3):
        store.put_chunks(row(i, f"word{i} shared"))
    first = store.manifest()["chunks"]
    store.put_chunks(row(1, "changed shared"))
    ops = store.manifest()["chunks"]
    assert ops[:3] == first and [sorted(o) for o in ops[3:]] == [["at", "del"], ["at"]]  # nothing was rewritten
    want = {r["id"]: r["score"] for r in store.search_keyword("shared").collect()}
    assert set(want) == {"c0", "c1", "c2"} and store.search_keyword("word1").isEmpty() and store.search_keyword("changed").count() == 1
    store.compact()
    assert [sorted(o) for o in store.manifest()["chunks"]] == [["at"]]
    assert {r["id"]: r["score"] for r in store.search_keyword("shared").collect()} == want
    plan = store.rank_keyword("shared")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,shared)" in plan and "regexp_extract_all" not in plan  # only the term's postings, no text


def test_owner_and_cli(spark, store, capsys):
    owner.store_owner(store, "Ann Lee", "ann", ["a@x.org"])
    assert owner.update_owner(store, nickname="annie", emails=["A@X.org", "b@x.org"]) == {"name": "Ann Lee", "nickname": "annie", "emails": ["a@x.org", "b@x.org"]}
    row = store.find_entities(type="person").collect()
    assert len(row) == 1 and json.loads(row[0]["attributes"]) == {"emails": "a@x.org, b@x.org", "nickname": "annie"}
    assert [r["content"] for r in store.table("chunks").collect()] == ["My name is Ann Lee. My nickname is annie. My email addresses are a@x.org, b@x.org."]
    assert cli.main(["--db", store.path, "recall", "annie"], spark) == 0
    assert "nickname is annie" in capsys.readouterr().out
    assert cli.main(["--db", store.path, "entity", "get", row[0]["id"]], spark) == 0
    assert json.loads(capsys.readouterr().out)["name"] == "Ann Lee"
    assert cli.main(["--db", store.path, "config", "--name", "Bo"], spark) == 0 and cli.main(["--db", store.path, "config"], spark) == 0
    assert [json.loads(x)["name"] for x in capsys.readouterr().out.splitlines()] == ["Bo", "Bo"]
    answers = iter(["Cy", "", "c@x.org", ""])
    assert cli.main(["--db", store.path, "init"], spark, lambda _: next(answers)) == 0
    assert owner.load_owner(store) == {"name": "Cy", "nickname": "", "emails": ["c@x.org"]}
    with pytest.raises(ValueError):
        owner.update_owner(KnowledgeStore(spark, store.path + "-new"), nickname="x")


def test_operations_by_name(store):
    api.call(store, "remember", content="See [[Ketch]]", source="notes")
    found = api.call(store, "find_entities", name="ketch").first()
    assert api.call(store, "get_entity", id=found["id"])["name"] == "Ketch" and api.call(store, "get_relationships", entity_id=found["id"]).isEmpty()
    assert api.call(store, "search", query="see").count() == 1 and api.call(store, "recall", query="see ketch").count() == 1
    assert api.call(store, "traverse", start_id=found["id"])[0].count() == 1
    api.call(store, "forget", entity_id=found["id"])
    assert api.call(store, "find_entities").isEmpty()
    with pytest.raises(LookupError):
        api.call(store, "drop")


def test_remote_providers_over_a_given_transport():
    sent = []

    def transport(url, headers, body):
        sent.append((url, headers, body))
        if url.endswith("/embeddings"):
            return {"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]}
        plan = '{"queries": [{"type": "keyword", "params": {"query": "q"}}]}'
        return {"choices": [{"message": {"content": plan}}]} if "completions" in url else {"content": [{"type": "text", "text": plan}, {"type": "other"}]}

    env = {"STRANDLINE_KEY": "k", "STRANDLINE_URL": "http://x/v1/", "STRANDLINE_MODEL": "m", "STRANDLINE_EMBEDDING_MODEL": "e", "STRANDLINE_EMBEDDING_DIMS": "1"}
    model, embedder = remote.providers_from(env, transport)
    assert model.decompose("q?") == [{"type": "keyword", "params": {"query": "q"}}] and model.extract("t", "p").startswith("{") and model.summarize(["a", "b"])
    assert sent[0][0] == "http://x/v1/chat/completions" and sent[0][2]["response_format"] and "response_format" not in sent[2][2] and sent[1][2]["messages"][0]["content"] == "p"
    assert embedder.embed(["a", "b"]) == [[1.0], [2.0]] and embedder.dimensions == 1
    other, offline = remote.providers_from({**env, "STRANDLINE_PROVIDER": "messages", "STRANDLINE_EMBEDDING_MODEL": ""}, transport)
    assert other.decompose("q?")[0]["type"] == "keyword" and sent[-1][2]["max_tokens"] == 4096 and offline.dimensions == 8
    assert remote.providers_from({}, transport)[0] is None
    for bad in ({"STRANDLINE_PROVIDER": "messages"}, {"STRANDLINE_PROVIDER": "x"}, {"STRANDLINE_KEY": "k"}, {**env, "STRANDLINE_PROVIDER": "messages"}):
        with pytest.raises(ValueError):
            remote.providers_from(bad, transport)
    with pytest.raises(ValueError):
        remote.CompletionsModel("k", "http://x", "m", lambda *a: {}).extract("t")


def test_a_put_cuts_its_texts_once(spark, tmp_path, monkeypatch):
    """Totals and dictionary come from the postings, also of texts that are replaced; a put that repeats a key keeps the later row."""
    store = KnowledgeStore(spark, f"file://{tmp_path}/once")
    rows = lambda *texts: spark.createDataFrame([(i, None, t, "{}") for i, t in texts], "id string, entity_id string, content string, metadata string").coalesce(1).withColumn("created_at", F.timestamp_seconds(F.lit(0)))

    def never(*_, **__):
        raise AssertionError("texts are cut again")

    monkeypatch.setattr(search, "lengths", never)
    store.put_chunks(rows(("a", "one two two"), ("b", "two"), ("c", None), ("d", "?")))
    store.put_chunks(rows(("a", "one"), ("b", "old"), ("b", "three three")))
    assert tuple(store.snapshot().stats().first())[:2] == (4, 3)
    assert sorted(map(tuple, store.term_dictionary().collect())) == [("one", 1, 1), ("three", 1, 2)]
    assert [r["id"] for r in store.search_keyword("three").collect()] == ["b"]


def test_a_put_writes_texts_and_postings_once(spark, tmp_path, monkeypatch):
    """Nothing of a text's size is staged, postings are not shuffled, and what is staged is gone after the put, also after a failed one."""
    from strandline import staging
    from strandline.sources import store as module

    tags, made = [], []
    monkeypatch.setattr(module, "staged", lambda df, tag, of=module.staged: tags.append(tag) or of(df, tag))
    monkeypatch.setattr(search, "postings", lambda *a, of=search.postings: made.append(of(*a)) or made[-1])
    store = KnowledgeStore(spark, f"file://{tmp_path}/once")
    row = lambda r, text: r.select(F.format_string("c%03d", "id").alias("id"), F.lit(None).cast("string").alias("entity_id"), F.concat(F.lit(text), F.col("id")).alias("content"), F.lit("{}").alias("metadata"), F.timestamp_seconds(F.lit(0)).alias("created_at"))
    folder, before = staging.shared_folder(spark).removeprefix("file://"), spark.conf.get(staging.SWEEP, None)
    left = lambda: {x for x in os.listdir(f"{folder}/strandline") if not x.startswith("store")} if os.path.isdir(f"{folder}/strandline") else set()
    found = left()
    store.put_chunks(row(spark.range(40), "first "))
    assert tags == [] and "Exchange" not in made[0].sortWithinPartitions("term")._jdf.queryExecution().executedPlan().toString()
    store.put_chunks(row(spark.range(20).union(spark.range(5)), "second "))  # keys that repeat
    assert set(tags) <= {"old", "gone", "lost"}
    with pytest.raises(Exception, match="no such row"):
        store.put_chunks(row(spark.range(3), "third ").withColumn("content", F.expr("CAST(raise_error('no such row') AS STRING)")))
    with pytest.raises(ValueError):
        store.forget()
    assert left() == found and spark.conf.get(staging.SWEEP, None) == before
    kept = {o["at"].partition("/")[2] for o in store.manifest()["chunks"]}
    assert not [x for x in (tmp_path / "once" / "chunks").iterdir() if x.name not in kept and list(x.glob("*.parquet"))]
    assert store.search_keyword("second", 50).count() == 20 and store.search_keyword("first", 50).count() == 20 and store.table("chunks").count() == 40
    files = [f for at in store.manifest()["postings"] if "del" not in at for f in (tmp_path / "once" / at["at"]).glob("*.parquet")]
    for f in files:
        terms = [r["term"] for r in spark.read.parquet(f"file://{f}").collect()]
        assert terms == sorted(terms)


def test_replaced_texts_are_found_by_ranges_of_ids(spark, tmp_path, monkeypatch):
    """No text is shuffled to learn which of them a put replaces, and no broadcast grows with their number."""
    monkeypatch.setattr(lookup, "PUSHED", 3)
    monkeypatch.setattr(lookup, "SLICE", 10)
    store = KnowledgeStore(spark, f"file://{tmp_path}/sliced")
    row = lambda r, text: r.select(F.format_string("c%03d", "id").alias("id"), F.lit(None).cast("string").alias("entity_id"), F.concat(F.lit(text), F.col("id") % 3).alias("content"), F.lit("{}").alias("metadata"), F.timestamp_seconds(F.lit(0)).alias("created_at"))
    store.put_chunks(row(spark.range(60), "same first "))
    parts = lookup.sliced(store.table("chunks"), spark.range(0, 200, 2).select(F.format_string("c%03d", "id").alias("id")))
    assert len(parts) > 5 and all("Exchange hashpartitioning" not in p._jdf.queryExecution().executedPlan().toString() for p in parts)
    found = sorted(r["id"] for p in parts for r in p.collect())
    assert found == [f"c{i:03}" for i in range(0, 60, 2)]
    store.put_chunks(row(spark.range(0, 200, 2), "same second "))
    whole = search.postings(store.table("chunks")).groupBy("term").agg(F.count(F.lit(1)), F.sum("tf"))
    assert sorted(map(tuple, store.term_dictionary().collect())) == sorted(map(tuple, whole.collect()))
    assert tuple(store.snapshot().stats().first())[:2] == (130, 390)


def test_extractions_are_dealt_by_document(spark, monkeypatch):
    """As many slices as there are extracted rows to group, whatever files they are written to; a key that repeats stays whole."""
    answer = F.format_string('{"entities":[{"type":"t","name":"n%d"},{"type":"t","name":"both"}],"memories":["m%d"]}', "id", "id")
    docs = spark.range(40).select((F.col("id") % 30).alias("doc_id"), F.lit("text").alias("content"), answer.alias("answer")).coalesce(1)
    monkeypatch.setattr(ingest, "SLICE", 8)
    links = ingest.remember(docs, source="s")["memory_entities"]
    assert links.count() == 20 * 2 + 10 * 3  # ten keys come twice, with the same memory
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert re.findall(r"RepartitionByExpression \[doc_id#\d+L?\], (\d+)", plan) == ["15", "15"]
