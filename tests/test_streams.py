"""The data source, exactly-once batches, threads in state, and answers that are kept."""

import os
import random

import pytest
from pyspark.sql import functions as F

from strandline.operators.kept import KeptAnswers
from strandline.providers import ScriptedModel
from strandline.sources import connectors, files_source
from strandline.sources.store import KnowledgeStore
from strandline.streaming import sync


def touch(path, text, at):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text) if isinstance(text, str) else path.write_bytes(text)
    os.utime(path, (at, at))


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in"
    touch(root / "b.MD", "bé", 100)
    touch(root / "sub" / "a.txt", b"bad \xff byte", 200)
    touch(root / "sub" / "c.yaml", "", 300)
    touch(root / "no.exe", "skipped", 400)
    touch(root / "none", "skipped", 400)
    return root


def test_files_as_a_data_source(spark, folder, tmp_path):
    files_source.register(spark)
    read = lambda **options: spark.read.format("strandline_files").options(**options).load(str(folder))
    rows = {r["path"].rpartition("/")[2]: r for r in read().collect()}
    assert {k: r["content"] for k, r in rows.items()} == {"b.MD": "bé", "a.txt": "bad � byte", "c.yaml": ""}
    assert {k: r["content_type"] for k, r in rows.items()} == {"b.MD": "markdown", "a.txt": "text", "c.yaml": "yaml"}
    assert read(partitionBytes=1).rdd.getNumPartitions() == 3 and read(partitionBytes=12).rdd.getNumPartitions() == 2
    # The same rows as the reader of the connector, and its strict mark.
    same = connectors.read_directory(spark, str(folder))
    key = lambda df, at: sorted((r["path"].rpartition("/")[2], r["content"], r["content_type"], r[at]) for r in df.collect())
    assert key(read(), "modified") == key(same, "modificationTime")
    assert {r["path"].rpartition("/")[2] for r in read(since=100 * 10**6).collect()} == {"a.txt", "c.yaml"}
    assert spark.read.format("strandline_files").load(str(tmp_path / "nothing")).isEmpty()


class Counting(ScriptedModel):
    """Counts calls in a file; fails on the first of each text if asked to."""

    def __init__(self, folder, fails=0):
        super().__init__()
        self.folder, self.fails = str(folder), fails

    def extract(self, text, prompt=""):
        at = os.path.join(self.folder, f"{text.encode().hex()[:80]}.calls")
        with open(at, "a") as f:
            f.write("x")
        if os.path.getsize(at) <= self.fails:
            raise ConnectionError("not now")
        return '{"entities": [{"type": "t", "name": "N"}], "memories": ["of %s"]}' % (text.split() or ["nothing"])[0]

    def calls(self):
        return {f: os.path.getsize(os.path.join(self.folder, f)) for f in os.listdir(self.folder) if f.endswith(".calls")}


def test_stream_restarts_and_reads_changed_files_again(spark, folder, tmp_path):
    store = KnowledgeStore(spark, f"file://{tmp_path}/store")
    run = lambda: sync.stream_directory(store, str(folder), f"{tmp_path}/cp").awaitTermination()
    contents = lambda: sorted(r["content"] for r in store.table("chunks").collect())
    run()
    assert contents() == ["", "bad � byte", "bé"]
    before = store.version()
    run()
    assert store.version() == before  # nothing new
    touch(folder / "b.MD", "changed", 500)
    touch(folder / "d.log", "new", 600)
    run()
    assert contents() == ["", "bad � byte", "changed", "new"]


def test_a_repeated_batch_asks_no_model(spark, folder, tmp_path):
    """The process dies between the store's commit and the checkpoint's: the batch comes again and is skipped."""
    (tmp_path / "calls").mkdir()
    store = KnowledgeStore(spark, f"file://{tmp_path}/store", model=Counting(tmp_path / "calls"))
    whole = store.remember

    def dying(*args, **options):
        whole(*args, **options | {"kept": None})  # without kept answers, so that every asking counts
        raise RuntimeError("killed")

    store.remember = dying
    with pytest.raises(Exception, match="killed"):
        sync.stream_directory(store, str(folder), f"{tmp_path}/cp").awaitTermination()
    version, calls = store.version(), store.model.calls()
    assert sum(calls.values()) == 3
    store.remember = lambda *args, **options: whole(*args, **options | {"kept": None})
    sync.stream_directory(store, str(folder), f"{tmp_path}/cp").awaitTermination()
    assert store.version() == version and store.model.calls() == calls and store.table("chunks").count() == 3
    touch(folder / "e.md", "later", 900)
    sync.stream_directory(store, str(folder), f"{tmp_path}/cp").awaitTermination()
    assert store.table("chunks").count() == 4 and sum(store.model.calls().values()) == 4


def test_threads_of_a_stream_equal_the_batch(spark, tmp_path):
    r = random.Random(5)
    rows = [(c, t, r.choice(["user", None]), r.choice([f"text {c} {t}", "", None])) for c in range(7) for t in range(6)] + [(3, None, "user", "no turn"), (3, 2, "user", "twice"), (3, 2, "user", "twice")]
    r.shuffle(rows)
    schema = "conv_id long, turn int, role string, text string"
    store = KnowledgeStore(spark, f"file://{tmp_path}/store")
    for i in range(0, len(rows), 15):
        spark.createDataFrame(rows[i : i + 15], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/turns")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/turns")
        sync.stream_conversations(store, stream, f"{tmp_path}/cp", max_chunk_bytes=0).awaitTermination()
        so_far = connectors.threads(spark.createDataFrame(rows[: i + 15], schema))
        assert sorted(x["content"] for x in store.table("chunks").collect()) == sorted(x["content"] for x in so_far.collect())
    assert spark.conf.get(sync.STATE_STORE, "").rpartition(".")[2] != "RocksDBStateStoreProvider"


def test_threads_are_a_streaming_aggregation(spark, tmp_path):
    """No Python state: any state store will do, and threads of two batches equal the batch operator, equal turns and a null id too."""
    schema = "conv_id long, turn int, role string, text string"
    rows = [(1, 2, "user", "b"), (1, None, "user", "z"), (None, 1, "user", "of none"), (2, 1, None, "é"), (1, 2, "user", "b"), (1, 1, None, None), (2, 1, None, "z"), (None, 0, "a", "")]
    got = {}
    for half in (rows[:4], rows[4:]):
        spark.createDataFrame(half, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        changes = sync.thread_changes(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        writer = changes.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True)
        writer.foreachBatch(lambda batch, _: got.update({r["conv_id"]: r["content"] for r in batch.collect()})).start().awaitTermination()
    whole = connectors.threads(spark.createDataFrame(rows, schema)).collect()
    assert got == {r["conv_id"]: r["content"] for r in whole} and len(got) == 3


def test_each_text_is_asked_once_and_failures_are_repeated(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    model = Counting(tmp_path / "calls", fails=2)
    kept = KeptAnswers(spark, f"file://{tmp_path}/answers", pause=0.01)
    docs = spark.createDataFrame([(i, f"text{i % 5} of a document") for i in range(40)] + [(98, None), (99, "")], "doc_id int, content string").repartition(4)
    got = kept.answers(docs, model, prompt="p").collect()
    assert len(got) == 42 and all(r["answer"] for r in got if r["content"])
    assert set(model.calls().values()) == {3} and len(model.calls()) == 6  # two failures and an answer each; null is the empty text
    assert kept.answers(docs.union(docs), model, prompt="p").count() == 84 and set(model.calls().values()) == {3}
    with pytest.raises(Exception, match="not now"):
        KeptAnswers(spark, f"file://{tmp_path}/other", attempts=2, pause=0.01).answers(docs.where("doc_id = 99"), Counting(tmp_path, fails=9)).collect()


class Embedder:
    model, dimensions = "count-words", 2

    def __init__(self, folder):
        self.at = os.path.join(str(folder), "embedded")

    def embed(self, texts):
        with open(self.at, "a") as f:
            f.write("x" * len(texts))
        return [[float(len(t.split())), 1.0] for t in texts]


def test_vectors_are_kept(spark, tmp_path):
    kept, embedder = KeptAnswers(spark, f"file://{tmp_path}/answers"), Embedder(tmp_path)
    rows = spark.createDataFrame([(i, "word " * (i % 4)) for i in range(20)], "id int, content string")
    for _ in range(2):
        assert {(r["content"].count("word"), tuple(r["vector"])) for r in kept.vectors(rows, embedder).collect()} == {(k, (float(k), 1.0)) for k in range(4)}
    assert os.path.getsize(embedder.at) == 4
    store = KnowledgeStore(spark, f"file://{tmp_path}/store", embedder=embedder)
    store.remember("two words")
    store.remember(spark.createDataFrame([("x", "two words"), ("y", "two words")], "doc_id string, content string"), source="other")
    assert store.table("embeddings").count() == 3 and os.path.getsize(embedder.at) == 5


def test_a_run_clears_up_after_itself(spark, tmp_path):
    from strandline.staging import scratch, shared_folder, staged

    with scratch(spark) as folder:
        rows = staged(spark.range(5), "rows")
        with scratch(spark) as inner:
            staged(rows, "again")
            assert inner.startswith(folder) and os.path.isdir(inner.removeprefix("file://"))
        assert not os.path.exists(inner.removeprefix("file://"))
        rows.write.parquet(f"{tmp_path}/out")
    assert not os.path.exists(folder.removeprefix("file://")) and not shared_folder(spark).startswith(folder)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5
    with pytest.raises(KeyError), scratch(spark) as folder:
        staged(spark.range(1), "rows")
        raise KeyError
    assert not os.path.exists(folder.removeprefix("file://"))
