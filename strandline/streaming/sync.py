"""Streams into the store: a directory of files, and conversations whose turns arrive in any order.

A micro-batch is one commit, and its number is part of that commit.  A batch that comes again after its commit (the
process died before the checkpoint knew) is skipped before any model is asked, so what the stream does to the store
happens exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import files_source

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _started(rows: DataFrame, store, source: str, checkpoint: str, max_chunk_bytes: int, once: bool, mode: str = "append") -> StreamingQuery:
    def ingest_batch(batch: DataFrame, epoch: int) -> None:
        store.remember(batch, source=source, max_chunk_bytes=max_chunk_bytes, stream=(checkpoint, epoch))

    writer = rows.writeStream.outputMode(mode).foreachBatch(ingest_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_directory(store, directory: str, checkpoint: str, max_chunk_bytes: int = 0, once: bool = True) -> StreamingQuery:
    """Ingest the files of a directory, each again when it has changed."""
    files_source.register(store.spark)
    files = store.spark.readStream.format(files_source.NAME).load(directory)
    return _started(files.select(F.col("path").alias("doc_id"), "content"), store, f"file:{directory}", checkpoint, max_chunk_bytes, once)


def thread_changes(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, content) of each conversation that a micro-batch has changed: its whole thread, as the batch
    operator ``connectors.threads`` gives it for all turns so far.

    A thread's lines are the state of a streaming aggregation: no row passes through Python, and what a batch reads and
    writes of the state is what it gives, the threads that it changes."""
    line = F.concat(F.coalesce(F.col(role), F.lit("")), F.lit(": "), F.coalesce(F.col(text), F.lit("")))
    at = F.struct(F.col(turn).isNotNull().alias("has"), F.coalesce(F.col(turn), F.lit(0)).cast("long").alias("turn"), line.alias("line"))
    lists = messages.groupBy(F.col(conversation).alias("conv_id")).agg(F.array_sort(F.collect_list(at)).alias("lines"))
    return lists.select("conv_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n").alias("content"))


class state_store:  # noqa: N801 (used as ``with state_store(spark):``)
    """The state store that keeps states on disk, not in the executors' memory, for queries started inside; the session's setting comes back after."""

    def __init__(self, spark):
        self.spark = spark

    def __enter__(self):
        self.before = self.spark.conf.get(STATE_STORE, None)
        self.spark.conf.set(STATE_STORE, ROCKS)

    def __exit__(self, *_):
        if self.before is None:
            self.spark.conf.unset(STATE_STORE)
        else:
            self.spark.conf.set(STATE_STORE, self.before)


def stream_conversations(store, messages: DataFrame, checkpoint: str, max_chunk_bytes: int = 6000, once: bool = True, **columns) -> StreamingQuery:
    """Keep the threads of a stream of turns in the store: only changed threads are cut and indexed again."""
    threads = thread_changes(messages, **columns)
    docs = threads.select(F.concat(F.lit("conversation-"), F.col("conv_id").cast("string")).alias("doc_id"), "content")
    with state_store(store.spark):
        return _started(docs, store, "conversation", checkpoint, max_chunk_bytes, once, "update")
