"""The knowledge store: immutable Parquet segments and an atomic manifest per commit.

A relation is a list of operations: ``add`` names a segment of rows, ``del`` a segment of
keys that what came before loses.  A commit writes only its own segments, then a manifest
with the longer lists; manifests are numbered and created exclusively, and a writer commits
against the version it read, so of two concurrent writers one fails and can retry and readers
always see a whole snapshot.  A relation of many operations is written as one segment again.

The search index is stored with the chunks: ``postings`` (each file sorted by term, so a
search reads the pages of its terms), the term dictionary ``terms`` and the one row ``totals``, both
kept by increments: a put or a forget adds what its own chunks change, so no search counts the corpus.
``grams`` has the trigrams of names and memories; it is only added to, for the exact test drops what is stale.
Texts and postings are large, so they are written once, as the segments they become, and postings are not shuffled; what a
write stages, and its shuffle files, are deleted when it is done.
Segments are sorted by identifier, and the best few rows of a search are read by identifiers that reach the scan."""

from __future__ import annotations

import json
import os
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .. import schemas
from ..operators import entities as E
from ..operators import forget as forgetting
from ..operators import graph, ingest, kept, lookup, ranked, recall, search, trigrams
from ..staging import own_scratch, staged

#: Rows with the same key: the later one replaces the earlier.
KEYS = {"relationships": ["id"], "chunks": ["id"], "memories": ["id"], "memory_entities": ["memory_id", "entity_id"], "embeddings": ["id"], "sync_state": ["connector"], "entities": ["id"], "origins": ["doc", "relation", "id"]}
#: Reads of a relation join one anti-join per ``del``; beyond so many operations it is compacted.
COMPACT_AT = 24
WRITERS = 8

#: Rows or keys, or the segment that has them already.
Changes = list[tuple[str, str, DataFrame | str]]


def _write(method):
    """A write's staged tables are deleted at its end: its result is a number."""

    @wraps(method)
    def run(self, *args, **options):
        with own_scratch(self.spark):
            return method(self, *args, **options)

    return run


class ConcurrentCommit(RuntimeError):
    """Another writer committed first."""


class Snapshot:
    """One version of the store; everything that is read and committed refers to it."""

    def __init__(self, store: KnowledgeStore, version: int):
        self.store, self.version, self.operations = store, version, store.manifest(version)

    def table(self, name: str) -> DataFrame:
        spark, schema = self.store.spark, schemas.TABLES[name]
        out = None
        for op in self.operations.get(name, []):
            at = f"{self.store.path}/{op['at']}"
            if "del" in op:
                if out is not None:
                    out = out.join(spark.read.parquet(at), op["del"], "left_anti").select(*schema.names)
            else:
                rows = spark.read.schema(schema).parquet(at)
                out = rows if out is None else out.unionByName(rows)
        out = spark.createDataFrame([], schema) if out is None else out
        if name == "terms":  # increments add up; a term's increments are found by its name
            out = out.groupBy("term").agg(F.sum("df").alias("df"), F.sum("occurrences").alias("occurrences")).where("df > 0")
        return out.agg(F.sum("n_chunks").alias("n_chunks"), F.sum("n_tokens").alias("n_tokens")) if name == "totals" else out

    def stats(self) -> DataFrame:
        """What a search needs to know of all chunks: one row a commit is read, not the chunks' lengths."""
        return self.table("totals").withColumn("avgdl", F.col("n_tokens") / F.col("n_chunks"))

    def grams(self, relation: str) -> DataFrame:
        return self.table("grams").where(F.col("relation") == relation)

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in schemas.TABLES}


class KnowledgeStore:
    def __init__(self, spark: SparkSession, path: str, model=None, embedder=None, extractor=None):
        self.spark, self.path, self.model, self.embedder, self.extractor = spark, path.rstrip("/"), model, embedder, extractor
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at("manifests"))

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def close(self) -> None:
        self.spark.catalog.clearCache()

    # Snapshots

    def version(self) -> int:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("manifests"))]
        return max((int(n.split(".")[0]) for n in names if n.endswith(".json") and n[0] != "_"), default=0)

    def manifest(self, version: int | None = None) -> dict[str, list[dict]]:
        version = self.version() if version is None else version
        if not version:
            return {}
        stream = self._fs.open(self._at("manifests", f"{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def snapshot(self) -> Snapshot:
        return Snapshot(self, self.version())

    def table(self, name: str) -> DataFrame:
        return self.snapshot().table(name)

    def tables(self) -> dict[str, DataFrame]:
        return self.snapshot().tables()

    def _typed(self, name: str, df: DataFrame, *more: str) -> DataFrame:
        return df.select(*[F.col(f.name).cast(f.dataType) for f in schemas.TABLES[name].fields], *more)

    def _segment(self, name: str, df: DataFrame, sort=lookup.clustered) -> str | None:
        """Where the rows were written; None without rows."""
        at = f"{name}/{uuid.uuid4().hex}"
        order = {"postings": ["term", "chunk_id"], "terms": ["term"], "grams": ["relation", "gram"], "chunks": ["id"], "memories": ["id"], "entities": ["id"]}.get(name)
        if order and set(order) <= set(df.columns) and len(df.columns) > len(order):
            df = sort(df, *order)
        writer = df.write.partitionBy("ref_type") if name == "embeddings" and "vector" in df.columns else df.write
        writer.option("compression", "zstd").parquet(f"{self.path}/{at}")
        return None if self.spark.read.schema(df.schema).parquet(f"{self.path}/{at}").isEmpty() else at

    def _rows(self, name: str, at: str | None, *more: StructField) -> DataFrame:
        """What a segment has, with columns that only its writer knows."""
        schema = StructType([*schemas.TABLES[name].fields, *more])
        return self.spark.read.schema(schema).parquet(f"{self.path}/{at}") if at else self.spark.createDataFrame([], schema)

    def commit(self, base: Snapshot, changes: Changes) -> int:
        """Write ``changes`` to ``base``, a list of ("add" or "del", relation, rows or keys); all of
        them become visible at once, if no other commit followed ``base``."""
        operations = {name: list(ops) for name, ops in base.operations.items()}

        def write(change: tuple[str, str, DataFrame | str]) -> str | None:
            kind, name, df = change
            if isinstance(df, str):
                return df
            if kind == "del":
                return self._segment(name, df) if base.operations.get(name) else None
            return self._segment(name, self._typed(name, df))

        with ThreadPoolExecutor(WRITERS) as pool:  # segments don't depend on each other
            written = list(pool.map(write, changes))
        for (kind, name, df), at in zip(changes, written, strict=True):
            if at:
                operations.setdefault(name, []).append({"del": df.columns, "at": at} if kind == "del" else {"at": at})
        manifest = {name: ops if len(ops) <= COMPACT_AT else self._compacted(base, name, ops) for name, ops in operations.items()}
        self._publish(base.version + 1, manifest)
        return base.version + 1

    def _compacted(self, base: Snapshot, name: str, operations: list[dict]) -> list[dict]:
        whole = Snapshot(self, base.version)
        whole.operations = {name: operations}
        at = self._segment(name, whole.table(name))
        return [{"at": at}] if at else []

    @_write
    def compact(self) -> int:
        """Write every relation as one segment."""
        base = self.snapshot()
        self._publish(base.version + 1, {name: self._compacted(base, name, ops) for name, ops in base.operations.items()})
        return base.version + 1

    def _publish(self, version: int, manifest: dict) -> None:
        """Create the manifest of ``version``; it is an error if another writer did."""
        jvm = self.spark._jvm
        target, temporary = self._at("manifests", f"{version:012d}.json"), self._at("manifests", f"_{uuid.uuid4().hex}")
        out = self._fs.create(temporary, False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                # A hard link is an exclusive create on one machine; renames there overwrite.
                os.link(temporary.toUri().getPath(), target.toUri().getPath())
            else:
                none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(temporary, target, none)
        except Exception as e:
            if self._fs.exists(target):
                raise ConcurrentCommit(f"version {version} exists") from e
            raise
        finally:
            self._fs.delete(temporary, False)

    # Writes

    def _put(self, base: Snapshot, name: str, new: DataFrame) -> Changes:
        """``new`` rows (staged: they are read several times) in place of old ones of the same key."""
        keys = KEYS[name]
        latest = new
        if not new.groupBy(*keys).count().where("count > 1").isEmpty():  # only then are whole rows shuffled by key
            latest = new.withColumn("_at", F.monotonically_increasing_id()).groupBy(*keys).agg(F.max_by(F.struct(*new.columns), "_at").alias("_r")).select("_r.*")
            latest = staged(latest, "latest") if name == "memories" else latest  # the index reads it too
        old = base.table(name).select(*keys)
        if base.operations.get(name):
            old = staged(old.join(latest.select(*keys), keys, "left_semi").distinct(), "old")
        changes = [("del", name, old), ("add", name, latest)]
        if name == "memories":
            changes.append(("add", "grams", self._grams(base, "memories", latest, "content")))
        return changes

    def _put_chunks(self, base: Snapshot, rows: DataFrame) -> Changes:
        """``rows`` are written once, as the segment, and all else is read from there."""
        numbered = rows.withColumn("_at", F.monotonically_increasing_id())
        at = self._segment("chunks", self._typed("chunks", numbered, "_at"))
        new = self._rows("chunks", at)
        if not new.groupBy("id").count().where("count > 1").isEmpty():
            several = self._rows("chunks", at, StructField("_at", LongType()))
            latest = several.groupBy("id").agg(F.max_by(F.struct(*new.columns), "_at").alias("_r")).select("_r.*")
            first, at = at, self._segment("chunks", latest)
            new = self._rows("chunks", at)
            self._fs.delete(self._at(first), True)
        old = base.table("chunks").select("id")
        if base.operations.get("chunks"):
            old = staged(old.join(new.select("id"), "id", "left_semi").distinct(), "old")
        changes: Changes = [("del", "chunks", old)] + ([("add", "chunks", at)] if at else [])
        return changes + self._index_changes(base, old, new)

    def _index_changes(self, base: Snapshot, gone: DataFrame | None, new: DataFrame | None) -> Changes:
        """The search index without the chunks ``gone`` (column ``id``) and with ``new`` ones.

        Texts are cut into tokens once: the totals count the tokens of the postings."""
        changes: Changes = []
        terms, totals = [], []
        if gone is not None and base.operations.get("chunks"):
            changes.append(("del", "postings", gone.withColumnRenamed("id", "chunk_id")))
            gone = staged(gone.distinct(), "gone")
            few = len(gone.limit(lookup.PUSHED + 1).collect()) <= lookup.PUSHED
            before = [lookup.semi(base.table("chunks"), gone)] if few else lookup.sliced(base.table("chunks"), gone)
            counted = lambda texts: search.postings(texts).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("occurrences"))
            for texts in before:
                lost = staged(counted(texts), "lost")
                terms.append(lost.select("term", (-F.col("df")).alias("df"), (-F.col("occurrences")).alias("occurrences")))
                totals += [texts.select(F.lit(-1).cast("long").alias("n_chunks"), F.lit(0).cast("long").alias("n_tokens")), lost.select(F.lit(0).cast("long").alias("n_chunks"), (-F.col("occurrences")).alias("n_tokens"))]
        if new is not None:
            at = self._segment("postings", self._typed("postings", search.postings(new)), lambda df, term, _: df.sortWithinPartitions(term))
            added = self._rows("postings", at)
            changes += [("add", "postings", at)] if at else []
            terms.append(added.select("term", F.lit(1).cast("long").alias("df"), F.col("tf").alias("occurrences")))
            totals += [new.select(F.lit(1).cast("long").alias("n_chunks"), F.lit(0).cast("long").alias("n_tokens")), added.select(F.lit(0).cast("long").alias("n_chunks"), F.col("tf").alias("n_tokens"))]
        if terms:
            change = reduce(DataFrame.unionByName, terms).groupBy("term").agg(F.sum("df").alias("df"), F.sum("occurrences").alias("occurrences"))
            changes.append(("add", "terms", change.where("df <> 0 OR occurrences <> 0")))
            changes.append(("add", "totals", reduce(DataFrame.unionByName, totals).agg(F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("n_chunks"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))))
        return changes

    def _grams(self, base: Snapshot, relation: str, rows: DataFrame, text: str) -> DataFrame:
        """Trigrams of the rows whose text is new: those of the same text are stored already."""
        new = rows.select("id", text).join(base.table(relation).select("id", text), ["id", text], "left_anti") if base.operations.get(relation) else rows
        return trigrams.grams(staged(new.select("id", text), "texts"), text, tag=f"{uuid.uuid4().hex}-").withColumn("relation", F.lit(relation))

    def _put_entities(self, base: Snapshot, new: DataFrame) -> Changes:
        """Upsert by (name, type): a known entity keeps its id and created_at."""
        names = schemas.TABLES["entities"].names
        known = base.table("entities").join(new.select("name", "type").distinct(), ["name", "type"], "left_semi").withColumn("seq", F.lit(-1).cast("long"))
        merged = E.upsert_entities(known.unionByName(new.select(*names).withColumn("seq", F.monotonically_increasing_id()))).select(*names)
        merged = staged(merged, "merged")
        return [("del", "entities", known.select("id")), ("add", "entities", merged), ("add", "grams", self._grams(base, "entities", merged, "name"))]

    @_write
    def put_entities(self, rows: DataFrame) -> int:
        base = self.snapshot()
        return self.commit(base, self._put_entities(base, staged(rows, "put")))

    @_write
    def put_relationships(self, rows: DataFrame) -> int:
        base, rows = self.snapshot(), staged(rows, "put")
        if not E.dangling_relationships(rows, base.table("entities")).isEmpty():
            raise ValueError("a relationship refers to no entity")
        return self.commit(base, self._put(base, "relationships", rows))

    @_write
    def put_chunks(self, rows: DataFrame) -> int:
        base = self.snapshot()
        return self.commit(base, self._put_chunks(base, rows))

    @_write
    def put_memories(self, rows: DataFrame) -> int:
        """``rows`` carry ``entity_ids``; memories and links are committed together."""
        base, rows = self.snapshot(), staged(rows, "put")
        links = rows.select(F.col("id").alias("memory_id"), F.explode("entity_ids").alias("entity_id")).distinct()
        return self.commit(base, self._put(base, "memories", rows.drop("entity_ids")) + self._put(base, "memory_entities", links))

    @_write
    def put_embeddings(self, rows: DataFrame) -> int:
        base = self.snapshot()
        return self.commit(base, self._put(base, "embeddings", staged(rows, "put")))

    def kept_answers(self) -> kept.KeptAnswers:
        """Answers and vectors that this store's models have given."""
        return kept.KeptAnswers(self.spark, f"{self.path}/answers")

    @_write
    def remember(self, docs: DataFrame | str, source: str | None = None, max_chunk_bytes: int = 0, model=None, stream: tuple[str, int] | None = None, **options) -> int:
        """Ingest documents (doc_id, content) in one commit.

        ``stream`` is the name of a stream and the number of its batch.  The number is stored with the batch's rows, and a
        batch whose number was already committed changes nothing, before any model is asked.

        What the same document of the same source had before (chunks, memories, links, vectors,
        relationships) is replaced.  Entities stay, for other documents may speak of them."""
        if isinstance(docs, str):
            docs = self.spark.createDataFrame([(uuid.uuid5(uuid.NAMESPACE_OID, docs).hex, docs)], "doc_id string, content string")
        base = self.snapshot()
        if stream is not None:
            done = base.table("sync_state").where(F.col("connector") == f"stream:{stream[0]}").first()
            if done is not None and int(done["state"]) >= stream[1]:
                return base.version
        if "kept" not in options and (model or self.model or self.embedder):
            options["kept"] = self.kept_answers()
        new = ingest.remember(docs, source=source, max_chunk_bytes=max_chunk_bytes, model=model or self.model, extractor=self.extractor, embed=self.embedder, known=base.table("entities"), **options)
        origins = new.pop("origins")
        before = staged(base.table("origins").join(new.pop("documents"), "doc", "left_semi"), "before")
        gone = lambda relation, name="id": before.where(F.col("relation") == relation).select(F.col("id").alias(name)).distinct()
        refs = before.where("relation IN ('chunks', 'memories')").select(F.col("id").alias("ref_id"), F.when(F.col("relation") == "chunks", "chunk").otherwise("memory").alias("ref_type")).distinct()
        changes: Changes = []
        if not before.isEmpty():
            changes += [("del", r, gone(r)) for r in ("relationships", "chunks", "memories")]
            changes += [("del", "memory_entities", gone("memories", "memory_id")), ("del", "embeddings", refs), ("del", "origins", before.select("doc").distinct())]
        changes += self._put_entities(base, new.pop("entities"))
        changes += self._index_changes(base, gone("chunks"), new["chunks"])
        changes += [("add", "grams", self._grams(base, "memories", new["memories"], "content")), ("add", "origins", origins)]
        changes += [("add", name, rows) for name, rows in new.items()]
        if stream is not None:
            changes += self._sync_state(f"stream:{stream[0]}", str(stream[1]))
        return self.commit(base, changes)

    @_write
    def forget(self, entity_id: str | None = None, source: str | None = None, strict_source: bool = False) -> int:
        base = self.snapshot()
        relations = {name: base.table(name) for name in forgetting.RELATIONS}
        keys = forgetting.doomed_keys(relations, entity_id, source, strict_source, staged)
        changes: Changes = self._index_changes(base, keys["chunks"], None)
        changes += [("del", name, rows.select(*KEYS[name])) for name, rows in keys.items()]
        return self.commit(base, changes)

    # Sync state

    def get_sync_state(self, connector: str) -> str:
        row = self.table("sync_state").where(F.col("connector") == connector).first()
        return row["state"] if row else ""

    def _sync_state(self, connector: str, state: str) -> Changes:
        row = self.spark.range(1).select(F.lit(connector).alias("connector"), F.lit(state).alias("state"), F.current_timestamp().alias("updated_at"))
        return [("del", "sync_state", row.select("connector")), ("add", "sync_state", row)]

    def set_sync_state(self, connector: str, state: str) -> int:
        return self.commit(self.snapshot(), self._sync_state(connector, state))

    @_write
    def put_sync_states(self, rows: DataFrame) -> int:
        """The latest of ``rows`` (connector, state, updated_at) per connector, in place of what was stored, unless that is later."""
        base = self.snapshot()
        both = staged(rows, "put").unionByName(base.table("sync_state").join(rows.select("connector").distinct(), "connector", "left_semi"))
        latest = staged(both.groupBy("connector").agg(F.max_by("state", F.struct("updated_at", "state")).alias("state"), F.max("updated_at").alias("updated_at")), "states")
        return self.commit(base, [("del", "sync_state", latest.select("connector")), ("add", "sync_state", latest)])

    # Reads

    def get_entity(self, id: str):
        row = E.get_entity(self.table("entities"), id).first()
        if row is None:
            raise LookupError(f"no entity {id!r}")
        return row

    def find_entities(self, name_like: str | None = None, **filters) -> DataFrame:
        at = self.snapshot()
        if name_like:
            return trigrams.find_entities_indexed(at.table("entities"), at.grams("entities"), name_like, **filters)
        return E.find_entities(at.table("entities"), **filters)

    def get_relationships(self, entity_id: str, types: list[str] | None = None) -> DataFrame:
        return E.relationships_of(self.table("relationships"), entity_id, types)

    def traverse(self, start: str, depth: int = 1, types: list[str] | None = None, **options) -> tuple[DataFrame, DataFrame]:
        at = self.snapshot()
        return graph.traverse(at.table("entities"), at.table("relationships"), start, depth, types, **options)

    def search_keyword(self, query: str, limit: int = 10, strict: bool = True) -> DataFrame:
        at = self.snapshot()
        return search.search_keyword(at.table("chunks"), query, limit, strict, at.table("postings"), at.stats())

    def rank_keyword(self, query: str, limit: int = 10, strict: bool = True) -> DataFrame | None:
        """(chunk_id, score) of the best chunks, without their texts."""
        at = self.snapshot()
        return search.rank_keyword(at.table("chunks"), query, limit, strict, at.table("postings"), at.stats())

    def term_dictionary(self, prefix: str = "") -> DataFrame:
        """(term, df, occurrences) of all terms, or of those that begin with ``prefix``."""
        return ranked.terms_with_prefix(self.table("terms"), prefix)

    def search_vector(self, query, limit: int = 10, ref_type: str = "chunk") -> DataFrame:
        at = self.snapshot()
        return search.search_vector(at.table("embeddings"), at.table("chunks"), query, limit, self.embedder, ref_type)

    def search_memories(self, query: str, limit: int = 10) -> DataFrame:
        at = self.snapshot()
        return E.with_links(trigrams.search_memories_indexed(at.table("memories"), at.grams("memories"), query, limit), at.table("memory_entities"))

    def memories_by_entity(self, entity_id: str) -> DataFrame:
        at = self.snapshot()
        return E.memories_by_entity(at.table("memories"), at.table("memory_entities"), entity_id)

    def recall(self, query: str, limit: int = recall.LIMIT, **options) -> DataFrame:
        at = self.snapshot()
        t = at.tables()
        sources = recall.Sources(self.spark, t["entities"], t["relationships"], t["chunks"], t["memories"], t["memory_entities"], t["embeddings"], t["postings"], at.stats())
        return recall.recall(sources, query, limit, self.model, self.embedder, **options)
