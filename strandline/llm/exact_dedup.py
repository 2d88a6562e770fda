"""Exact deduplication with Patricia tries.

Pass 1 builds owners.  Every input partition inserts its normalised texts, as
full byte strings, into a compressed radix trie whose terminal nodes hold the
preferred identifier and a count, so copies are merged before the shuffle: a
text that makes up a third of all rows leaves each task once.  The survivors are
dealt by (length, content hash) and inserted into tries again; their terminals
are the owners of the whole table.

A trie over its memory limit spills by subtree.  It goes down to the fork below which more
than half of it hangs and spills the largest subtrees of that fork until half is gone: to run
files in the task's own temporary folder (a lost task makes them again), or, before the shuffle,
straight downstream as partial terminals.  At the end each spilled subtree is rebuilt from its
runs alone, without the bytes that lead to it, and spills again if need be; so a prefix that many
texts share is passed once, however long it is.  A single text is never spilled from a trie of its own.

Pass 2 joins each row to its owner by content hash.  Only the rows
(identifier, hash) are shuffled, only owners of more than one row are joined,
and a hot hash is split by Spark's skew join.

Texts are equal when identical after lower-casing A-Z.  Defined results: null
counts as empty; a null identifier is preferred last; rows that repeat the same
identifier and text are all marked kept, for they cannot be told apart; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore

TRIE_BYTES = 96 << 20
NODE_BYTES = 220
BATCH_BYTES = 2 << 20


class Node:
    """``label`` leads here from the parent; ``count`` > 0 marks a terminal."""

    __slots__ = ("best", "children", "count", "label")

    def __init__(self, label: bytes, best=None, count: int = 0):
        self.label, self.best, self.count, self.children = label, best, count, None


def common_prefix(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of ``a`` and ``b[at:]``."""
    low, high = 0, min(len(a), len(b) - at)
    step = 8
    while low < high:
        probe = min(low + step, high)
        if a[low:probe] == b[at + low : at + probe]:
            low, step = probe, step * 4
        elif probe - low == 1:
            return low
        else:
            high, step = probe - 1 if probe - low <= 1 else probe, max(1, (probe - low) // 2)
    return low


class PatriciaTrie:
    """A compressed radix trie of byte strings; ``better(a, b)`` picks an identifier."""

    def __init__(self, better: Callable, limit: int = TRIE_BYTES, spill: Callable | None = None):
        self.better, self.limit, self.spill = better, limit, spill
        self.root, self.bytes, self.leaves = Node(b""), 0, 0

    def insert(self, key: bytes, best, count: int) -> None:
        node, at, grown = self.root, 0, 0
        while at < len(key):
            branch = key[at]
            child = node.children.get(branch) if node.children else None
            if child is None:
                child = Node(key[at:])
                if node.children is None:
                    node.children = {}
                node.children[branch] = child
                grown += len(child.label) + NODE_BYTES
                self.leaves += 1
            elif not key.startswith(child.label, at):
                same = common_prefix(child.label, key, at)
                fork = Node(child.label[:same])
                child.label = child.label[same:]
                fork.children = {child.label[0]: child}
                node.children[branch] = child = fork
                grown += NODE_BYTES
            node, at = child, at + len(child.label)
        node.best = best if node.count == 0 else self.better(node.best, best)
        node.count += count
        self.bytes += grown
        if self.bytes > self.limit and self.spill and self.leaves > 1:
            self.spill_half()

    def _sizes(self) -> dict[int, tuple[int, int]]:
        """(bytes, leaves) of the subtree of every node, by the node's id."""
        order, stack = [], [self.root]
        while stack:
            node = stack.pop()
            order.append(node)
            stack.extend((node.children or {}).values())
        out: dict[int, tuple[int, int]] = {}
        for node in reversed(order):
            below = [out[id(c)] for c in (node.children or {}).values()]
            out[id(node)] = (len(node.label) + NODE_BYTES + sum(b for b, _ in below), sum(n for _, n in below) if below else 1)
        return out

    def spill_half(self) -> None:
        sizes = self._sizes()
        of = lambda branch: sizes[id(node.children[branch])][0]
        node, path = self.root, b""
        while len(node.children) == 1 or of(max(node.children, key=of)) > self.bytes // 2:
            child = node.children[max(node.children, key=of)]
            if not child.children:
                break
            node, path = child, path + child.label
        goal = self.bytes // 2
        for branch in sorted(node.children, key=of, reverse=True):
            if self.bytes <= goal:
                break
            child = node.children.pop(branch)
            self.bytes -= sizes[id(child)][0]
            self.leaves -= sizes[id(child)][1]
            self.spill(path + bytes([branch]), self.walk(child, path))

    def detach(self, prefix: bytes) -> Iterator[tuple[bytes, object, int]]:
        """Take out all texts that begin with ``prefix``."""
        node, at = self.root, 0
        while node.children and prefix[at] in node.children:
            child = node.children[prefix[at]]
            if child.label.startswith(prefix[at:]):
                return self.walk(node.children.pop(prefix[at]), prefix[:at])
            if not prefix.startswith(child.label, at):
                break
            node, at = child, at + len(child.label)
        return iter(())

    def walk(self, node: Node, prefix: bytes) -> Iterator[tuple[bytes, object, int]]:
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            path = prefix + node.label
            if node.count:
                yield path, node.best, node.count
            stack.extend((c, path) for c in (node.children or {}).values())

    def terminals(self) -> Iterator[tuple[bytes, object, int]]:
        return self.walk(self.root, b"")


def owners(entries: Iterator[tuple[bytes, object, int]], better: Callable, limit: int = TRIE_BYTES) -> Iterator[tuple[bytes, object, int]]:
    """All owners among ``entries``, in bounded memory: (text, identifier, count)."""
    with tempfile.TemporaryDirectory() as folder:
        pending: list[tuple[Iterator, bytes]] = [(entries, b"")]
        serial = 0
        while pending:
            source, lead = pending.pop()
            runs: dict[bytes, str] = {}

            def spill(prefix: bytes, rows, runs=runs):
                nonlocal serial
                if prefix not in runs:
                    serial += 1
                    runs[prefix] = os.path.join(folder, str(serial))
                with open(runs[prefix], "ab") as f:
                    for row in rows:
                        pickle.dump(row, f)

            trie = PatriciaTrie(better, limit, spill)
            for text, best, count in source:
                trie.insert(text, best, count)
            # A prefix below another one that was spilled later belongs to that one's run.
            heads: list[bytes] = []
            for prefix in sorted(runs):
                if not heads or not prefix.startswith(heads[-1]):
                    heads.append(prefix)
            for prefix in heads:
                spill(prefix, trie.detach(prefix))
            for text, best, count in trie.terminals():
                yield lead + text, best, count
            for head in heads:
                parts = [path for prefix, path in runs.items() if prefix.startswith(head)]
                pending.append((_reread_all(parts, len(head)), lead + head))


def _reread_all(paths: list[str], skip: int) -> Iterator[tuple[bytes, object, int]]:
    for path in paths:
        yield from _reread(path, skip)


def _reread(path: str, skip: int) -> Iterator[tuple[bytes, object, int]]:
    with open(path, "rb") as f:
        while True:
            try:
                text, best, count = pickle.load(f)
            except EOFError:
                break
            yield text[skip:], best, count
    os.unlink(path)


def _largest(a, b):
    return b if a is None else a if b is None else max(a, b)


def _smallest(a, b):
    return b if a is None else a if b is None else min(a, b)


PREFER = {"largest": _largest, "smallest": _smallest}


def _texts(array: pa.Array) -> Iterator[bytes]:
    for x in array:
        v = x.as_py()
        yield b"" if v is None else (v.encode() if isinstance(v, str) else v).lower()  # bytes.lower() maps A-Z only


def _flush(rows: list[tuple]) -> pa.RecordBatch:
    length, sha, text, best, count = zip(*rows, strict=True) if rows else ([],) * 5
    return pa.RecordBatch.from_arrays([pa.array(length, pa.int64()), pa.array(sha, pa.binary()), pa.array(text, pa.binary()), pa.array(best, pa.int64()), pa.array(count, pa.int64())], ["length", "sha", "body", "best", "n"])


def _local(better: Callable, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple] = []
        size = 0

        def emit(_top, rows):
            ready.extend((len(t), hashlib.sha256(t).digest(), t, best, n) for t, best, n in rows)

        def drain():
            rows, total = [], 0
            while ready:
                row = ready.pop()
                rows.append(row)
                total += row[0]
                if total > BATCH_BYTES:
                    yield _flush(rows)
                    rows, total = [], 0
            if rows:
                yield _flush(rows)

        trie = PatriciaTrie(better, limit, emit)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), strict=True):
                trie.insert(text, key, 1)
            yield from drain()
        rows = []
        for t, best, n in trie.terminals():
            rows.append((len(t), hashlib.sha256(t).digest(), t, best, n))
            size += len(t)
            if size > BATCH_BYTES:
                yield _flush(rows)
                rows, size = [], 0
        if rows:
            yield _flush(rows)

    return textcore.tidy(run)


def _global(better: Callable, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def entries():
            for batch in batches:
                best, n = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                for i, text in enumerate(batch.column(0)):
                    yield text.as_py(), best[i], n[i]

        rows = []
        for text, best, n in owners(entries(), better, limit):
            if n > 1:
                rows.append((hashlib.sha256(text).digest(), best, n))
            if len(rows) >= 10_000:
                yield pa.RecordBatch.from_pylist([dict(zip(("sha", "keep_id", "group_size"), r, strict=True)) for r in rows], OWNERS)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(("sha", "keep_id", "group_size"), r, strict=True)) for r in rows], OWNERS)

    return textcore.tidy(run)


OWNERS = pa.schema([("sha", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


@textcore.tidy
def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sha = pa.array([hashlib.sha256(t).digest() for t in _texts(batch.column(1))], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), sha], ["_id", "_sha"])


def text_owners(docs: DataFrame, key: str = "doc_id", text: str = "text", prefer: str = "largest", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """(sha, keep_id, group_size) of every text that more than one row has."""
    rows = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text"))
    local = rows.mapInArrow(_local(PREFER[prefer], trie_bytes), "length long, sha binary, body binary, best long, n long")
    return local.repartition("length", "sha").select("body", "best", "n").mapInArrow(_global(PREFER[prefer], trie_bytes), "sha binary, keep_id long, group_size long")


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", prefer: str = "largest", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per document: key, keep_id, group_size, kept, text_sha256."""
    found = text_owners(docs, key, text, prefer, trie_bytes)
    rows = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text")).mapInArrow(_digests, "_id long, _sha binary")
    joined = rows.join(found, rows["_sha"] == found["sha"], "left")
    keep = F.when(F.col("sha").isNull(), F.col("_id")).otherwise(F.col("keep_id"))
    return joined.select(
        F.col("_id").alias(key),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )
