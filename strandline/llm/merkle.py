"""A Merkle manifest of a dataset: one root over all sources, and a proof for every record.

A record's leaf is the SHA-256 of its length-prefixed fields.  The leaves of a source, in the order of
the key, form a tree of up to three children a node; the sources' roots form another such tree.

1. Leaves are made inside the scan; from here on only digests move.
2. Positions.  Leaves are range-partitioned by (tree, key), which also splits a tree with a third of all
   rows over many tasks, and written with their row numbers; a partition's share of each tree is
   counted, the counts are summed up to offsets, and so every leaf gets its place without a
   window over its tree.
3. Up.  Aligned blocks of 3^6 leaves are rows of their own.  A recursive postorder traversal of a
   block returns its subtree's digest; the block roots are the leaves of the next distributed
   traversal, until each tree is one block.  The roots of the sources go the same way.
4. Down.  Each block is traversed again; while the recursion unwinds, every node appends the siblings of
   its children to the leaves below them.  A block root's own siblings come from the level above by a
   join on the block, so a leaf's proof is complete where its block is.

Memory: a block of 729 leaves and their proofs.  Nothing goes to the driver but counts.

Defined results: a null field is ``-``; leaves of equal keys are ordered by digest (null keys
first); repeated rows are leaves of their own; the null source is the first tree, and differs from
the empty one; a record with a null key is never tampered with; an empty table gives an empty result;
other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textcore
from .staging import staged

ARITY = 3
DEPTH = 6
BLOCK = ARITY**DEPTH
ROWS_PER_TASK = 1 << 18

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def tree_name(source: str | Column) -> Column:
    """A name that is never null and sorts as the source does, null first."""
    source = F.col(source) if isinstance(source, str) else source
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def positioned(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` (tree, digest and others) with ``pos``, their place in the tree, and ``total``, its size."""
    spark = nodes.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-nodes.count() // ROWS_PER_TASK))
    keys = ["tree", *[c for c in order if c != "tree"], "digest"]
    dealt = nodes.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    dealt = staged(dealt.withColumn("at", F.monotonically_increasing_id()), "places").withColumn("part", F.shiftright("at", 33))
    shares = dealt.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    offsets = shares.select("tree", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(Window.partitionBy("tree")).alias("total"))
    return dealt.join(offsets, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def blocks_of(nodes: DataFrame, extra: list[str]) -> DataFrame:
    """A row for each aligned block of BLOCK nodes."""
    node = F.struct("pos", "digest", *extra)
    rows = nodes.groupBy("tree", F.floor(F.col("pos") / BLOCK).cast("long").alias("block"), "total").agg(F.sort_array(F.collect_list(node)).alias("nodes"))
    return staged(rows, "blocks")


def sha(*parts: bytes) -> bytes:
    """The digest of digests, which are written as hexadecimal text."""
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


def traverse(digests: list[bytes], whole: bool, proofs: list[list[bytes]] | None = None) -> bytes:
    """The root of a block of digests; ``proofs`` get each leaf's steps, lowest first.

    A ``whole`` tree ends where one node remains; a block of a larger tree always has DEPTH levels."""
    counts = [len(digests)]
    while counts[-1] > 1 if whole else len(counts) <= DEPTH:
        counts.append(-(-counts[-1] // ARITY))

    def visit(level: int, at: int) -> tuple[bytes, int, int]:
        """The digest of a node, and the leaves it contains."""
        if level == 0:
            return digests[at], at, at + 1
        below = [visit(level - 1, child) for child in range(ARITY * at, min(ARITY * at + ARITY, counts[level - 1]))]
        if proofs is not None:
            for i, (_, low, high) in enumerate(below):
                step = bytes([4 * i + len(below) - 1]) + b"".join(d for j, (d, _, _) in enumerate(below) if j != i)
                for leaf_ in range(low, high):
                    proofs[leaf_].append(step)
        return sha(*[d for d, _, _ in below]), below[0][1], below[-1][2]

    return visit(len(counts) - 1, 0)[0]


def steps(path: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """A path's steps: the place among the siblings, and the siblings."""
    at = 0
    while at < len(path):
        place, n = divmod(path[at], 4)
        yield place, [path[at + 1 + 32 * i : at + 33 + 32 * i] for i in range(n)]
        at += 1 + 32 * n


def fold(digest: bytes, path: bytes) -> bytes:
    """The root that a leaf and its proof give."""
    for place, others in steps(path):
        digest = sha(*others[:place], digest, *others[place:])
    return digest


def _structs(column: pa.Array) -> Iterator[tuple[int, int, pa.StructArray]]:
    """Each row's range in the flat array of all rows' nodes."""
    ends, flat = column.offsets.to_pylist(), column.values
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield a, b, flat


def _up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tree, pos, digest, total): each block's root, as a node of the level above."""
    for batch in batches:
        totals, roots = batch.column("total").to_pylist(), []
        for (a, b, flat), total in zip(_structs(batch.column("nodes")), totals, strict=True):
            roots.append(traverse(flat.field("digest").slice(a, b - a).to_pylist(), total <= BLOCK))
        above = pa.array([-(-t // BLOCK) for t in totals], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("block"), pa.array(roots, pa.binary()), above], ["tree", "pos", "digest", "total"])


NODE = "tree string, pos long, digest binary, total long"
ABOVE = "tree string, block long, path binary, subroot binary, root binary"


def _down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tree, block, path, subroot, root) of each node of the blocks: what its own block needs below."""
    for batch in batches:
        tree, path, subroot, root = (batch.column(c).to_pylist() for c in ("tree", "path", "subroot", "root"))
        totals = batch.column("total").to_pylist()
        for i, (a, b, flat) in enumerate(_structs(batch.column("nodes"))):
            proofs: list[list[bytes]] = [[] for _ in range(b - a)]
            traverse(flat.field("digest").slice(a, b - a).to_pylist(), totals[i] <= BLOCK, proofs)
            n = b - a
            columns = [pa.array([tree[i]] * n), flat.field("pos").slice(a, n), pa.array([b"".join(p) + path[i] for p in proofs], pa.binary()), pa.array([subroot[i]] * n, pa.binary()), pa.array([root[i]] * n, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["tree", "block", "path", "subroot", "root"])


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The result's rows: each leaf's proof, and the root that the (changed) record gives."""
    for batch in batches:
        path, subroot, root, totals = (batch.column(c).to_pylist() for c in ("path", "subroot", "root", "total"))
        for i, (a, b, flat) in enumerate(_structs(batch.column("nodes"))):
            n = b - a
            digests, changed = (flat.field(c).slice(a, n).to_pylist() for c in ("digest", "changed"))
            proofs: list[list[bytes]] = [[] for _ in range(n)]
            traverse(digests, totals[i] <= BLOCK, proofs)
            proof, folded = [], []
            for digest, other, own in zip(digests, changed, proofs, strict=True):
                whole = b"".join(own) + path[i]
                proof.append(sha(*[d for _, others in steps(whole) for d in others]).hex())
                folded.append(fold(digest if other is None else other, whole).hex())
            top = root[i].hex()
            columns = [flat.field("id").slice(a, n), [d.hex() for d in digests], [subroot[i].hex()] * n, [top] * n, proof, folded, [f == top for f in folded]]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


class Tree:
    """All levels of the trees of ``nodes`` (tree, pos, total, digest and ``extra``)."""

    def __init__(self, nodes: DataFrame, extra: list[str]):
        self.levels: list[DataFrame] = []
        self.ended: list[DataFrame] = []  # per level, the trees that it makes one node of
        while True:
            blocks = blocks_of(nodes, extra if not self.levels else [])
            largest = blocks.agg(F.max("total")).first()[0] or 0
            roots = staged(blocks.mapInArrow(_up, NODE), "roots")
            self.levels.append(blocks)
            self.ended.append(roots.where("total = 1").select("tree", "digest"))
            if largest <= BLOCK:
                break
            nodes = roots.where("total > 1")

    def roots(self) -> DataFrame:
        """(tree, digest) of every tree."""
        out = self.ended[0]
        for more in self.ended[1:]:
            out = out.unionByName(more)
        return out

    def below(self, tops: DataFrame) -> DataFrame:
        """The lowest blocks with what is above them; ``tops`` has that for whole trees."""
        paths = None
        for level in range(len(self.levels) - 1, -1, -1):
            ends = tops.join(self.ended[level].select("tree"), "tree", "left_semi").select("tree", F.lit(0).cast("long").alias("block"), "path", "subroot", "root")
            paths = ends if paths is None else paths.unionByName(ends)
            joined = self.levels[level].join(paths, ["tree", "block"]).select("tree", "total", "nodes", "path", "subroot", "root")
            if level:
                paths = staged(joined.mapInArrow(_down, ABOVE), "paths")
        return joined


def manifest(docs: DataFrame, key: str = "doc_id", source: str = "source", fields: tuple[str, ...] = FIELDS, changed: Column | None = None) -> DataFrame:
    """One row per record: key, leaf, subroot (of its source), root, proof_sha256, folded_root, verified.

    ``changed`` is the leaf of the record as it is now (null: as it was); the proof is of the record as it
    was, so ``verified`` tells which records still are what the manifest says."""
    kind = docs.select(key).schema[0].dataType.simpleString()
    leaves = docs.select(
        tree_name(source).alias("tree"),
        F.col(key).alias("id"),
        F.unhex(leaf([F.col(f) for f in fields])).alias("digest"),
        (F.lit(None).cast("binary") if changed is None else F.unhex(changed)).alias("changed"),
    )
    records = Tree(positioned(staged(leaves, "leaves"), ["tree", "id"]), ["id", "changed"])
    subroots = staged(records.roots(), "subroots")
    sources = Tree(positioned(subroots.select(F.lit("all").alias("tree"), F.col("tree").alias("of"), "digest"), ["of"]), ["of"])
    root = sources.roots().select("tree", F.lit(b"").alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    tops = staged(sources.below(root).mapInArrow(_tops, "tree string, path binary, root binary"), "tops").join(subroots, "tree").select("tree", "path", F.col("digest").alias("subroot"), "root")
    found = records.below(tops).mapInArrow(textcore.tidy(_leaves), f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return found.withColumnRenamed("id", key)


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tree, path, root) of each source."""
    for batch in batches:
        path, root, totals = (batch.column(c).to_pylist() for c in ("path", "root", "total"))
        for i, (a, b, flat) in enumerate(_structs(batch.column("nodes"))):
            proofs: list[list[bytes]] = [[] for _ in range(b - a)]
            traverse(flat.field("digest").slice(a, b - a).to_pylist(), totals[i] <= BLOCK, proofs)
            yield pa.RecordBatch.from_arrays([flat.field("of").slice(a, b - a), pa.array([b"".join(p) + path[i] for p in proofs], pa.binary()), pa.array([root[i]] * (b - a), pa.binary())], ["tree", "path", "root"])


def without_line_ends(key: str = "doc_id", fields: tuple[str, ...] = FIELDS, text: str = "text") -> Column:
    """The leaf of a record whose text lost its line ends, for keys of even crc32; null for others."""
    tampered = (F.crc32(F.col(key).cast("string").cast("binary")) % 2 == 0) & F.contains(F.col(text), F.lit("\n"))
    return F.when(tampered, leaf([F.replace(F.col(f), F.lit("\n"), F.lit("")) if f == text else F.col(f) for f in fields]))
