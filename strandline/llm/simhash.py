"""Near-duplicates by SimHash and a byte-position inverted index.

1. Fingerprints.  Every shingle's XXH64 is made with numpy on a whole batch of texts; bit i of a
   fingerprint is set if more than half of the document's shingles (repeats included) set it.
2. Documents with equal fingerprints are one node, so copies never meet in a pair.
3. Inverted index.  Fingerprints with at most three differing bits differ in at most three of
   their eight bytes, so they share at least five positional bytes, and of five positions three lie
   in one half.  The index therefore has a list for each three positions of a half and their
   values: 8 entries a node.  A list of more than ``LIST`` nodes is never gathered: its entries are
   dealt again under every five positions around its three (10 entries a node), which still bring
   together every pair that shares five.  Such a list has at most 2^24 nodes, as only three bytes
   are free.
4. Count filter.  Inside a list the shared positional bytes of each pair are tallied; pairs with
   at least five are verified on the bits.  A list gives a spanning forest of its links, not its
   pairs: nodes that a link has already reached are not compared again.  In a list of more than
   ``LIST`` nodes the neighbours of a node are looked up under all 2,324 changes of at most three of
   its 24 free bits, so the work grows with the list and not with its square.
5. Components by contraction; the smallest identifier of each goes back to the documents.

Memory: a task holds a slice of texts, then one list.  Nothing that grows with the input goes to the
driver.

Defined results: null or wordless texts have fingerprint zero and link like any other; texts with
fewer words than a shingle have one shingle, the whole sequence; null identifiers are ignored when the
smallest is chosen (null if there is no other); repeated rows and ties are one node; an empty
table gives an empty result; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textcore
from .jaccard_join import components
from .staging import staged

WORDS = 3
SEED = 42
DISTANCE = 3
SHARED = 8 - DISTANCE
LIST = 2048
SHORT = 8
BLOCK = 1 << 16

_U = np.uint64
# Fixed values of xxHash64.
_P1, _P2, _P3, _P4, _P5 = (_U(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotl(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << _U(bits)) | (x >> _U(64 - bits))


def _word_at(data: np.ndarray, at: np.ndarray, size: int, kind) -> np.ndarray:
    """The little-endian integers of ``size`` bytes that begin at ``at``."""
    return data[at[:, None] + np.arange(size)].view(kind)[:, 0].astype(_U)


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of each span of ``data``.  Spans of 32 bytes and more, few among shingles, go to the
    xxhash package one by one."""
    size = ends - starts
    with np.errstate(over="ignore"):
        h = size.astype(_U) + _P5 + _U(seed)
        for lane in range(3):
            on = np.flatnonzero((size >= 8 * lane + 8) & (size < 32))
            word = _rotl(_word_at(data, starts[on] + 8 * lane, 8, _U) * _P2, 31) * _P1
            h[on] = _rotl(h[on] ^ word, 27) * _P1 + _P4
        at = starts + (size & ~7)
        on = np.flatnonzero(size & 4)
        h[on] = _rotl(h[on] ^ (_word_at(data, at[on], 4, np.uint32) * _P1), 23) * _P2 + _P3
        at += size & 4
        for k in range(3):
            on = np.flatnonzero((size & 3) > k)
            h[on] = _rotl(h[on] ^ (data[at[on] + k].astype(_U) * _P5), 11) * _P1
        h = (h ^ (h >> _U(33))) * _P2
        h = (h ^ (h >> _U(29))) * _P3
        h ^= h >> _U(32)
    for i in np.flatnonzero(size >= 32).tolist():
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), seed=seed)
    return h


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> np.ndarray:
    """The fingerprint of each text of a slice."""
    low = textcore.LOWER[data]
    starts, ends, first = textcore.word_spans(low, offsets, textcore.SPACE)
    n_docs, size = len(offsets) - 1, ends - starts
    # The words with one space between them.
    place = np.cumsum(size + 1) - (size + 1)
    joined = np.full(int((size + 1).sum()), 0x20, np.uint8)
    from_, to = np.repeat(starts, size), np.repeat(place, size)
    step = np.arange(len(from_)) - np.repeat(np.cumsum(size) - size, size)
    joined[to + step] = low[from_ + step]
    del from_, to, step
    per_doc = np.diff(first)
    n = np.where(per_doc >= words, per_doc - words + 1, np.minimum(per_doc, 1))
    doc = np.repeat(np.arange(n_docs), n)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    head = first[:-1][doc] + nth
    tail = np.minimum(head + words, first[1:][doc]) - 1
    ones = np.zeros((n_docs, 64), np.int64)
    for a in range(0, len(doc), BLOCK):
        at = slice(a, a + BLOCK)
        h = xxh64(joined, place[head[at]], place[tail[at]] + size[tail[at]])
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cut = np.flatnonzero(np.concatenate([[True], doc[at][1:] != doc[at][:-1]]))
        ones[doc[at][cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view(_U)[:, 0]


def _describe(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in textcore.slices(batch.column(1)):
                found = fingerprints_of(data, offsets, words).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(found)], ["id", "fp"])

    return textcore.tidy(run)


def _mask(positions) -> int:
    mask = sum(255 << 8 * p for p in positions)
    return mask - (1 << 64) if mask >> 63 else mask


TRIPLES = [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]
FIVES = list(combinations(range(8), SHARED))


def _entries(fp: Column, positions: list[tuple[int, ...]], first: int) -> Column:
    """(list, key): the positions' number and the fingerprint's bytes at them."""
    one = [F.struct(F.lit(first + i).alias("list"), fp.bitwiseAND(F.lit(_mask(p))).alias("key")) for i, p in enumerate(positions)]
    return F.explode(F.array(*one)).alias("e")


def _dealt_again() -> Column:
    """The entries of a node of a long list under all five positions around the list's three."""
    found = F.lit(None)
    for i, t in enumerate(TRIPLES):
        around = [(j, five) for j, five in enumerate(FIVES) if set(t) <= set(five)]
        one = [F.struct(F.lit(len(TRIPLES) + j).alias("list"), F.col("fp").bitwiseAND(F.lit(_mask(p))).alias("key")) for j, p in around]
        found = F.when(F.col("list") == i, F.array(*one)).otherwise(found)
    return F.explode(found).alias("e")


def linked(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pairs that share at least five positional bytes (the tally) and differ in at most three bits."""
    apart = np.atleast_1d(x ^ y)
    out = (apart.view(np.uint8).reshape(-1, 8) == 0).sum(1) >= SHARED
    out[out] = np.bitwise_count(apart[out]) <= DISTANCE
    return out


def _forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of one list."""
    a, b, left = [], [], fps
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = linked(left, x)
            if near.any():
                a.append(np.full(int(near.sum()), x))
                b.append(left[near])
                queue += left[near].tolist()
                queue = [_U(q) for q in queue]
                left = left[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


def _changes(positions: tuple[int, ...]) -> np.ndarray:
    """All changes of at most three bits outside the five positions."""
    bits = [1 << 8 * p + k for p in range(8) if p not in positions for k in range(8)]
    return np.array([sum(c) for k in range(1, DISTANCE + 1) for c in combinations(bits, k)], _U)


def _looked_up(fps: np.ndarray, positions: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect a long list: for each change, those whose ends are not yet connected."""
    fps = np.unique(fps)
    group = np.arange(len(fps))
    for change in _changes(positions):
        other = fps ^ change
        at = np.minimum(np.searchsorted(fps, other), len(fps) - 1)
        i = np.flatnonzero((fps[at] == other) & (fps < other))
        j = at[i]
        open_ = group[i] != group[j]
        i, j = i[open_], j[open_]
        if len(i):
            yield fps[i], fps[j]
        while len(i):  # the smaller group number wins on both sides, to the fixed point
            low, high = np.minimum(group[i], group[j]), np.maximum(group[i], group[j])
            np.minimum.at(group, high, low)
            while (group != group[group]).any():
                group = group[group]
            apart = group[i] != group[j]
            i, j = i[apart], j[apart]


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of all lists of a partition, which is sorted by list and key."""

    def out(a, b) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], ["a", "b"])

    def whole(number, key, fps) -> Iterator[pa.RecordBatch]:
        cut = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | (key[1:] != key[:-1]), [True]]))
        first, size = cut[:-1], np.diff(cut)
        for m in range(2, SHORT + 1):
            at = first[size == m]
            for i, j in combinations(range(m), 2) if len(at) else ():
                x, y = fps[at + i], fps[at + j]
                near = linked(x, y)
                if near.any():
                    yield out(x[near], y[near])
        for at, m in zip(first[size > SHORT].tolist(), size[size > SHORT].tolist(), strict=True):
            if m <= LIST:
                yield out(*_forest(fps[at : at + m]))
            else:
                yield from (out(a, b) for a, b in _looked_up(fps[at : at + m], FIVES[int(number[at]) - len(TRIPLES)]))

    held: list[list[np.ndarray]] = []
    for batch in batches:
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(new[0]):
            continue
        new[2] = new[2].view(_U)
        ends = np.flatnonzero((new[0][1:] != new[0][:-1]) | (new[1][1:] != new[1][:-1])) + 1
        if held and (held[-1][0][-1] != new[0][0] or held[-1][1][-1] != new[1][0]):
            yield from whole(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held = []
        if len(ends):
            held.append([x[: ends[-1]] for x in new])
            yield from whole(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held, new = [], [x[ends[-1] :] for x in new]
        held.append([x.copy() for x in new])
    if held:
        yield from whole(*(np.concatenate(x) for x in zip(*held, strict=True)))


def links(nodes: DataFrame) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints ``fp`` which links connect."""
    entries = nodes.select("fp", _entries(F.col("fp"), TRIPLES, 0)).select("e.list", "e.key", "fp")
    long = staged(entries.groupBy("list", "key").count().where(F.col("count") > LIST).select("list", "key"), "long")
    if not long.isEmpty():
        again = entries.join(long, ["list", "key"], "left_semi").select("fp", _dealt_again()).select("e.list", "e.key", "fp").distinct()
        entries = entries.join(long, ["list", "key"], "left_anti").unionByName(again)
    dealt = entries.repartition("list", "key").sortWithinPartitions("list", "key")
    return staged(dealt.mapInArrow(textcore.tidy(_lists), "a long, b long"), "links")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """One row per document: key, fingerprint (16 hex digits), component_id (smallest key reachable by links)."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = docs.select(key).schema[0].dataType.simpleString()
    prints = staged(rows.mapInArrow(_describe(words), f"id {kind}, fp long"), "prints")
    nodes = staged(prints.groupBy("fp").agg(F.min("id").alias("rep")), "nodes")
    roots = components(links(nodes.select("fp")))
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    found = placed.join(placed.groupBy("root").agg(F.min("rep").alias("first")), "root").select("fp", "first")
    return prints.join(staged(found, "classes"), "fp", "left").select(F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id"))
