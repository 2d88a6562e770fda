"""Language-model scoring by prediction by partial matching (PPM).

The model is a byte-context trie of order ``ORDER``, counted over all training
texts.  A byte that its longest known context has never seen escapes to the next
shorter one: the escape share is estimated from the number of distinct
successors (method C), and the symbols of the longer context are excluded below.  Under the empty context every byte that
is still possible has the same probability.  Texts are lower-cased (A-Z) and end
in a zero byte, so the probabilities of all texts sum to one; a text's code
length is the sum over its bytes.

How it runs.  Counting happens per input partition on packed integers (a context
and its byte are one 64-bit number) and leaves each task as a few sorted,
compressed blocks per key range, not as rows.  Merging tasks add up a key range.
No node is dropped, so the trie grows with the corpus and is never in one place:
a key range has all grams whose contexts end in the same two bytes, thus whole
contexts of order 2 and more.  Only orders 0 and 1 (at most 65,536 nodes) are
broadcast.  The commonest pair of bytes has some fortieth of all distinct grams, which is the
largest share of a range.  Documents are dealt into chunks; each chunk asks for the costs of its
distinct grams and for the counts of its distinct words (the unigram reference,
``base_score``) by key range, and the answers come back to the chunk.  Chunks and key ranges
follow the input: as many as keep the bytes (and rows) behind each below a fixed size.

Defined results: null counts as empty (its end is still scored); a byte zero
inside a text is scored like an end; without training texts the trie is empty
and every byte costs log10(256), and base counts are 0; a null identifier
belongs to the training side if crc32 of the empty text says so; equal rows are
scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore
from .langid import held_out
from .staging import staged

ORDER = 5
CHUNK_BYTES = 32 << 20
#: A row without text still costs something; texts behind one key range of counts.
ROW_BYTES = 64
RANGE_BYTES = 64 << 20
END = np.uint64(zlib.crc32(b"end of text") | 1 << 40)

_U = np.uint64


def pack(keys: np.ndarray) -> bytes:
    """Sorted unsigned integers as compressed byte planes of their differences."""
    if len(keys) == 0:
        return b""
    steps = np.diff(keys, prepend=np.zeros(1, keys.dtype))
    planes = steps.view(np.uint8).reshape(len(steps), keys.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(raw: bytes, dtype=np.uint64) -> np.ndarray:
    if not raw:
        return np.zeros(0, dtype)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(dtype).ravel(), dtype=dtype)


def pack_counts(counts: np.ndarray) -> bytes:
    planes = counts.astype(np.uint64).view(np.uint8).reshape(len(counts), 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes()) if len(counts) else b""


def unpack_counts(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.int64).ravel()


def add_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their summed counts."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(k)), bool), k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(c, first) if len(first) else c


def grams(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Each byte of each lower-cased text and its end, packed with its ``order``
    predecessors (zeros before the text), and where each text's grams begin."""
    n = len(offsets) - 1
    at = offsets + np.arange(n + 1)
    buffer = np.zeros(len(data) + n, np.uint64)
    lengths = np.diff(offsets)
    buffer[np.arange(len(data)) + np.repeat(np.arange(n), lengths)] = textcore.LOWER[data]
    g = buffer.copy()
    for k in range(1, order + 1):
        g[k:] |= buffer[:-k] << _U(8 * k)
    for k in range(order):
        i = at[:-1] + k
        i = i[i < at[1:]]
        g[i] &= _U((1 << 8 * (k + 1)) - 1)
    return g, at


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words and its end, and where each text's tokens begin."""
    hashes, first = textcore.word_hashes(data, offsets)
    n = len(offsets) - 1
    at = first + np.arange(n + 1)
    out = np.full(len(hashes) + n, END, np.uint64)
    out[np.arange(len(hashes)) + np.repeat(np.arange(n), np.diff(first))] = hashes
    return out, at


def word_range(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Key range of each word hash; ascending, since it is taken from the top bits."""
    return ((keys >> _U(32)) * _U(ranges) >> _U(32)).astype(np.int64)


def gram_range(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Key range of each gram: the same for all grams whose contexts end in the same two bytes."""
    with np.errstate(over="ignore"):
        return ((((keys >> _U(8) & _U(0xFFFF)) + _U(1)) * _U(0x9E3779B97F4A7C15) >> _U(40)) % _U(ranges)).astype(np.int64)


BLOCK = "kind int, part int, keys binary, counts binary"


def _block_batch(rows: list[tuple]) -> pa.RecordBatch:
    kind, part, keys, counts = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(part, pa.int32()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], ["kind", "part", "keys", "counts"])


def _count(order: int, ranges: int, held: int = 4_000_000):
    """Counts of grams (kind 0) and words (kind 1) of one input partition, by key range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = {0: ([], []), 1: ([], [])}

        def flush(kind: int):
            keys, counts = store[kind]
            if not keys:
                return
            k, c = add_up(keys, counts)
            store[kind] = ([], [])
            part = gram_range(k, ranges) if kind == 0 else word_range(k, ranges)
            rank = np.argsort(part, kind="stable")
            k, c, part = k[rank], c[rank], part[rank]
            edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            yield _block_batch([(kind, int(part[a]), pack(k[a:b]), pack_counts(c[a:b])) for a, b in zip(edges[:-1], edges[1:], strict=True)])

        for batch in batches:
            for _, _, data, offsets in textcore.slices(batch.column(0), 4 << 20):
                for kind, found in ((0, grams(data, offsets, order)[0]), (1, tokens(data, offsets)[0])):
                    k, c = np.unique(found, return_counts=True)
                    store[kind][0].append(k)
                    store[kind][1].append(c.astype(np.int64))
                    if sum(map(len, store[kind][0])) > held:
                        k, c = add_up(*store[kind])
                        store[kind] = ([k], [c])
                        if len(k) > held // 2:
                            yield from flush(kind)
        for kind in store:
            yield from flush(kind)

    return textcore.tidy(run)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a key range, of grams (kind 0) and words (kind 1), and the order 1 of its grams (kind 2)."""
    held: dict[tuple[int, int], tuple[list, list]] = {}
    for batch in batches:
        for kind, part, keys, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            store = held.setdefault((kind, part), ([], []))
            store[0].append(unpack(keys))
            store[1].append(unpack_counts(counts))
            if len(store[0]) >= 16:
                k, c = add_up(*store)
                held[kind, part] = ([k], [c])
    for kind, part in sorted(held):
        k, c = add_up(*held.pop((kind, part)))
        rows = [(kind, part, pack(k), pack_counts(c))]
        if kind == 0:
            k, c = add_up([k & _U(0xFFFF)], [c])
            rows.append((2, part, pack(k), pack_counts(c)))
        yield _block_batch(rows)


class Table:
    """Open addressing over distinct 64-bit keys, filled and probed with numpy."""

    PROBES = 12

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(10, int(len(keys) * 2.5).bit_length())
        size = 1 << self.bits
        self.keys, self.used, self.values = np.zeros(size, np.uint64), np.zeros(size, bool), np.zeros(size, values.dtype)
        left = np.arange(len(keys))
        home = self._home(keys)
        for probe in range(self.PROBES):
            if not len(left):
                break
            slot = (home[left] + probe) & (size - 1)
            free = ~self.used[slot]
            _, first = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[first]
            s = slot[put]
            self.keys[s], self.values[s], self.used[s] = keys[left[put]], values[left[put]], True
            left = np.delete(left, put)
        order = np.argsort(keys[left])
        self.rest_keys, self.rest_values = keys[left][order], values[left][order]

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys * _U(0x9E3779B97F4A7C15) >> _U(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, found)."""
        values, found = np.zeros(len(keys), self.values.dtype), np.zeros(len(keys), bool)
        left, slot = np.arange(len(keys)), self._home(keys)
        for probe in range(self.PROBES + 1):
            if probe == self.PROBES:
                if len(self.rest_keys) and len(left):
                    at = np.minimum(np.searchsorted(self.rest_keys, keys[left]), len(self.rest_keys) - 1)
                    hit = self.rest_keys[at] == keys[left]
                    values[left[hit]], found[left[hit]] = self.rest_values[at[hit]], True
                break
            used = self.used[slot]
            hit = used & (self.keys[slot] == keys[left])
            values[left[hit]], found[left[hit]] = self.values[slot[hit]], True
            on = used & ~hit
            if not on.any():
                break
            left, slot = left[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return values, found


class Trie:
    """The nodes of each order as sorted packed grams with counts."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.order = len(levels) - 1
        self.levels, self.contexts = [], []
        for o, (keys, counts) in enumerate(levels):
            name, first = self._contexts(keys)
            whole = np.add.reduceat(counts, first) if len(first) else counts
            distinct = np.diff(np.append(first, len(keys)))
            below = np.zeros(len(first), np.int64)
            if o and len(first):
                low_keys, low_counts = self.levels[o - 1]
                below = np.add.reduceat(low_counts[np.searchsorted(low_keys, keys & _U((1 << 8 * o) - 1))], first)
            self.levels.append((keys, counts))
            self.contexts.append((name, whole, distinct, below))

    @staticmethod
    def _contexts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct contexts and where each one's nodes begin."""
        context = keys >> _U(8)
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), context[1:] != context[:-1]]))
        return context[first], first

    @classmethod
    def of_range(cls, low: list[tuple[np.ndarray, np.ndarray]], order: int, keys: np.ndarray, counts: np.ndarray) -> Trie:
        """The trie of a key range: its own contexts of order 2 and more, and orders 0 and 1 of all."""
        levels = []
        for o in range(order, 1, -1):
            if o < order:
                keys, counts = add_up([keys & _U((1 << 8 * (o + 1)) - 1)], [counts])
            levels.append((keys, counts))
        return cls([*low[: order + 1], *levels[::-1]])

    def log10(self, g: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last byte after its other bytes."""
        out = np.zeros(len(g))
        left = np.arange(len(g))
        mass, seen = np.zeros(len(g), np.int64), np.zeros(len(g), np.int64)
        for o in range(self.order, -1, -1):
            if not len(left):
                break
            keys, counts = self.levels[o]
            name, whole, distinct, below = self.contexts[o]
            if not len(keys):
                continue
            k = g[left] & _U((1 << 8 * (o + 1)) - 1)
            c = np.minimum(np.searchsorted(name, k >> _U(8)), len(name) - 1)
            known = name[c] == k >> _U(8)
            at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
            hit = known & (keys[at] == k)
            novel = distinct[c] - seen[left]
            total = whole[c] - mass[left] + novel
            with np.errstate(divide="ignore", invalid="ignore"):
                out[left[hit]] += np.log10(counts[at[hit]] / total[hit])
                escape = known & ~hit & (novel > 0) & (total > 0)
                out[left[escape]] += np.log10(novel[escape] / total[escape])
            mass[left] = np.where(known, below[c], 0)
            seen[left] = np.where(known, distinct[c], 0)
            left = left[~hit]
        out[left] -= np.log10(np.maximum(256 - seen[left], 1))
        return out

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        g, at = grams(data, offsets, self.order)
        distinct, back = np.unique(g, return_inverse=True)
        return np.add.reduceat(self.log10(distinct)[back], at[:-1]) if len(at) > 1 else np.zeros(0)


def train(docs: DataFrame, text: str, order: int, ranges: int) -> tuple[DataFrame, list[tuple[np.ndarray, np.ndarray]], int, int]:
    """(staged counts by key range, orders 0 and 1, training tokens, distinct training tokens)."""
    blocks = docs.select(F.col(text)).mapInArrow(_count(order, ranges), BLOCK)
    merged = staged(blocks.repartition(ranges, "part").mapInArrow(_merge, BLOCK), "ppm")
    pair = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for row in merged.where("kind = 2").toLocalIterator():
        pair = add_up([pair[0], unpack(row["keys"])], [pair[1], unpack_counts(row["counts"])])
    low = [add_up([pair[0] & _U(0xFF)], [pair[1]]), pair]
    sums = merged.where("kind = 1").select("part", "keys", "counts").mapInArrow(_totals, "tokens bigint, types bigint").agg(F.sum("tokens"), F.sum("types")).first()
    return merged.where("kind < 2"), low, int(sums[0] or 0), int(sums[1] or 0)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [unpack_counts(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([pa.array([int(c.sum()) for c in counts], pa.int64()), pa.array([len(c) for c in counts], pa.int64())], ["tokens", "types"])


def _chunk_slices(texts: pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for a in texts.chunks:
        for _, _, data, offsets in textcore.slices(a):
            yield data, offsets


def _chunk_distinct(texts: pa.ChunkedArray, find, held: int = 2_000_000) -> np.ndarray:
    """Distinct keys of a chunk's texts, in order; ``find`` is ``tokens`` or gives grams."""
    found, size = [np.zeros(0, np.uint64)], 0
    for data, offsets in _chunk_slices(texts):
        found.append(sorted_distinct(find(data, offsets)[0]))
        size += len(found[-1])
        if size > held:
            found, size = [sorted_distinct(np.concatenate(found))], 0
    return sorted_distinct(np.concatenate(found))


def sorted_distinct(keys: np.ndarray) -> np.ndarray:
    k = np.sort(keys)
    return k[np.concatenate([np.ones(min(1, len(k)), bool), k[1:] != k[:-1]])]


def _ask(order: int, ranges: int):
    """A chunk's distinct grams (kind 0) and words (kind 1), by key range."""

    def run(table: pa.Table) -> pa.Table:
        chunk, rows = table.column("_chunk")[0].as_py(), []
        for kind, find, place in ((0, lambda d, o: grams(d, o, order), gram_range), (1, tokens, word_range)):
            keys = _chunk_distinct(table.column("_text"), find)
            part = place(keys, ranges)
            rank = np.argsort(part, kind="stable")
            keys, part = keys[rank], part[rank]
            edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            rows += [(kind, int(part[a]), chunk, pack(keys[a:b])) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        kinds, parts, chunks, keys = zip(*rows, strict=True)
        return pa.table({"kind": pa.array(kinds, pa.int32()), "part": pa.array(parts, pa.int32()), "chunk": pa.array(chunks, pa.int32()), "keys": pa.array(keys, pa.binary()), "counts": pa.array([b""] * len(rows), pa.binary())})

    return run


ANSWER = "chunk int, kind int, part int, keys binary, found binary"
ANSWER_BYTES = 8 << 20


def _answer(low, order: int):
    """Costs of grams (with their keys) and counts of words (in the order of their hashes).
    Within each key range and kind the counts (chunk -1) come first, then the chunks that ask."""

    def answers(rows: list[tuple]) -> pa.RecordBatch:
        chunk, kind, part, keys, found = zip(*rows, strict=True) if rows else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(chunk, pa.int32()), pa.array(kind, pa.int32()), pa.array(part, pa.int32()), pa.array(keys, pa.binary()), pa.array(found, pa.binary())], ["chunk", "kind", "part", "keys", "found"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, counts, trie = None, None, None, None
        for batch in batches:
            rows, size = [], 0
            for kind, part, chunk, k, c in zip(*[batch.column(i) for i in range(5)], strict=True):
                kind, part, chunk, k, c = kind.as_py(), part.as_py(), chunk.as_py(), k.as_py(), c.as_py()
                if (kind, part) != now:
                    now, keys, counts, trie = (kind, part), np.zeros(0, np.uint64), np.zeros(0, np.int64), None
                if chunk < 0:
                    keys, counts = unpack(k), unpack_counts(c)
                    continue
                asked = unpack(k)
                if kind == 0:
                    if trie is None:
                        trie = Trie.of_range(low.value, order, keys, counts)
                    rows.append((chunk, kind, part, k, pack_counts(trie.log10(asked).view(np.uint64))))
                else:
                    found = np.zeros(len(asked), np.int64)
                    if len(keys):
                        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                        found = np.where(keys[at] == asked, counts[at], 0)
                    rows.append((chunk, kind, part, b"", pack_counts(found)))
                size += len(rows[-1][3]) + len(rows[-1][4])
                if size > ANSWER_BYTES:
                    yield answers(rows)
                    rows, size = [], 0
            yield answers(rows)

    return textcore.tidy(run)


SCORES = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _score(order: int, total: int, types: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        words = _chunk_distinct(docs.column("_text"), tokens)
        told = sorted(zip(*[answers.column(c).to_pylist() for c in ("kind", "part", "keys", "found")], strict=True))
        counts = [unpack_counts(found) for kind, _, _, found in told if kind == 1]
        lookup = Table(words, np.concatenate(counts) if counts else np.zeros(0, np.int64))
        known = [(unpack(keys), unpack_counts(found).view(np.float64)) for kind, _, keys, found in told if kind == 0]
        costs = Table(*[np.concatenate(x) for x in zip(*known, strict=True)]) if known else Table(np.zeros(0, np.uint64), np.zeros(0))
        del told, counts, known
        columns = [[], [], [], []]
        for data, offsets in _chunk_slices(docs.column("_text")):
            hashes, at = tokens(data, offsets)
            c, _ = lookup.get(hashes)
            base = np.log10((c + 0.5) / (total + 0.5 * (types + 1)))
            columns[0].append(np.diff(at))
            columns[1].append(np.add.reduceat((c > 0).astype(np.int64), at[:-1]))
            columns[2].append(np.add.reduceat(base, at[:-1]))
            g, at = grams(data, offsets, order)
            columns[3].append(np.add.reduceat(costs.get(g)[0], at[:-1]))
        return pa.table([docs.column("_id").combine_chunks(), *[pa.array(np.concatenate(x) if x else []) for x in columns]], schema=SCORES)

    return run


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", modulus: int = 5, remainder: int = 1, order: int = ORDER, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per document: key, held_out, n_tokens, n_known, train_tokens, base_score, score.
    ``key`` is an integer."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text"))
    size = rows.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("_text"), F.lit(0)) + ROW_BYTES), F.lit(0))).first()[0]
    chunks = max(1, -(-size // chunk_bytes))
    ranges = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    counts, low, total, types = train(rows.where(~held_out("_id", modulus, remainder)), "_text", order, ranges)
    chunk = F.pmod(F.xxhash64("_id", F.crc32(F.coalesce(F.col("_text"), F.lit("")).cast("binary"))), F.lit(chunks)).cast("int")
    dealt = rows.withColumn("_chunk", chunk)
    asked = dealt.groupBy("_chunk").applyInArrow(_ask(order, ranges), "kind int, part int, chunk int, keys binary, counts binary")
    known = counts.select("kind", "part", F.lit(-1).cast("int").alias("chunk"), "keys", "counts")
    told = _answer(spark.sparkContext.broadcast(low), order)
    answers = known.unionByName(asked).repartition(ranges, "part").sortWithinPartitions("kind", "part", "chunk").mapInArrow(told, ANSWER)
    found = dealt.groupBy("_chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score(order, total, types), "id long, n_tokens long, n_known long, base_score double, score double")
    return found.select(F.col("id").alias(key), held_out("id", modulus, remainder).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
