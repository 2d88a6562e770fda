"""Near-duplicate classes by a grouped prefix join on word n-grams.

A document is its set of distinct word shingles.  Two documents link when
``den * |A n B| >= num * |A u B|``; the result names the connected component of
every document.  The join is exact: no link between different texts is lost, and
every link that is used was verified on the full sets.

1. Documents with equal sets are one node, so copies never meet in a pair.
2. Prefix filter.  Under one global order of all shingles, linked sets share at least
   three shingles (or all that they need) among the first ``n - ceil(t n) + 3`` of
   each.  The order is by hash, with heavy shingles last (those found too often in
   first prefixes: shared passages).  Any order is exact; this one keeps lists short.
3. Grouping.  Nodes with the same size and the same prefix are one group, and only
   groups enter the inverted lists.  Lists travel as packed arrays per shingle
   range, not as rows.
4. Short lists give all their group pairs that pass the size and position filters;
   pairs that met often enough are expanded to members.  (A pair that also meets in a
   long list is found there.)  Long lists (and large groups) are expanded to
   members with their parity bitmaps, a lower bound of the distance, and give a
   spanning forest of their candidate graph: a clique of m near copies costs m - 1
   pairs, not m * m / 2.  A list of more than ``BLOCK_MEMBERS`` members is dealt into blocks:
   first each block gives its forest, then each pair of blocks gives a forest between the
   components that the verified links have made.
5. Verification joins the pairs with the full sets, which are made again from the texts
   that a bounded Bloom filter lets through, so texts are never shuffled.  If a forest edge fails, the
   block (or pair of blocks) it came from gives, in a further round, every candidate pair that the
   verified edges have not yet connected.  Then all links are covered: a linked pair
   meets in one pair of blocks of a long list, or in three short ones, and is either inside a
   verified component or verified itself.
6. Components by contraction to the smallest neighbour with pointer jumping.

Memory: a task holds the arrays of one shingle range (ranges follow the bytes of the
prefixes) or two blocks of a long list (a bitmap has about a bit a shingle).  Nothing that
grows with the input goes to the driver; the heavy shingles that do are at most ``HEAVY`` by the
choice of their threshold, and they only decide the order of shingles.

"Exact" is up to equal 64-bit hashes of different shingles and equal 128-bit hashes of
different sets.  Keys are integers.

Defined results: null or wordless texts have the empty set, link with nothing and
are their own component; documents with fewer words than a shingle have one
shingle, the whole sequence; null identifiers are ignored when the smallest is
chosen (null if there is no other); rows that repeat an identifier are one
document; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textcore
from .ppm import pack, pack_counts, unpack, unpack_counts
from .staging import fresh, staged

WORDS = 5
THRESHOLD = (80, 100)
HEAVY = 1 << 18
HEAVY_LEAST = 32
SHORT = 8
COMMON = 3
BITMAP_WORDS = 8
FLUSH_TOKENS = 1 << 20
FILTER_BITS = 1 << 28
FILTER_BLOCKS = 16
BLOCK_MEMBERS = 1024
RANGE_BYTES = 32 << 20

_U = np.uint64
_FACTORS = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, size=64, dtype=np.uint64) * _U(2) + _U(1)


def prefix_length(n, threshold):
    """So many first shingles of a set hold at least COMMON shingles of every linked set (all
    common ones, if they are fewer)."""
    num, den = threshold
    return min(n, n - -(-(num * n) // den) + COMMON)


def needed_overlap(a, b, threshold):
    num, den = threshold
    return -(-(num * (a + b)) // (num + den))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """Each document's distinct shingles as sorted 64-bit hashes."""
    hashes, first = textcore.word_hashes(data, offsets)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
        for k in range(words):
            rolled += hashes[k : k + len(rolled)] * _FACTORS[k]
        rolled = textcore.mix64(rolled)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= words:
                yield np.unique(rolled[a : b - words + 1])
            elif b > a:
                yield textcore.mix64((hashes[a:b] * _FACTORS[: b - a]).sum(keepdims=True) + _U(b - a))
            else:
                yield hashes[:0]


def prefix_of(s: np.ndarray, k: int, heavy: np.ndarray) -> np.ndarray:
    """The first ``k`` shingles of a set, heavy ones last."""
    if not len(heavy) or not k:
        return s[:k]
    at = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
    last = heavy[at] == s
    if not last[:k].any():
        return s[:k]
    light = s[~last]
    return light[:k] if len(light) >= k else np.concatenate([light, s[last][: k - len(light)]])


def bitmap_of(s: np.ndarray) -> np.ndarray:
    """Bit i is the parity of the shingles that fall on it; the bitmaps of two sets differ in
    at most as many bits as the sets in shingles.  It has a bit a shingle (rounded up to a
    power of two), so that long texts can be told apart as well as short ones."""
    size = max(64 * BITMAP_WORDS, 1 << max(0, len(s) - 1).bit_length())
    bits = np.bincount(((s >> _U(20)) % _U(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    """The bitmap(s) at a smaller size: halves are added bit by bit."""
    while bitmap.shape[-1] > words:
        half = bitmap.shape[-1] // 2
        bitmap = bitmap[..., :half] ^ bitmap[..., half:]
    return bitmap


class Bitmaps:
    """Bitmaps of different sizes, by row number."""

    def __init__(self, raw: list[bytes]):
        self.words = np.array([len(x) // 8 for x in raw], np.int64)
        self.place = np.zeros(len(raw), np.int64)
        self.of: dict[int, np.ndarray] = {}
        for w in np.unique(self.words).tolist():
            rows = np.flatnonzero(self.words == w)
            self.place[rows] = np.arange(len(rows))
            self.of[w] = np.frombuffer(b"".join(raw[i] for i in rows.tolist()), np.uint64).reshape(-1, w)

    def apart(self, x: int, others: np.ndarray) -> np.ndarray:
        """A lower bound of the distance of row ``x`` to each of ``others``."""
        own, out = self.of[int(self.words[x])][self.place[x]], np.zeros(len(others), np.int64)
        for w in np.unique(self.words[others]).tolist():
            at = self.words[others] == w
            least = min(w, len(own))
            out[at] = np.bitwise_count(folded(self.of[w][self.place[others[at]]], least) ^ folded(own, least)).sum(1, dtype=np.int64)
        return out


def signature(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _prefix_counts(words: int, threshold):
    """Shingles that several prefixes of an input partition share, with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for _, _, data, offsets in textcore.slices(batch.column(0)):
                held += [s[: prefix_length(len(s), threshold)] for s in shingle_sets(data, offsets, words) if len(s)]
        token, count = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        often = count > 1
        yield pa.RecordBatch.from_arrays([pa.array(token[often].view(np.int64)), pa.array(count[often].astype(np.int64))], ["token", "n"])

    return textcore.tidy(run)


def heavy_shingles(texts: DataFrame, words: int, threshold) -> np.ndarray:
    """Shingles in many prefixes.  The result only orders shingles, so it needn't be exact;
    their counts exceed total / HEAVY, so there are fewer than HEAVY of them."""
    counts = staged(texts.mapInArrow(_prefix_counts(words, threshold), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > HEAVY_LEAST), "heavy")
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.where(F.col("n") > max(HEAVY_LEAST, total // HEAVY)).select("token").toArrow()
    return np.sort(rows.column(0).to_numpy().astype(np.int64).view(np.uint64))



def _self() -> Column:
    """A row as (no key, key, text hash): the order of documents, rows without a key last."""
    return F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("hash").alias("hash"))


SETS = "id long, hash long, n long, sig binary, shape long, prefix binary, bitmap binary"


def _describe(words: int, threshold, heavy):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in textcore.slices(batch.column(1)):
                n, sig, shape, prefix, bitmap = [], [], [], [], []
                for s in shingle_sets(data, offsets, words):
                    n.append(len(s))
                    sig.append(signature(s))
                    prefix.append(prefix_of(s, prefix_length(len(s), threshold) if len(s) else 0, heavy.value).tobytes())
                    shape.append(int.from_bytes(hashlib.blake2b(prefix[-1] + len(s).to_bytes(8, "little"), digest_size=8).digest(), "little", signed=True))
                    bitmap.append(bitmap_of(s).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(shape, pa.int64()), pa.array(prefix, pa.binary()), pa.array(bitmap, pa.binary())], ["id", "hash", "n", "sig", "shape", "prefix", "bitmap"])

    return textcore.tidy(run)


def _row_key(id: Column, hash: Column) -> Column:
    return F.xxhash64(id, hash).alias("key")


def _postings(ranges: int):
    """Inverted-list entries (shingle, position, set size, group) as packed arrays per shingle range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush():
            tokens = [np.frombuffer(x[2], np.uint64) for x in held]
            lengths = np.array([len(t) for t in tokens])
            token, owner = np.concatenate(tokens), np.repeat(np.arange(len(held)), lengths)
            pos = np.arange(len(token)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            order = np.argsort(token, kind="stable")
            token, pos, owner = token[order], pos[order], owner[order]
            gid, n = np.array([x[0] for x in held], np.int64)[owner], np.array([x[1] for x in held], np.int64)[owner]
            part = ((token >> _U(32)) * _U(ranges) >> _U(32)).astype(np.int64)
            edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            cuts = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
            columns = [pa.array([int(part[a]) for a, _ in cuts], pa.int32()), pa.array([pack(token[a:b]) for a, b in cuts], pa.binary())]
            columns += [pa.array([pack_counts(x[a:b]) for a, b in cuts], pa.binary()) for x in (pos, n)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([gid[a:b].tobytes() for a, b in cuts], pa.binary())], ["part", "tokens", "pos", "n", "gids"])

        for batch in batches:
            for gid, n, prefix in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                held.append((gid, n, prefix))
                size += len(prefix) // 8
                if size >= FLUSH_TOKENS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return textcore.tidy(run)


LISTS = "kind int, list long, a long, b long, pos int"


def _candidates(n: np.ndarray, pos: np.ndarray, i, j, threshold) -> np.ndarray:
    """Which entry pairs of a list pass the size and position filters.  Whatever common shingle
    the list is of, at most those before it in both and those from it on can be common."""
    num, den = threshold
    small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    most = np.minimum(pos[i], pos[j]) + np.minimum(n[i] - pos[i], n[j] - pos[j])
    return (den * small >= num * large) & (most >= needed_overlap(n[i], n[j], threshold))


def _meet(threshold):
    """Group pairs (kind 0) of short lists, with the number of lists they met in (list) and the
    number they must meet in (pos); entries (kind 1) of long lists."""

    def lists(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        token = np.concatenate([unpack(r[0]) for r in rows])
        order = np.argsort(token, kind="stable")
        token = token[order]
        pos, n = (np.concatenate([unpack_counts(r[k]) for r in rows])[order] for k in (1, 2))
        gids = np.concatenate([np.frombuffer(r[3], np.int64) for r in rows])[order]
        edges = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
        starts, sizes = edges[:-1], np.diff(edges)
        left, right, need = [], [], []
        for size in range(2, SHORT + 1):
            at = starts[sizes == size]
            for x in range(size):
                for y in range(x + 1, size):
                    ok = at[_candidates(n, pos, at + x, at + y, threshold)]
                    left.append(gids[ok + x])
                    right.append(gids[ok + y])
                    need.append(np.minimum(COMMON, needed_overlap(n[ok + x], n[ok + y], threshold)))
        i, j, need = np.concatenate(left), np.concatenate(right), np.concatenate(need)
        pairs, times = np.unique(np.stack([np.minimum(i, j), np.maximum(i, j), need]), axis=1, return_counts=True)
        if pairs.shape[1]:
            k = pairs.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array([0] * k, pa.int32()), pa.array(times.astype(np.int64)), pa.array(pairs[0]), pa.array(pairs[1]), pa.array(pairs[2].astype(np.int32))], ["kind", "list", "a", "b", "pos"])
        long = np.repeat(sizes > SHORT, sizes)
        if long.any():
            k = int(long.sum())
            yield pa.RecordBatch.from_arrays([pa.array([1] * k, pa.int32()), pa.array(token[long].view(np.int64)), pa.array(gids[long]), pa.nulls(k, pa.int64()), pa.array(pos[long].astype(np.int32))], ["kind", "list", "a", "b", "pos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for part, *rest in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                held.setdefault(part, []).append(tuple(rest))
        for part in sorted(held):
            yield from lists(held.pop(part))

    return textcore.tidy(run)


FOREST = "list string, x int, y int, a binary, b binary"


def _spanning(threshold, mode: str):
    """Candidate pairs of one block (x = y) or between two blocks (x < y) of a long list:
    ``forest``, a spanning forest of the candidate graph; ``bridge``, a forest between the
    components (``root``) that the verified links have made; ``all``, every pair whose ends
    are in different components."""
    num, den = threshold

    def run(table: pa.Table) -> pa.Table:
        n, pos, block = (np.array(table.column(c).to_pylist(), np.int64) for c in ("n", "pos", "block"))
        order = np.argsort(n, kind="stable")
        n, pos, block = n[order], pos[order], block[order]
        sig, raw = table.column("sig").to_pylist(), table.column("bitmap").to_pylist()
        sig, bits = [sig[i] for i in order.tolist()], Bitmaps([raw[i] for i in order.tolist()])
        key, x_block, y_block = (table.column(c)[0].as_py() for c in ("list", "x", "y"))
        low, high = np.searchsorted(n, -(-(num * n) // den)), np.searchsorted(n, den * n // num, side="right")

        def near(x: int, others: np.ndarray) -> np.ndarray:
            others = others[np.searchsorted(others, low[x]) : np.searchsorted(others, high[x])]
            if x_block != y_block:
                others = others[block[others] != block[x]]
            others = others[_candidates(n, pos, np.full(len(others), x), others, threshold)]
            return others[bits.apart(x, others) <= n[others] + n[x] - 2 * needed_overlap(n[others], n[x], threshold)]

        pairs: list[tuple[int, int]] = []
        if mode == "forest":
            left = np.arange(len(n))
            while len(left):
                queue, left = [int(left[0])], left[1:]
                while queue and len(left):
                    x = queue.pop()
                    found = near(x, left)
                    if len(found):
                        pairs += [(x, int(y)) for y in found]
                        queue += found.tolist()
                        left = np.setdiff1d(left, found, assume_unique=True)
        else:
            root = table.column("root").to_pylist()
            names = {r: k for k, r in enumerate(dict.fromkeys(root))}
            group = np.array([names[root[i]] for i in order.tolist()])
            apart = len(names)
            for x in range(len(n)):
                if apart == 1:
                    break
                others = np.arange(x + 1, int(high[x]))
                others = near(x, others[group[others] != group[x]])
                if mode == "all":
                    pairs += [(x, int(y)) for y in others]
                    continue
                for y in others.tolist():
                    if group[x] != group[y]:
                        pairs.append((x, y))
                        group[group == group[y]] = group[x]
                        apart -= 1
        a, b = [min(sig[x], sig[y]) for x, y in pairs], [max(sig[x], sig[y]) for x, y in pairs]
        k = len(pairs)
        return pa.table({"list": pa.array([key] * k, pa.string()), "x": pa.array([x_block] * k, pa.int32()), "y": pa.array([y_block] * k, pa.int32()), "a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def _could_link(threshold):
    """Drop pairs whose bitmaps are too far apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (np.array(batch.column(k).to_pylist(), np.int64) for k in (2, 4))
            apart = np.zeros(len(n), np.int64)
            for i, (x, y) in enumerate(zip(batch.column(3), batch.column(5), strict=True)):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                least = min(len(a), len(b))
                apart[i] = np.bitwise_count(folded(a, least) ^ folded(b, least)).sum()
            num, den = threshold
            ok = (apart <= n + m - 2 * needed_overlap(n, m, threshold)) & (den * np.minimum(n, m) >= num * np.maximum(n, m))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok))

    return textcore.tidy(run)


def _filter_bits(bits: int):
    """A Bloom filter (two bits a key) of the keys of an input partition, in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = np.unique(np.concatenate(_bit_places(batch.column(0).to_numpy(zero_copy_only=False), bits)))
            if len(at):
                byte, bit = at >> 3, (128 >> (at & 7)).astype(np.uint8)
                first = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
                held[byte[first]] |= np.bitwise_or.reduceat(bit, first)
        parts = np.split(held, FILTER_BLOCKS)
        some = [i for i, x in enumerate(parts) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([zstandard.compress(parts[i].tobytes()) for i in some], pa.binary())], ["block", "bits"])

    return textcore.tidy(run)


def _bit_places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = keys.astype(np.int64).view(np.uint64)
    return (h % _U(bits)).astype(np.int64), ((textcore.mix64(h) >> _U(7)) % _U(bits)).astype(np.int64)


def _filter_or(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.frombuffer(zstandard.decompress(raw), np.uint8)
            held[block] = held[block] | x if block in held else x
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([zstandard.compress(x.tobytes()) for x in held.values()], pa.binary())], ["block", "bits"])


def key_filter(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of one long column, eight places a byte.  Its size follows the number of keys up to
    FILTER_BITS, which bounds the broadcast; beyond that it only lets more rows through."""
    bits = min(FILTER_BITS, max(1 << 16, 1 << int(16 * keys.count()).bit_length()))
    blocks = keys.mapInArrow(_filter_bits(bits), "block int, bits binary").repartition(FILTER_BLOCKS, "block").mapInArrow(_filter_or, "block int, bits binary").collect()
    out = np.zeros((FILTER_BLOCKS, bits // 8 // FILTER_BLOCKS), np.uint8)
    for r in blocks:
        out[r["block"]] = np.frombuffer(zstandard.decompress(bytes(r["bits"])), np.uint8)
    return out.ravel()


def _full_sets(words: int, wanted):
    """The sets of the documents whose key passes the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = wanted.value
        for batch in batches:
            one, two = (held[at >> 3] & (128 >> (at & 7)) > 0 for at in _bit_places(batch.column(0).to_numpy(zero_copy_only=False), 8 * len(held)))
            found = batch.filter(pa.array(one & two))
            for _, _, data, offsets in textcore.slices(found.column(1)):
                sets = list(shingle_sets(data, offsets, words))
                yield pa.RecordBatch.from_arrays([pa.array([signature(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["sig", "members"])

    return textcore.tidy(run)


def _verify(threshold):
    num, den = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                linked.append(den * both >= num * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return textcore.tidy(run)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): one root per component."""
    edges = staged(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))), "edges")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        up = staged(edges.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("node"), F.least("a", "p").alias("root")), "up")
        for _ in range(2):
            over = up.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
            up = up.join(over, F.col("root") == F.col("_n")).select("node", F.col("_r").alias("root"))
        up = staged(up, "up")
        steps.append(up)
        of = lambda side: up.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))  # noqa: B023, E731
        edges = staged(edges.join(of("a"), "a").join(of("b"), "b").where(F.col("a_root") != F.col("b_root")).select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct(), "edges")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = steps[0]
    for step in steps[1:]:
        on = step.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        out = out.join(on, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"))
    return staged(out, "roots")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, threshold: tuple[int, int] = THRESHOLD, block_members: int = BLOCK_MEMBERS) -> DataFrame:
    """(id, hash, n, first) per document: its key, text hash and set size, and as ``first`` the
    (none, id, hash) of the document of smallest key in its component."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"))
    heavy = spark.sparkContext.broadcast(heavy_shingles(rows.select("text"), words, threshold))
    base = staged(rows.mapInArrow(_describe(words, threshold, heavy), SETS), "sets")

    prefixes = base.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0
    ranges = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-prefixes // RANGE_BYTES))

    # Nodes: distinct sets.  Groups: nodes of one shape (size and prefix).  Two groups whose
    # 64-bit shapes collide only add candidates, which verification drops.
    full = base.where(F.col("n") > 0)
    nodes = staged(full.groupBy("sig").agg(F.min(_self()).alias("rep"), F.first("n").alias("n"), F.first("shape").alias("gid"), F.first("bitmap").alias("bitmap")), "nodes")
    groups = staged(nodes.groupBy("gid").agg(F.count(F.lit(1)).alias("m")), "groups")
    members = nodes.join(groups, "gid").select("gid", "m", "sig", "n", "bitmap")

    shapes = full.select("shape", "n", "prefix").distinct()
    posted = shapes.select("shape", "n", "prefix").mapInArrow(_postings(ranges), "part int, tokens binary, pos binary, n binary, gids binary")
    met = staged(posted.repartition(ranges, "part").mapInArrow(_meet(threshold), LISTS), "lists")

    # Expand group pairs to member pairs, or to a list of both groups' members if they are many.
    of = lambda side: members.select(F.col("gid").alias(side), F.col("sig").alias(f"{side}_sig"), F.col("m").alias(f"{side}_m"))
    sizes = lambda side: groups.select(F.col("gid").alias(side), F.col("m").alias(f"{side}_m"))
    often = met.where(F.col("kind") == 0).groupBy("a", "b").agg(F.sum("list").alias("times"), F.min("pos").alias("need")).where(F.col("times") >= F.col("need"))
    pairs = staged(often.where(F.col("a") != F.col("b")).select("a", "b"), "pairs").join(sizes("a"), "a").join(sizes("b"), "b")
    few = pairs.where(F.col("a_m") * F.col("b_m") <= SHORT * SHORT).select("a", "b")
    across = few.join(of("a").drop("a_m"), "a").join(of("b").drop("b_m"), "b").select(F.col("a_sig").alias("a"), F.col("b_sig").alias("b"))
    small = members.where((F.col("m") > 1) & (F.col("m") <= SHORT)).select("gid", "sig")
    inside = small.withColumnRenamed("sig", "a").join(small.withColumnRenamed("sig", "b"), "gid").where(F.col("a") < F.col("b")).select("a", "b")

    many = pairs.where(F.col("a_m") * F.col("b_m") > SHORT * SHORT).select(F.concat_ws(",", F.lit("p"), "a", "b").alias("list"), F.array("a", "b").alias("both"))
    entries = met.where(F.col("kind") == 1).select(F.concat(F.lit("t"), F.col("list").cast("string")).alias("list"), F.col("a").alias("gid"), "pos")
    entries = entries.unionByName(many.select("list", F.explode("both").alias("gid"), F.lit(0).alias("pos")))
    entries = entries.unionByName(groups.where(F.col("m") > SHORT).select(F.concat_ws(",", F.lit("g"), "gid").alias("list"), "gid", F.lit(0).alias("pos")))
    long = staged(entries.join(members.select("gid", "sig", "n", "bitmap"), "gid").select("list", "sig", "n", "pos", "bitmap"), "long")
    # Long lists in blocks.  Only lists of more than one block are in the (small) table of sizes.
    dealt = staged(long.groupBy("list").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > block_members).select("list", F.ceil(F.col("m") / block_members).cast("int").alias("k")), "dealt")
    long = long.join(dealt, "list", "left").withColumn("k", F.coalesce("k", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("sig"), F.col("k")).cast("int"))
    alone = long.withColumn("x", F.col("block")).withColumn("y", F.col("block"))
    spread = lambda mode: lambda df: df.groupBy("list", "x", "y").applyInArrow(_spanning(threshold, mode), FOREST)
    forest = staged(spread("forest")(alone), "forest")

    def verified(candidates: DataFrame) -> DataFrame:
        side = lambda c: nodes.select(F.col("sig").alias(c), F.col("n").alias(f"{c}_n"), F.col("bitmap").alias(f"{c}_bits"))
        joined = candidates.distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_n", "a_bits", "b_n", "b_bits")
        close = staged(joined.mapInArrow(_could_link(threshold), "a binary, b binary"), "close")
        ends = close.select(F.col("a").alias("sig")).union(close.select("b")).distinct()
        wanted = spark.sparkContext.broadcast(key_filter(nodes.join(ends, "sig", "left_semi").select(_row_key(F.col("rep.id"), F.col("rep.hash")))))
        sets = staged(rows.select(_row_key(F.col("id"), F.col("hash")), "text").mapInArrow(_full_sets(words, wanted), "sig binary, members binary"), "full")
        whole = lambda c: sets.select(F.col("sig").alias(c), F.col("members").alias(f"{c}_set"))
        loaded = close.join(whole("a"), "a").join(whole("b"), "b").select("a", "b", "a_set", "b_set")
        return staged(loaded.mapInArrow(_verify(threshold), "a binary, b binary, linked boolean").where("linked").select("a", "b").distinct(), "links")

    def open_in(tried: DataFrame, links: DataFrame) -> DataFrame:
        """The blocks and pairs of blocks of which a candidate failed."""
        return staged(tried.join(links, ["a", "b"], "left_anti").select("list", "x", "y").distinct(), "failed")

    def with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
        return rows.join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))

    links = verified(across.union(inside).union(forest.select("a", "b")))
    roots = components(links)
    # Second round: between the blocks of a list, and blocks of which an edge failed.  Third: pairs of blocks of which one did.
    failed = open_in(forest, links)
    other = F.explode(F.filter(F.sequence(F.lit(0), F.col("k") - 1), lambda j: j != F.col("block"))).alias("other")
    paired = long.where("k > 1").select("*", other).withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other")).drop("other")
    first = not failed.isEmpty()
    second = not dealt.isEmpty()
    tried = forest.select("a", "b")
    for round_ in range(2):
        found = []
        if round_ == 0 and first:
            found.append(spread("all")(with_roots(alone.join(failed, ["list", "x", "y"], "left_semi"), roots)))
        if round_ == 0 and second:
            found.append(spread("bridge")(with_roots(paired, roots)))
        if round_ == 1 and second and not failed.isEmpty():
            found.append(spread("all")(with_roots(paired.join(failed, ["list", "x", "y"], "left_semi"), roots)))
        if not found:
            break
        open_pairs = staged(reduce(DataFrame.unionByName, found), "open")
        more = verified(open_pairs.select("a", "b").distinct().join(tried.distinct(), ["a", "b"], "left_anti"))
        tried = tried.union(open_pairs.select("a", "b"))
        if not more.isEmpty():
            links = staged(links.union(more), "links")
            roots = components(links)
        failed = open_in(open_pairs, links)

    placed = nodes.select("sig", "rep").join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    smallest = placed.groupBy("root").agg(F.min("rep").alias("first"))
    found = staged(placed.join(smallest, "root").select("sig", "first"), "classes")
    return base.join(found, "sig", "left").select("id", "hash", "n", F.when(F.col("n") == 0, _self()).otherwise(F.col("first")).alias("first"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: key, n_shingles, component_id (smallest key reachable by links)."""
    return classes(docs, key, text, **options).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("first.id").alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each component: the one of smallest key (of rows that
    repeat key and text, one)."""
    mark, nth, id_, hash_ = (fresh(docs.columns, name) for name in ("_hash", "_nth", "_key", "_kept"))
    kept = classes(docs, key, text, **options).where(_self() == F.col("first")).select(F.col("id").alias(id_), F.col("hash").alias(hash_)).distinct()
    rows = docs.withColumn(mark, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    rows = rows.join(kept, F.col(key).eqNullSafe(F.col(id_)) & (F.col(mark) == F.col(hash_)), "left_semi")
    numbered = rows.withColumn(nth, F.row_number().over(Window.partitionBy(key, mark).orderBy(F.lit(0))))
    return numbered.where(F.col(nth) == 1).drop(nth, mark)
