"""Benchmark decontamination with a generalised suffix automaton.

The normalised test items go into one suffix automaton over word numbers.  Its
states know which items their strings come from and which whole short items end
in them.  Training texts are streamed through it: the automaton's current state
and length are the longest match that ends at each word, and words inside
matches of at least ``window`` words (or of a whole shorter item) are hit.

A word that is in no item resets the automaton, and so does a pair of adjacent
words that is adjacent in no item: the longest match restarts at length 1.  Both
are found for a whole slice of text at once with numpy, and the automaton walks
only through the runs between them that are long enough to hold the shortest
window; no match of that length can lie outside such a run.

The items are read in blocks of at most ``block_words`` words (some 0.5 kB of memory each,
on the driver and in every worker) or one item, one automaton per block and one pass over the
texts for each; a pass is written before the next one's automaton is made, so one block is
in memory at a time whatever the size of the benchmark.  Items of equal words are one sequence.

Words are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z.
Defined results: null texts have no words, null or wordless items never occur;
items with equal texts all occur; a null item identifier is skipped; empty tables
give empty results or no hits; repeated rows are separate documents.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore
from .staging import fresh, staged, with_fields

WINDOW = 10
BLOCK_WORDS = 200_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def item_words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(UPPER))


class SuffixAutomaton:
    """A generalised suffix automaton of word-number sequences."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: dict[int, set[int]] = {}
        self.shorts: dict[int, list[tuple[int, int]]] = {}

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(-1)
        self.length.append(length)
        return len(self.next) - 1

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            q = self.next[last][word]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, word, q)
        cur = self._state(self.length[last] + 1)
        p = last
        while p != -1 and word not in self.next[p]:
            self.next[p][word] = cur
            p = self.link[p]
        if p == -1:
            self.link[cur] = 0
        else:
            q = self.next[p][word]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, word, q)
        return cur

    def _clone(self, p: int, word: int, q: int) -> int:
        copy = self._state(self.length[p] + 1)
        self.next[copy] = dict(self.next[q])
        self.link[copy] = self.link[q]
        self.link[q] = copy
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: list[int]) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)

    def finish(self, sequences: list[list[int]], window: int) -> None:
        """Mark, for each state of strings of ``window`` words, the sequences that hold them, and
        for each state the short sequences it ends with, longest first."""
        self.window = window
        for number, words in enumerate(sequences):
            state = length = 0
            for w in words:
                state, length = self.step(state, length, w)
                if length >= window:
                    self.items.setdefault(self._window_state(state), set()).add(number)
            if len(words) < window:
                self.shorts.setdefault(state, []).append((len(words), number))
        ends = dict(self.shorts)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            if self.link[s] in ends:
                ends[s] = ends.get(s, []) + ends[self.link[s]]
        self.ends = {s: sorted(found, reverse=True) for s, found in ends.items()}

    def _window_state(self, state: int) -> int:
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        while state and word not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        if word in self.next[state]:
            return self.next[state][word], length + 1
        return 0, 0

    def hits(self, words: list[int], found: set[int]) -> list[list[int]]:
        """Merged [first, end) spans of all occurrences of windows in ``words``; the numbers of the
        sequences they come from are added to ``found``.  A position adds one span, the longest."""
        spans: list[list[int]] = []
        state = length = 0
        seen: set[tuple[int, int]] = set()
        for i, w in enumerate(words):
            state, length = self.step(state, length, w)
            longest = 0
            if length >= self.window:
                at = self._window_state(state)
                if (at, -1) not in seen:
                    seen.add((at, -1))
                    found |= self.items[at]
                longest = self.window
            for k, number in self.ends.get(state, ()):
                if k <= length:
                    longest = max(longest, k)
                    if (state, length) in seen:
                        break
                    found.add(number)
            seen.add((state, length))
            if longest:
                if spans and i + 1 - longest <= spans[-1][1]:
                    spans[-1][0], spans[-1][1] = min(spans[-1][0], i + 1 - longest), i + 1
                    while len(spans) > 1 and spans[-1][0] <= spans[-2][1]:
                        spans[-2:] = [[min(spans[-2][0], spans[-1][0]), spans[-1][1]]]
                else:
                    spans.append([i + 1 - longest, i + 1])
        return spans


class Matcher:
    """The automaton of one block of items with its word numbers and adjacent pairs."""

    def __init__(self, items: list[tuple[object, str]], window: int = WINDOW):
        self.names: list[list] = []  # the items of each sequence
        vocabulary: dict[str, int] = {}
        place: dict[tuple[int, ...], int] = {}
        for item, text in items:
            words = tuple(vocabulary.setdefault(x, len(vocabulary)) for x in item_words(text)) if item is not None else ()
            if words:
                if place.setdefault(words, len(self.names)) == len(self.names):
                    self.names.append([])
                self.names[place[words]].append(item)
        sequences = [list(w) for w in place]
        self.automaton = SuffixAutomaton()
        for w in sequences:
            self.automaton.add(w)
        self.automaton.finish(sequences, window)
        self.shortest = min((min(len(w), window) for w in sequences), default=0)
        words = [w.encode() for w in vocabulary]
        data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words]).astype(np.int64)
        starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]]) if words else ends
        hashes = textcore.span_hashes(data, starts, ends)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order.astype(np.int64)
        self.size = len(words)
        pairs = {a * self.size + b for w in sequences for a, b in zip(w, w[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.first = np.zeros(1 << 16, bool)
        self.first[(self.hashes & np.uint64(0xFFFF)).astype(np.int64)] = True

    def numbered(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's number, or -1 for a word that is in no item."""
        found = np.full(len(hashes), -1, np.int64)
        if not self.size:
            return found
        maybe = np.flatnonzero(self.first[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), self.size - 1)
        ok = self.hashes[at] == hashes[maybe]
        found[maybe[ok]] = self.numbers[at[ok]]
        return found

    def runs(self, numbers: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs whose words, and adjacent pairs, all occur in items."""
        n = len(numbers)
        known = numbers >= 0
        joined = np.zeros(n, bool)  # word i continues the run of word i - 1
        if n > 1:
            both = known[1:] & known[:-1]
            both[first[(first > 0) & (first < n)] - 1] = False
            at = np.flatnonzero(both)
            pair = numbers[at] * self.size + numbers[at + 1]
            if len(self.pairs):
                p = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
                joined[at[self.pairs[p] == pair] + 1] = True
        starts = np.flatnonzero(known & ~joined)
        last = known.copy()
        last[:-1] &= ~joined[1:]
        ends = np.flatnonzero(last) + 1
        long = ends - starts >= max(1, self.shortest)
        return starts[long], ends[long]


RESULTS = ["n_words", "n_hit", "spans", "hit_items"]
FOUND = "n_words bigint, n_hit bigint, spans array<array<bigint>>, hit_items array<string>"


def _scan(matcher, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher.value
        for batch in batches:
            columns = {"n_words": [], "n_hit": [], "spans": [], "hit_items": []}
            texts = batch.column(batch.schema.names.index(text))
            for a, b, data, offsets in textcore.slices(texts):
                hashes, first = textcore.word_hashes(data, offsets, textcore.NOT_ALNUM)
                n_docs = b - a
                spans: dict[int, list[list[int]]] = {}
                items: dict[int, set] = {}
                if m.size:
                    numbers = m.numbered(hashes)
                    starts, ends = m.runs(numbers, first)
                    owner = np.searchsorted(first, starts, side="right") - 1
                    for s, e, d in zip(starts.tolist(), ends.tolist(), owner.tolist(), strict=True):
                        begin = s - int(first[d])
                        spans.setdefault(d, []).extend([x + begin, y + begin] for x, y in m.automaton.hits(numbers[s:e].tolist(), items.setdefault(d, set())))
                columns["n_words"] += np.diff(first).tolist()
                for d in range(n_docs):
                    merged: list[list[int]] = []
                    for x, y in sorted(spans.get(d, ())):
                        if merged and x <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], y)
                        else:
                            merged.append([x, y])
                    columns["n_hit"].append(sum(y - x for x, y in merged))
                    columns["spans"].append(merged)
                    columns["hit_items"].append(sorted({str(i) for k in items.get(d, ()) for i in m.names[k]}))
            types = {"n_words": pa.int64(), "n_hit": pa.int64(), "spans": pa.list_(pa.list_(pa.int64())), "hit_items": pa.list_(pa.string())}
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(v, types[k]) for k, v in columns.items()]], [*batch.schema.names, *columns])

    return textcore.tidy(run)


def item_blocks(benchmark: DataFrame, item: str, text: str, block_words: int) -> Iterator[list[tuple[object, str]]]:
    block, size = [], 0
    for row in benchmark.select(item, text).where(F.col(text).isNotNull()).orderBy(item, text).toLocalIterator():
        n = len(WORD.findall(row[1].translate(UPPER)))
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += n
    yield block


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with n_words, n_hit, spans (merged [first, end) word spans) and hit_items
    (sorted identifiers of the items with occurring windows)."""
    base = docs.drop(*RESULTS)
    old = {name: fresh(base.columns, f"_{name}") for name in RESULTS}
    out = None
    for block in item_blocks(benchmark, item, item_text, block_words):
        matcher = docs.sparkSession.sparkContext.broadcast(Matcher(block, window))
        source = base if out is None else staged(out, "scanned").withColumnsRenamed(old)
        found = source.mapInArrow(_scan(matcher, text), with_fields(source.schema, FOUND))
        if out is not None:
            words = F.array_distinct(F.flatten(F.transform(F.concat(old["spans"], "spans"), lambda s: F.sequence(s[0], s[1] - 1))))
            found = found.withColumn("n_hit", F.size(words).cast("long")).withColumn("spans", F.array_sort(F.concat(old["spans"], "spans")))
            found = found.withColumn("hit_items", F.array_sort(F.array_distinct(F.concat(old["hit_items"], "hit_items")))).drop(*old.values())
        out = found
    return out


def _cut_text(raw: bytes, spans: list[list[int]]) -> bytes:
    """``raw`` without what lies between the first and the last word of each span."""
    data = textcore.LOWER[np.frombuffer(raw, np.uint8)]
    starts, ends, _ = textcore.word_spans(data, np.array([0, len(data)], np.int64), textcore.NOT_ALNUM)
    out, at = [], 0
    for x, y in spans:
        out.append(raw[at : max(at, int(starts[x]))])
        at = max(at, int(ends[y - 1]))
    out.append(raw[at:])
    return b"".join(out)


def _cut(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            texts, spans = batch.column(names.index(name)), batch.column(names.index("spans"))
            done = [t.as_py() if not s.as_py() else _cut_text(t.as_py().encode(), s.as_py()).decode("utf-8", "replace") for t, s in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string()) if n == name else batch.column(i) for i, n in enumerate(names)], names)

    return textcore.tidy(run)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", max_coverage: float = 0.5, **options) -> DataFrame:
    """``docs`` without contamination, with its own columns: hit spans are cut out, and
    documents of which more than ``max_coverage`` of the words are hit are dropped whole."""
    own = {name: fresh(docs.columns, f"_own_{name}") for name in RESULTS if name in docs.columns}
    found = scan(docs.withColumnsRenamed(own), benchmark, text, **options)
    kept = found.where(F.col("n_hit") <= max_coverage * F.col("n_words"))
    cut = kept.mapInArrow(_cut(text), kept.schema).drop(*RESULTS)
    return cut.withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


def report(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: key, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = scan(docs.select(key, text), benchmark, text, **options)
    joined = F.concat_ws(",", "hit_items")
    return found.select(key, "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(joined.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
