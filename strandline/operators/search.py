"""Keyword search (inverted index, BM25, match expressions) and exact vector search."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.text import search_tokens, tokens_of
from ..staging import staged
from .entities import check_limit
from .lookup import join_top

K1, B = 1.2, 0.75
IDF_FLOOR = 1e-6


class MatchSyntaxError(ValueError):
    """The match expression can't be parsed."""


def _indexed(content: Column, wanted=None) -> Column:
    """A text's number of tokens ``dl`` and its ``entries`` (term, tf, dl, positions).

    Tokens are sorted with their positions, and every run of equal terms is a slice of that array."""
    def runs(toks: Column, dl: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(toks) - 1), lambda i: (i == 0) | (F.get(toks, i)["term"] != F.get(toks, i - 1)["term"]))
        return _once(starts, lambda at: F.transform(at, lambda s, k: entry(toks, dl, s, F.coalesce(F.get(at, k + 1), F.size(toks)) - s)))

    def entry(toks: Column, dl: Column, first: Column, tf: Column) -> Column:
        places = F.transform(F.slice(toks, first + 1, tf), lambda t: t["pos"])
        return F.struct(F.get(toks, first)["term"].alias("term"), tf.cast("long").alias("tf"), dl.alias("dl"), places.alias("positions"))

    def sorted_words(tokens: Column) -> Column:
        words = F.transform(tokens, lambda t, i: F.struct(t.alias("term"), i.alias("pos")))
        return F.sort_array(words if wanted is None else F.filter(words, lambda w: wanted(w["term"])))

    def both(tokens: Column) -> Column:
        entries = _once(sorted_words(tokens), lambda toks: F.when(F.size(toks) > 0, runs(toks, F.size(tokens))))
        return F.struct(F.greatest(F.size(tokens), F.lit(0)).alias("dl"), entries.alias("entries"))

    return _once(search_tokens(content), both)


#: So many tokens are sorted at once; a longer text is a slice of its own.
SORTED_TOKENS = 1 << 18


def token_slices(batch: pa.RecordBatch, rows: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.DictionaryArray]]:
    """A batch whose last column are tokens, in slices of some ``SORTED_TOKENS`` tokens (or of ``rows`` rows): the slice,
    each row's number of tokens and all its tokens as codes."""
    tokens = batch.column(batch.num_columns - 1)
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    before, at = np.concatenate([[0], np.cumsum(sizes)]), 0
    while at < len(sizes):
        end = at + rows if rows else max(at + 1, int(np.searchsorted(before, before[at] + SORTED_TOKENS, "right")) - 1)
        part = batch.slice(at, end - at)
        yield part, sizes[at:end], part.column(batch.num_columns - 1).flatten().dictionary_encode()
        at = end


def _postings_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens in the order of (row, term), positions ascending; every run of equal ones is a posting."""
    for batch in batches:
        for part, sizes, coded in token_slices(batch):
            if not len(coded):
                continue
            row = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            key = row * len(coded.dictionary) + coded.indices.to_numpy()
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ends = np.append(first, len(key))
            head, of = order[first], row[order[first]]
            positions = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(place[order].astype(np.int32)))
            columns = [coded.dictionary.take(coded.indices.take(pa.array(head))), part.column(0).take(pa.array(of)), pa.array(np.diff(ends)), pa.array(sizes[of].astype(np.int32)), positions]
            yield pa.RecordBatch.from_arrays(columns, ["term", "chunk_id", "tf", "dl", "positions"])


def postings(chunks: DataFrame, id: str = "id", content: str = "content") -> DataFrame:
    """The inverted index: (term, chunk_id, tf, dl, positions).

    Everything is built where a row is read (its tokens are sorted in Arrow batches), so the scan gives postings without a shuffle."""
    tokens = chunks.select(F.col(id).alias("chunk_id"), search_tokens(F.col(content)).alias("tokens"))
    kind = tokens.schema["chunk_id"].dataType.simpleString()
    return tokens.mapInArrow(_postings_of, f"term string, chunk_id {kind}, tf bigint, dl int, positions array<int>")


def _exploded(rows: DataFrame) -> DataFrame:
    # The planner would put an inner explode behind a filter that computes the entries a second time.
    return rows.select("chunk_id", F.explode_outer("entries").alias("p")).where(F.col("p").isNotNull()).select("p.term", "chunk_id", "p.tf", "p.dl", "p.positions")


def query_index(chunks: DataFrame, match, id: str = "id", content: str = "content") -> tuple[DataFrame, DataFrame]:
    """Postings of the expression's terms, and the statistics of all chunks, from one reading of
    the texts: each chunk's length and its entries of those terms are written, and both read that."""
    found = _indexed(F.col(content), lambda term: _selector(term, match))
    rows = staged(chunks.select(F.col(id).alias("chunk_id"), found.alias("x")).select("chunk_id", "x.dl", "x.entries"), "found")
    return _exploded(rows), stats_of(rows)


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once: a lambda's variable is a value, while the
    planner would copy an expression into every place (and every element) that refers to it."""
    return F.get(F.transform(F.array(value), use), 0)


def lengths(chunks: DataFrame, id: str = "id", content: str = "content") -> DataFrame:
    """(chunk_id, dl): the number of tokens of every chunk."""
    return chunks.select(F.col(id).alias("chunk_id"), F.greatest(F.size(search_tokens(F.col(content))), F.lit(0)).alias("dl"))


def stats_of(lengths: DataFrame) -> DataFrame:
    """One row: n_chunks, n_tokens, avgdl."""
    return lengths.agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("dl").alias("n_tokens"), F.avg(F.col("dl").cast("double")).alias("avgdl"))


def corpus_stats(chunks: DataFrame, content: str = "content") -> DataFrame:
    """One row: n_chunks, n_tokens, avgdl, from the texts."""
    return stats_of(lengths(chunks, chunks.columns[0], content))


@dataclass(frozen=True)
class Phrase:
    """Adjacent tokens; the last may be a prefix.  It is one scoring unit."""

    terms: tuple[str, ...]
    prefix: bool = False
    initial: bool = False


@dataclass(frozen=True)
class Match:
    """and / or / not over phrases; near holds phrases within a distance."""

    op: str
    parts: tuple = field(default=())
    distance: int = 10


_LEX = re.compile(r'\s*(?:("(?:[^"]|"")*")|(NEAR\s*\()|([()+*^,:])|([^\s"()+*^,:]+))')


class _Parser:
    """Grammar, loosest first: or := and (OR and)*; and := not (AND not)*; not := list (NOT list)*;
    list := "(" or ")" | near+ (neighbours are all required); near := phrase | NEAR(phrase+, n).
    ``content:`` may stand before a list's member or a parenthesis."""

    def __init__(self, query: str):
        self.tokens: list[tuple[str, str]] = []
        at, query = 0, query.rstrip()
        while at < len(query):
            m = _LEX.match(query, at)
            if not m:
                raise MatchSyntaxError(f"can't read {query[at:]!r}")
            at = m.end()
            if m[1] is not None:
                self.tokens.append(("string", m[1][1:-1].replace('""', '"')))
            elif m[2]:
                self.tokens.append(("near", "NEAR"))
            elif m[3]:
                self.tokens.append(("mark", m[3]))
            else:
                word = m[4]
                if word in ("AND", "OR", "NOT"):
                    self.tokens.append(("op", word))
                elif re.fullmatch(r"[\w\x80-\U0010ffff]+", word):
                    self.tokens.append(("word", word))
                else:
                    raise MatchSyntaxError(f"syntax error near {word!r}")
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, kind: str, text: str | None = None) -> str | None:
        k, t = self.peek()
        if k == kind and text in (None, t):
            self.at += 1
            return t
        return None

    def parse(self):
        if not self.tokens:
            raise MatchSyntaxError("empty expression")
        out = self.either()
        if self.peek()[0] != "end":
            raise MatchSyntaxError(f"syntax error near {self.peek()[1]!r}")
        return out

    def _chain(self, word: str, part, join):
        parts = [part()]
        while self.take("op", word):
            parts.append(part())
        return parts[0] if len(parts) == 1 else join(parts)

    def either(self):
        return self._chain("OR", self.every, lambda parts: Match("or", tuple(parts)))

    def every(self):
        return self._chain("AND", self.without, lambda parts: Match("and", tuple(parts)))

    def without(self):
        return self._chain("NOT", self.listed, lambda parts: reduce(lambda a, b: Match("not", (a, b)), parts))

    def _column(self) -> None:
        if self.peek()[0] in ("word", "string") and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1] == ("mark", ":"):
            if (self.take("word") or self.take("string")).lower() != "content":
                raise MatchSyntaxError("no such column")
            self.take("mark", ":")

    def listed(self):
        self._column()
        if self.take("mark", "("):
            inner = self.either()
            if not self.take("mark", ")"):
                raise MatchSyntaxError("missing )")
            return inner
        parts = [self.near()]
        while self.peek()[0] in ("word", "string", "near") or self.peek() == ("mark", "^"):
            self._column()
            parts.append(self.near())
        return parts[0] if len(parts) == 1 else Match("and", tuple(parts))

    def near(self):
        if not self.take("near"):
            return self.phrase()
        parts = [self.phrase()]
        while self.peek()[0] in ("word", "string"):
            parts.append(self.phrase())
        distance = 10
        if self.take("mark", ","):
            distance = int(self.take("word") or "x") if self.peek()[1].isdigit() else self._fail()
        if not self.take("mark", ")"):
            raise MatchSyntaxError("missing )")
        return Match("near", tuple(parts), distance)

    def _fail(self):
        raise MatchSyntaxError(f"syntax error near {self.peek()[1]!r}")

    def phrase(self) -> Phrase:
        initial = bool(self.take("mark", "^"))
        terms: list[str] = []
        while True:
            text = self.take("word") or self.take("string")
            if text is None:
                self._fail()
            terms += tokens_of(text)
            if self.take("mark", "*"):
                return Phrase(tuple(terms), True, initial)
            if not self.take("mark", "+"):
                return Phrase(tuple(terms), False, initial)


def parse_match(query: str):
    return _Parser(query).parse()


def plain_match(text: str):
    """A lenient reading of free text: all its tokens.  None if it has none."""
    words = [Phrase((t,)) for t in dict.fromkeys(tokens_of(text))]
    return None if not words else words[0] if len(words) == 1 else Match("and", tuple(words))


def phrases_of(node) -> list[Phrase]:
    """All phrases in order; one that is written twice counts twice."""
    if isinstance(node, Phrase):
        return [node] if node.terms else []
    return [p for part in node.parts for p in phrases_of(part)]


def _numbered(node, at: int = 0):
    """The expression with (phrase, number) leaves, and the next free number."""
    if isinstance(node, Phrase):
        return ((node, at), at + 1) if node.terms else (None, at)
    parts = []
    for part in node.parts:
        leaf, at = _numbered(part, at)
        parts.append(leaf)
    return Match(node.op, tuple(parts), node.distance), at


def _nears(node) -> list[Match]:
    if not isinstance(node, Match):
        return []
    return [node] if node.op == "near" else [n for part in node.parts for n in _nears(part)]


def _needed(match) -> tuple[list[str], list[str]]:
    """The terms and the prefixes that an expression asks for."""
    units = phrases_of(match)
    exact = sorted({t for p in units for i, t in enumerate(p.terms) if not (p.prefix and i == len(p.terms) - 1)})
    return exact, sorted({p.terms[-1] for p in units if p.prefix})


def _selector(term: Column, match) -> Column:
    terms, prefixes = _needed(match)
    test = term.isin(terms) if terms else F.lit(False)
    for p in prefixes:
        test = test | F.startswith(term, F.lit(p))
    return test


def _starts(phrase: Phrase) -> Column:
    """Positions at which a phrase begins, from the map term -> positions ``at``."""
    last = len(phrase.terms) - 1
    empty = F.array().cast("array<int>")

    def where(i: int) -> Column:
        term = phrase.terms[i]
        if i == last and phrase.prefix:
            hits = F.flatten(F.map_values(F.map_filter("at", lambda k, _: F.startswith(k, F.lit(term)))))
        else:
            hits = F.coalesce(F.try_element_at("at", F.lit(term)), empty)
        return F.transform(hits, lambda p: p - F.lit(i))

    out = where(0)
    for i in range(1, last + 1):
        out = F.array_intersect(out, where(i))
    return F.filter(out, lambda p: p == 0) if phrase.initial else out


def _near_columns(node: Match) -> dict[str, Column]:
    """The occurrences of each phrase of a NEAR group that stand close to all its others.

    A group matches around an anchor, the last of its phrases to begin, if every phrase ends
    at most ``distance`` tokens before the anchor begins."""
    leaves = [x for x in node.parts if x is not None]

    def reaches(t: Column, s: Column, phrase: Phrase) -> Column:
        return (t <= s) & (t >= s - F.lit(len(phrase.terms) + node.distance))

    def is_anchor(s: Column) -> Column:
        tests = [_any_reaching(i, phrase, s, reaches) for phrase, i in leaves]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out

    anchors = F.array_distinct(F.flatten(F.array(*[F.filter(F.col(f"s{i}"), is_anchor) for _, i in leaves])))
    return {f"s{i}": _close_to(anchors, i, phrase, reaches) for phrase, i in leaves}


def _any_reaching(i: int, phrase: Phrase, s: Column, reaches) -> Column:
    return F.exists(F.col(f"s{i}"), lambda t: reaches(t, s, phrase))


def _close_to(anchors: Column, i: int, phrase: Phrase, reaches) -> Column:
    return F.filter(F.col(f"s{i}"), lambda t: F.exists(anchors, lambda s: reaches(t, s, phrase)))


def _holds(node) -> Column:
    if node is None:
        return F.lit(True)
    if not isinstance(node, Match):
        return F.col(f"f{node[1]}") > 0
    if node.op == "not":
        return _holds(node.parts[0]) & ~_holds(node.parts[1])
    out = _holds(node.parts[0])
    for part in node.parts[1:]:
        out = out | _holds(part) if node.op == "or" else out & _holds(part)
    return out


def _counting(node, holds: Column | None = None) -> dict[int, Column | None]:
    """Under which condition each phrase counts for the score: every group around it must hold.
    What stands to the right of NOT never counts."""
    if node is None:
        return {}
    if not isinstance(node, Match):
        return {node[1]: holds}
    own = _holds(node) if holds is None else holds & _holds(node)
    parts = node.parts[:1] if node.op == "not" else node.parts
    return {i: c for part in parts for i, c in _counting(part, own).items()}


def keyword_hits(index: DataFrame, stats: DataFrame, match) -> DataFrame:
    """(chunk_id, score) of all chunks that match; higher is better.

    The index is read once, pruned to the expression's terms.  A phrase (or prefix) is one
    scoring unit with its own frequency and document frequency."""
    units = phrases_of(match)
    tree, _ = _numbered(match)
    per = index.where(_selector(F.col("term"), match)).groupBy("chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"), F.first("dl").alias("dl"))
    per = per.select("chunk_id", "dl", *[_starts(p).alias(f"s{i}") for i, p in enumerate(units)])
    df = per.agg(*[F.sum((F.size(f"s{i}") > 0).cast("double")).alias(f"n{i}") for i in range(len(units))])
    for near in _nears(tree):
        per = per.withColumns(_near_columns(near))
    per = per.select("*", *[F.size(f"s{i}").alias(f"f{i}") for i in range(len(units))])
    whole = stats.select(F.col("n_chunks").cast("double").alias("_n"), F.col("avgdl").alias("_avg")).crossJoin(df)  # one row each
    score = F.lit(0.0)
    for i, counts in sorted(_counting(tree).items()):
        raw = F.log((F.col("_n") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5))
        idf = F.when(raw <= 0, F.lit(IDF_FLOOR)).otherwise(raw)
        f = F.col(f"f{i}").cast("double") if counts is None else F.when(counts, F.col(f"f{i}")).otherwise(0).cast("double")
        score = score + idf * (f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("_avg"))))
    return per.where(_holds(tree)).join(F.broadcast(whole)).select("chunk_id", score.alias("score"))


def search_keyword(chunks: DataFrame, query: str, limit: int = 10, strict: bool = True, index: DataFrame | None = None, stats: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """The best ``limit`` chunks for a match expression, with ``score``.

    ``strict`` raises on bad syntax; otherwise the text's tokens are searched (all of them).
    Without a stored ``index`` and ``stats`` the texts are read, once."""
    top = rank_keyword(chunks, query, limit, strict, index, stats, digits)
    return chunks.withColumn("score", F.lit(0.0)).limit(0) if top is None else join_top(chunks, top, "chunk_id", limit)


def rank_keyword(chunks: DataFrame, query: str, limit: int = 10, strict: bool = True, index: DataFrame | None = None, stats: DataFrame | None = None, digits: int | None = None) -> DataFrame | None:
    """(chunk_id, score) of the best ``limit`` chunks, from the index alone; None if the expression has no term."""
    check_limit(limit)
    match = parse_match(query) if strict else plain_match(query)
    if match is None or not phrases_of(match):
        return None
    if index is None or stats is None:
        found, counted = query_index(chunks, match)
        index, stats = found if index is None else index, counted if stats is None else stats
    hits = keyword_hits(index, stats, match)
    if digits is not None:
        hits = hits.withColumn("score", F.round("score", digits))
    return hits.orderBy(F.col("score").desc(), "chunk_id").limit(limit)


def vector_topk(embeddings: DataFrame, vector, limit: int = 10, ref_type: str | None = "chunk", digits: int | None = None) -> DataFrame:
    """(ref_id, similarity) of the nearest embeddings; one scan, top-k per task, then merged."""
    check_limit(limit)
    rows = embeddings.where(F.col("ref_type") == ref_type) if ref_type else embeddings
    sim = vectors.cosine(F.col("vector"), vectors.literal(vector)).cast("float").cast("double")
    scored = rows.select("ref_id", (F.round(sim, digits) if digits is not None else sim).alias("similarity"))
    return scored.orderBy(F.col("similarity").desc(), "ref_id").limit(limit)


def search_vector(embeddings: DataFrame, chunks: DataFrame, query, limit: int = 10, embedder=None, ref_type: str = "chunk", digits: int | None = None) -> DataFrame:
    """Chunks nearest to a text (needs an embedder) or a vector, with ``similarity``.

    The limit applies before chunks are looked up; hits without a chunk are skipped."""
    if isinstance(query, str):
        if embedder is None:
            raise ValueError("no embedder")
        vector = embedder.embed([query])[0]
    else:
        vector = query
    if len(vector) == 0:
        raise ValueError("empty vector")
    return join_top(chunks, vector_topk(embeddings, vector, limit, ref_type, digits), "ref_id", limit)
