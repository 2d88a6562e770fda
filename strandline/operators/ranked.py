"""Ranked keyword retrieval that stops early: a term dictionary and posting lists with block maxima.

Chunks are dealt into blocks of similar length.  A term has a row for each block it occurs in: its greatest
frequency and the least length there, then the entries.  The frequency part of BM25 grows with the
frequency and falls with the length, so the two numbers bound the score of every entry of the block,
whatever the average length has become since.

A search reads the dictionary's rows of its terms, then the bounds (the entries are another column), scores the
blocks with the best bounds, and then only those others whose bound reaches the k-th score found.  The result is
that of scoring everything."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import search_tokens
from ..staging import staged
from . import lookup
from .entities import check_limit
from .search import IDF_FLOOR, K1, B, Match, Phrase, parse_match, token_slices

BLOCK_CHUNKS = 256
#: Blocks that are scored first.
FIRST = 64


def dictionary(postings: DataFrame) -> DataFrame:
    """(term, df, occurrences)."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("occurrences"))


def terms_with_prefix(terms: DataFrame, prefix: str) -> DataFrame:
    """The dictionary's terms that begin with ``prefix``: a range of a table that is sorted by term."""
    return terms.where(F.startswith("term", F.lit(prefix)))


def blocks(postings: DataFrame, lengths: DataFrame, block_chunks: int = BLOCK_CHUNKS) -> DataFrame:
    """(term, block, max_tf, min_dl, entries) from (term, chunk_id, tf, dl) and (chunk_id, dl)."""
    placed = staged(lookup.clustered(lengths.select("dl", "chunk_id"), "dl", "chunk_id").withColumn("at", F.monotonically_increasing_id()), "lengths")
    # A partition's rows are numbered from 0 in the low 33 bits, so its last block may be short.
    block = F.concat_ws("-", F.shiftright("at", 33), F.floor(F.col("at").bitwiseAND((1 << 33) - 1) / block_chunks))
    rows = postings.select("term", "chunk_id", "tf", "dl").join(placed.select("chunk_id", block.alias("block")), "chunk_id")
    entry = F.struct("chunk_id", "tf", "dl")
    return rows.groupBy("term", "block").agg(F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.sort_array(F.collect_list(entry)).alias("entries"))


def _blocks_of(block_chunks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sizes, coded in token_slices(batch, block_chunks):
                if not len(coded):
                    continue
                row = np.repeat(np.arange(len(sizes)), sizes)
                key, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(sizes) + row, return_counts=True)
                term, of = key // len(sizes), key % len(sizes)
                first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
                ends, dl = np.append(first, len(key)), sizes[of].astype(np.int32)
                entry = pa.StructArray.from_arrays([part.column(1).take(pa.array(of)), pa.array(tf), pa.array(dl)], ["chunk_id", "tf", "dl"])
                columns = [
                    coded.dictionary.take(pa.array(term[first])),
                    pa.array([str(part.column(0)[0])] * len(first)),
                    pa.array(np.maximum.reduceat(tf, first)),
                    pa.array(np.minimum.reduceat(dl, first)),
                    pa.array(np.diff(ends)),
                    pa.array(np.add.reduceat(tf, first)),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), entry),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["term", "block", "max_tf", "min_dl", "df", "occurrences", "entries"])

    return run


def block_index(chunks: DataFrame, id: str = "id", content: str = "content", block_chunks: int = BLOCK_CHUNKS) -> DataFrame:
    """(term, block, max_tf, min_dl, df, occurrences, entries) from texts: what ``blocks`` gives for their postings.

    Texts are shuffled once, by their length in bytes, and a block's postings are made where its texts lie, so no
    single posting is shuffled or joined."""
    near = chunks.select(F.col(id).alias("chunk_id"), F.col(content).alias("content"), F.octet_length(content).alias("size"))
    near = lookup.clustered(near, "size", "chunk_id").withColumn("at", F.monotonically_increasing_id())
    rows = near.select("at", "chunk_id", search_tokens(F.col("content")).alias("tokens"))
    kind = rows.schema["chunk_id"].dataType.simpleString()
    return rows.mapInArrow(_blocks_of(block_chunks), f"term string, block string, max_tf bigint, min_dl int, df bigint, occurrences bigint, entries array<struct<chunk_id: {kind}, tf: bigint, dl: int>>")


def dictionary_of(index: DataFrame) -> DataFrame:
    """(term, df, occurrences) from a block index, without its entries."""
    return index.groupBy("term").agg(F.sum("df").alias("df"), F.sum("occurrences").alias("occurrences"))


def totals_of(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """One row: n_chunks, n_tokens.  Tokens are counted in the dictionary, not in the texts."""
    return chunks.agg(F.count(F.lit(1)).alias("n_chunks")).crossJoin(terms.agg(F.sum("occurrences").alias("n_tokens")))


def plain_terms(query: str) -> tuple[list[str], bool]:
    """The terms of an expression that only joins single words, and whether all are required."""
    tree = parse_match(query)
    parts = tree.parts if isinstance(tree, Match) else (tree,)
    if (isinstance(tree, Match) and tree.op not in ("and", "or")) or not all(isinstance(p, Phrase) and len(p.terms) == 1 and not p.prefix and not p.initial for p in parts):
        raise ValueError("early stop is for words joined by AND or by OR")
    terms = [p.terms[0] for p in parts]
    if len(set(terms)) < len(terms):
        raise ValueError("a word twice")
    return terms, isinstance(tree, Match) and tree.op == "and"


def _saturated(tf: Column, dl: Column, avgdl: float) -> Column:
    tf = tf.cast("double")
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(avgdl)))


class BlockSearch:
    """Searches over ``index`` (see :func:`blocks`), ``terms`` (see :func:`dictionary`) and ``totals`` (one row: n_chunks, n_tokens)."""

    def __init__(self, index: DataFrame, terms: DataFrame, totals: DataFrame):
        self.index, self.terms, self.totals = index, terms, totals
        #: Of the last search: blocks with a term, and blocks whose entries were read.
        self.n_blocks = self.n_read = 0

    def _idf(self, words: Sequence[str]) -> tuple[dict[str, float], float]:
        total = self.totals.first()
        n, tokens = float(total["n_chunks"] or 0), float(total["n_tokens"] or 0)
        df = {r["term"]: r["df"] for r in self.terms.where(lookup.one_of("term", words)).collect()}
        raw = {w: math.log((n - df.get(w, 0) + 0.5) / (df.get(w, 0) + 0.5)) for w in words}
        return {w: x if x > 0 else IDF_FLOOR for w, x in raw.items()}, tokens / n if n else 1.0

    def topk(self, query: str, limit: int = 10, digits: int | None = None) -> DataFrame:
        """(chunk_id, score) of the best ``limit`` chunks."""
        check_limit(limit)
        words, every = plain_terms(query)
        idf, avgdl = self._idf(words)
        weight = F.element_at(F.create_map(*[F.lit(x) for w in words for x in (w, idf[w])]), F.col("term"))
        asked = self.index.where(lookup.one_of("term", words))
        best = (weight * _saturated(F.col("max_tf"), F.col("min_dl"), avgdl)).alias("best")
        bounds = asked.select("term", "block", best).groupBy("block").agg(F.sum("best").alias("bound"), F.count(F.lit(1)).alias("n"))
        bounds = staged(bounds.where(F.col("n") == len(words)) if every else bounds, "bounds").select("block", "bound")
        self.n_blocks = bounds.count()
        first = [r["block"] for r in bounds.orderBy(F.col("bound").desc(), "block").limit(FIRST).collect()]
        self.n_read = len(first)

        def scored(rows: DataFrame) -> DataFrame:
            entries = rows.select("term", F.explode("entries").alias("e")).select("term", "e.*")
            score = F.sum(weight * _saturated(F.col("tf"), F.col("dl"), avgdl))
            found = entries.groupBy("chunk_id").agg((F.round(score, digits) if digits is not None else score).alias("score"), F.count(F.lit(1)).alias("n"))
            found = found.where(F.col("n") == len(words)) if every else found
            return found.select("chunk_id", "score").orderBy(F.col("score").desc(), "chunk_id").limit(limit)

        top = staged(scored(asked.where(lookup.one_of("block", first))), "top")
        if limit == 0 or self.n_blocks <= len(first):
            return top.orderBy(F.col("score").desc(), "chunk_id")
        reached = top.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).first()
        open_ = bounds.where(~lookup.one_of("block", first))
        if reached["n"] == limit:  # rounding, and sums in another order, may lift a score by less than this
            open_ = open_.where(F.col("bound") >= reached["least"] - (10.0 ** -digits if digits is not None else 1e-9))
        open_ = staged(open_.select("block"), "open")
        n = open_.count()
        if n:
            self.n_read += n
            rest = scored(lookup.semi(asked, open_, "block"))
            top = top.unionByName(rest).orderBy(F.col("score").desc(), "chunk_id").limit(limit)
        return top
