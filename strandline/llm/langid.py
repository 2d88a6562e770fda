"""Language identification by compression.

For each language a zstandard raw-content dictionary is made from labelled
texts.  A text is encoded with every dictionary; the language whose dictionary
gives the smallest output wins, and a narrow margin between the two smallest
outputs is rejected.  What is encoded is the lower-cased words of a text; its
other characters carry no language.  Texts are encoded whole, in blocks of ``block_bytes``
that start at character boundaries, each block against a fresh dictionary, so a
long text can't outgrow the dictionaries by matching itself.  Each block is encoded twice and
the sizes are added: plainly, and by a finer search behind a prelude (a few bytes of every
language, whose own size is taken off), which tells short blocks apart that would be stored.

All texts, short and long, go the same way and are held to the same margin (bytes saved
over the second language, per byte of words); a tie is below every margin.

Only the dictionaries are learned.  They come from a bounded sample: at most
``sample_docs`` documents per language, chosen by a hash of their identifiers
among all labelled rows, of each of them a span at a place that its hash chooses, as
long as the dictionary has room for.  What reaches the driver and is broadcast is bounded by
``sample_docs``, ``dictionary_bytes`` and ``ALL_BYTES``: so many languages that their dictionaries would be more
in all have shorter ones, and none is left out.  A language with little text has a small dictionary, and
the others keep theirs whole: it wins the texts that its few bytes do encode best.

Defined results: a text that is null or has no letter is ``und`` with score 0;
equal sizes go to the first language in alphabetical order, with margin 0, and are
rejected; with a single language everything is that one, with margin 1;
without any labelled text everything is ``und``; an empty table gives an empty
result; null labels are not learned from; columns named like a result are replaced.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Mapping

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textcore
from .staging import staged, with_fields

UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")
NOT_LETTERS = regex.compile(r"\P{L}+")

DICTIONARY_BYTES = 96 << 10
SAMPLE_DOCS = 256
BLOCK_BYTES = 1 << 12
LEVEL = 3
FINE_LEVEL = 6
PRELUDE_BYTES = 64
MIN_MARGIN = 0.001
#: All dictionaries, and all preludes, at most.
ALL_BYTES = 48 << 20
ALL_PRELUDES = 32 << 10
#: Nats of score per byte saved.
SCALE = 1.0


def letters(text: str) -> str:
    """Lower-case words; everything between letters is one space."""
    return NOT_LETTERS.sub(" ", text.lower()).strip()


def sample_by_language(docs: DataFrame, key: str, text: str, lang: str, sample_docs: int, span: int = DICTIONARY_BYTES) -> dict[str, list[str]]:
    """Of each language a span of at most ``sample_docs`` texts, those of smallest key hash."""
    labelled = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where(F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = staged(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "langs")
    n_langs = counts.count()
    if not n_langs:
        return {}
    span = min(span, max(1, ALL_BYTES // n_langs))
    sample_docs = max(1, min(sample_docs, ALL_BYTES // (64 * n_langs)))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("langid"), F.col("key")), 11) / float(1 << 53)
    begin = F.pmod(F.xxhash64(F.lit("span"), F.col("text")), F.greatest(F.lit(1), F.length("text") - span + 1)).cast("int") + 1
    drawn = labelled.join(counts, "lang").where(draw < 2.0 * sample_docs / F.col("n"))
    rows = drawn.select("lang", draw.alias("draw"), F.substring(F.col("text"), begin, F.lit(span)).alias("text")).collect()
    found: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r[0], r["draw"], r["text"])):
        if len(found.setdefault(r[0], [])) < sample_docs:
            found[r[0]].append(r["text"])
    return found


def build_dictionaries(samples: Mapping[str, list[str]], dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Equal shares of each sampled text, joined; each language has as much as its own texts give."""
    pools = {}
    dictionary_bytes = min(dictionary_bytes, max(8, ALL_BYTES // max(1, len(samples))))
    for lang, texts in sorted(samples.items()):
        raw = sorted((letters(t).encode() for t in texts), key=len)
        room, part = dictionary_bytes, []
        for i, t in enumerate(raw):
            size = max(1, room // (len(raw) - i))
            begin = zlib.crc32(t) % (len(t) - size + 1) if len(t) > size else 0
            part.append(t[begin : begin + size].decode("utf-8", "ignore").encode())
            room -= len(part[-1]) + 1
        pools[lang] = b"\n".join(part)[-dictionary_bytes:]
    return pools


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS, dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    return build_dictionaries(sample_by_language(docs, key, text, lang, sample_docs), dictionary_bytes)


class Coder:
    def __init__(self, dictionaries: Mapping[str, bytes], level: int = LEVEL, block_bytes: int = BLOCK_BYTES):
        self.langs, self.block_bytes = sorted(dictionaries), block_bytes
        raw = [dictionaries[lang] for lang in self.langs]
        given = [min(PRELUDE_BYTES, len(x) // 2, ALL_PRELUDES // len(raw)) for x in raw]  # something stays in a small dictionary
        self.prelude = b" ".join(x[:n] for n, x in zip(given, raw, strict=True)) + b" "
        self.plain = [self._coder(x, level, block_bytes, 4) for x in raw]
        self.fine = [self._coder(x[n:], FINE_LEVEL, block_bytes + len(self.prelude), 3) for n, x in zip(given, raw, strict=True)]
        self.idle = [len(c.compress(self.prelude)) for c in self.fine]

    @staticmethod
    def _coder(raw: bytes, level: int, block_bytes: int, min_match: int) -> zstandard.ZstdCompressor:
        params = zstandard.ZstdCompressionParameters.from_level(level, source_size=block_bytes, dict_size=len(raw), min_match=min_match, write_content_size=False, write_checksum=False, write_dict_id=False)
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(dict_data=d, compression_params=params)

    def blocks(self, raw: bytes) -> Iterator[bytes]:
        a = 0
        while a < len(raw):
            b = min(len(raw), a + self.block_bytes)
            while b < len(raw) and raw[b] & 0xC0 == 0x80:
                b -= 1
            yield raw[a:b]
            a = b

    def sizes(self, raw: bytes) -> list[int]:
        parts = [(p, self.prelude + p) for p in self.blocks(raw)]
        return [sum(len(c.compress(p)) + len(f.compress(q)) - i for p, q in parts) for c, f, i in zip(self.plain, self.fine, self.idle, strict=True)]

    def classify(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin): margin is the saving over the second best, per byte of text."""
        if not text or not self.langs or not LETTER.search(text):
            return UNDETERMINED, 0.0, 0.0
        raw = letters(text).encode()
        sizes = self.sizes(raw)
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        best = order[0]
        margin = (sizes[order[1]] - sizes[best]) / len(raw) if len(order) > 1 else 1.0
        score = 1.0 / sum(math.exp(max(-700.0, SCALE * (sizes[best] - s))) for s in sizes)
        return self.langs[best], score, margin


def _classifier(dictionaries: Mapping[str, bytes], text: str, min_margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(dictionaries)
        for batch in batches:
            found = [coder.classify(x.as_py()) for x in batch.column(batch.schema.names.index(text))]
            lang, score, margin = zip(*found, strict=True) if found else ((), (), ())
            rejected = [f == UNDETERMINED or m < min_margin for f, _, m in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array(rejected, pa.bool_())], [*batch.schema.names, "lang_pred", "lang_score", "lang_margin", "lang_rejected"])

    return textcore.tidy(run)


def classify(docs: DataFrame, dictionaries: Mapping[str, bytes], text: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """``docs`` with lang_pred, lang_score (0 to 1), lang_margin and lang_rejected: ``und``, or a
    margin below ``min_margin``."""
    base = docs.drop("lang_pred", "lang_score", "lang_margin", "lang_rejected")
    out = with_fields(base.schema, "lang_pred string, lang_score double, lang_margin double, lang_rejected boolean")
    return base.mapInArrow(_classifier(dict(dictionaries), text, min_margin), out)


def held_out(key: str, modulus: int, remainder: int) -> Column:
    """crc32 of the identifier as text, modulo ``modulus``, is ``remainder``."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus == remainder
