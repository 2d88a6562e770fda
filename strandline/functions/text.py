"""Text functions: SQLite LIKE, search tokens, splitting, canonical JSON, stable identifiers."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Unicode white space, as Java's regex spells it.
BLANK = r"(?U)\s+"


def like_regex(pattern: str) -> str:
    """The regex of a LIKE pattern: ``%`` and ``_`` are the only wildcards, there is no escape."""
    body = "".join(".*" if c == "%" else "." if c == "_" else re.sub(r"([^\w\s])", r"\\\1", c, flags=re.A) for c in pattern)
    return rf"(?is)\A{body}\z"


def sqlite_like(column: Column, pattern: str) -> Column:
    """LIKE that ignores the case of ASCII letters only."""
    return column.rlike(like_regex(pattern))


def fields(text: str) -> list[str]:
    """The words of a text between Unicode white space."""
    return text.split()


def trim(column: Column) -> Column:
    return F.regexp_replace(column, r"(?U)\A\s+|\s+\z", "")


# The combining marks that the search tokenizer drops, as ranges of a pattern.
MARKS = "\u0300-\u0304\u0306-\u030c\u030f\u0311\u031b\u0323-\u0328\u032d\u032e\u0330\u0331"
_IS_MARK = regex.compile(f"[{MARKS}]")


def fold_char(c: str) -> str:
    """A lower-case character as the index keeps it: case variants (final sigma, long s) become
    one, and a letter a-z loses its mark if it carries a single one.  Marks of other scripts, and
    letters with two marks, are letters of their own."""
    plain = unicodedata.normalize("NFD", c.casefold())
    if len(plain) == 2 and plain[0].isascii() and _IS_MARK.match(plain[1]):
        return plain[0]
    return c.casefold() if len(c.casefold()) == 1 else c


def _folds() -> tuple[str, str]:
    """All lower-case characters that ``fold_char`` changes and what becomes of them, then the marks alone."""
    pairs = [(c, fold_char(c)) for c in map(chr, range(0x80, 0x3000)) if c.lower() == c and fold_char(c) != c]
    return "".join(a for a, _ in pairs) + "".join(c for c in map(chr, range(0x300, 0x370)) if _IS_MARK.match(c)), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _folds()
_FOLD = {ord(c): FOLD_TO[i] if i < len(FOLD_TO) else None for i, c in enumerate(FOLD_FROM)}
_LETTERS = r"\p{L}\p{N}\p{Co}"
TOKEN = rf"[{_LETTERS}][{_LETTERS}{MARKS}]*"
_TOKEN = regex.compile(TOKEN)


def fold(column: Column) -> Column:
    return F.translate(column, FOLD_FROM, FOLD_TO)


def search_tokens(column: Column) -> Column:
    """Runs of letters and digits, lower-cased and folded.

    Folding comes first: a mark never begins a token, so without it the tokens are the same.
    Texts of single bytes have nothing to fold."""
    low = F.lower(column)
    plain = F.when(F.octet_length(low) == F.char_length(low), low).otherwise(fold(low))
    return F.regexp_extract_all(plain, F.lit(f"[{_LETTERS}]+"), F.lit(0))


def tokens_of(text: str) -> list[str]:
    """The driver-side twin of ``search_tokens``, for query strings."""
    return [t.translate(_FOLD) for t in _TOKEN.findall(text.lower())]


def sentences(column: Column) -> Column:
    """A text's sentences: cut after . ! ? before a space or newline; trimmed."""
    cut = F.split(column, r"(?<=[.!?])[ \n]")
    last = F.size(cut) - 1
    parts = F.transform(cut, lambda s, i: F.struct(trim(s).alias("s"), i.alias("i")))
    kept = F.transform(F.filter(parts, lambda p: (p["s"] != "") | (p["i"] < last)), lambda p: p["s"])
    return F.when(F.size(kept) == 0, F.array(column)).otherwise(kept)


SENTENCE_END = re.compile(r"(?<=[.!?])[ \n]")


def _pack(pieces: list[str], joiner: str, limit: int) -> Iterator[str]:
    """Join neighbours as long as they fit; empty pieces don't start a chunk."""
    chunk, size, gap = "", 0, len(joiner.encode())
    for piece in pieces:
        n = len(piece.encode())
        if not size:
            chunk, size = piece, n
        elif size + gap + n <= limit:
            chunk, size = chunk + joiner + piece, size + gap + n
        else:
            yield chunk
            chunk, size = piece, n
    if size:
        yield chunk


def _hard_cut(text: str, limit: int) -> Iterator[str]:
    """Pieces of at most ``limit`` bytes that end at code points (at least one each)."""
    raw = text.encode()
    while len(raw) > limit:
        at = limit
        while at > 0 and raw[at] & 0xC0 == 0x80:
            at -= 1
        if at == 0:
            at = next((i for i in range(1, len(raw)) if raw[i] & 0xC0 != 0x80), len(raw))
        yield raw[:at].decode()
        raw = raw[at:]
    if raw:
        yield raw.decode()


def split_text(text: str | None, limit: int) -> list[str]:
    """Chunks of at most ``limit`` bytes: paragraphs, else sentences, else hard cuts."""
    if text is None:
        return []
    if limit <= 0 or len(text.encode()) <= limit:
        return [text]
    out: list[str] = []
    for block in _pack(text.split("\n\n"), "\n\n", limit):
        if len(block.encode()) <= limit:
            out.append(block)
            continue
        cut = SENTENCE_END.split(block)
        parts = [s.strip() for s in cut[:-1]] + [s for s in [cut[-1].strip()] if s]
        for piece in _pack(parts or [block], " ", limit):
            out += _hard_cut(piece, limit)
    return out


def chunked(column: Column, limit: int) -> Column:
    """``array<string>`` of chunks, through an Arrow UDF."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split_chunks(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, limit))

    return split_chunks(column)


def canonical_json(pairs: Column) -> Column:
    """JSON text of a string map with its keys in order."""
    entries = F.array_sort(F.map_entries(pairs))
    return F.to_json(F.map_from_entries(entries))


def stable_id(kind: str, *parts: Column) -> Column:
    """An identifier that retries and recomputation don't change."""
    return F.concat(F.lit(f"{kind}:"), F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), 256), 1, 32))
