import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.functions import text as T


@pytest.mark.parametrize(
    ("value", "pattern", "hit"),
    [
        ("Alice Johnson", "alice%", True),
        ("Alice", "%LIC%", True),
        ("a.b", "a_b", True),
        ("axb", "a.b", False),
        ("50% off", "50% off", True),
        ("two\nlines", "two%lines", True),
        ("Été", "été", False),  # only ASCII letters fold
        ("back\\slash", "back\\slash", True),
        ("trail\\", "%\\", True),
        ("(x)", "(x)", True),
        ("abc", "ab", False),
    ],
)
def test_like(spark, value, pattern, hit):
    row = spark.createDataFrame([(value,)], "v string").select(T.sqlite_like(F.col("v"), pattern)).first()
    assert row[0] is hit


def test_tokens_fold_marks_and_case(spark):
    text = "Café snake_case naïve 12a"
    row = spark.createDataFrame([(text,)], "v string").select(T.search_tokens(F.col("v"))).first()
    assert row[0] == T.tokens_of(text) == ["cafe", "snake", "case", "naive", "12a"]


def test_split_keeps_short_text_and_zero_disables():
    assert T.split_text("abc", 10) == ["abc"]
    assert T.split_text("a" * 50, 0) == ["a" * 50]
    assert T.split_text(None, 5) == []


def test_split_prefers_paragraphs():
    parts = [c * 90 for c in "abc"]
    assert T.split_text("\n\n".join(parts), 100) == parts


def test_split_packs_greedily():
    out = T.split_text("\n\n".join("x" * 50 for _ in range(10)), 200)
    assert len(out) <= 5 and all(len(c) <= 200 for c in out)


def test_hard_cut_is_lossless():
    out = T.split_text("z" * 10_000, 1000)
    assert "".join(out) == "z" * 10_000 and len(out) == 10


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. !?\né漢\U0001f600", max_size=300), st.integers(4, 60))
def test_split_limits_are_bytes(text, limit):
    out = T.split_text(text, limit)
    assert all(len(c.encode()) <= limit for c in out)
    assert re.sub(r"\s", "", "".join(out)) == re.sub(r"\s", "", text)


def test_sentences(spark):
    cases = {"One. Two!\nThree? four": ["One.", "Two!", "Three?", "four"], "a.b c": ["a.b c"], "": [""], "End. ": ["End."]}
    for text, want in cases.items():
        assert spark.createDataFrame([(text,)], "v string").select(T.sentences(F.col("v"))).first()[0] == want


def test_chunk_udf_equals_splitter(spark):
    r = random.Random(3)
    texts = ["".join(r.choice("ab. \né") for _ in range(r.randrange(400))) for _ in range(50)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string").select("i", T.chunked(F.col("v"), 64).alias("c")).collect()
    assert all(r["c"] == T.split_text(texts[r["i"]], 64) for r in rows)


def test_stable_id_separates_null_and_empty(spark):
    row = spark.createDataFrame([(None, "")], "a string, b string").select(T.stable_id("x", F.col("a")), T.stable_id("x", F.col("b"))).first()
    assert row[0] != row[1] and row[0].startswith("x:")


@pytest.mark.parametrize("limit", [7, 20, 40])
def test_splitter_equals_its_sql(limit):
    """Random texts of paragraphs, sentences, long words and letters of several bytes."""
    import duckdb

    from strandline.plans.splitting import split_sql

    r = random.Random(limit)
    texts = ["".join(r.choice(["a", "bc", "é", "漢", " ", ". ", "! ", ".\n", "\n\n", "\n\n\n", "long" * 5, "x y z. "]) for _ in range(r.randrange(1, 40))) for _ in range(150)]
    con = duckdb.connect()
    con.execute("CREATE TABLE texts(id INTEGER, content VARCHAR)")
    con.executemany("INSERT INTO texts VALUES (?, ?)", list(enumerate(texts)))
    got = sorted(con.execute(split_sql("SELECT id, content FROM texts", "id", limit)).fetchall())
    want = [(i, k + 1, len(parts), p) for i, parts in ((i, T.split_text(t, limit)) for i, t in enumerate(texts)) for k, p in enumerate(parts)]
    assert got == sorted(want)
