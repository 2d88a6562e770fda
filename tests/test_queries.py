"""Each registered query against its SQL, on the smallest tables."""

import os
import re
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from strandline.plans.catalog import ORACLES, QUERIES
from strandline.plans.fixtures import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr(tuple(r[i] for i in order)) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    result = duck.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, result.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def test_chunks_of_conversations_by_a_plain_splitter(spark):
    """chunk_split has no SQL: a splitter written from the rules, by repeated trial."""
    limit = 1000
    size = lambda t: len(t.encode())

    def packed(pieces, joiner):
        out = []
        for piece in pieces:
            if out and size(out[-1]) and size(out[-1] + joiner + piece) <= limit:
                out[-1] += joiner + piece
            elif out and not size(out[-1]):
                out[-1] = piece
            else:
                out.append(piece)
        return [x for x in out if x]

    def pieces(text):
        if size(text) <= limit:
            return [text]
        out = []
        for paragraph in packed(text.split("\n\n"), "\n\n"):
            if size(paragraph) <= limit:
                out.append(paragraph)
                continue
            for part in packed([s.strip() for s in re.split(r"(?<=[.!?])[ \n]", paragraph)], " "):
                while size(part) > limit:
                    cut = max(k for k in range(1, limit + 1) if size(part[:k]) <= limit)
                    out.append(part[:cut])
                    part = part[cut:]
                out.append(part)
        return out

    turns = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        turns.setdefault(r["conv_id"], []).append((r["turn"], f"{r['role'] or ''}: {r['text'] or ''}"))
    want = {(c, i, len(p), t) for c, rows in turns.items() for p in [pieces("\n\n".join(x for _, x in sorted(rows)))] for i, t in enumerate(p, 1)}
    assert {(r["conv_id"], r["part"], r["parts"], r["content"]) for r in QUERIES["chunk_split"](spark, SF).collect()} == want


def test_entry_without_the_optional_operators(tmp_path):
    """A package that the training-data operators need is missing: the other queries stay."""
    code = "import sys\nsys.modules['zstandard'] = None\nimport __spark_entry__ as e\nassert 'recall_hybrid' in e.queries() and not [q for q in e.queries() if q.startswith('op')] and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.abspath(entry.__file__)))
