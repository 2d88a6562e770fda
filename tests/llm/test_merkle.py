"""The Merkle manifest against plain recomputation."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from strandline.llm import merkle, queries

SF = "/root/testdata/sf0.001"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    values = [None if v is None else str(v) for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)]
    return h(*["-" if v is None else f"{len(v.encode())}:{v}" for v in values])


def climb(nodes):
    """The root, and each node's (left, right) siblings per level."""
    where, paths = [[i] for i in range(len(nodes))], [[] for _ in nodes]
    while len(nodes) > 1:
        runs = [range(a, min(a + 3, len(nodes))) for a in range(0, len(nodes), 3)]
        for run in runs:
            for i in run:
                for k in where[i]:
                    paths[k].append(([nodes[j] for j in run if j < i], [nodes[j] for j in run if j > i]))
        where = [sum((where[i] for i in run), []) for run in runs]
        nodes = [h(*[nodes[i] for i in run]) for run in runs]
    return nodes[0], paths


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs, inner = [], []
    for s in sources:
        by[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        sub, paths = climb([leaf(r, r["text"]) for r in by[s]])
        subs.append(sub)
        inner.append(paths)
    if not subs:
        return []
    root, outer = climb(subs)
    out = []
    for s, sub, paths, top in zip(sources, subs, inner, outer, strict=True):
        for r, path in zip(by[s], paths, strict=True):
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None
            now = leaf(r, r["text"].replace("\n", "") if tampered else r["text"])
            proof = []
            for left, right in path + top:
                proof += left + right
                now = h(*left, now, *right)
            out.append((r["doc_id"], leaf(r, r["text"]), sub, root, h(*proof), now, now == root))
    return sorted(out, key=str)


def test_query_against_plain(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = queries.QUERIES["op13_merkle"](spark, SF)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 728, 729, 730, 2187, 2188, 5000])
def test_blocks_of_a_tree(n):
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    root, paths = climb([d.hex() for d in digests])
    blocks = [digests[a : a + merkle.BLOCK] for a in range(0, n, merkle.BLOCK)]
    proofs = [[[] for _ in b] for b in blocks]
    tops = [merkle.traverse(b, n <= merkle.BLOCK, p) for b, p in zip(blocks, proofs, strict=True)]
    above = [[] for _ in tops]
    assert merkle.traverse(tops, True, above).hex() == root
    for i in {0, 1, 2, n // 2, n - 2, n - 1} & set(range(n)):
        path = b"".join(proofs[i // merkle.BLOCK][i % merkle.BLOCK] + above[i // merkle.BLOCK])
        assert [([d.hex() for d in o[:p]], [d.hex() for d in o[p:]]) for p, o in merkle.steps(path)] == paths[i]
        assert merkle.fold(digests[i], path).hex() == root


def test_several_levels(spark, monkeypatch):
    """A hot source of several levels of blocks, a lone leaf, a null and an empty source."""
    rows = spark.range(2500).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < 2300, "hot").when(F.col("id") < 2301, "lone").when(F.col("id") < 2310, "").when(F.col("id") < 2400, F.concat(F.lit("s"), F.col("id"))).alias("source"),
        F.lit("en").alias("lang"), (F.col("id") % 7).alias("n_chars"), F.concat(F.lit("a\nb"), F.col("id") % 5).alias("text"))
    got = merkle.manifest(rows, changed=merkle.without_line_ends()).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows.collect())


def test_edges(edge_docs, no_docs):
    got = merkle.manifest(edge_docs, changed=merkle.without_line_ends()).collect()
    assert sorted(map(tuple, got), key=str) == plain(edge_docs.collect())
    assert all(r["verified"] for r in merkle.manifest(edge_docs).collect())
    assert merkle.manifest(no_docs, changed=merkle.without_line_ends()).isEmpty()
    clash = edge_docs.withColumns({c: F.lit("x") for c in ("tree", "digest", "pos", "total", "changed", "block", "path", "root", "leaf", "at", "part", "nodes", "verified")})
    assert len({r["root"] for r in merkle.manifest(clash).collect() + got}) == 1
