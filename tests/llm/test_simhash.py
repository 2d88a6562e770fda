"""SimHash near-duplicates against brute force."""

import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from strandline.llm import queries, simhash

SF = "/root/testdata/sf0.001"


def plain(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def classes(prints):
    """The smallest member each number is connected to, by comparing all."""
    near = [[y for y in prints if bin(x ^ y).count("1") <= 3] for x in prints]
    at, first = {x: i for i, x in enumerate(prints)}, {}
    for x in prints:
        if x not in first:
            queue, seen = [x], {x}
            while queue:
                for y in near[at[queue.pop()]]:
                    if y not in seen:
                        seen.add(y)
                        queue.append(y)
            first.update(dict.fromkeys(seen, min(seen)))
    return first


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    prints = {r["doc_id"]: plain(r["text"]) for r in docs}
    root = classes(sorted(set(prints.values())))
    first = {}
    for i, p in prints.items():
        first[root[p]] = min(i, first.get(root[p], i))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.QUERIES["op11_simhash"](spark, SF).collect()}
    assert got == {i: (f"{p:016x}", first[root[p]]) for i, p in prints.items()}


def test_hashes_of_all_lengths():
    data = np.random.default_rng(3).integers(0, 256, 4000, dtype=np.uint8)
    starts = np.random.default_rng(4).integers(0, 3900, 500)
    ends = starts + np.arange(500) % 70
    assert simhash.xxh64(data, starts, ends).tolist() == [xxhash.xxh64_intdigest(data[a:b].tobytes(), seed=42) for a, b in zip(starts, ends, strict=True)]


def test_long_lists_lose_no_link(spark, monkeypatch):
    """Dense clusters: lists beyond the limit are dealt again and looked up."""
    r = np.random.default_rng(5)
    prints = set(r.integers(0, 1 << 63, 50).tolist())
    for base in r.integers(0, 1 << 63, 2).tolist():
        prints |= {base ^ sum(1 << int(k) for k in set(r.integers(0, 24, 4).tolist())) for _ in range(250)}
    monkeypatch.setattr(simhash, "LIST", 20)
    nodes = spark.createDataFrame([(p,) for p in prints], "fp long")
    found = simhash.links(nodes).collect()
    assert all(bin(a ^ b).count("1") <= 3 for a, b in found)
    root = classes(sorted(prints))
    group = {p: p for p in prints}

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in found:
        x, y = sorted((top(a), top(b)))
        group[y] = x
    assert {p: top(p) for p in prints} == root
    # The lookup under all changes by itself, as workers keep the limit they were started with.
    fives = simhash.FIVES[0]
    keep = sum(255 << 8 * p for p in fives)
    by_key = {}
    for p in prints:
        by_key.setdefault(p & keep, []).append(p)
    for members in by_key.values():
        linked = {p: p for p in members}
        for a, b in simhash._looked_up(np.array(members, np.uint64), fives):
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                old, new = max(linked[x], linked[y]), min(linked[x], linked[y])
                linked = {k: new if v == old else v for k, v in linked.items()}
        assert linked == classes(sorted(members))


def test_edges(edge_docs, no_docs):
    got = {}
    for r in simhash.near_duplicates(edge_docs).collect():
        got.setdefault(r["doc_id"], []).append((r["fingerprint"], r["component_id"]))
    assert got[1] == got[2] == [("0" * 16, 1)]  # empty and null
    assert got[3] == [(got[4][0][0], 3)] and got[4] == [got[3][0]] * 2
    assert len(got[None]) == 2 and {c for _, c in got[None]} == {None}
    assert simhash.near_duplicates(no_docs).isEmpty()
    text_keys = edge_docs.withColumn("doc_id", F.concat(F.lit("k"), F.col("doc_id")))
    assert {r["component_id"] for r in simhash.near_duplicates(text_keys).collect() if r["doc_id"] == "k4"} == {"k3"}
