"""The whole pipeline against what each of its stages promises, by brute force."""

import os
import re

import pytest

import corpus_pipeline
from strandline.llm import langid

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF).collect()
    given = {r["doc_id"]: r for r in docs.collect()}
    assert {r["doc_id"] for r in out} <= set(given) and len({r["doc_id"] for r in out}) == len(out)
    # Language: the ones that one encoder, text by text, doesn't reject.
    coder = langid.Coder(langid.train(docs))
    clear = {i for i, r in given.items() if (found := coder.classify(r["text"]))[0] != "und" and found[2] >= langid.MIN_MARGIN}
    assert {r["doc_id"] for r in out} <= clear
    # Near duplicates: no two of the given texts that stay are near, and each that went for it has one of a smaller id.
    sets = {i: shingles(given[i]["text"]) for i in clear}
    near = lambda a, b: len(a & b) * 100 >= 80 * len(a | b) and bool(a)
    ids = sorted(r["doc_id"] for r in out)
    assert not [(i, j) for k, i in enumerate(ids) for j in ids[k + 1 :] if near(sets[i], sets[j])]
    # Decontamination: what is left of each text is of it, in order; no benchmark passage of ten words is in it.
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    for r in out:
        mine, w = iter(words(given[r["doc_id"]]["text"])), words(r["text"])
        assert all(x in mine for x in w)
        if r["text"] == given[r["doc_id"]]["text"]:
            assert not any(tuple(w[i : i + 10]) in windows for i in range(len(w) - 9))
        assert r["n_chars"] == len(r["text"])
    # Shards: gapless slots.
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(corpus_pipeline.SHARDS))
    # Mixing takes four fifths of the rest's tokens at most, and most of them.
    assert len(out) > len(given) / 4
