"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import zlib

from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import decontaminate, exact_dedup, html_extract, jaccard_join, langid, licenses, mixing, ppm, quality, sharding


def _by_id(df, key="doc_id"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], []).append(r.asDict())
    return out


def test_mixing(edge_docs, no_docs):
    placed = lambda df: df.withColumn("domain", F.lit("d"))
    got = mixing.mix(placed(edge_docs), budget=60_000, max_epochs=2).collect()
    assert all(0 < r["take_tokens"] <= r["n_tokens"] for r in got)
    assert not [r for r in got if r["doc_id"] in (1, 2)]  # without tokens
    assert sum(r["take_tokens"] for r in got) <= 60_000
    assert sorted(r["epoch"] for r in got if r["doc_id"] == 4) == [0, 0, 1, 1]  # both repeated rows, both epochs
    assert mixing.mix(placed(no_docs)).isEmpty()
    twins = edge_docs.where("doc_id = 4").drop("domain").withColumn("domain", F.lit("d"))  # equal order keys, three tokens each
    for budget, want in ((4, [1, 3]), (3, [3]), (8, [2, 3, 3])):
        assert sorted(r["take_tokens"] for r in mixing.mix(twins, budget=budget).collect()) == want


def test_quality(edge_docs, no_docs, spark):
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, 0), (6, 1), (7, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(edge_docs, labels)
    got = quality.score(edge_docs, model).collect()
    assert len(got) == edge_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score(no_docs, model).isEmpty()
    one_kind = quality.train(no_docs, labels.limit(0))
    assert {r["score"] for r in quality.score(edge_docs, one_kind).collect()} == {0.5}


def test_exact_dedup(edge_docs, no_docs):
    got = _by_id(exact_dedup.exact_dedup(edge_docs))
    assert [r["kept"] for r in got[4]] == [True, True] and got[3][0]["keep_id"] == 4 and got[3][0]["group_size"] == 3 and not got[3][0]["kept"]
    assert got[1][0]["keep_id"] == 2 and got[2][0]["group_size"] == 2 and got[2][0]["kept"]  # null counts as empty
    assert got[2][0]["text_sha256"] == hashlib.sha256(b"").hexdigest()
    assert [r["kept"] for r in got[None]] == [True, True] and [r["group_size"] for r in got[None]] == [1, 1]
    assert exact_dedup.exact_dedup(no_docs).isEmpty()
    small = _by_id(exact_dedup.exact_dedup(edge_docs, prefer="smallest", trie_bytes=500))
    assert small[4][0]["keep_id"] == 3 and small[6][0]["group_size"] == 1


def test_langid(edge_docs, no_docs):
    dictionaries = langid.train(edge_docs)
    assert set(dictionaries) == {"en", "fr"}
    got = _by_id(langid.classify(edge_docs, dictionaries))
    for i in (1, 2, 5):
        assert got[i][0]["lang_pred"] == "und" and got[i][0]["lang_score"] == 0 and got[i][0]["lang_rejected"]
    assert all(0 <= r["lang_score"] <= 1 for rows in got.values() for r in rows)
    assert langid.classify(no_docs, dictionaries).isEmpty() and langid.train(no_docs) == {}
    assert {r["lang_pred"] for r in langid.classify(edge_docs, {}).collect()} == {"und"}
    tie = _by_id(langid.classify(edge_docs, {"b": b"xx", "a": b"xx"}))[3][0]
    assert tie["lang_pred"] == "a" and tie["lang_margin"] == 0 and tie["lang_rejected"]
    many = edge_docs.sparkSession.createDataFrame([(i, f"word{i} " + "abcdefgh"[i % 8] * 30, f"l{i}") for i in range(700)], "doc_id int, text string, lang string")
    learned = langid.train(many)
    assert len(learned) == 700 and all(learned.values()) and langid.Coder(learned).classify("hello there")[0] in learned
    one = _by_id(langid.classify(edge_docs, {"b": b"xx"}))[3][0]
    assert one["lang_pred"] == "b" and one["lang_margin"] == 1 and not one["lang_rejected"]


def test_near_duplicates_and_keep_one(edge_docs, no_docs):
    got = _by_id(jaccard_join.near_duplicates(edge_docs, words=3, threshold=(90, 100)))
    assert got[1][0]["n_shingles"] == 0 and got[1][0]["component_id"] == 1 and got[2][0]["component_id"] == 2
    assert got[4][0]["component_id"] == got[3][0]["component_id"] == 3
    assert [r["component_id"] for r in got[None]] == [None, None] and sorted(r["n_shingles"] for r in got[None]) == [3, 10]
    assert got[5][0]["n_shingles"] == 1  # "123 !!! ..." is one shingle
    kept = jaccard_join.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 0, 1, 2, 3, 5, 6, 7]
    assert jaccard_join.near_duplicates(no_docs).isEmpty()


def test_html(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "<p>a &lt; b &amp;am <b>c"), (4, "u", "<article>" + "<div>" * 3000 + "deep" + "</article>"), (5, None, "<article><p>x</p><"), (6, "u", "<article><p>same</p></article>"), (6, "u", "<article><p>same</p></article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"_html": F.lit(1), "text": F.lit("old")})
    got = _by_id(html_extract.extract(pages), "page_id")
    assert got[1][0]["text"] == got[2][0]["text"] == "" and got[1][0]["n_chars"] == 0
    assert got[4][0]["text"] == "deep" and got[5][0]["text"].startswith("x") and len(got[6]) == 2
    assert html_extract.extract(pages.limit(0)).isEmpty()


def test_ppm(edge_docs, no_docs):
    got = _by_id(ppm.score_documents(edge_docs, chunk_bytes=1 << 14))
    assert sum(map(len, got.values())) == 10
    assert got[1][0]["n_tokens"] == got[2][0]["n_tokens"] == 1 and got[1][0]["score"] < 0
    assert got[4][0]["score"] == got[4][1]["score"] and got[3][0]["score"] == got[4][0]["score"]
    assert ppm.score_documents(no_docs).isEmpty()


def test_decontaminate(edge_docs, no_docs, spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (None, "same text here"), (9, "TEXT here"), (10, "text here"), (11, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    got = _by_id(decontaminate.report(edge_docs, bench))
    assert got[3][0]["n_hit"] == 2 and got[3][0]["n_items"] == 2 and got[3][0]["items_sha256"] == hashlib.sha256(b"10,9").hexdigest()
    assert got[2][0]["n_words"] == 0 and not got[2][0]["contaminated"]
    assert sorted(r["n_hit"] for r in got[None]) == [0, 11]
    blocks = _by_id(decontaminate.report(edge_docs, bench, block_words=1))
    assert blocks == got  # several automata give the same
    none = decontaminate.report(edge_docs, bench.limit(0)).collect()
    assert len(none) == 10 and not any(r["contaminated"] for r in none)
    assert decontaminate.report(no_docs, bench).isEmpty()
    clean = _by_id(decontaminate.decontaminate(edge_docs, bench))
    assert 3 not in clean and clean[6][0]["text"] == edge_docs.where("doc_id = 6").first()["text"]
    assert len(clean[None]) == 1


def test_sharding(edge_docs, no_docs):
    got = _by_id(sharding.shard_documents(edge_docs, n_shards=3))
    assert got[2][0]["size"] == 16 and got[2][0]["text_crc32"] == 0 and got[7][0]["text_crc32"] == zlib.crc32(edge_docs.where("doc_id = 7").first()["text"].encode())
    slots = sorted((r["shard"], r["slot"]) for rows in got.values() for r in rows)
    assert slots == [(s, i) for s in range(3) for i in range(sum(x[0] == s for x in slots))]
    assert len({r["shard"] for r in got[None]}) == 1
    assert sharding.shard_documents(no_docs).isEmpty()
    assert "shard" in sharding.with_shards(edge_docs, "doc_id", [1.0, 2.0]).columns


def test_licenses(edge_docs, no_docs):
    placed = edge_docs.withColumn("path", F.when(F.col("doc_id") != 5, F.concat(F.col("source"), F.lit("/x/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("n")))))
    got = _by_id(licenses.scan(placed))
    assert got[7][0]["licence"] == "MIT" and got[7][0]["origin"] == "own"
    assert got[6][0]["origin"] == "inherited" and got[6][0]["licence_dir"] == "s2/x" and got[6][0]["licence"] == "MIT"
    assert got[3][0]["origin"] == "none" and got[2][0]["path"] is None and len(got[4]) == 2
    assert licenses.scan(no_docs).isEmpty()


def test_pipeline_stages(edge_docs, no_docs, spark, tmp_path):
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    base = edge_docs.columns  # with every clashing column, which must come through unchanged
    marked = edge_docs.withColumns({"n_words": F.lit("kept"), "domain": F.lit("own"), "shard": F.lit("mine"), "epoch": F.lit(7), "lang_pred": F.lit(5)})
    for docs in (marked, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            new = stage(spark, docs, str(tmp_path))
            path = str(tmp_path / f"{name}-{docs.count()}")
            new.write.parquet(path)
            if name != "shard":
                assert new.columns == base
            else:
                assert set(base) <= set(new.columns) and {"size", "text_crc32", "law", "out_shard", "out_slot", "grown_shard"} <= set(new.columns)
            docs = spark.read.parquet(path)
            rows = docs.collect()
            assert {(r["n_words"], r["domain"], r["shard"], r["epoch"], r["lang_pred"]) for r in rows} <= {("kept", "own", "mine", 7, 5)}
            if name == "language_id":
                assert not {1, 2, 5} & {r["doc_id"] for r in rows}
