import random

import pytest

CLASHES = "score string, epoch int, n_tokens string, take_tokens int, shard string, slot int, lang_pred int, lang_margin int, n_words string, spans int, _text int, _html string, id int, hash string, sig int, n int, sha string, keep_id string, component_id int, domain string, path string, _whole string, _rest int, _take string, _last int, _begin string, _level_domain string, _here int, _key string, _kept int, _label string, _nth string, _leaf int, _cut string, _salt string, _c1 string, lang_n int, draw string, key string, text_n int"


def rows():
    r = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    long = " ".join(r.choice(words) + str(r.randrange(9999)) for _ in range(40_000))
    texts = [
        (1, "", "en", "s0"),
        (2, None, "en", None),
        (None, "one two three four five six seven eight nine ten eleven twelve", None, "s1"),
        (None, "un deux trois quatre cinq", "fr", "s1"),
        (3, "Same Text HERE", "en", "s0"),
        (4, "same text here", "fr", "s0"),
        (4, "same text here", "fr", "s0"),
        (5, "123 !!! ... \t\n ", None, "s0"),
        (6, long, "en", "s2"),
        (7, "École à Ünïcode 漢字. Released under the MIT License.", "fr", "s2"),
    ]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in texts]


@pytest.fixture(scope="session")
def edge_docs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in (x.split() for x in CLASHES.split(", "))]).cache()


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0).cache()
