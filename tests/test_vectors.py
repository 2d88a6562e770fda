import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import vectors as V


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [([1.0, 2.0], [1.0, 2.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0, 1.0], [-1.0, -1.0], -1.0), ([0.0, 0.0], [1.0, 1.0], 0.0), ([1.0], [1.0, 2.0], 0.0), ([], [], 0.0)],
)
def test_cosine(spark, a, b, want):
    row = spark.createDataFrame([(a, b)], "a array<float>, b array<float>").select(V.cosine(F.col("a"), F.col("b"))).first()
    assert row[0] == pytest.approx(want, abs=1e-6)


def test_codec_round_trip_ignores_trailing_bytes(spark):
    df = spark.createDataFrame([([1.5, -2.25, 3.0],)], "v array<float>").select(V.encode_floats("v").alias("b"))
    assert bytes(df.first()[0]) == np.array([1.5, -2.25, 3.0], "<f4").tobytes()
    assert df.select(V.decode_floats(F.concat("b", F.unhex(F.lit("AA"))))).first()[0] == [1.5, -2.25, 3.0]


def test_embedder_is_unit_length_byte_sums(spark):
    text = "héllo world"
    sums = np.zeros(8)
    for i, b in enumerate(text.encode()):
        sums[i % 8] += b
    got = spark.createDataFrame([(text,)], "t string").select(V.embed("t")).first()[0]
    assert np.allclose(got, sums / np.linalg.norm(sums), atol=1e-6)
    assert not V.embed_text("").any()
