"""Support by sentences in blocks, against the expressions on all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from cotejo.operators import semantic


@pytest.mark.parametrize("block", [4096, 5])
def test_blocks_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(semantic, "BLOCK", block)
    monkeypatch.setattr(semantic, "GROUP", 2)
    rng = random.Random(block)

    def vector(n=3):
        return [float(rng.randrange(-2, 3)) for _ in range(n)]

    odd = [None, [], [0.0] * 3, [float("nan"), 1.0, 1.0], [1.0, None, 1.0], [1e200, 1.0, 0.0], [1e-200, 0.0, 0.0], [1.0, 2.0]]
    e = [(i % 4 if i % 11 else None, i, vector()) for i in range(120)] + [(1, 500 + i, v) for i, v in enumerate(odd)] + [(7, 900, [1.0, 0.0, 0.0]), (8, 901, [1.0, 0.0, 0.0]), (9, 902, [1.0, 0.0, 0.0])]
    s = [(i % 3, vector()) for i in range(4)] + [(7, v) for v in odd] + [(8, [0.0, 0.0, 0.0]), (9, [-1.0, 0.0, 0.0])]
    e = spark.createDataFrame(e, "doc_id long, pos int, embedding array<double>")
    s = spark.createDataFrame(s, "doc_id long, embedding array<double>")
    pairs = e.join(s.withColumnRenamed("embedding", "other"), "doc_id").groupBy("pos").agg(F.max(semantic.cosine(F.col("embedding"), F.col("other"))).alias("c"))
    for threshold in (0.5, 1.0, 0.9):
        want = {r.pos: r.ok for r in e.join(pairs, "pos", "left").select("pos", F.coalesce(F.col("c") >= threshold, F.lit(True)).alias("ok")).collect()}
        got = {r.pos: r.supported for r in semantic.supported(e, s, threshold=threshold).collect()}
        assert got == want and set(want.values()) == {True, False}


def test_no_pair_of_vectors_is_a_row(spark):
    """Many vectors of one key: the plan joins no vector with a vector."""
    e = spark.range(40).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("pos"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"))
    out = semantic.supported(e, e.select("doc_id", "embedding"))
    assert out.count() == 40 and "zip_with" not in out._jdf.queryExecution().toString()
