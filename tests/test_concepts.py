"""Concepts by products of batches, and candidates that are computed once for both of their uses."""

import math
import random

from pyspark.sql import functions as F

from cotejo.functions import text as tx
from cotejo.operators import entities, semantic


def plain(x, y):
    """The cosine in the order of ``semantic.cosine``; None where there is none."""
    if x is None or y is None or len(x) != len(y) or None in x or None in y:
        return None
    dot = lambda a, b: sum((p * q for p, q in zip(a, b)), 0.0) if a else 0.0
    norm = math.sqrt(dot(x, x)) * math.sqrt(dot(y, y))
    return dot(x, y) / norm if norm != 0 else None


def test_products_tell_what_cosines_tell(spark, monkeypatch):
    rng = random.Random(4)
    concepts = [[rng.uniform(-1, 1) for _ in range(3)] for _ in range(5)] + [[3.0, 4.0, 0.0], [0.0, 0.0, 0.0], [1e-170, 0.0, 0.0], [1e160, 0.0, 0.0], [1.0, 1.0], [], [1.0, None, 1.0], None]
    odd = [None, [], [0.0, 0.0, 0.0], [1.0, None, 1.0], [1.0, 2.0], [1.0, -1.0], [1e200, 1.0, 1.0], [1e-170, 1e-170, 1e-170], [float("nan"), 1.0, 1.0], [1e-170, 0.0, 0.0], [5.0, 0.0, 0.0], [-1.0, -1.0, 0.0]]
    vectors = odd + [[rng.uniform(-1, 1) for _ in range(3)] for _ in range(300)]
    e = spark.createDataFrame(list(enumerate(vectors)), "id int, embedding array<double>")
    c = spark.createDataFrame([(x,) for x in concepts], "embedding array<double>")
    monkeypatch.setattr(semantic, "TILE", 40)
    for some in ([3.0, 4.0, 0.0], None):
        few = c if some is None else c.filter(F.col("embedding") == F.array(*map(F.lit, some)))
        for threshold in (0.6, plain([5.0, 0.0, 0.0], [3.0, 4.0, 0.0]), 0.95):
            pairs = e.crossJoin(few.select(F.col("embedding").alias("c"))).groupBy("id").agg(F.max(semantic.cosine("embedding", "c")).alias("m"))
            want = {r.id: r.kept for r in pairs.select("id", F.coalesce(F.col("m") < threshold, F.lit(True)).alias("kept")).collect()}
            got = semantic.drop_near_concepts(e, few, threshold)
            assert {r.id: r.kept for r in got.collect()} == want and set(want.values()) == {True, False}
            assert "aggregate(" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_candidates_are_stored_for_both_uses(spark):
    docs = spark.createDataFrame([(1, "Usa Python."), (2, ""), (3, "nada")], "doc_id long, text string")
    raw = [(1, 1, "Python", [1.0, 0.0]), (1, 2, "Kafka", [0.0, 1.0]), (2, 1, "Kafka", [0.0, 1.0]), (3, 1, "Perl", [0.0, 1.0]), (3, 2, "Cobol", [1.0, 0.1])]
    e = spark.createDataFrame(raw, "doc_id long, pos int, entidad string, embedding array<double>")
    concepts, sentences = (spark.createDataFrame(x, "doc_id long, embedding array<double>") for x in ([(0, [1.0, -1.0])], [(1, [-1.0, 0.0]), (3, [0.1, 1.0])]))
    out = entities.clean_entities(e, docs, concepts=concepts.drop("doc_id"), sentence_vectors=sentences, threshold=0.8)
    assert {r.doc_id: r.entidades for r in out.collect()} == {1: ["Python"], 2: [tx.UNDECLARED], 3: ["Perl"]}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(" not in plan and "ArrowEvalPython" not in plan  # no text is normalised again


def test_latin_letters_are_told_without_a_class_of_them(spark):
    import unicodedata

    texts = ["".join(map(chr, range(0xC0, 0x180))), "Plain", "é" * 5, "ﬁn ñ 漢", "Ĳ ŀ", "×÷ß", None, ""]
    df = spark.createDataFrame([(x,) for x in texts], "x string").select("x", tx._ascii(F.col("x")).alias("y"))
    for r in df.collect():
        assert r.y == unicodedata.normalize("NFKD", r.x or "").encode("ascii", "ignore").decode()
    assert "\\x7FÀ" not in df._jdf.queryExecution().optimizedPlan().toString() and "\x7FÀ" not in df._jdf.queryExecution().optimizedPlan().toString()
