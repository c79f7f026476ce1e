"""Repeated ids, clashing labels, bounded caches, odd characters, agreement and held-out figures."""

import os
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cotejo.llm import ann, common, packing, pieces, quality, queries, secrets, tokencount, toxicity
from cotejo.llm.common import read_table, show_code

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars int"


def test_repeated_ids_have_each_neighbour_once(spark):
    show_code(spark)
    rows = [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [1.0, 0.5]), (2, [0.0, 1.0]), (3, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["rank"], r.vec_id) for r in ann.nearest(df, F.col("id") % 50 == 0).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2), (3, 3)]
    score = {r.vec_id: r.score for r in ann.nearest(df, F.col("id") % 50 == 0).collect()}
    assert score[2] == 0.0  # of the two rows the smaller vector


def test_sample_is_the_same_however_rows_are_dealt(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c"), (4, "d"), (5, "e"), (6, "e"), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (3, 0), (4, 1), (4, 1), (5, 0), (6, 1), (None, 1), (7, 2)], "doc_id long, toxic int")
    want = None
    for parts in (1, 3, 5):
        sample = toxicity.training_sample(docs.repartition(parts), labels.repartition(parts), F.lit(True))
        got = list(zip(sample["text"], sample["toxic"]))
        want = want or got
        assert got == want and sorted(got) == [("a b", 0), ("d", 1)]


def test_null_ids_are_held_out(spark):
    df = spark.createDataFrame([(None,), (1,)], "doc_id long")
    assert [r[0] for r in df.select(queries.held_out(F.col("doc_id"))).collect()] == [True, zlib.crc32(b"1") % 5 == 0]


def test_toxicity_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    if not os.path.exists(folder):
        pytest.skip("needs the tables of that size")
    scored = queries.op10_toxicity(spark, folder).filter("held_out").join(read_table(spark, folder, "labels").select("doc_id", "toxic"), "doc_id")
    rows = scored.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("predicted") == F.col("toxic")).cast("int")).alias("right")).collect()
    right = {r.toxic: r.right for r in rows}
    assert right[1] >= 0.75 and right[0] >= 0.98, rows  # measured: 0.825 and 0.997


def test_caches_are_bounded_in_letters(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefg .") for _ in range(3000)) + "x" * rng.randrange(2000) for _ in range(12)]
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = packing.RunEncoder(path).encode(pa.array(texts))[0].tolist()
    monkeypatch.setattr(packing, "LETTERS", 5000)
    small = packing.RunEncoder(path)
    parts = [small.encode(pa.array([t]))[0].tolist() for t in texts]
    assert sum(parts, []) == whole and small.letters < 10_000
    model = public_tokenizers.path("piece_bpe_32k.model")
    want = [pieces.Segmenter(model, 3).segment(t)[1] for t in texts[:3]]
    monkeypatch.setattr(pieces, "MAX_LETTERS", 2000)
    s = pieces.Segmenter(model, 3)
    assert [s.segment(t)[1] for t in texts[:3]] == want and s.letters < 8000
    counter = tokencount.TokenCounter(public_tokenizers.path("byte_bpe_50k.json"))
    n = counter.count(["ab" * 2500 + " b"])[0]
    assert all(len(w) <= tokencount.LONGEST for w in counter.words.words)
    monkeypatch.setattr(tokencount, "MAX_STATES", 50)
    assert tokencount.TokenCounter(public_tokenizers.path("byte_bpe_50k.json")).count(["ab" * 2500 + " b"])[0] == n


def test_the_space_mark_itself_survives(spark):
    show_code(spark)
    model = public_tokenizers.path("piece_bpe_32k.model")
    texts = ["a▁b", "▁", "▁▁ a", " ▁x\n", "é🙂▁"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = pieces.segment(df, model).select("row.text", pieces.decoder(model)("ids").alias("back")).collect()
    assert all(r.text == r.back for r in rows)


def test_agreement_with_the_library(spark, folder):
    """The objective is another one: about as many pieces, seldom the same."""
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    library, ours = sentencepiece.SentencePieceProcessor(model_file=model), pieces.Segmenter(model, 1)
    texts = [r.text or "" for r in read_table(spark, folder, "documents").select("text").collect()]
    same = total = theirs = 0
    for t in texts:
        a, b = ours.segment(t)[0].tolist(), library.encode(t)
        same, total, theirs = same + (a == b), total + len(a), theirs + len(b)
    assert same < len(texts) // 2 and 1 <= total / theirs < 1.05


def test_the_files_own_scores(spark):
    """Scores are sums of the file's; the texts come back; another name of scores is an error."""
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = ["the cat sat on the mat", "  ab\n cd", "ñandú", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = pieces.segment(df, model, scores="file").select("row.text", "ids", "scores", pieces.decoder(model)("ids").alias("back")).collect()
    assert [r.back for r in rows] == [t or "" for t in texts]
    for r in rows:
        if not any(library.is_byte(i) for i in r.ids):
            assert r.scores[0] == round(1e6 * sum(x for x in map(library.get_score, r.ids) if x > -1e8))
    with pytest.raises(ValueError):
        pieces.Lattice(model, "own")


def test_n_best_of_long_units_are_held_within_a_bound(monkeypatch):
    model = public_tokenizers.path("piece_bpe_32k.model")
    units = [f"{i}".rjust(30, "x") for i in range(60)]
    want = [pieces.Segmenter(model, 3).segment(u)[1] for u in units[:2]]
    monkeypatch.setattr(pieces, "MAX_LETTERS", 500)
    s = pieces.Segmenter(model, 3)
    assert [s.segment(u)[1] for u in units[:2]] == want
    for u in units:
        s.segment(u)
        assert s.held <= 500 and s.held == sum(len(k) + sum(len(i) for _, i in v) for k, v in s.options.items())


def test_a_bad_host_is_refused_and_a_raised_rate_is_not(spark):
    good = " ".join(f"word{i}" for i in range(30))
    rows = [(i, good if i // 40 % 20 else "short", "en", f"h{i % 40}", 1) for i in range(4000)]
    rows += [(5000 + i, good if i % 2 else "short", "en", "bad", 1) for i in range(60)]  # half of them fail
    rows += [(6000 + i, good if i % 14 else "short", "en", "hot", 1) for i in range(3000)]  # 7 against 5 in 100
    rows += [(9000, "short", "en", "tiny", 1), (9001, good, "en", "tiny", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    hosts = quality.judge_hosts(quality.measure(docs))
    assert [r.host for r in hosts.filter("refused").collect()] == ["bad"]
    kept = quality.keep_good(docs).groupBy("source").count().collect()
    assert {r.source for r in kept} == {f"h{i}" for i in range(40)} | {"hot", "tiny"}


def test_stages_at_the_edges(spark, folder):
    """Nulls in any column, repeats, no rows, and columns of other names in every stage but the last."""
    show_code(spark)
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words, "en", "s", 9), (1, words, "en", "s", 9), (2, None, None, None, None), (None, words, None, "s", 3), (None, None, None, None, None), (3, "user: ab token=x1 " + words, "en", "s", 1), (4, words, "en", None, 2), (5, "", "en", "s", 0)]
    odd = spark.createDataFrame([(*r, "clash", 7, True) for r in rows], DOCUMENTS + ", row string, key int, kept boolean")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, folder)
        assert out.columns == odd.columns, name
        found = sorted(((r.doc_id is None, r.doc_id, r.text or "") for r in out.collect()), key=str)
        if name == "quality_rules":
            assert {x[2] for x in found} == {words, "user: ab token=x1 " + words} and len(found) == 5
        if name == "simhash_near_dedup":
            assert found == sorted([(False, 1, words), (False, 2, "")], key=str)  # 56 of 59 shingles are shared
        if name == "secret_scans":
            assert len(found) == 8 and (False, 3, "[SECRET] [SECRET] " + words) in found
        assert stage(spark, odd.limit(0), folder).count() == 0, name
    assert secrets.redact(odd.limit(0)).count() == 0


def test_tables_are_deleted(spark, folder):
    first = common.tables_written()
    assert corpus_pipeline.run(spark, folder).count() > 0
    left = [x for x in common._written[first:] if x]
    assert len(left) == 2  # the last stage's input and its own table
    common.drop_tables(spark, first, common.tables_written())
    assert not any(os.path.exists(x.removeprefix("file:")) for x in left) and np.all([x == "" for x in common._written[first:]])


def test_cosines_of_very_large_and_very_small_vectors(spark):
    show_code(spark)
    for far in (1e200, 1e-170, 5e-324, 1e308):
        rows = [(50, [far, far]), (1, [far, 0.0]), (2, [1.0, -1.0]), (3, [1.0, 1.0]), (4, [-far, -far]), (5, [far, far])]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        found = ann.nearest(df, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect()
        got = sorted(((r.vec_id, round(r.score, 9)) for r in found), key=lambda x: (-x[1], x[0]))
        assert [r["rank"] for r in found] == [1, 2, 3, 4, 5]
        assert got == [(3, 1.0), (5, 1.0), (1, round(0.5**0.5, 9)), (2, 0.0), (4, -1.0)], far


def test_hosts_of_which_many_are_bad(spark):
    """One host, two hosts, and mostly bad hosts: the bad ones are refused, the others are not."""
    good = " ".join(f"word{i}" for i in range(30))

    def refused(hosts):
        rows = [(k, good if i >= bad else "short", "en", h, 1) for k, (h, n, bad) in enumerate(hosts) for i in range(n)]
        return sorted(r.host for r in quality.judge_hosts(quality.measure(spark.createDataFrame(rows, DOCUMENTS))).filter("refused").collect())

    assert refused([("a", 500, 500), ("b", 500, 0)]) == ["a"]
    assert refused([("a", 500, 500), ("b", 500, 25)]) == ["a"]
    assert refused([(f"bad{i}", 300, 300) for i in range(5)] + [(f"ok{i}", 300, 3) for i in range(5)]) == [f"bad{i}" for i in range(5)]
    assert refused([("only", 300, 90)]) == [] and refused([("only", 300, 290)]) == ["only"]
    assert refused([("a", 400, 4), ("b", 400, 5)]) == []
    assert refused([("a", 10_000, 100), ("b", 400, 0), ("c", 400, 0)]) == []
    assert refused([("a", 200, 100)] + [(f"ok{i}", 100, 5) for i in range(9)]) == ["a"]
