"""The view of raw entities is cut from each text once."""

from pyspark.sql import functions as F

from cotejo.sources.fixtures import VIEWS, raw_entities


def test_same_rows_as_the_view_in_one_scan(spark, folder):
    odd = [(-1, "a"), (-2, ""), (-3, None), (-4, " " * 40), (-5, "x  y " * 9), (None, "a b c"), (9, " ".join("w" * (i % 3) for i in range(34))), (10, "\n".join("abc") + " é")]
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    want, got = spark.sql(VIEWS["entidades_crudas"], documents=docs), raw_entities(docs)
    assert got.dtypes == want.dtypes
    key = [F.col(c) for c in ("doc_id", "pos", "entidad")]
    assert sorted(map(str, got.select(*key).collect())) == sorted(map(str, want.select(*key).collect()))
    assert raw_entities(spark.read.parquet(f"{folder}/documents.parquet"))._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
