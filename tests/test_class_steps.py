"""Steps on the way to classes of profiles: what is shuffled, and into how many parts."""

from pyspark.sql import functions as F

from cotejo.operators import matching
from cotejo.sources import fixtures
from tests.test_block_ranking import frames, topics
from tests.test_classes import copied


def shuffles(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]


def test_evidence_is_grouped_after_one_shuffle_in_counted_parts(spark, monkeypatch):
    rows = [(1, "a", 1), (1, "a", 1), (1, "a", 2), (1, "b", None), (2, None, 3), (None, "a", 4), (None, "a", 5), (2, "a", -70), (2, "a", 1 << 20)]
    evidence = spark.createDataFrame(rows, "curso_id long, nodo_id string, semana int")
    evidence = evidence.selectExpr("*", "curso_id AS docente_id", "semana > 1 AS explicito", "CAST(semana AS STRING) AS recencia")
    monkeypatch.setattr(fixtures, "PART", 1)
    for name, key in fixtures.GROUPED.items():
        out = spark.sql(fixtures.VIEWS[name], evidencias=fixtures.deal(evidence, key, 7))
        assert len(shuffles(out)) == 1 and "nodo_id#" in shuffles(out)[0] and ", 7)" in shuffles(out)[0]
        want = spark.sql(fixtures.VIEWS[name], evidencias=evidence)
        assert out.dtypes == want.dtypes and sorted(map(str, out.collect())) == sorted(map(str, want.collect()))


def test_views_of_profiles_have_more_parts_where_there_are_more_lines(spark, folder, monkeypatch):
    t = fixtures.Tables(spark, folder)
    monkeypatch.setattr(fixtures, "PART", 500)
    lines = t.lineitem.count()
    for view in (t.docente_nodos, t.curso_nodos):
        assert len(shuffles(view)) == len(shuffles(t.evidencias)) + 1
        assert f", {-(-lines // 500)})" in shuffles(view)[0] and lines > 2500


def test_whole_profiles_are_not_shuffled_for_few_classes(spark, monkeypatch):
    teachers, courses = topics(5, 6, 40, 6)
    t, _ = frames(spark, copied(teachers, 7), courses)
    plans, keep = [], matching.stored
    monkeypatch.setattr(matching, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = matching.teacher_classes(t)
        assert "BroadcastHashJoin" in plans[-1]
        monkeypatch.setattr(matching, "REPS", 0)
        many = matching.teacher_classes(t)
        assert "SortMergeJoin" in plans[-1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for x in ("members", "lists"):
        assert sorted(map(str, getattr(few, x).collect())) == sorted(map(str, getattr(many, x).collect()))
    assert few.lists.count() < few.members.agg(F.count(F.lit(1))).first()[0]
