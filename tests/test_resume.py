"""Profiles that are folded on from stored rows, in batches and in a stream."""

import random

import pytest
from pyspark.sql import functions as F

from cotejo.operators import profiles, tables
from cotejo.streaming import feeds

CALLS = "docente_id long, nodo_id string, seq long, semana int, texto string, explicito boolean, recencia string, w int"


def some_calls(spark, n=240, seed=3):
    rng = random.Random(seed)
    rows = [
        (rng.randrange(6), rng.choice("ab"), i, rng.randrange(3), rng.choice(["x", "y", "z", "ñ", None]), rng.random() < 0.8, rng.choice([None, "", "2024", "2025"]), rng.randrange(1, 9))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, CALLS).withColumn("peso", F.col("w").cast("decimal(18,4)")).drop("w")


def plain(df, key):
    return {(r[key], r.nodo_id): tuple(tuple(v) if isinstance(v, list) else v for k, v in sorted(r.asDict(recursive=True).items())) for r in df.drop("last_batch", "bucket").collect()}


def test_parts_equal_the_whole(spark):
    calls = some_calls(spark)
    whole = plain(profiles.teacher_profile(calls), "docente_id")
    stored = profiles.teacher_profile(calls.filter("seq < 30"))
    for lo, hi in ((30, 31), (31, 170), (170, 240)):
        stored = profiles.resume_teacher_profile(stored, calls.filter(F.col("seq").between(lo, hi - 1)))
    assert plain(stored, "docente_id") == whole
    assert plain(profiles.resume_teacher_profile(stored, calls.limit(0)), "docente_id") == whole
    assert plain(profiles.resume_teacher_profile(stored.limit(0), calls), "docente_id") == whole


def test_parts_of_courses_and_of_lists(spark):
    calls = some_calls(spark).withColumnRenamed("docente_id", "curso_id")
    whole = plain(profiles.course_profile(calls), "curso_id")
    stored = profiles.course_profile(calls.filter("seq < 100"))
    assert plain(profiles.resume_course_profile(stored, calls.filter("seq >= 100")), "curso_id") == whole
    maps = some_calls(spark).withColumn("evidencias", F.array(F.create_map(F.lit("t"), "texto"), F.create_map(F.lit("w"), F.col("semana").cast("string")))).drop("texto")
    stored = profiles.teacher_profile(maps.filter("seq < 100"))
    got = profiles.resume_teacher_profile(stored, maps.filter("seq >= 100"))

    def rows(df):
        return sorted((r.docente_id, r.nodo_id, r.peso, r.explicito, r.recencia, str(r.evidencias)) for r in df.collect())

    assert rows(got) == rows(profiles.teacher_profile(maps))


def test_a_restart_between_the_writes_changes_nothing(spark, tmp_path, monkeypatch):
    calls = some_calls(spark)
    folder, table, cache = (str(tmp_path / x) for x in ("in", "profiles", "cache"))
    for k in range(3):
        calls.filter(F.floor(F.col("seq") / 80) == k).coalesce(1).write.mode("append").parquet(folder)
    old = spark.createDataFrame([(c, d, 1.0) for c in range(20) for d in range(4, 9)], "curso_id long, docente_id long, score_combinado double")
    touched = [r.docente_id for r in calls.select("docente_id").distinct().collect()]
    tables.store_cache(old, cache)

    def run():
        stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        query = feeds.keep_profiles(stream, table, cache).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()

    real, left = feeds.purge_stored, [1, 3]

    def fails(*args):
        left[1] -= 1
        if left[1] == 1 and left[0]:
            left[0] = 0
            raise RuntimeError("lost between the two writes")
        return real(*args)

    monkeypatch.setattr(feeds, "purge_stored", fails)
    with pytest.raises(Exception, match="lost between"):
        run()
    run()
    assert plain(spark.read.parquet(table), "docente_id") == plain(profiles.teacher_profile(calls), "docente_id")
    want = sorted((c, d) for c in range(20) for d in range(4, 9) if d not in touched)
    assert sorted((r.curso_id, r.docente_id) for r in spark.read.parquet(cache).collect()) == want


def test_batches_can_be_repeated_and_buckets_stay(spark, tmp_path):
    path = str(tmp_path / "p")
    calls = some_calls(spark)
    profiles.fold_stored(calls.filter("seq < 100"), path, 0)
    profiles.fold_stored(calls.filter("seq < 100"), path, 0)
    half = calls.filter("seq >= 100")
    profiles.fold_stored(half.filter("docente_id < 3"), path, 1)  # as if it had failed half way
    profiles.fold_stored(half, path, 1)
    profiles.fold_stored(half.limit(0), path, 2)
    assert plain(spark.read.parquet(path), "docente_id") == plain(profiles.teacher_profile(calls), "docente_id")


def test_purge_of_a_stored_cache(spark, tmp_path):
    path = str(tmp_path / "c")
    tables.store_cache(spark.createDataFrame([(c, c % 5, 1.0) for c in range(40)], "curso_id long, docente_id long, score_combinado double"), path)
    gone = spark.createDataFrame([(0,), (1,), (2,), (3,)], "docente_id long")
    assert tables.purge_stored(spark, path, gone) > 0 and tables.purge_stored(spark, path, gone) == 0
    assert sorted(r.curso_id for r in spark.read.parquet(path).collect()) == list(range(4, 40, 5))
