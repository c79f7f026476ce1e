"""Course profiles take one shuffle, and calls that are folded in parts are computed once."""

from pyspark.sql import functions as F

from cotejo import queries
from cotejo.operators import profiles
from test_resume import plain, some_calls


def test_a_course_profile_is_shuffled_once(spark):
    calls = some_calls(spark).withColumnRenamed("docente_id", "curso_id")
    plan = profiles.course_profile(calls)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_parts_read_the_calls_from_a_table(spark):
    calls = some_calls(spark).withColumnRenamed("docente_id", "curso_id")
    out = queries.in_parts(calls, profiles.course_profile, profiles.resume_course_profile)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "parquet" in plan and "ExistingRDD" not in plan and "LocalTableScan" not in plan
    assert plain(out, "curso_id") == plain(profiles.course_profile(calls), "curso_id")
    assert queries.in_parts(calls.filter(F.lit(False)), profiles.course_profile, profiles.resume_course_profile).count() == 0
