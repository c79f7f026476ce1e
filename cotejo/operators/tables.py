"""Maintenance of the stored tables, and figures over them.

Every change is a function from the old rows to the new ones, for whole batches of calls:
write the result to a new path and swap. Aggregations combine map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cotejo.sources.scratch import cut_lineage

DEFAULT_OWNER = "default@example.org"


def append(old: DataFrame, new: DataFrame, owner: str = DEFAULT_OWNER) -> DataFrame:
    """Old and new rows; new ones without an owner get the default."""
    return old.unionByName(new.withColumn("propietario_email", F.coalesce("propietario_email", F.lit(owner))).select(*old.columns))


def upsert_history(calls: DataFrame, old: DataFrame | None = None, per_owner: bool = False) -> DataFrame:
    """Per teacher and course the period of the last call (ties: the larger).

    Calls (and old rows) with a ``propietario_email`` keep the owner of the first insert, an
    old row's before any call's; with ``per_owner`` the owner is part of the key instead.
    """
    owned = "propietario_email" in calls.columns
    key = ["nombre_docente", "nombre_curso"] + (["propietario_email"] if per_owner else [])
    columns = ["nombre_docente", "nombre_curso", "periodo", *(["propietario_email"] if owned else [])]
    rows = calls.select(*columns, F.col("seq"), F.lit(True).alias("called"))
    if old is not None:
        before = old.withColumnRenamed("ultima_vez", "periodo").select(*columns, F.lit(0).cast(calls.schema["seq"].dataType).alias("seq"), F.lit(False).alias("called"))
        rows = before.unionByName(rows)
    last = [F.max(F.struct("called", "seq", "periodo")).alias("x")]
    if owned and not per_owner:
        last.append(F.min(F.struct("called", "seq", "propietario_email")).alias("y"))
    owner = [] if not owned else ["propietario_email"] if per_owner else ["y.propietario_email"]
    return rows.groupBy(*key).agg(*last).select("nombre_docente", "nombre_curso", F.col("x.periodo").alias("ultima_vez"), *owner)


def upsert(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """New rows replace old ones of the same key; others are added; none is removed.

    Columns in ``keep`` stay as they were. Of repeated new keys the last by the column
    ``order`` wins (ties, or without an order: the greatest row).
    """
    others = [c for c in old.columns if c != key]
    rank = [F.col(order).alias("__order")] if order else []
    fresh = new.groupBy(key).agg(F.max(F.struct(*rank, *others)).alias("n"))
    joined = old.withColumn("__old", F.lit(True)).join(fresh, key, "full")

    def value(c: str) -> Column:
        stays = F.col("n").isNull() | (F.lit(c in keep) & F.col("__old").isNotNull())
        return F.when(stays, F.col(c)).otherwise(F.col("n")[c]).alias(c)

    return joined.select(key, *[value(c) for c in others])


def patch(df: DataFrame, changes: DataFrame, key: str, now: Column | None = None, given: str | None = None) -> DataFrame:
    """Set columns by ``changes`` (unique keys); unknown keys do nothing.

    A row sets its non-null columns. Where ``given`` names a column of ``changes`` with the
    names of the columns that a row sets, it sets just these, to null too; a null list sets
    none, and the key is never set.
    """
    fields = [c for c in changes.columns if c not in (key, given)]
    names = F.lit(None) if given is None else F.coalesce(given, F.array().cast("array<string>"))
    c = changes.select(F.col(key), F.struct(*fields).alias("__c"), names.alias("__given"))
    joined = df.join(c, key, "left")

    def value(f: str) -> Column:
        if given is None:
            return F.coalesce(F.col("__c")[f], F.col(f))
        return F.when(F.array_contains("__given", f), F.col("__c")[f]).otherwise(F.col(f))

    set_ = {f: value(f) for f in fields}
    if now is not None:
        set_["updated_at"] = F.when(F.col("__c").isNotNull(), now).otherwise(F.col("updated_at"))
    return joined.select(*[set_[x].alias(x) if x in set_ else F.col(x) for x in df.columns])


def invalidate(rankings: DataFrame, courses: DataFrame) -> DataFrame:
    """Rankings of the given courses (curso_id) are no longer valid."""
    hit = courses.select("curso_id").distinct().withColumn("__hit", F.lit(True))
    return rankings.join(hit, "curso_id", "left").withColumn("is_valid", F.col("__hit").isNull() & F.col("is_valid")).select(*rankings.columns)


def replace_cache(cache: DataFrame, fresh: DataFrame, key: str = "curso_id") -> DataFrame:
    """All old rows of the fresh rows' courses go, the fresh ones come; a missing score is 0."""
    rest = cache.join(fresh.select(key).distinct(), key, "left_anti").select(*cache.columns)
    return rest.unionByName(fresh.withColumn("score_combinado", F.coalesce("score_combinado", F.lit(0.0))).select(*cache.columns))


#: Parts of a stored cache; a course lies in one of them.
BUCKETS = 64


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")


def store_cache(cache: DataFrame, path: str, key: str = "curso_id", buckets: int = BUCKETS) -> None:
    """Write a cache as a table whose partitions are buckets of courses."""
    parts = cache.select("*", _bucket(key, buckets)).repartition("bucket", key)  # a course with very many rows is one task's, not a bucket
    parts.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(path)


def replace_stored(spark: SparkSession, path: str, fresh: DataFrame, key: str = "curso_id", buckets: int = BUCKETS) -> int:
    """``replace_cache`` on a stored table; the number of partitions that were rewritten.

    Only partitions that hold a course of the fresh rows are read and written, by a dynamic
    partition overwrite: files are written aside and put in place when all tasks are done, so
    a job that fails before leaves the old rows. The fresh rows are written down first, as
    they may come from the table itself. Several writers of one table are not kept apart.
    """
    fresh = cut_lineage(fresh)
    old = spark.read.parquet(path)
    touched = [r.bucket for r in fresh.select(_bucket(key, buckets)).distinct().collect()]  # BUCKETS numbers at most
    if touched:
        columns = [c for c in old.columns if c != "bucket"]
        rows = replace_cache(old.filter(F.col("bucket").isin(touched)).select(*columns), fresh, key)
        parts = rows.select("*", _bucket(key, buckets)).repartition("bucket", key)
        parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return len(touched)


def purge_stored(spark: SparkSession, path: str, gone: DataFrame, by: str = "docente_id", key: str = "curso_id", buckets: int = BUCKETS) -> int:
    """Remove the rows of a stored cache whose column ``by`` is among the given ones (column ``by``);
    the number of partitions that were rewritten. Doing so again changes nothing."""
    gone = cut_lineage(gone.select(by).distinct())
    old = spark.read.parquet(path)
    touched = [r.bucket for r in old.select("bucket", by).join(gone, by, "left_semi").select("bucket").distinct().collect()]
    if touched:
        part = old.filter(F.col("bucket").isin(touched))
        rest = purge(part, gone, by)
        emptied = part.select("bucket").distinct().join(rest.select("bucket").distinct(), "bucket", "left_anti").collect()
        columns = [c for c in old.columns if c != "bucket"]
        writer = rest.select(*columns, "bucket").repartition("bucket", key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("bucket").parquet(path)
        for r in emptied:  # an overwrite does not touch partitions without rows
            place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={r.bucket}")
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return len(touched)


def purge(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not among the keys."""
    return df.join(keys.select(key), key, "left_anti").select(*df.columns)


def latest(logs: DataFrame, key: str = "drive_file_id", at: str = "timestamp") -> DataFrame:
    """The newest log row of each file; a missing time counts as newest, ties go to the larger id.

    The maximum is aggregated map-side, so a file with very many rows is no hot spot.
    """
    newest = F.max(F.struct(F.col(at).isNull().alias("none"), F.col(at).alias("at"), F.col("id").alias("id")))
    ids = logs.groupBy(key).agg(newest.alias("x")).select(F.col("x.id").alias("id"))
    return logs.join(ids, "id", "left_semi")


def update_latest_status(logs: DataFrame, status: DataFrame, key: str = "drive_file_id") -> DataFrame:
    """Set ``status`` (key, status; unique keys) on the newest log row of each file."""
    changes = latest(logs, key).select("id", key).join(status, key).select("id", "status")
    return patch(logs, changes, "id")


def add_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pairs, each once."""
    return old.unionByName(new).distinct()


def remove_pairs(old: DataFrame, gone: DataFrame) -> DataFrame:
    return old.join(gone, old.columns, "left_anti")


def visible_workspaces(sharing: DataFrame, users: DataFrame) -> DataFrame:
    """``email``, ``workspace``: each user's own, and those of the owners who invited them."""
    own = users.select("email", F.col("email").alias("workspace"))
    shared = sharing.join(users, sharing["invitado_email"] == users["email"]).select("email", F.col("propietario_email").alias("workspace"))
    return own.union(shared).distinct()


def cache_stats(cache: DataFrame) -> DataFrame:
    """Rows, courses, oldest and newest of the cache, in one pass."""
    return cache.agg(
        F.count(F.lit(1)).alias("total"), F.count_distinct("curso_id").alias("cursos"),
        F.min("fecha_generada").alias("oldest"), F.max("fecha_generada").alias("newest"),
    )


def is_active(now: Column, minutes: int = 15) -> Column:
    """A log row that waits, or has been processed for less than the limit."""
    recent = F.col("updated_at") >= now - F.expr(f"interval {minutes} minutes")
    return F.coalesce((F.col("status") == "received") | ((F.col("status") == "processing") & recent), F.lit(False))


def active_processing(logs: DataFrame, now: Column, minutes: int = 15) -> DataFrame:
    return logs.agg(F.count_if(is_active(now, minutes)).alias("active"))


def system_status(logs: DataFrame, now: Column, minutes: int = 15) -> DataFrame:
    """Is anything being processed, and how much is pending?"""
    n = active_processing(logs, now, minutes)
    return n.select((F.col("active") > 0).alias("is_processing"), F.col("active").alias("pending_count"))


def distinct_cycles(courses: DataFrame) -> DataFrame:
    return courses.select("ciclo").distinct().orderBy(F.asc_nulls_last("ciclo"))


def cycle_of(courses: DataFrame) -> DataFrame:
    """Adds ``grupo``: the cycle of a course, where a missing one or 0 is 1."""
    return courses.withColumn("grupo", F.coalesce(F.nullif(F.col("ciclo"), F.lit(0)), F.lit(1)))


def courses_by_cycle(courses: DataFrame) -> DataFrame:
    """One row per course, in the order of its group: ``grupo``, ``n`` (courses of the group), ``id``.

    Groups are counted map-side and joined back, so a cycle of very many courses is no single row.
    """
    grouped = cycle_of(courses).select("grupo", "id")
    sizes = grouped.groupBy("grupo").agg(F.count(F.lit(1)).alias("n"))
    return grouped.join(sizes, "grupo").select("grupo", "n", "id").orderBy("grupo", "id")


def course_lists(courses: DataFrame) -> DataFrame:
    """The groups as the list of a page shows them: ``ciclo``, ``n`` and all sorted ids."""
    return cycle_of(courses).groupBy(F.col("grupo").alias("ciclo")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("id")).alias("ids"))


def erase(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str = "id") -> dict[str, DataFrame]:
    """Each table (with the column that names the entity) without the rows of the erased ones."""
    return {
        name: df.join(gone.select(F.col(key).alias(column)), column, "left_anti").select(*df.columns) for name, (df, column) in tables.items()
    }


def valid_top_n(rankings: DataFrame, n: int = 10) -> DataFrame:
    """The n best valid stored rows of every course."""
    window = Window.partitionBy("curso_id").orderBy(F.desc_nulls_last("score"), F.asc("id"))
    return rankings.filter("is_valid").withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= n)
