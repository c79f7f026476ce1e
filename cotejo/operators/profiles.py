"""Profiles built from streams of evidence, and the taxonomy they refer to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from cotejo.functions.text import evidence_key
from cotejo.sources.scratch import cut_lineage, exists, stored

#: A further distinct piece of evidence adds a tenth to a weight, here in units of 10^-4.
BONUS, UNIT = 1000, 10_000
ORDER = ("seq", "semana", "texto", "peso")


def _evidence_rows(calls: DataFrame) -> DataFrame:
    """Calls with one piece of evidence a row: ``e`` (null where a call has none), its place and its key.

    A call has ``texto`` (one piece) or ``evidencias`` (a list of texts, structs or maps).
    """
    if "evidencias" not in calls.columns:
        return calls.withColumn("e", F.col("texto")).withColumn("place", F.lit(0)).withColumn("ekey", F.col("texto"))
    kind = calls.schema["evidencias"].dataType
    assert isinstance(kind, ArrayType)
    rows = calls.select("*", F.posexplode_outer("evidencias").alias("place", "e")).drop("evidencias")
    return rows.withColumn("ekey", evidence_key(F.col("e"), kind.elementType))


def teacher_profile(calls: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """Fold upsert calls into one row per teacher and node.

    ``calls`` has docente_id, nodo_id, peso, explicito, recencia, evidence (see
    ``_evidence_rows``) and the columns of ``order``, which tell the calls of a teacher and
    node apart and give their order of arrival. A call sets the weight to the larger of old
    and new plus a tenth for every piece of evidence after the first known so far; the
    first call only sets it. So the result is the largest, over calls j, of weight j plus
    all bonuses from j on; both parts are window sums, and no state is folded row by row.
    All windows and the final aggregation share one shuffle by teacher and node.
    """
    if order is None:
        order = [c for c in ORDER if c in calls.columns]
    key = ["docente_id", "nodo_id"]
    call = Window.partitionBy(*key).orderBy(*order)
    forth = Window.partitionBy(*key).orderBy(*order, "place")
    back = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order], F.desc("place"))
    # an evidence counts from its first arrival on
    first = (F.row_number().over(Window.partitionBy(*key, "ekey").orderBy(*order, "place")) == 1) & F.col("e").isNotNull()
    rows = _evidence_rows(calls).repartition(*key).withColumn("fresh", first)
    rows = rows.withColumn("at", F.row_number().over(forth)).withColumn("call", F.dense_rank().over(call))
    rows = rows.withColumn("known", F.sum(F.col("fresh").cast("long")).over(forth.rowsBetween(Window.unboundedPreceding, 0)))
    ends = F.coalesce(F.lead("call").over(forth) != F.col("call"), F.lit(True))  # the last row of a call
    bonus = F.when(ends & (F.col("call") > 1), BONUS * F.greatest(F.col("known") - 1, F.lit(0))).otherwise(0)
    rows = rows.withColumn("ends", ends).withColumn("bonus", bonus)
    rows = rows.withColumn("later", F.sum("bonus").over(back.rowsBetween(Window.unboundedPreceding, 0)))
    reached = F.when(F.col("ends"), (F.col("peso") * UNIT).cast("long") + F.col("later"))
    seen = F.when(F.col("fresh"), F.struct("at", "e"))
    recent = F.when(F.coalesce("recencia", F.lit("")) != "", F.col("at"))
    versions = [F.max_by("version", "at").alias("version")] if "version" in calls.columns else []
    return rows.groupBy(*key).agg(
        (F.max(reached) / UNIT).cast("decimal(18,4)").alias("peso"),
        F.bool_and("explicito").alias("explicito"),
        F.max_by("recencia", recent).alias("recencia"),
        _in_order(seen).alias("evidencias"),
        *versions,
    )


def _in_order(seen: Column) -> Column:
    """Evidence by its place; places are unique and compared alone, as maps have no order."""
    def by_place(a: Column, b: Column) -> Column:
        return F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0)

    return F.transform(F.array_sort(F.collect_list(seen), by_place), lambda x: x["e"])


def course_profile(calls: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """One row per course and node: largest centrality, sorted weeks, evidence in order of arrival.

    A call has one week (``semana``) or several (``semanas``), and evidence and order as in
    ``teacher_profile``; the window and the aggregation share one shuffle by course and node.
    """
    if order is None:
        order = [c for c in ORDER[:3] if c in calls.columns]
    key = ["curso_id", "nodo_id"]
    weeks = F.array("semana") if "semanas" not in calls.columns else F.coalesce("semanas", F.array().cast(calls.schema["semanas"].dataType))
    rows = _evidence_rows(calls.withColumn("__weeks", weeks))
    first = F.row_number().over(Window.partitionBy(*key, "ekey").orderBy(*order, "place")) == 1
    rows = rows.repartition(*key).withColumn("fresh", first & F.col("e").isNotNull())
    seen = F.when(F.col("fresh"), F.struct(F.struct(*order, "place").alias("at"), "e"))
    return rows.groupBy(*key).agg(
        F.max("peso").alias("peso_centralidad"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("__weeks")))).alias("semanas"),
        _in_order(seen).alias("evidencias"),
    )


def _lists(calls: DataFrame) -> DataFrame:
    """Calls with their evidence as a list."""
    return calls if "evidencias" in calls.columns else calls.withColumn("evidencias", F.array("texto")).drop("texto")


def _ordered(calls: DataFrame, order: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Calls with copies of the columns that order them, and the names of these."""
    given = [c for c in order if c in calls.columns]
    return calls.withColumns({f"__{c}": F.col(c) for c in given}), [f"__{c}" for c in given]


def _resume(stored: DataFrame, base: dict[str, Column], calls: DataFrame, key: list[str], order: list[str], fold) -> DataFrame:
    """Stored rows of the keys that the calls touch become their first calls; the others stay."""
    kinds = dict(calls.dtypes)
    first = [F.lit(None).cast(kinds[c]).alias(c) for c in order]
    keys = calls.select(*key).distinct()
    before = stored.join(keys, key, "left_semi").select(*key, *[c.alias(k) for k, c in base.items()], *first, F.lit(False).alias("__called"))
    now = calls.select(*key, *base, *order, F.lit(True).alias("__called"))
    folded = fold(before.unionByName(now), ("__called", *order))
    return folded.unionByName(stored.join(keys, key, "left_anti").select(*folded.columns))


def resume_teacher_profile(stored: DataFrame, calls: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """Stored profiles with later calls folded in, as ``teacher_profile`` of all calls would have them.

    ``stored`` is a result of either function. A stored row is all that its old calls leave
    behind: as a first call with its weight and its evidence it gives no bonus, and every
    evidence of it is known to those that follow. Rows that no call touches are not folded.
    """
    calls, names = _ordered(calls, ORDER if order is None else order)
    base = {c: F.col(c) for c in ("peso", "explicito", "recencia", "evidencias", *(["version"] if "version" in calls.columns else []))}
    return _resume(stored, base, _lists(calls), ["docente_id", "nodo_id"], names, teacher_profile)


def resume_course_profile(stored: DataFrame, calls: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """Stored profiles of courses with later calls folded in; see ``resume_teacher_profile``."""
    calls, names = _ordered(calls, ORDER[:3] if order is None else order)
    if "semanas" not in calls.columns:
        calls = calls.withColumn("semanas", F.array("semana"))
    base = {"peso": F.col("peso_centralidad"), "semanas": F.col("semanas"), "evidencias": F.col("evidencias")}
    return _resume(stored, base, _lists(calls), ["curso_id", "nodo_id"], names, course_profile)


#: Parts of a stored profile table.
BUCKETS = 64


def fold_stored(calls: DataFrame, path: str, number: int, buckets: int = BUCKETS) -> None:
    """Fold the batch of calls of this number into the teachers' profiles stored at a path.

    The table's partitions are buckets of teachers, and their rows say which batch was folded
    last. Only buckets that the calls touch are read and written, by a dynamic partition
    overwrite; those that have this batch already (a run that failed after them) are left
    alone, so a batch can be repeated. Batches must come in the order of their numbers.
    """
    spark = calls.sparkSession
    bucket = F.pmod(F.xxhash64("docente_id"), F.lit(buckets)).cast("int")
    calls = cut_lineage(calls.withColumn("bucket", bucket))
    todo = {r.bucket for r in calls.select("bucket").distinct().collect()}  # as many numbers as there are buckets
    stored = None
    if exists(spark, path):
        stored = spark.read.parquet(path)
        todo -= {r.bucket for r in stored.filter(F.col("last_batch") >= number).select("bucket").distinct().collect()}
    if not todo:
        return
    wanted = F.col("bucket").isin(sorted(todo))
    new = calls.filter(wanted).drop("bucket")
    folded = teacher_profile(new) if stored is None else resume_teacher_profile(stored.filter(wanted).drop("bucket", "last_batch"), new)
    out = folded.withColumns({"last_batch": F.lit(number).cast("long"), "bucket": bucket})
    writer = out.repartition("bucket", "docente_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("bucket").parquet(path)


def taxonomy_closure(nodes: DataFrame) -> DataFrame:
    """Pairs of a node and an ancestor with their distance (0: itself), at any depth.

    Paths are doubled: the pairs at less than 2^k steps and those at exactly 2^k give the
    pairs at less than 2^(k+1), so a chain of n nodes takes log2(n) rounds, each written and
    read on. A cycle is an error.
    """
    base = cut_lineage(nodes.select("id", "parent_id"))
    near = base.select(F.col("id").alias("descendant"), F.col("id").alias("ancestor"), F.lit(0).alias("distance"))
    ahead = base.join(base.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select(F.col("id").alias("descendant"), F.col("parent_id").alias("ancestor"))
    strays = base.filter("parent_id is not null").join(base.select(F.col("id").alias("parent_id")), "parent_id", "left_anti")
    total, step = base.count(), 1
    while not ahead.isEmpty():
        if step > total:
            raise ValueError("the taxonomy has a cycle")
        via = ahead.select("descendant", F.col("ancestor").alias("via"))
        up = near.select(F.col("descendant").alias("via"), "ancestor", (F.col("distance") + step).alias("distance"))
        near = cut_lineage(near.unionByName(via.join(up, "via").select("descendant", "ancestor", "distance")))
        ahead = cut_lineage(via.join(ahead.select(F.col("descendant").alias("via"), "ancestor"), "via").select("descendant", "ancestor"))
        step *= 2
    # a parent that is no node itself is an ancestor still
    above = strays.select(F.col("id").alias("ancestor"), F.col("parent_id").alias("stray"))
    lost = near.join(above, "ancestor").select("descendant", F.col("stray").alias("ancestor"), (F.col("distance") + 1).alias("distance"))
    return near.unionByName(lost)


#: Rows of a part of ``roll_up``, each of which has a row for each ancestor while the part is reduced.
ROLLED = 1 << 18


def roll_up(calls: DataFrame, nodes: DataFrame, who: str = "docente_id") -> DataFrame:
    """Weights of leaves carried up to all their ancestors: ``who``, ``nodo_id``, ``peso``, ``n``.

    ``calls`` has ``who``, nodo_id, peso and evidence (see ``_evidence_rows``). For a node an
    evidence counts once, with its largest weight, however many nodes below it hold it: ``n``
    is the number of its evidences and ``peso`` their sum. Calls on nodes that the taxonomy
    does not have stay with that node; calls without evidence count as one without a text.

    Evidence is reduced to one row a node (map-side) before it meets the closure. These rows are
    dealt by ``who`` and evidence into parts of some ``ROLLED`` rows, however many there are, and
    meet the closure and are reduced there, so the rows of all ancestors are never shuffled.
    """
    rows = stored(_evidence_rows(calls).groupBy(who, "nodo_id", "ekey").agg(F.max("peso").alias("peso")))
    rows = rows.repartition(rows.count() // ROLLED + 1, who, "ekey")
    above = taxonomy_closure(nodes).select(F.col("descendant").alias("nodo_id"), "ancestor")
    carried = rows.join(above, "nodo_id", "left").withColumn("nodo_id", F.coalesce("ancestor", "nodo_id"))
    once = carried.groupBy(who, "nodo_id", "ekey").agg(F.max("peso").alias("peso"))
    return once.groupBy(who, "nodo_id").agg(F.sum("peso").cast("decimal(38,4)").alias("peso"), F.count(F.lit(1)).alias("n"))


#: A node of a taxonomy file; its children stay JSON until their level is reached.
NODE = "struct<id:string,name:string,type:string,aliases:array<string>,domain:string,children:string>"


def flatten_taxonomy(roots: DataFrame, column: str = "roots") -> DataFrame:
    """Rows id, parent_id, name, node_type, aliases, domain from nested nodes (JSON), of any depth.

    ``visit`` orders the rows as a walk through the tree meets them. One level is parsed a
    round; levels are written and read on, so a deep file is not parsed anew for each.
    """
    level = roots.select(F.col(column).alias("children"), F.lit(None).cast("string").alias("parent_id"), F.array().cast("array<int>").alias("visit"))
    out = None
    while True:
        nodes = level.select("parent_id", "visit", F.posexplode(F.from_json("children", f"array<{NODE}>")).alias("at", "n"))
        level = cut_lineage(nodes.select("parent_id", F.concat("visit", F.array("at")).alias("visit"), "n"))
        rows = level.select(
            "n.id", "parent_id", "n.name", F.coalesce("n.type", F.lit("leaf")).alias("node_type"),
            F.coalesce("n.aliases", F.array().cast("array<string>")).alias("aliases"), "n.domain", "visit",
        )
        out = rows if out is None else out.unionByName(rows)
        level = level.filter("n.children is not null").select("n.children", F.col("n.id").alias("parent_id"), "visit")
        if level.isEmpty():
            return out
