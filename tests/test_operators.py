"""Golden cases and property checks of the core operators."""

import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from cotejo.functions import text as tx
from cotejo.operators import entities, filters, matching, names, profiles, semantic, tables
from cotejo.sources import files
from cotejo.streaming import feeds


def values(df, column, order=None):
    rows = df.orderBy(order) if order else df
    return [r[0] for r in rows.select(column).collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_text_functions(spark):
    assert one(spark, tx.normalize_text(F.lit("  Ingeniería\tDE  Datos ñ漢"))) == "ingenieria de datos n"
    assert one(spark, tx.normalize_text(F.lit(None).cast("string"))) == ""
    again = tx.normalize_text(tx.normalize_text(F.lit(" É  x ")))
    assert one(spark, again) == "e x"
    assert one(spark, tx.strip_tag(F.lit("Big (Inferido) Data (inferido)"))) == "BigData"
    for bad in ("IA", "r", "", "  ", "Maestria en Redes", "Universidad de Lima", "Profesor de Redes", "Derecho"):
        assert one(spark, tx.is_invalid_entity(F.lit(bad))) is True, bad
    for good in ("Python", "Bases de datos", "Docker"):
        assert one(spark, tx.is_invalid_entity(F.lit(good))) is False, good
    assert one(spark, tx.report_slug(F.lit(None).cast("string"))) == "curso"
    assert one(spark, tx.round2(F.lit(2.345678))) == 2.35


def test_text_support(spark):
    text = F.lit("bases de datos con python")
    assert one(spark, tx.appears_in_text(F.lit("Datos en Bases"), text)) is True
    assert one(spark, tx.appears_in_text(F.lit("c++"), text)) is False
    assert one(spark, tx.appears_in_text(F.lit(""), text)) is False
    assert one(spark, tx.appears_in_text(F.lit("x"), F.lit(""))) is False


def test_workspaces_none_is_not_empty(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, propietario_email string")
    assert filters.in_workspaces(df, None).count() == 3
    assert filters.in_workspaces(df, []).count() == 0
    assert values(filters.in_workspaces(df, ["b"]), "id") == [2]
    assert values(filters.in_workspaces(df, spark.createDataFrame([("a",)], "w string")), "id") == [1]


def test_fresh_includes_the_limit(spark):
    day = datetime.datetime
    df = spark.createDataFrame([(1, day(2024, 1, 1)), (2, day(2024, 1, 2)), (3, day(2024, 1, 8))], "id int, fecha_generada timestamp_ntz")
    now = F.lit(day(2024, 1, 9)).cast("timestamp_ntz")
    assert sorted(values(filters.fresh(df, now), "id")) == [2, 3]
    assert filters.fresh(df, now, None).count() == 3


def test_cache_hit_needs_all_rows_current(spark):
    rows = [(1, matching.CACHE_VERSION)] * 3 + [(2, matching.CACHE_VERSION)] * 3 + [(2, "old"), (3, matching.CACHE_VERSION)]
    hits = matching.cache_hits(spark.createDataFrame(rows, "curso_id int, version_algoritmo string"), 2)
    assert {r.curso_id: r.hit for r in hits.collect()} == {1: True, 2: False, 3: False}


def test_ranking_by_hand(spark):
    t = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0), (2, "a", 1.0), (3, "z", 9.0)], "docente_id long, nodo_id string, p double")
    c = spark.createDataFrame([(7, "a", 3.0), (7, "b", 1.0)], "curso_id long, nodo_id string, p double")
    t = t.withColumn("peso", F.col("p").cast("decimal(18,4)")).drop("p")
    c = c.withColumn("peso_centralidad", F.col("p").cast("decimal(18,4)")).drop("p")
    got = [(r.docente_id, r.score, r["rank"], r.score_relativo) for r in matching.rank(t, c).orderBy("rank").collect()]
    assert got == [(1, 100.0, 1, 100.0), (2, 37.5, 2, 37.5)]
    assert values(matching.gaps(matching.rank(t, c), t, c), "nodo_id") == ["b"]


def test_top_factors_by_absolute_value(spark):
    m = F.create_map(*[F.lit(x) for kv in {"a": 1.0, "b": -5.0, "c": 2.0, "d": 0.0}.items() for x in kv])
    assert [x.key for x in one(spark, matching.top_factors(m, 3))] == ["b", "c", "a"]
    assert one(spark, matching.top_factors(F.lit(None).cast("map<string,double>"))) == []


def fold(calls):
    """The sequential definition of a teacher profile."""
    out = {}
    for doc, node, _, _, text, peso, explicit, recent in sorted(calls, key=lambda c: (c[2], c[3], c[4], c[5])):
        if (doc, node) not in out:
            out[doc, node] = [peso, explicit, recent or None, [text]]
            continue
        p = out[doc, node]
        if text not in p[3]:
            p[3].append(text)
        p[0] = max(p[0], peso) + 1000 * max(0, len(p[3]) - 1)
        p[1], p[2] = p[1] and explicit, recent or p[2]
    return out


def test_profile_equals_sequential_fold(spark):
    rng = random.Random(5)
    calls = list({(rng.randrange(3), rng.choice("xy"), i, 1, rng.choice("abcd"), rng.randrange(1, 9) * 10_000, rng.random() < 0.8, rng.choice([None, "", "2020", "2021"])) for i in range(120)})
    df = spark.createDataFrame(calls, "docente_id long, nodo_id string, seq long, semana int, texto string, p long, explicito boolean, recencia string")
    df = df.withColumn("peso", (F.col("p") / 10_000).cast("decimal(18,4)"))
    got = {(r.docente_id, r.nodo_id): [int(r.peso * 10_000), r.explicito, r.recencia, list(r.evidencias)] for r in profiles.teacher_profile(df).collect()}
    assert got == fold(calls)


def score(a, b):
    x, y = a.split(), b.split()
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    return sum(w in y for w in x) / len(x) if x else 0.0


def test_similar_names_lose_no_pair(spark):
    rng = random.Random(3)
    pool = ["ANA", "LUIS", "PEREZ", "DIAZ", "DE", "LA", "CRUZ", "ROJAS"]
    left = [" ".join(rng.choice(pool) for _ in range(rng.randrange(0, 6))) for _ in range(60)]
    right = [" ".join(rng.choice(pool) for _ in range(rng.randrange(0, 6))) for _ in range(40)]
    l, r = (spark.createDataFrame([(x,) for x in n], "n string") for n in (left, right))
    got = {(x.a, x.b) for x in names.similar_names(l, r).collect()}
    want = {(a, b) for a, b in itertools.product(left, right) if score(a, b) >= 0.8}
    assert got == want and want


def test_no_teachers_orphan_all_history(spark):
    h = spark.createDataFrame([("Ana Diaz", "c")], "nombre_docente string, nombre_curso string")
    assert names.without_teacher(h, spark.createDataFrame([], "nombre string")).count() == 1
    assert names.without_teacher(h, spark.createDataFrame([("diaz ana maria",)], "nombre string")).count() == 0


def test_vectors_fail_open(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "id int, embedding array<float>")
    c = spark.createDataFrame([([1.0, 0.1],)], "embedding array<float>")
    assert {r.id: r.kept for r in semantic.drop_near_concepts(e, c).collect()} == {1: False, 2: True, 3: True, 4: True}
    assert semantic.drop_near_concepts(e, c.limit(0)).filter("kept").count() == 4
    assert one(spark, semantic.sentences(F.lit("corta. Esta frase es bastante larga.\nno"))) == ["Esta frase es bastante larga"]


def test_clean_entities(spark):
    docs = spark.createDataFrame([(1, "Usa Python y Docker"), (2, None), (3, "nada")], "doc_id long, text string")
    raw = spark.createDataFrame([(1, 1, " Python (inferido)"), (1, 2, "python"), (1, 3, "IA"), (1, 4, "Docker"), (1, 5, None), (3, 1, "Kafka")], "doc_id long, pos int, entidad string")
    got = {r.doc_id: r.entidades for r in entities.clean_entities(raw, docs).collect()}
    assert got == {1: ["Python (inferido)", "Docker"], 2: [tx.UNDECLARED], 3: [tx.UNDECLARED]}
    kept = entities.clean_entities(raw, docs, most=1, undecided="keep").collect()
    assert {r.doc_id: r.entidades for r in kept}[3] == ["Kafka"]


def test_maintenance_is_idempotent(spark):
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "propietario_email string, invitado_email string")
    assert tables.add_pairs(tables.add_pairs(pairs, pairs), pairs).count() == 2
    cache = spark.createDataFrame([(1, 5.0), (1, 4.0), (2, 3.0)], "curso_id int, score_combinado double")
    new = spark.createDataFrame([(1, None)], "curso_id int, score_combinado double")
    once = tables.replace_cache(cache, new)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, tables.replace_cache(once, new).collect())) == [(1, 0.0), (2, 3.0)]
    nodes = spark.createDataFrame([("r", None, "R"), ("x", "r", "X")], "id string, parent_id string, name string")
    up = tables.upsert(nodes, spark.createDataFrame([("x", None, "Y"), ("z", "r", "Z")], nodes.schema), "id")
    assert {tuple(r) for r in up.collect()} == {("r", None, "R"), ("x", None, "Y"), ("z", "r", "Z")}


def test_latest_counts_missing_time_as_newest(spark):
    t = datetime.datetime(2024, 1, 1)
    logs = spark.createDataFrame([(1, "f", t, "a"), (2, "f", None, "b"), (3, "g", t, "c"), (4, "g", t, "d")], "id int, drive_file_id string, timestamp timestamp, status string")
    assert sorted(values(tables.latest(logs), "id")) == [2, 4]


def test_taxonomy_file(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"roots":[{"id":"a","name":"A","type":"root","children":[{"id":"b","name":"B","aliases":["x"],"children":[{"id":"c","name":"C","domain":"d"}]}]}]}')
    rows = {r.id: (r.parent_id, r.node_type, r.aliases, r.domain) for r in profiles.flatten_taxonomy(files.read_taxonomy(spark, str(tmp_path / "t.json"))).collect()}
    assert rows == {"a": (None, "root", [], None), "b": ("a", "leaf", ["x"], None), "c": ("b", "leaf", [], "d")}
    closure = profiles.taxonomy_closure(spark.createDataFrame([("a", None), ("b", "a"), ("c", "b")], "id string, parent_id string"))
    assert closure.count() == 6 and closure.filter("distance = 2").count() == 1


def test_reports_and_exports(spark, tmp_path):
    ranking = spark.createDataFrame([(1, 2, 1), (1, 3, 2), (4, 2, 1)], "curso_id long, docente_id long, rank int")
    courses = spark.createDataFrame([(1, "Bases de datos"), (4, None)], "id long, nombre string")
    files.write_reports(ranking, courses, str(tmp_path / "reports"))
    assert sorted(p.name for p in (tmp_path / "reports").glob("report=*")) == ["report=Bases_de_datos_1", "report=curso_4"]
    files.write_rankings(ranking, str(tmp_path / "all"))
    assert spark.read.option("header", True).csv(str(tmp_path / "all")).count() == 3
    assert files.load_contents(spark, str(tmp_path / "all")).filter("length > 0").count() >= 1


def test_profile_stream_equals_batch(spark, tmp_path):
    schema = "docente_id long, nodo_id string, seq long, semana int, texto string, peso decimal(18,4), explicito boolean, recencia string"
    rows = [(1, "n", i, 1, t, None, True, None) for i, t in enumerate("abca")]
    df = spark.createDataFrame(rows, schema).withColumn("peso", (F.col("seq") + 1).cast("decimal(18,4)"))
    for i in range(2):
        df.filter(F.floor(F.col("seq") / 2) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = feeds.read_events(spark, str(tmp_path / "in"), df.schema, 1)
    paths = {k: str(tmp_path / k) for k in ("profiles", "stale")}
    q = feeds.merge_profiles(stream, paths).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.read.parquet(paths["profiles"]).filter("batch = 1").drop("batch").collect()
    assert last == profiles.teacher_profile(df).collect()


@pytest.mark.parametrize("again", [False, True])
def test_intake_drops_repeats(spark, tmp_path, again):
    t = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, t), (1, t), (2, t)], "id long, timestamp timestamp")
    df.write.parquet(str(tmp_path / "in"))
    out = feeds.run_available(feeds.intake(feeds.read_events(spark, str(tmp_path / "in"), df.schema)), str(tmp_path / "out"))
    if again:  # a restart from the checkpoint adds nothing
        out = feeds.run_available(feeds.intake(feeds.read_events(spark, str(tmp_path / "in"), df.schema)), str(tmp_path / "out"))
    assert sorted(values(out, "id")) == [1, 2]
