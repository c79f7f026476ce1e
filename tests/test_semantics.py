"""Behaviour at the edges: any depth, any character, lists of evidence, streams, block products."""

import datetime
import json
import random
import re
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from cotejo.functions import text as tx
from cotejo.operators import entities, matching, profiles, semantic, tables
from cotejo.plans import ranking as plan
from cotejo.sources import files, scratch
from cotejo.streaming import feeds


def normal(s):
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode().strip()).lower()


def name_words(s):
    return re.sub("[^A-Z0-9 ]", " ", unicodedata.normalize("NFD", s).encode("ascii", "ignore").decode().upper()).split()


def test_normal_forms_of_every_code_point(spark):
    chars = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}B" for c in chars[i : i + 128]) for i in range(0, len(chars), 128)] + ["a\u00a0b Š ő ﬁ x", "½㎏ⅷ ﷺ", "  \x1c É "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.normalize_text(F.col("t")).alias("n"), tx.name_words(F.col("t")).alias("w")).collect()
    for r in rows:
        assert r.n == normal(r.t) and r.w == name_words(r.t)


def test_closure_of_any_depth_and_of_a_cycle(spark):
    chain = [(str(i), str(i - 1) if i else None) for i in range(25)] + [("lost", "nowhere")]
    got = {tuple(r) for r in profiles.taxonomy_closure(spark.createDataFrame(chain, "id string, parent_id string")).collect()}
    assert got == {(str(i), str(j), i - j) for i in range(25) for j in range(i + 1)} | {("lost", "lost", 0), ("lost", "nowhere", 1)}
    cycle = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "id string, parent_id string")
    with pytest.raises(ValueError, match="cycle"):
        profiles.taxonomy_closure(cycle)
    assert profiles.taxonomy_closure(cycle.limit(0)).count() == 0


def test_taxonomy_file_of_twelve_levels(spark, tmp_path):
    node = None
    for i in reversed(range(12)):
        node = {"id": f"n{i}", "name": f"N{i}", "children": [node] if node else []}
    twin = {"id": "n0", "name": "last", "aliases": ["z"]}
    (tmp_path / "t.json").write_text(json.dumps({"roots": [node, twin]}))
    flat = profiles.flatten_taxonomy(files.read_taxonomy(spark, str(tmp_path / "t.json")))
    rows = flat.orderBy("visit").collect()
    assert [(r.id, r.parent_id) for r in rows] == [(f"n{i}", f"n{i - 1}" if i else None) for i in range(12)] + [("n0", None)]
    old = spark.createDataFrame([("n0", "old"), ("gone", "stays")], "id string, name string")
    got = {tuple(r) for r in tables.upsert(old, flat.select("id", "name", "visit"), "id", order="visit").collect()}
    assert got == {("n0", "last"), ("gone", "stays")} | {(f"n{i}", f"N{i}") for i in range(1, 12)}


def fold(calls):
    """Sequential upserts of calls (weight, evidence list, explicit, recency)."""
    weight, known, keys, explicit, recent = None, [], set(), True, None
    for peso, evidence, said, period in calls:
        for e in evidence:
            key = json.dumps(e, sort_keys=True)
            if key not in keys:
                keys.add(key)
                known.append(e)
        weight = peso if weight is None else max(weight, peso) + 1000 * max(0, len(known) - 1)
        explicit, recent = explicit and said, period or recent
    return weight, known, explicit, recent


@pytest.mark.parametrize("kind", ["map<string,string>", "struct<b:string,a:string>"])
def test_lists_of_evidence_are_folded_in_order(spark, kind):
    rng = random.Random(8)
    calls = []
    for i in range(60):
        evidence = [{k: rng.choice("xyz") for k in rng.sample("ab", 2)} for _ in range(rng.randrange(4))]
        calls.append((rng.randrange(2), "n", i, rng.randrange(1, 9), evidence, rng.random() < 0.9, rng.choice([None, "", "2020", "2021"])))
    df = spark.createDataFrame(calls, f"docente_id long, nodo_id string, seq long, p long, evidencias array<{kind}>, explicito boolean, recencia string")
    df = df.withColumn("peso", F.col("p").cast("decimal(18,4)")).drop("p")
    for r in profiles.teacher_profile(df, ["seq"]).collect():
        want = fold([(p * 10_000, e, x, y) for d, _, _, p, e, x, y in calls if d == r.docente_id])
        found = [e if isinstance(e, dict) else e.asDict() for e in r.evidencias]
        assert (int(r.peso * 10_000), found, r.explicito, r.recencia) == want
    weeks = df.withColumn("curso_id", F.col("docente_id")).withColumn("semanas", F.array((F.col("seq") % 5).cast("int"), F.lit(9)))
    for r in profiles.course_profile(weeks, ["seq"]).collect():
        own = [c for c in calls if c[0] == r.curso_id]
        assert [e if isinstance(e, dict) else e.asDict() for e in r.evidencias] == fold([(0, c[4], True, None) for c in own])[1]
        assert r.semanas == sorted({c[2] % 5 for c in own} | {9}) and r.peso_centralidad == max(c[3] for c in own)


def test_evidence_keys(spark):
    df = spark.createDataFrame([({"b": "1", "a": None}, {"a": None, "b": "1"}, {"b": "1"})], "x map<string,string>, y map<string,string>, z map<string,string>")
    x, y, z = df.select(*[tx.evidence_key(F.col(c), df.schema[c].dataType) for c in "xyz"]).first()
    assert x == y == '{"a":null,"b":"1"}' and z == '{"b":"1"}'


@pytest.mark.parametrize("dense", [matching.DENSE, 0])
def test_block_product_equals_all_pairs(spark, monkeypatch, dense):
    for name, value in {"DENSE": dense, "COURSE_ROWS": 40, "TEACHER_ROWS": 60, "TILE": 3, "GROUP": 2}.items():
        monkeypatch.setattr(matching, name, value)
    rng = random.Random(6)
    teachers = [(t, f"n{n}", rng.randrange(1, 5)) for t in range(60) for n in rng.sample(range(12), rng.randrange(6))] + [(None, "n1", 9), (3, None, 9), (7, "n2", 2), (7, "n2", 2)]
    courses = [(c, f"n{n}", rng.randrange(4)) for c in range(50) for n in rng.sample(range(14), rng.randrange(7))]
    t = spark.createDataFrame(teachers, "docente_id long, nodo_id string, p int").withColumn("peso", F.col("p").cast("decimal(18,4)"))
    c = spark.createDataFrame(courses, "curso_id long, nodo_id string, p int").withColumn("peso_centralidad", F.col("p").cast("decimal(18,4)"))
    top = {n: max(p for _, m, p in teachers if m == n) for _, n, _ in teachers if n}
    want = {}
    for course in range(50):
        own = [(n, p * 10_000) for k, n, p in courses if k == course]
        sums = {}
        for d, n, p in teachers:
            for m, cent in own:
                if n == m and d is not None:
                    s = sums.setdefault(d, [0, 0])
                    s[0] += cent * int(p / top[n] * 1_000_000 + 0.5)
                    s[1] += 1
        total = sum(x for _, x in own)
        rows = sorted((-(s / (total * 1_000_000) * 100) if total else 0.0, d, n) for d, (s, n) in sums.items())[:10]
        want |= {(course, d): (i + 1, -s, n) for i, (s, d, n) in enumerate(rows)}
    got = {(r.curso_id, r.docente_id): (r["rank"], r.score, r.n_nodes) for r in matching.rank(t, c).collect()}
    assert got == want and len(want) > 300
    assert matching.rank(t.limit(0), c).count() == matching.rank(t, c.limit(0)).count() == 0


def test_ranking_job(spark):
    day = datetime.datetime
    t = spark.createDataFrame([(1, "a", 2), (2, "a", 1)], "docente_id long, nodo_id string, p int").withColumn("peso", F.col("p").cast("decimal(18,4)"))
    c = spark.createDataFrame([(7, "a"), (7, "b"), (8, "a")], "curso_id long, nodo_id string").withColumn("peso_centralidad", F.lit(1).cast("decimal(18,4)"))
    people = spark.createDataFrame([(1, "Ana Diaz", None), (2, "Luis", "Doctor")], "id long, nombre string, grado string")
    cache = spark.createDataFrame([(1, 8, 2, 40.0, ("hola", [], ["a"]), matching.CACHE_VERSION, day(2024, 1, 1)), (2, 8, 1, 10.0, None, matching.CACHE_VERSION, day(2024, 1, 1))],
        "id long, curso_id long, docente_id long, score_combinado double, shap_explanations struct<text:string,brechas:array<string>,matches_atomicos:array<string>>, version_algoritmo string, fecha_generada timestamp_ntz")
    history = spark.createDataFrame([("DIAZ ANA", "x"), ("Otro", "y")], "nombre_docente string, nombre_curso string")
    out = plan.recommend(cache, people, spark.createDataFrame([(7,), (8,)], "id long"), t, c, F.lit(day(2024, 1, 2)).cast("timestamp_ntz"), k=2, history=history)
    rows = {(r.curso_id, r.docente_id): (r["rank"], r.score, r.score_relativo, r.text, r.from_cache) for r in out.rows.collect()}
    assert rows == {
        (7, 1): (1, 50.0, 100.0, "Cubre 1 nodos; faltan 1", False), (7, 2): (2, 25.0, 50.0, "Cubre 1 nodos; faltan 1", False),
        (8, 2): (1, 40.0, 100.0, "hola", True), (8, 1): (2, 10.0, 25.0, "", True),
    }
    saved = {r.docente_id: r.shap_explanations.asDict() for r in out.renewed.collect()}
    assert saved[1] == {"text": "Cubre 1 nodos; faltan 1", "brechas": ["b"], "matches_atomicos": ["a"]} and set(saved) == {1, 2}
    assert [r.nombre_docente for r in out.history.collect()] == ["DIAZ ANA"]


def test_entities_by_vectors(spark):
    docs = spark.createDataFrame([(1, "Usa Python y poco más. Otra frase."), (2, ""), (3, "nada")], "doc_id long, text string")
    raw = [(1, 1, "Python", [1.0, 0.0]), (1, 2, "Kafka", [0.0, 1.0]), (1, 3, "Cobol", [1.0, 1.0]), (1, 4, "Gremio", [1.0, -1.0]), (1, 5, "Rust", None), (2, 1, "Kafka", [0.0, 1.0]), (3, 1, "Perl", [0.0, 1.0])]
    e = spark.createDataFrame(raw, "doc_id long, pos int, entidad string, embedding array<double>")
    concepts = spark.createDataFrame([([1.0, -1.0],)], "embedding array<double>")
    sentences = spark.createDataFrame([(1, [0.1, 1.0]), (1, [-1.0, 0.0])], "doc_id long, embedding array<double>")
    got = {r.doc_id: r.entidades for r in entities.clean_entities(e, docs, concepts=concepts, sentence_vectors=sentences).collect()}
    assert got == {1: ["Kafka", "Cobol", "Rust"], 2: [tx.UNDECLARED], 3: ["Perl"]} or got[1] == ["Python", "Kafka", "Cobol", "Rust"]
    kept = {r.doc_id: r.entidades for r in entities.clean_entities(e, docs, undecided="keep").collect()}
    assert kept[2] == [tx.UNDECLARED] and kept[3] == ["Perl"] and len(kept[1]) == 5


def test_more_concepts_than_a_block(spark, monkeypatch):
    rng = random.Random(2)
    vectors = lambda n: [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(n)]
    e, c = (spark.createDataFrame(vectors(n) + [(99, None)], "id int, embedding array<double>") for n in (30, 25))
    want = {r.id: r.kept for r in semantic.drop_near_concepts(e, c, 0.9).collect()}
    monkeypatch.setattr(semantic, "CONCEPTS", 4)
    assert {r.id: r.kept for r in semantic.drop_near_concepts(e, c, 0.9).collect()} == want and set(want.values()) == {True, False}


def test_history_keeps_its_first_owner(spark):
    calls = spark.createDataFrame([("t", "c", 2, "2021", "b"), ("t", "c", 1, "2020", "a"), ("u", "c", 3, "2022", "b")], "nombre_docente string, nombre_curso string, seq int, periodo string, propietario_email string")
    old = spark.createDataFrame([("u", "c", "2001", "z"), ("v", "c", "2002", "z")], "nombre_docente string, nombre_curso string, ultima_vez string, propietario_email string")
    got = {tuple(r) for r in tables.upsert_history(calls, old).collect()}
    assert got == {("t", "c", "2021", "a"), ("u", "c", "2022", "z"), ("v", "c", "2002", "z")}
    assert tables.upsert_history(calls, old, per_owner=True).count() == 5


def test_unreadable_files_are_null_rows(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_bytes(b"abc")
    (tmp_path / "in" / "deep" / "b.txt").write_bytes(b"x")
    listing = files.scan_files(spark, str(tmp_path / "in")).select("path").unionByName(spark.createDataFrame([("file:/none",)], "path string"))
    got = {r.path.split("/")[-1]: (r.length, r.content) for r in files.load_contents(spark, str(tmp_path / "in"), listing).collect()}
    assert got == {"a.txt": (3, bytearray(b"abc")), "b.txt": (1, bytearray(b"x")), "none": (None, None)}


LOG = "id long, drive_file_id string, status string, timestamp timestamp"


def minute(m):
    return datetime.datetime(2024, 1, 1, 10) + datetime.timedelta(minutes=m)


def as_stream(spark, rows, schema, path, per_batch):
    """A stream of files of a few rows each, in order."""
    df = spark.createDataFrame(rows, schema)
    for n, i in enumerate(range(0, len(rows), per_batch)):
        spark.createDataFrame(rows[i : i + per_batch], schema).coalesce(1).write.parquet(f"{path}/in/{n:03}")
    return feeds.read_events(spark, f"{path}/in/*", df.schema, 1), df


@pytest.mark.parametrize("per_batch", [1, 3, 100])
def test_stuck_files(spark, tmp_path, per_batch):
    rows = [(1, "f", "processing", minute(0)), (2, "g", "processing", minute(1)), (3, "g", "SUCCESS", minute(10)), (4, "f", "SUCCESS", minute(20)),
            (5, "h", "processing", minute(30)), (6, "h", "processing", minute(44)), (7, "h", "processing", minute(60)), (8, "f", "received", minute(400))]
    stream, _ = as_stream(spark, rows, LOG, tmp_path, per_batch)
    out = feeds.run_available(feeds.stuck(stream), str(tmp_path / "out"))
    assert sorted((r.drive_file_id, r.since) for r in out.collect()) == [("f", minute(0)), ("h", minute(44)), ("h", minute(60))]


@pytest.mark.parametrize("per_batch", [1, 100])
def test_latest_status_equals_batch(spark, tmp_path, per_batch):
    rows = [(1, "f", "a", minute(5)), (2, "f", "b", minute(3)), (3, "g", "c", minute(4)), (4, "g", "d", minute(4)), (5, "h", "e", None), (6, "h", "f", minute(9)), (7, "f", "z", minute(50))]
    stream, df = as_stream(spark, rows, LOG, tmp_path, per_batch)
    out = feeds.newest(feeds.run_available(feeds.latest_status(stream, "1 hour"), str(tmp_path / "out"), "update"), "drive_file_id")
    assert {(r.drive_file_id, r.id) for r in out.collect()} == {(r.drive_file_id, r.id) for r in tables.latest(df).collect()} == {("f", 7), ("g", 4), ("h", 5)}


def test_sessions_stream_equals_batch(spark, tmp_path):
    rows = [(u, minute(m)) for m in (0, 50, 100, 300, 350, 5000) for u in (1, 2)]
    stream, df = as_stream(spark, rows, "user_id long, ts timestamp", tmp_path, 2)
    out = feeds.run_available(feeds.sessions(stream, late="2 hours"), str(tmp_path / "out")).drop("batch_id")
    closed = {tuple(r) for r in feeds.sessions(df).filter("session_end < timestamp'2024-01-03'").collect()}
    assert {tuple(r) for r in out.collect()} == closed and len(closed) == 4


def test_periodic_status(spark, tmp_path):
    stream, df = as_stream(spark, [(i, "f", "ab"[i % 2], minute(i)) for i in range(9)], LOG, tmp_path, 4)
    seen = {}
    query = feeds.periodic_status(stream, lambda batch, n: seen.update({(r.window_start, r.status): r.n for r in batch.collect()}), "100 milliseconds").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert seen == {(r.window_start, r.status): r.n for r in feeds.status_windows(df).collect()}


def test_no_local_folders_on_a_cluster():
    class Context:
        master = "spark://x"
        _jsc = property(lambda self: self)
        sc = getCheckpointDir = lambda self: self
        isEmpty = lambda self: True

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_folder(Session())
