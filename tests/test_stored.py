"""Sources, trees, stored caches, edits and roll-ups against plain versions."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cotejo.functions import text as tx
from cotejo.operators import profiles, semantic, tables
from cotejo.sources import files


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- relational source

@pytest.fixture(scope="module")
def database(spark):
    url = "jdbc:derby:memory:cotejo;create=true"
    rows = spark.createDataFrame([(i, f"name {i}", i % 7) for i in range(1, 501)] + [(None, "no key", None)], "ID int, NAME string, GRP int")
    files.write_jdbc(rows, url, "PEOPLE", createTableColumnTypes="NAME VARCHAR(40)")
    files.write_jdbc(rows.limit(0), url, "NOBODY", createTableColumnTypes="NAME VARCHAR(40)")
    return url


def test_jdbc_reads_in_ranges_and_pushes_filters(spark, database):
    df = files.read_jdbc(spark, database, "PEOPLE", "ID", parts=5)
    assert df.rdd.getNumPartitions() == 5
    sizes = df.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 5 and max(r["count"] for r in sizes) < 150
    some = df.filter("GRP = 3 and NAME like 'name 1%'").select("ID")
    assert "GRP = 3" in re.sub(r"[\[\]]", "", plan_of(some)).replace("EqualTo(GRP,3)", "GRP = 3") and "PushedFilters" in plan_of(some)
    assert "NAME#" not in plan_of(some.select("ID")).split("ReadSchema")[-1]
    assert sorted(r.ID for r in some.collect()) == [i for i in range(1, 501) if i % 7 == 3 and str(i).startswith("1")]
    assert df.count() == 501 and files.read_jdbc(spark, database, "PEOPLE", "ID", 100, 200, 3).count() == 501
    assert files.read_jdbc(spark, database, "PEOPLE").rdd.getNumPartitions() == 1
    assert files.read_jdbc(spark, database, "NOBODY", "ID", parts=4).count() == 0


# --- trees of folders

def plain_walk(rows, roots=None):
    below, mime = defaultdict(list), {}
    for id, parent, name, kind in rows:
        below[parent].append((id, name))
        mime[id] = kind
    folder = {i for i in mime if i in below or mime[i] is None}
    names = {id: name for id, _, name, _ in rows}
    starts = [i for i, _ in below[None] if i in folder] if roots is None else [i for i in names if i in roots]
    out = []

    def walk(root, id, on, path):
        for child, name in sorted(set(below[id]), key=lambda x: (x[0] in folder, x[1], x[0])):
            if child in on:
                continue
            here = f"{path}/{name}"
            if child in folder:
                walk(root, child, [*on, child], here)
            else:
                out.append((root, child, here, len(on)))

    for r in dict.fromkeys(starts):
        walk(r, r, [r], names[r])
    return out


def test_tree_of_any_depth(spark):
    rng = random.Random(4)
    rows = [(0, None, "root", None), (1, None, "other", None), (2, None, "lone file", "t")]
    rows += [(i, rng.choice([0, 1, *range(3, i)]), f"n{rng.randrange(30)}", None if rng.random() < 0.4 else "t") for i in range(3, 80)]
    rows += [(100 + i, 99 + i if i else 0, f"deep{i}", None) for i in range(30)] + [(200, 129, "end", "t")]
    rows += [(40, 1, next(r[2] for r in rows if r[0] == 40), next(r[3] for r in rows if r[0] == 40))]  # several parents
    rows += [(300, 1, "a", None), (301, 300, "b", None), (300, 301, "a", None), (302, 301, "c", "t"), (303, 303, "self", None)]  # cycles
    df = spark.createDataFrame(rows, "id long, parent_id long, name string, mime_type string")
    found = files.scan_tree(df)
    got = [(r.root, r.id, r.path, r.depth) for r in found.orderBy("root", "order").collect()]
    assert got == plain_walk(rows) and max(x[3] for x in got) == 31
    inner = spark.createDataFrame([(300,), (100,)], "id long")
    assert sorted((r.root, r.id, r.path, r.depth) for r in files.scan_tree(df, inner).collect()) == sorted(plain_walk(rows, {300, 100}))
    assert files.scan_tree(df, mime_types=["x"]).count() == 0 and files.scan_tree(df.limit(0)).count() == 0


# --- contents

def test_bytes_are_not_moved(spark, tmp_path):
    for i in range(6):
        (tmp_path / f"f{i}").write_bytes(bytes([i]) * (i * 1000 + 1))
    have = {r.path: r.length for r in files.load_contents(spark, str(tmp_path)).collect()}
    assert len(have) == 6
    wanted = [*sorted(have)[:3], sorted(have)[0], "file:/nowhere"]
    df = files.load_contents(spark, str(tmp_path), spark.createDataFrame([(p,) for p in wanted], "path string"))
    got = {r.path: (r.length, r.content and len(r.content)) for r in df.collect()}
    assert got == {p: (have[p], have[p]) for p in sorted(have)[:3]} | {"file:/nowhere": (None, None)} and df.count() == 4
    scan = plan_of(df).split("Union")[1]
    loaded = scan[: scan.index("content")] if "content" in scan else scan
    assert "Exchange hashpartitioning" not in loaded and "SortMergeJoin" not in plan_of(df)


# --- edits and stored caches

def test_edits_set_named_columns_to_null(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (3, None, 7), (4, "d", 8)], "id long, x string, y int")
    edits = spark.createDataFrame([(1, None, 9, ["x"]), (2, None, None, []), (3, "c", None, ["x", "y"]), (4, "e", 1, None), (5, "z", 1, ["x"])], "id long, x string, y int, given array<string>")
    assert sorted(map(tuple, tables.patch(df, edits, "id", given="given").collect())) == [(1, None, 5), (2, "b", 6), (3, "c", None), (4, "d", 8)]
    assert sorted(map(tuple, tables.patch(df, edits.drop("given"), "id").collect())) == [(1, "a", 9), (2, "b", 6), (3, "c", 7), (4, "e", 1)]


def test_stored_cache_is_replaced_in_place(spark, tmp_path):
    path = str(tmp_path / "cache")
    old = spark.createDataFrame([(c, d, float(c + d)) for c in range(200) for d in range(3)], "curso_id long, docente_id long, score_combinado double")
    tables.store_cache(old, path)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "cache").rglob("*.parquet")}
    fresh = spark.createDataFrame([(5, 1, None), (5, 2, 0.5), (999, 1, 1.0)], old.schema)
    assert tables.replace_stored(spark, path, fresh) in (1, 2)

    def rows():
        return sorted((r.curso_id, r.docente_id, r.score_combinado) for r in spark.read.parquet(path).collect())

    want = sorted([(c, d, float(c + d)) for c in range(200) for d in range(3) if c != 5] + [(5, 1, 0.0), (5, 2, 0.5), (999, 1, 1.0)])
    assert rows() == want
    kept = [p for p, at in before.items() if p.exists() and p.stat().st_mtime_ns == at]
    assert len(kept) >= len(before) * 0.9  # other partitions were not written
    fail = F.udf(lambda x: 1 / 0, "double")
    with pytest.raises(Exception):
        tables.replace_stored(spark, path, fresh.withColumn("score_combinado", fail("docente_id")))
    assert rows() == want and tables.replace_stored(spark, path, fresh.limit(0)) == 0
    itself = spark.read.parquet(path).filter("curso_id = 7").select(*old.columns)
    tables.replace_stored(spark, path, itself)
    assert rows() == want


def test_a_write_that_fails_leaves_the_old_rows(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cache")
    old = spark.createDataFrame([(c, 1, 1.0) for c in range(50)], "curso_id long, docente_id long, score_combinado double")
    tables.store_cache(old, path)
    real = tables.replace_cache
    late = F.udf(lambda c: 1 / 0 if c == 3 else 2.0, "double")  # fails while the partitions are written
    monkeypatch.setattr(tables, "replace_cache", lambda *a: real(*a).withColumn("score_combinado", late("curso_id")))
    with pytest.raises(Exception):
        tables.replace_stored(spark, path, old.filter("curso_id < 10"))
    assert sorted(map(tuple, spark.read.parquet(path).select(*old.columns).collect())) == [(c, 1, 1.0) for c in range(50)]


# --- roll-up

def test_roll_up_of_a_deep_tree(spark):
    rng = random.Random(2)
    nodes = [("n0", None)] + [(f"n{i}", f"n{i - 1}") for i in range(1, 25)] + [(f"m{i}", f"n{rng.randrange(24)}") for i in range(40)]
    parent = dict(nodes)
    calls = [(rng.randrange(3), f"{rng.choice('mn')}{rng.randrange(25)}", rng.choice(["a", "b", "c", None]), rng.randrange(1, 9)) for _ in range(300)] + [(1, "unknown", "a", 2)]
    want = defaultdict(dict)
    for who, node, text, w in calls:
        at = node
        while at is not None:
            want[who, at][text] = max(want[who, at].get(text, 0), w)
            at = parent.get(at)
    df = spark.createDataFrame(calls, "docente_id long, nodo_id string, texto string, w int").withColumn("peso", F.col("w").cast("decimal(18,4)"))
    taxonomy = spark.createDataFrame(nodes, "id string, parent_id string")
    got = {(r.docente_id, r.nodo_id): (int(r.peso), r.n) for r in profiles.roll_up(df, taxonomy).collect()}
    assert got == {k: (sum(v.values()), len(v)) for k, v in want.items()}
    lists = df.groupBy("docente_id", "nodo_id", "peso").agg(F.collect_list("texto").alias("evidencias"))
    assert profiles.roll_up(lists.filter("size(evidencias) > 0"), taxonomy).filter("nodo_id = 'n0'").count() == 3


# --- text and vectors

def test_plain_text_of_mixed_letters(spark):
    import unicodedata

    rng = random.Random(9)
    texts = ["abc", "ñandú Ægir", "ŉ ĳ", "ﬁ é", "½ a", "漢 é", "", "Łódź ŧ đ", "\x80\xa0é"] + ["".join(rng.choice("aé ŁñĲŉﬁ½漢ǆßſ\xa0ÿŽ") for _ in range(12)) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx._ascii(F.col("t")).alias("a"))
    for r in df.collect():
        assert r.a == unicodedata.normalize("NFKD", r.t).encode("ascii", "ignore").decode(), ascii(r.t)


def test_support_with_odd_vectors(spark):
    e = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [0.0, 0.0]), (1, 3, None), (2, 1, [1.0, 0.0]), (3, 1, [1.0, 0.0])], "doc_id long, pos int, embedding array<double>")
    s = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 1.0]), (2, None)], "doc_id long, embedding array<double>")
    got = {(r.doc_id, r.pos): r.supported for r in semantic.supported(e, s).collect()}
    assert got == {(1, 1): True, (1, 2): True, (1, 3): True, (2, 1): False, (3, 1): True}


def test_many_concepts_meet_in_blocks(spark, monkeypatch):
    rng = random.Random(12)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(40)]

    def around():
        return [x + rng.gauss(0, 0.3) for x in rng.choice(centres)]

    concepts = [(around(),) for _ in range(5000)] + [(None,), ([0.0] * 8,), ([1.0, 2.0],), ([1.0] * 7 + [None],)]
    entities = [(i, around() if i % 3 else [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    entities += [(300, None), (301, [0.0] * 8), (302, [2.0, 4.0]), (303, []), (304, [1.0, None] * 4)]
    c = spark.createDataFrame(concepts, "embedding array<double>")
    e = spark.createDataFrame(entities, "row long, embedding array<double>")
    monkeypatch.setattr(semantic, "BLOCK", 128)
    monkeypatch.setattr(semantic, "GROUP", 3)
    df = semantic.drop_near_concepts(e, c, 0.9)
    assert df.columns == ["row", "embedding", "kept"]
    assert "NestedLoop" not in plan_of(df) and "Cartesian" not in plan_of(df)

    def cosine(x, y):
        if len(x) != len(y) or None in x or None in y:
            return -2
        size = sum(a * a for a in x) ** 0.5 * sum(b * b for b in y) ** 0.5
        return sum(a * b for a, b in zip(x, y)) / size if size else -2

    want = {i: v is None or not any(y and cosine(v, y) >= 0.9 for (y,) in concepts) for i, v in entities}
    got = {r.row: r.kept for r in df.collect()}
    assert got == want and 20 < sum(got.values()) < 250 and got[302] is False
    assert all(r.kept for r in semantic.drop_near_concepts(e.limit(0), c, 0.9).collect())
