"""The block product against plain sums, and the blocks that its bounds leave out."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cotejo.operators import matching


def plain(teachers, courses, k):
    """The k best of each course: (course, teacher, shared nodes), by exact sums in millionths."""
    top, weight = defaultdict(float), defaultdict(lambda: defaultdict(int))
    for _, node, w in teachers:
        top[node] = max(top[node], w)
    for who, node, w in teachers:
        weight[node][who] += int(w / top[node] * 1_000_000 + 0.5)
    out = []
    for course in sorted({c for c, _, _ in courses}):
        sums, shared = defaultdict(int), defaultdict(int)
        for c, node, w in courses:
            if c == course:
                for who, x in weight[node].items():
                    sums[who] += int(w * 10_000) * x
                    shared[who] += 1
        best = sorted(sums, key=lambda x: (-sums[x], x))[:k]
        out += [(course, r + 1, who, shared[who]) for r, who in enumerate(best)]
    return out


def frames(spark, teachers, courses):
    t = spark.createDataFrame(teachers, "docente_id long, nodo_id string, x double").select("docente_id", "nodo_id", F.col("x").cast("decimal(18,4)").alias("peso"))
    c = spark.createDataFrame(courses, "curso_id long, nodo_id string, x double").select("curso_id", "nodo_id", F.col("x").cast("decimal(18,4)").alias("peso_centralidad"))
    return t, c


def topics(seed, fields, people, each):
    """Teachers and courses of fields: mostly nodes of their own field, and one that all have."""
    rng = random.Random(seed)

    def profile(number, field, n):
        nodes = {f"f{field}/n{rng.randrange(12)}" for _ in range(n)} | {"common"}
        if rng.random() < 0.1:
            nodes.add(f"f{rng.randrange(fields)}/n{rng.randrange(12)}")
        return [(number, x, float(rng.randrange(1, 6))) for x in sorted(nodes)]

    teachers = [r for i in range(people) for r in profile(i, i % fields, each)]
    courses = [r for i in range(people // 2) for r in profile(i, rng.randrange(fields), each)]
    return teachers, courses


@pytest.fixture
def small_blocks(monkeypatch):
    for name, n in (("COURSE_ROWS", 120), ("TEACHER_ROWS", 200), ("CLOSE_ROWS", 120), ("GROUP", 3), ("TILE", 8), ("COURSE_GROUP", 4)):
        monkeypatch.setattr(matching, name, n)


@pytest.mark.parametrize(("k", "dense"), [(1, 1 << 23), (4, 1 << 23), (4, 100), (500, 1 << 23)])
def test_bounded_product_equals_plain_sums(spark, small_blocks, monkeypatch, k, dense):
    monkeypatch.setattr(matching, "DENSE", dense)
    teachers, courses = topics(k, 10, 240, 7)
    t, c = frames(spark, teachers, courses)
    assert matching.block_product(t, c, k)[1] is not None
    got = [(r.curso_id, r["rank"], r.docente_id, r.n_nodes) for r in matching.rank(t, c, k).orderBy("curso_id", "rank").collect()]
    assert got == plain(teachers, courses, k)


def test_most_pairs_of_blocks_are_left_out(spark, small_blocks):
    teachers, courses = topics(3, 30, 900, 8)
    t, c = frames(spark, teachers, courses)
    _, pairs = matching.block_product(t, c, 5)
    rows = {(r.i, r.b) for r in pairs.collect()}
    blocks = len({i for i, _ in rows}), len({b for _, b in rows})
    assert pairs.count() == len(rows) and len(rows) < blocks[0] * blocks[1] / 4, (len(rows), blocks)


def test_alike_teachers_and_ties(spark, small_blocks):
    teachers = [(i, n, 1.0) for i in range(400) for n in ("a", "b")]
    courses = [(1, "a", 1.0), (1, "z", 2.0), (2, "b", 0.0), (3, "z", 1.0), (4, "a", 1.0), (4, "b", 1.0)]
    got = [(r.curso_id, r["rank"], r.docente_id, r.n_nodes) for r in matching.rank(*frames(spark, teachers, courses), 3).orderBy("curso_id", "rank").collect()]
    assert got == plain(teachers, courses, 3)


def test_given_tables_by_small_blocks(spark, folder, monkeypatch):
    """The same ranking whether bounds are used or not."""
    from cotejo.sources.fixtures import Tables

    t = Tables(spark, folder)

    def ranked():
        return sorted((r.curso_id, r["rank"], r.docente_id, r.score) for r in matching.rank(t.docente_nodos, t.curso_nodos, 10).collect())

    want = ranked()
    for name, n in (("COURSE_ROWS", 500), ("TEACHER_ROWS", 700), ("CLOSE_ROWS", 300), ("GROUP", 2)):
        monkeypatch.setattr(matching, name, n)
    assert ranked() == want
