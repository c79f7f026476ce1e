"""The roll-up is dealt into parts of a bounded number of rows."""

import random
import re

from cotejo.operators import profiles


def test_parts_grow_with_the_rows(spark, monkeypatch):
    rng = random.Random(8)
    nodes = spark.createDataFrame([("root", None), *[(f"b{i}", "root") for i in range(3)], *[(f"b{i}/l{j}", f"b{i}") for i in range(3) for j in range(4)]], "id string, parent_id string")
    leaves = [f"b{i}/l{j}" for i in range(3) for j in range(4)] + ["b1", "unknown"]
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice(leaves), rng.choice(["x", "y", "z", None]), rng.randrange(1, 9)) for _ in range(400)]
    calls = spark.createDataFrame(rows, "docente_id long, nodo_id string, texto string, w int").selectExpr("docente_id", "nodo_id", "texto", "cast(w as decimal(18,4)) as peso")
    above = {None: [], "root": ["root"], **{f"b{i}": [f"b{i}", "root"] for i in range(3)}}
    best, want = {}, {}
    for who, node, text, w in rows:
        for a in above.get(node) or ([node, *above[node.split("/")[0]]] if "/" in node else [node]):
            best[who, a, text] = max(w, best.get((who, a, text), 0))
    for (who, a, _), w in best.items():
        total, n = want.get((who, a), (0, 0))
        want[who, a] = (total + w, n + 1)
    for rolled, parts in ((1 << 18, 1), (20, len({(r[0], r[1], r[2]) for r in rows}) // 20 + 1)):
        monkeypatch.setattr(profiles, "ROLLED", rolled)
        out = profiles.roll_up(calls, nodes)
        assert {(r.docente_id, r.nodo_id): (int(r.peso), r.n) for r in out.collect()} == want
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert rolled > 20 or re.search(rf"hashpartitioning\(docente_id#\d+L, ekey#\d+, {parts}\), REPARTITION_BY_NUM", plan)
