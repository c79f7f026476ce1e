"""Benchmark decontamination against a plain version that compares all windows."""

import random
import re
from collections import Counter

import pytest

from cotejo.llm import leaks
from cotejo.llm.common import show_code

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def plain(docs, items, width=10, near=4):
    """For each document: words, hits, items, and items near."""
    counts = Counter(w for d in docs for w in words(d))
    wins = {}
    for item, text in items:
        ws = words(text)
        for i in range(max(len(ws) - width, 0) + 1 if ws else 0):
            wins.setdefault(tuple(ws[i : i + width]), set()).add("" if item is None else str(item))
    out = []
    for d in docs:
        ws = words(d)
        hit, exact, close = set(), set(), set()
        for win, owners in wins.items():
            ranked = sorted({w: (counts[w], win.index(w), w) for w in win}.values())
            rare = [w for _, _, w in ranked[:near]]
            for i in range(len(ws)):
                if tuple(ws[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    exact |= owners
                    close |= owners
                if len(rare) == near and ws[i] == rare[0] and set(rare) <= set(ws[max(0, i - width + 1) : i + width]):
                    close |= owners
        out.append((len(ws), len(hit), sorted(exact), sorted(close)))
    return out


@pytest.fixture(scope="module")
def case():
    rng = random.Random(8)
    vocabulary = ["the"] * 30 + ["of"] * 15 + [f"w{k}" for k in range(40)] + ["ñandú", "É", "漢字"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 9, 10, 11, 25])))) for i in range(12)]
    items += [(20, None), (21, ""), (22, " ... "), (None, "no id but words"), (3, "the same id again with other words than before here"), (23, items[5][1]), (24, "the " * 30), (25, "never-seen words")]
    docs = [None, "", "?!", "the " * 200, "x" * 5000, "THE\0of_W1,w2"]
    for _ in range(60):
        text = rng.choices(vocabulary, k=rng.randrange(80))
        for _ in range(rng.randrange(3)):
            source = words(rng.choice(items)[1])
            if rng.random() < 0.3:
                rng.shuffle(source)
            at = rng.randrange(len(text) + 1)
            text[at:at] = source
        docs.append(" ".join(text).upper() if rng.random() < 0.2 else ", ".join(text))
    docs += docs[-3:]
    return docs, items


@pytest.mark.parametrize("most", [200_000, 3])
def test_against_the_plain_version(spark, case, monkeypatch, most):
    show_code(spark)
    monkeypatch.setattr(leaks, "BROADCAST", most)
    docs, items = case
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(docs)], "doc_id long, text string, items string, uid int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = leaks.contamination(df, bench).collect()
    got = {r.row.doc_id: (r.n_words, r.n_hit, r["items"], r.near_items) for r in rows}
    assert len(rows) == len(docs) and got == dict(enumerate(plain(docs, items)))
    assert any(len(x[3]) > len(x[2]) for x in got.values()) and {r.row["items"] for r in rows} == {"clash"}
    kept = leaks.drop_contaminated(df, bench, share=0.5)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, x in sorted(got.items()) if x[1] <= 0.5 * x[0]]


def test_other_widths(spark, case):
    docs, items = case
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = leaks.contamination(df, bench, match=leaks.Match(window=4, near=2), keep=("doc_id",)).collect()
    assert {r.row.doc_id: (r.n_words, r.n_hit, r["items"], r.near_items) for r in rows} == dict(enumerate(plain(docs, items, 4, 2)))


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c"), (None, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert leaks.contamination(docs.limit(0), bench).count() == 0
    assert [r.n_hit for r in leaks.contamination(docs, bench.limit(0)).collect()] == [0, 0]
    assert leaks.drop_contaminated(docs, bench).count() == 1
