"""The near-dedup stage of the pipeline against all pairs compared one by one."""

import itertools
import random

import corpus_pipeline

from cotejo.llm import jaccard, simhash
from cotejo.llm.common import show_code


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def survivors(texts):
    """The smallest id of each group linked at 0.8 or more."""
    best = {i: i for i in texts}
    links = [(i, j) for i, j in itertools.combinations(texts, 2) if similarity(shingles(texts[i]), shingles(texts[j])) >= 0.8]
    moved = True
    while moved:
        moved = False
        for i, j in links:
            if best[i] != best[j]:
                best[i] = best[j] = min(best[i], best[j])
                moved = True
    return sorted(set(best.values()))


def test_stage_links_five_word_shingles_at_four_fifths(spark):
    show_code(spark)
    rng = random.Random(3)
    texts = {}
    for i in range(30):
        words = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        for k in range(4):  # copies with up to three words changed, one after another
            texts[len(texts)] = " ".join(words)
            words[10 + 25 * k] = f"x{i}"
    prints = {i: simhash.simhash(t) & (2**64 - 1) for i, t in texts.items()}
    near = [(i, i + 1) for i in range(0, len(texts), 4) if similarity(shingles(texts[i]), shingles(texts[i + 1])) >= 0.8]
    far = sum((prints[i] ^ prints[j]).bit_count() > 3 for i, j in near)
    assert far > 10  # pairs that three bits of three-word shingles miss
    texts |= {len(texts): "", len(texts) + 1: " \n", len(texts) + 2: "one two", len(texts) + 3: "ONE  two"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == survivors(texts)


def test_exact_limit_and_members_apart_from_the_smallest(spark):
    show_code(spark)
    base = [f"a{i}" for i in range(49)]  # 45 shingles
    texts = {0: " ".join(base), 1: " ".join(base[:40]), 2: " ".join(base[:39]), 3: " ".join(base[9:])}  # 36 / 45 = 0.8, 35 / 45
    docs = spark.createDataFrame([(i, texts[i]) for i in (0, 1)], "doc_id long, text string")
    assert [r.doc_id for r in jaccard.drop_near_duplicates(docs).collect()] == [0]
    docs = spark.createDataFrame([(i, texts[i]) for i in (0, 2)], "doc_id long, text string")
    assert sorted(r.doc_id for r in jaccard.drop_near_duplicates(docs).collect()) == [0, 2]
    docs = spark.createDataFrame([*texts.items(), (None, texts[3]), (None, "")], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.doc_id) for r in jaccard.drop_near_duplicates(docs).collect()) == [(False, 0), (True, None)]
    assert jaccard.drop_near_duplicates(docs.limit(0)).count() == 0


def test_members_compared_in_tiles(spark, monkeypatch):
    show_code(spark)
    monkeypatch.setattr(jaccard, "PIVOTS", 0)
    monkeypatch.setattr(jaccard, "TILE", 3)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(80)]
    texts = {}
    for i in range(40):  # copies of one text, of which most are not alike
        words = list(base)
        for _ in range(rng.randrange(5)):
            words[rng.randrange(80)] = f"x{rng.randrange(99)}"
        texts[i] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in jaccard.drop_near_duplicates(docs).collect()) == survivors(texts)
