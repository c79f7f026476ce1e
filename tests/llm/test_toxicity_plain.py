"""The classifier's convolution against one written out; the last stage of the pipeline at the edges."""

import corpus_pipeline
import numpy as np
from test_edges import DOCUMENTS

from cotejo.llm import toxicity
from cotejo.llm.common import show_code


def plain_logit(model, words):
    embedded = [sum(model.table[r] for r in toxicity.word_rows(w)) for w in words]
    best = []
    for s, span in enumerate(toxicity.SPANS):
        for f in range(toxicity.FILTERS):
            found = [0.0]
            for at in range(len(words) - span + 1):
                found.append(sum(float(embedded[at + j] @ model.filters[s][j][:, f]) for j in range(span)) + float(model.bias[s][f]))
            best.append(max(found))
    return float(np.dot(best, model.out) + model.out_bias)


def test_logits_equal_a_plain_convolution(monkeypatch):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["fool", "idiot", "漢字", "é"]
    texts = [" ".join(rng.choice(vocabulary, size=n)) for n in (0, 1, 2, 3, 5, 30, 31, 64, 200, 17, 90)]
    labels = np.array([("fool" in t) or ("idiot" in t) for t in texts], float)
    model = toxicity.train(texts * 3, np.tile(labels, 3), epochs=2)
    words = [toxicity.words_of_text(t) for t in texts]
    want = [plain_logit(model, w) for w in words]
    for piece in (toxicity.PIECE, 29):  # longer texts go in pieces that overlap
        monkeypatch.setattr(toxicity, "PIECE", piece)
        assert np.allclose(toxicity.Scorer(model).logit(words), want, rtol=1e-3, atol=1e-3), piece


def test_packing_stage_at_the_edges(spark, folder):
    """Ids are four bytes each. Nulls, repeats, ids of no value and columns of other names: each row's ids lie in gapless pieces; no rows give none."""
    show_code(spark)
    words = " ".join(f"w{i}" for i in range(3000))
    rows = [(1, words, "en", "s", 9), (1, words, "en", "s", 9), (2, None, None, None, None), (None, "a b", None, "s", 3), (5, "", "en", "s", 0)]
    odd = spark.createDataFrame([(*r, "clash", 7, True, 8) for r in rows], DOCUMENTS + ", row string, key int, kept boolean, start long")
    stage = corpus_pipeline.STAGES[-1][1]
    pieces = stage(spark, odd, folder).collect()
    for key, copies in ((1, 2), (2, 1), (None, 1), (5, 1)):
        own = [p for p in pieces if p.doc_id == key]
        assert sum(len(p.ids) // 4 for p in own) == copies * own[0].doc_tokens, key
        assert {p.start for p in own} >= {0} and all(p.start + len(p.ids) // 4 <= p.doc_tokens for p in own)
    assert {p.doc_tokens for p in pieces if p.doc_id in (2, 5)} == {1}  # the end id alone
    filled = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == filled.get(p.sequence_id, 0)
        filled[p.sequence_id] = p.offset + len(p.ids) // 4
    assert max(filled.values()) <= 2048
    assert stage(spark, odd.limit(0), folder).count() == 0
