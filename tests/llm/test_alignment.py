"""Alignment of two tokenizers against the libraries and a plain version."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from cotejo.llm import alignment, queries
from cotejo.llm.common import read_table, show_code

A, B = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    codes = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in codes} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in codes)}

    def of_a(i):
        return bytes(shown[c] for c in first.id_to_token(i))

    def of_b(i):
        name = second.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if second.is_byte(i) else name.replace("▁", " ").encode()

    def plain(text):
        """Groups of ids and links by walking over both lists of ends."""
        if not text:
            return [], [], [], []
        a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
        ta, tb = [of_a(i) for i in a], [of_b(i) for i in b]
        if not b"".join(ta) == b"".join(tb) == (" " + text).encode():
            return [], [], [], []
        ea, eb = np.cumsum([len(x) for x in ta]).tolist(), np.cumsum([len(x) for x in tb]).tolist()
        both, groups, links, i, j = set(ea) & set(eb), [], [], 0, 0
        for e in sorted(both):
            p, q = ea.index(e, i) + 1, eb.index(e, j) + 1
            groups.append((a[i:p], b[j:q]))
            links.append((a[p - 1], b[q - 1]))
            i, j = p, q
        return a, b, groups, links

    return plain


def shown(groups):
    return ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)


def expected(plain, texts):
    found = {k: plain(t) for k, t in texts.items()}
    n = Counter(x for f in found.values() for x in f[3])
    top = Counter()
    for (_, b), c in n.items():
        top[b] = max(top[b], c)
    return {
        k: (len(a), len(b), len(g), len(x), sum(n[y] == top[y[1]] for y in x), sum(n[y] for y in x), hashlib.sha256(shown(g).encode()).hexdigest() if g else "")
        for k, (a, b, g, x) in found.items()
    }


@pytest.mark.parametrize("limit", [400_000, 10])
def test_query_against_the_libraries(spark, folder, libraries, monkeypatch, limit):
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", limit)
    texts = {r.doc_id: r.text for r in read_table(spark, folder, "documents").select("doc_id", "text").collect()}
    rows = queries.op11_tokenizer_alignment(spark, folder).collect()
    want = expected(libraries, texts)
    assert len(rows) == len(texts)
    assert {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows} == want


ODD = [
    "", "a", " ", "a ", "a▁ b ", "  a  b ", "a\n b\n\nc \td", "it's we'll they've", "<|endoftext|> x<s></s>", "a    b   c", "　 a 　", "naïve café à la è é",
    "漢字 仮名 🙂🙂 x", "a▁b", "▁", "x" * 3000, "\0 \x1c a", "12 345 6,789.00", "ab " * 900, "    y", "﻿ z", "a  ", "\r\n",
]


def test_odd_texts(libraries):
    aligner = alignment.Aligner(A, B)
    rng = random.Random(5)
    letters = "ab Z  é 　\n\t'sl9漢🙂., \x85 "
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(1500)]
    for t, (na, nb, n, groups, pairs, times) in zip(texts, aligner.align(texts)):
        a, b, g, links = libraries(t)
        assert (na, nb, n, groups) == (len(a), len(b), len(g), shown(g)), repr(t)
        assert {(int(p) >> 32, int(p) & 0xFFFFFFFF): c for p, c in zip(pairs, times)} == Counter(links)


def test_segments_and_small_caches(libraries, monkeypatch):
    monkeypatch.setattr(alignment, "SEGMENT", 200)
    monkeypatch.setattr(alignment, "CACHE", 50)
    aligner = alignment.Aligner(A, B)
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=400)), "▁ " + " ".join(words), "x" * 900, " ".join(words)]
    for t, found in zip(texts, aligner.align(texts)):
        a, b, g, links = libraries(t)
        assert found[:4] == (len(a), len(b), len(g), shown(g))
        assert found[5].sum() == len(links)


def test_group_ends_of_any_arrays():
    rng = random.Random(7)
    for _ in range(400):
        last = rng.randrange(1, 300)
        a, b = (np.array(sorted({*rng.sample(range(1, last + 1), rng.randrange(0, last)), last})) for _ in range(2))
        if rng.random() < 0.5:
            b = a.copy() if rng.random() < 0.5 else np.delete(a, rng.randrange(len(a) - 1)) if len(a) > 1 else a
        left, right = alignment.group_ends(a, b)
        both = sorted(set(a.tolist()) & set(b.tolist()))
        assert a[left].tolist() == b[right].tolist() == both


def test_every_code_point_is_cut_as_the_library_does():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(A), alignment.ByteLevel(A)
    library.encode_special_tokens = True
    for lo in range(0, 0x110000, 4096):
        texts = [f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}1 '{chr(c)}  {chr(c)}" for c in range(lo, lo + 4096, 7 if lo > 0x3000 else 1) if not 0xD800 <= c <= 0xDFFF]
        if texts:
            assert [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)] == own.encode(texts)


def test_edge_cases(spark, libraries):
    show_code(spark)
    rows = [(i, t, "clash", 1) for i, t in enumerate([None, *ODD])] + [(3, "a b", "clash", 1), (3, "a b", "clash", 1), (None, "a b", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, groups string, at int")
    found = alignment.align(df, A, B)
    out = alignment.add_agreement(found).collect()
    assert len(out) == len(rows) and {r.row.groups for r in out} == {"clash", None}
    want = expected(libraries, {k: r[1] for k, r in enumerate(rows)})
    got = sorted((r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, hashlib.sha256(r.groups.encode()).hexdigest() if r.n_groups else "") for r in out)
    assert got == sorted(want.values())
    assert alignment.add_agreement(alignment.align(df.limit(0), A, B)).count() == 0
