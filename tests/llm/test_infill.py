"""Fill-in-the-middle against a plain version that walks over code points."""

import hashlib

import pytest
import regex

from cotejo.llm import infill, queries
from cotejo.llm.common import read_table, show_code


def plain_cut(text, id, unit=None):
    units = list(text) if unit is None else unit(text)
    digest = hashlib.sha256(f"1:{id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    x, y, z = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{z}<P>{x}<M>{y}"
    return n, "psm", a, b - a, f"<P>{x}<S>{z}<M>{y}"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_against_the_plain_version(spark, folder):
    texts = {r.doc_id: r.text or "" for r in read_table(spark, folder, "documents").select("doc_id", "text").collect()}
    rows = queries.op12_fill_in_middle(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_cut(texts[r.doc_id], r.doc_id)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256) == (*want[:4], digest(want[4]))
        assert r.restored_sha256 == digest(texts[r.doc_id])
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


@pytest.fixture(scope="module")
def odd(spark):
    show_code(spark)
    texts = [None, "", "a", "é🙂\n漢\0x", "<P>a", "x<S>", "<M>", "<P <S\n>>", "y" * 20_000, "same", "same", "\r\n "]
    rows = [(i, t, "en", "clash", 5, 6) for i, t in enumerate(texts * 4)] + [(None, "no id", None, None, None, None), (7, "<P <S\n>>", "en", "clash", 5, 6)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, output string, n int, row int")


def test_edge_cases(odd):
    out = infill.fill_in_middle(odd)
    rows = out.select("*", infill.restore(out["output"], out["form"]).alias("back")).collect()
    assert len(rows) == odd.count() and {r.row.output for r in rows} == {"clash", None}
    for r in rows:
        t = r.row.text or ""
        assert (r.n, r.form, r.prefix_units, r.middle_units, r.output) == plain_cut(t, "" if r.row.doc_id is None else r.row.doc_id)
        assert r.back == t
    assert infill.fill_in_middle(odd.limit(0)).count() == 0


def test_long_texts_are_matched_in_blocks(monkeypatch):
    text = "aé🙂\n漢" * 4000
    want = infill.Cutter(infill.Plan()).cut(text, "3")
    monkeypatch.setattr(infill, "BLOCK", 777)
    assert infill.Cutter(infill.Plan()).cut(text, "3") == want == plain_cut(text, 3)


def test_other_units_and_plans(monkeypatch):
    plan = infill.Plan(unit=r"\s*\S+|\s+$", plain_percent=0)
    words = lambda t: regex.findall(r"\s*\S+|\s+$", t)
    text = " one  two\nthree four " * 50
    for _ in range(2):
        cutter = infill.Cutter(plan)
        for id in range(20):
            got = cutter.cut(text, str(id))
            n, form, a, b, out = plain_cut(text, id, words)
            assert got[0] == len(words(text))
            assert form == "plain" or got == (n, form, a, b, out)
        monkeypatch.setattr(infill, "BLOCK", 64)
    digits = infill.Cutter(infill.Plan(unit="[0-9]"))
    assert digits.cut("12a", "1") == (0, "plain", None, None, "12a")
    assert digits.cut("1" * 200 + "a", "1")[:2] == (0, "plain")


def test_shares_of_the_forms():
    cutter = infill.Cutter(infill.Plan())
    forms = [cutter.cut("some text", str(i))[1] for i in range(4000)]
    assert 0.08 < forms.count("plain") / 4000 < 0.12
    assert 0.15 < forms.count("spm") / 4000 < 0.21
