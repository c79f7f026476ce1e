"""Style sheets, visibility, spans, numbers, and pages that are deep or wide."""

import html as plain
import re
import time

import pytest

from cotejo.llm import html
from cotejo.llm.common import read_table


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<style>.x, p#y { color:red; display : none }</style><p class='a x'>no</p><p id=y>no</p><div id=y>yes</div>", "yes"),
        ("<p class=x>no</p><b>yes</b><style>p.x{display:none}</style>", "yes"),
        ("<style>@media print{.x{display:none}} .y{display:none}</style><p class=x>yes</p><p class=y>no</p>", "yes"),
        ("<style media=print>.x{display:none}</style><p class=x>yes</p>", "yes"),
        ("<style>.x{display:none} #i{display:block}</style><p class=x id=i>yes</p><p class=x style='display:block'>and</p>", "yes\n\nand"),
        ("<style>.x{display:none!important}</style><p class=x style='display:block'>no</p>yes", "yes"),
        ("<style>/* .x{display:none} */ div .x{display:none}</style><p class=x>yes</p>", "yes"),
        ("<!-- <style>p{display:none}</style> --><p>yes</p>", "yes"),
        ("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</div>", "yes"),
        ("<ol data-start=5><li>a</ol>", "1. a"),
        ("<ol start=1234567><li>a<li value=-2>b<li>c</ol>", "1234567. a\n-2. b\n-1. c"),
        ("<ol start=x><li>a</ol><ol start=99999999999999999999><li>b</ol>", "1. a\n\n1. b"),
        ("<table><tr><td colspan=2>wide title<td>c<tr><td>a<td>b<td>d</table>", "wide title | c\na | b      | d"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a | b\n    c\nd | e"),
        (f"<table><tr><td>{'x' * 200}<td>b<tr><td>y<td>c</table>", f"{'x' * 200} | b\ny{' ' * 199} | c"),
        ("<p><button><p>a</button>b", "a\n\nb"),
    ],
)
def test_visible_text(page, want):
    assert html.page_text(page) == want


@pytest.mark.parametrize(
    "page", ["<div>" * 100_000 + "x", "<p><button>" + "<div>" * 100_000 + "x", "<b>" * 50_000 + "</i>" * 50_000 + "x", "<ul><li>" * 30_000 + "x", "<table><tr><td>" * 5_000 + "x"]
)
def test_deep_pages_take_no_square_of_their_depth(page):
    began = time.time()
    assert html.page_text(page).endswith("x") and time.time() - began < 5


def test_padding_is_bounded():
    page = "<table>" + f"<tr><td>{'x' * 100_000}<td>b" + "<tr><td>y<td>c" * 5000 + "</table>"
    text = html.page_text(page)
    assert len(text) < 40 * len(page) and text.count("x") == 100_000 and text.count("c") == 5000


def words(page):
    """All words outside tags, by plain removal."""
    bare = re.sub(r"(?s)<(script|style|title)\b.*?</\1>|<!--.*?-->", " ", page or "")
    return "".join(plain.unescape(re.sub(r"<[^>]*>", " ", bare)).split())


def test_every_visible_word_of_every_page(spark, folder):
    pages = read_table(spark, folder, "pages").collect()
    for r in pages:
        got = re.sub(r"(?m)^\s*(?:- |\d+\. )", "", html.page_text(r.html)).replace(" | ", " ")
        assert "".join(got.split()).replace("-", "").replace("|", "") == words(r.html).replace("-", "").replace("|", ""), r.page_id


def test_null_empty_and_repeated_pages(spark):
    df = spark.createDataFrame([(1, "<p>a", "t"), (1, "<p>a", "t"), (2, None, "t"), (3, "", None)], "page_id long, html string, text string")
    assert sorted((r.row.page_id, r.text) for r in html.extract_text(df).collect()) == [(1, "a"), (1, "a"), (2, ""), (3, "")]
    assert html.extract_text(df.limit(0)).count() == 0
