"""Hidden elements end where shown ones would."""

import pytest

import time

from cotejo.llm import html


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<ul><li hidden>a<li>b</ul><p>rest</p>", "- b\n\nrest"),
        ("<p hidden>a<p>b", "b"),
        ("<dl><dt>t<dd hidden>a<dd>b</dl>rest", "t\n  b\n\nrest"),
        ("<table><tr><td hidden>a<td>b<tr hidden><td>c<tr><td>d</table>rest", "b\nd\n\nrest"),
        ("<select><option hidden>a<option>b</select> rest", "b rest"),
        ("<head><title>T</title><h1>Hello", "Hello"),
        ("<head><title>T</title>Hello", "Hello"),
        ("<html><head><noscript><style>x</style></noscript><meta charset=x><script>y</script></head><body>Hello", "Hello"),
        ("<head><noscript><p>Hello", "Hello"),
        ("<div>a<head>b</div>c", "ab\nc"),
        ("<div><template></div><p>x</template>y</div>z", "y\nz"),
        ("<div hidden><div>a</div>b<script></div></script>c</div>d", "d"),
        ("a <svg><title>no</title><desc>no</desc><text>seen</text></svg> b", "a seen b"),
        ("<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math>", "x=1"),
        ("<object data=x>fall<b>back</b></object>", "fallback"),
        ("<video>no</video><canvas>no</canvas>yes", "yes"),
    ],
)
def test_visible_text(page, want):
    assert html.page_text(page) == want


def test_closing_slashes_dialogs_details_and_media():
    cases = {
        "<div hidden/>secret</div>shown": "shown",
        "<p>a<br/>b<svg><g hidden/>t</svg>": "a\nbt",
        "<details>a<summary>S</summary>b<p>c</details>d": "S\nd",
        "<details open><summary>S</summary>b</details>": "S\nb",
        "<details><summary>a</summary><summary>b</summary></details>": "a",
        "<dialog>x</dialog>y<dialog open>z</dialog>": "y\nz",
        "<style>@media screen{.h{display:none}} @media print{.p{display:none}} .q{display:none}</style><b class=h>H</b><b class=p>P</b><b class=q>Q</b>": "P",
        "<style>@media print, all{.h{display:none}} @media (max-width:9px){.p{display:none}}</style><b class=h>H</b><b class=p>P</b>": "P",
        "<style>.a.b{display:none} .a{display:inline} .c{visibility:hidden}</style><b class='a b'>1</b><b class=a>2</b><b class='c a'>3</b>": "2",
        "<style>" + "*{display:block}" * 50 + "i{display:none}</style><i>1</i><b>2</b>": "2",
    }
    for page, text in cases.items():
        assert html.page_text(page) == text, page


def test_time_and_text_are_bounded_by_the_page():
    pages = {
        "tables": "<table><tr><td>x" * 20_000,
        "rows": "<table>" + "<tr><td rowspan=0>x" * 20_000,
        "lists": "<ul><li>x" * 20_000,
        "rules": "<style>" + "*{display:block}" * 4000 + "</style>" + "<div>x</div>" * 4000,
        "classes": "<style>" + "".join(f".a.b{i}{{display:block}}" for i in range(4000)) + "</style>" + "<div class='a c'>x</div>" * 4000,
    }
    for name, page in pages.items():
        began = time.process_time()
        text = html.page_text(page)
        assert text.count("x") == page.count("x") and len(text) < 20 * len(page), name
        assert time.process_time() - began < 10, name
