"""The language of a text is that of all its words."""

from cotejo.llm import toxicity


def test_language_of_a_text_with_a_foreign_beginning():
    words = [b"code"] * 1000 + [b"der", b"und"]
    assert toxicity.guess_language(words) == list(toxicity.MARKERS).index("de")
    assert toxicity.guess_language([b"the"] * 1000 + [b"les"] * 1001) == list(toxicity.MARKERS).index("fr")
    assert toxicity.guess_language([]) == 0
