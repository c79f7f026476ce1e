"""Long texts may be cut anywhere, also inside a contraction."""

import random
import time

import public_tokenizers
from tokenizers import Tokenizer

from cotejo.llm import tokencount


def test_cuts_at_every_position(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    strings = ["we'll you're I've it's he'd I'm they'lx a'r 'v", "a'll'll're've'l'r!'ll ''ve \n'll", "'ll", "x'", "é'll 漢're1've"]
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(strings, add_special_tokens=False)]
    counter = tokencount.TokenCounter(path)
    for piece in range(1, 50):
        monkeypatch.setattr(tokencount, "PIECE", piece)
        assert counter.count(strings).tolist() == want, piece


def test_long_runs_equal_the_library(monkeypatch):
    """Runs without a boundary over many chunks and pieces, also where entries of chunks do not settle at once."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    draw = random.Random(5)
    strings = [
        "a" * 3001, "ab" * 2000, "é漢🙂" * 700, "=" * 5000, " " * 4000 + "x", "1" * 999 + "'ll" * 50, "\n \t" * 800,
        "".join(draw.choice("etaoinshrdlu") for _ in range(6000)), "".join(chr(draw.choice((97, 233, 0x4E00, 39, 32, 108))) for _ in range(4000)),
    ]
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(strings, add_special_tokens=False)]
    counter = tokencount.TokenCounter(path)
    for piece, span, spans, rounds, states in [(1 << 20, 128, 64, 8, 150_000), (700, 7, 5, 8, 150_000), (1000, 16, 9, 1, 150_000), (333, 32, 4, 3, 50)]:
        for name, value in {"PIECE": piece, "SPAN": span, "SPANS": spans, "ROUNDS": rounds, "MAX_STATES": states}.items():
            monkeypatch.setattr(tokencount, name, value)
        assert counter.count(strings).tolist() == want, (piece, span)


def test_composed_maps():
    maps = [{0: (1, 2), 5: (6, 1)}, {1: (0, 3), 0: (2, 1)}, {0: (4, 1), 2: (2, 7)}]
    assert tokencount.compose(maps)[-1] == {0: (4, 6)} and tokencount.compose(maps)[1] == {0: (0, 5)}


def test_time_of_one_run_is_linear(monkeypatch):
    monkeypatch.setattr(tokencount, "PIECE", 1 << 14)
    counter = tokencount.TokenCounter(public_tokenizers.path("byte_bpe_50k.json"))
    draw = random.Random(6)
    text = "".join(draw.choices("etaoinshrdlu", k=1 << 16))

    def seconds(t):
        start = time.perf_counter()
        counter.count([t])
        return time.perf_counter() - start

    assert seconds(text * 8) < 2 * (8 * seconds(text) + 1)
