"""Token counts by finite-state transducers for a byte-level BPE tokenizer.

Two deterministic machines give the number of tokens without building them:

* A scanner with ``STATES`` states splits a text into pretokens (contractions, letters,
  digits, others, white space). Texts are cut into chunks of equal length; every chunk is
  run from all states at once, which gives its map from entry to exit state. The maps are
  composed by a parallel prefix scan, and a second run from the true entry states marks
  the boundaries. Chunks need not know where words or texts begin.
* A transducer over bytes counts the tokens of a pretoken. Its transitions carry the
  change of the token count. A state holds what can still matter: the longest suffix that
  may grow into a token, and the last token and relative count at each cut within it. It
  is determinised as it is used and cleared at ``MAX_STATES`` states.

  A pretoken of up to ``LONGEST`` bytes is a chunk that is entered at the start. Longer ones
  are cut into chunks of ``SPAN`` bytes; each is run from the few states that can occur at its
  begin, which gives a partial map from entry to exit state with the tokens emitted between
  them, and the maps are composed by a prefix scan as well.

Counts of pretokens of up to ``LONGEST`` bytes are remembered, ``MAX_WORDS`` of them a worker.

Defined results: a null text counts as empty (no bytes, no tokens); repeated rows are
counted one by one; texts of any length are counted in pieces of ``PIECE`` code points, and
both machines go on from piece to piece, so a run without any boundary costs no more than others.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo.llm.common import as_row

CHUNK, PIECE = 512, 1 << 20
MAX_STATES, MAX_WORDS, LONGEST = 150_000, 400_000, 64
#: Bytes of a chunk of the transducer and of its warm-up, chunks that are composed at once and that are remembered,
#: rounds in which the entries of chunks have to settle.
SPAN, WARM, SPANS, MAX_CHUNKS, ROUNDS = 128, 24, 64, 4096, 8
#: The state of the transducer before the first byte.
BEGIN = (b"", ((None, 0),))

# Classes of characters.
LETTER, NUMBER, BLANK, WHITE, QUOTE, OTHER, ONE, TWO_E, TWO_L, E, END = range(11)
CLASSES = 11
# States of the scanner: what the characters since the last boundary are.
START, LETTERS, NUMBERS, OTHERS, BLANK1, BLANKS, WHITE1, WHITES, QUOTED, HALF_E, HALF_L, CONTRACTED = range(12)
STATES = 12
#: Marks of a transition: a pretoken begins at this character, or at the one before.
HERE, BEFORE = 1, 2
#: Characters with the Unicode property White_Space.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    table[WHITE_SPACE] = WHITE
    for chars, c in ((" ", BLANK), ("'", QUOTE), ("stmd", ONE), ("rv", TWO_E), ("l", TWO_L), ("e", E)):
        table[[ord(x) for x in chars]] = c
    return table


def _step(state: int, c: int) -> tuple[int, int]:
    """Next state and mark of the scanner."""
    letter = c in (LETTER, ONE, TWO_E, TWO_L, E)
    pending = BEFORE if state in (HALF_E, HALF_L) else 0  # an apostrophe and one letter
    if c == END:
        return START, HERE | pending
    if state == QUOTED and c in (ONE, TWO_E, TWO_L):
        return {ONE: CONTRACTED, TWO_E: HALF_E, TWO_L: HALF_L}[c], 0
    if (state, c) in ((HALF_E, E), (HALF_L, TWO_L)):
        return CONTRACTED, 0
    if c in (BLANK, WHITE):
        if state in (BLANK1, BLANKS, WHITE1, WHITES):
            return (BLANKS if c == BLANK else WHITES), 0
        return (BLANK1 if c == BLANK else WHITE1), HERE | pending
    same = LETTERS if letter else NUMBERS if c == NUMBER else OTHERS
    if state == same or (state == QUOTED and same == OTHERS):
        return same, 0
    if pending:
        return (LETTERS, BEFORE) if letter else (QUOTED if c == QUOTE else same, BEFORE | HERE)
    if state == BLANK1:  # the blank belongs to what follows
        return same, 0
    if state == BLANKS:
        return same, BEFORE
    return (QUOTED if c == QUOTE else same), (BEFORE | HERE if state == WHITES else HERE)


NEXT = np.array([_step(s, c)[0] for s in range(STATES) for c in range(CLASSES)], np.uint8)
MARK = np.array([_step(s, c)[1] for s in range(STATES) for c in range(CLASSES)], np.uint8)


def scan(classes: np.ndarray, entry: int = START) -> tuple[np.ndarray, int]:
    """The marks of the scanner for the classes of characters one after another, and the state behind the last."""
    n = len(classes)
    lanes = max(1, -(-n // CHUNK))
    grid = np.full(lanes * CHUNK, END, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(lanes, CHUNK).T)
    maps = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], lanes, axis=1)
    for row in grid:
        maps = NEXT[maps * np.uint8(CLASSES) + row]
    step = 1
    while step < lanes:  # maps[:, i] becomes the map of all chunks up to i
        maps[:, step:] = np.take_along_axis(maps[:, step:], maps[:, :-step].astype(np.intp), axis=0)
        step *= 2
    state = np.concatenate(([entry], maps[entry, :-1])).astype(np.uint8)
    marks, end = np.empty_like(grid), entry
    for j, row in enumerate(grid):
        at = state * np.uint8(CLASSES) + row
        marks[j] = MARK[at]
        state = NEXT[at]
        if n and j == (n - 1) % CHUNK:
            end = int(state[-1])
    return marks.T.reshape(-1)[:n], end


def boundaries(classes: np.ndarray) -> np.ndarray:
    """True where a pretoken begins, for the classes of characters one after another."""
    marks, _ = scan(classes)
    begins = (marks & HERE) > 0
    begins[:-1] |= (marks[1:] & BEFORE) > 0
    return begins


#: A map of a chunk: entry state to exit state and emitted tokens, for the entries that can occur.
Map = dict[int, tuple[int, int]]


def compose(maps: list[Map]) -> list[Map]:
    """Element i becomes the map of all chunks up to i, by a prefix scan."""
    step = 1
    while step < len(maps):
        ahead = [{s: (b[t][0], n + b[t][1]) for s, (t, n) in a.items() if t in b} for a, b in zip(maps, maps[step:])]
        maps = maps[:step] + ahead
        step *= 2
    return maps


class WordCounter:
    """The byte transducer of one BPE vocabulary, built as it is used."""

    def __init__(self, vocabulary: dict[bytes, int], ranks: dict[tuple[bytes, bytes], int]):
        self.ranks = ranks
        self.tokens = {t for t in vocabulary if self.encode(t) == [t]}
        self.prefixes = {t[:i] for t in self.tokens for i in range(len(t))}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.words: dict[bytes, int] = {}
        self.clear()

    def clear(self) -> None:
        # a state: suffix, and (last token, count relative to the end) at each cut in it
        self.states: list[tuple] = [BEGIN]
        self.number = {BEGIN: 0}
        self.steps: list[dict[int, tuple[int, int]]] = [{}]
        self.chunks: dict[tuple[int, bytes], tuple[int, int]] = {}

    def encode(self, word: bytes) -> list[bytes]:
        """Byte-pair encoding as defined: the lowest-ranked pair merges first."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _fits(self, left: bytes | None, right: bytes) -> bool:
        """May ``right`` follow ``left``? Encodings are exactly the sequences of such pairs."""
        if left is None:
            return True
        if (known := self.pairs.get((left, right))) is None:
            if len(self.pairs) > 4 * MAX_STATES:
                self.pairs.clear()
            known = self.pairs[left, right] = self.encode(left + right) == [left, right]
        return known

    def _build(self, state: int, byte: int) -> tuple[int, int]:
        suffix, cuts = self.states[state]
        grown = suffix + bytes((byte,))
        for size in range(len(grown), 0, -1):  # the last token of the grown prefix
            token = grown[-size:]
            last, count = cuts[-size]
            if token in self.tokens and self._fits(last, token):
                break
        else:
            raise ValueError(f"no token ends with byte {byte}")
        delta = count + 1
        keep = next(i for i in range(len(grown) + 1) if grown[i:] in self.prefixes)
        after = (*((t, c - delta) for t, c in cuts[keep:]), (token, 0))
        to = self._number((grown[keep:], after))
        self.steps[state][byte] = to, delta
        return to, delta

    def _number(self, state: tuple) -> int:
        """The number of a state, which may be new."""
        if (n := self.number.get(state)) is None:
            n = self.number[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
        return n

    def _run(self, state: int, chunk: bytes) -> tuple[int, int]:
        """The state behind a chunk, and the tokens that it emits."""
        n = 0
        for byte in chunk:
            step = self.steps[state].get(byte) or self._build(state, byte)
            state = step[0]
            n += step[1]
        return state, n

    def _chunk(self, entry: int, chunk: bytes) -> tuple[int, int]:
        """As ``_run``; chunks that come again are not run again."""
        if (found := self.chunks.get((entry, chunk))) is None:
            if len(self.chunks) >= MAX_CHUNKS:
                self.chunks.clear()
            found = self.chunks[entry, chunk] = self._run(entry, chunk)
        return found

    def _maps(self, state: int, chunks: list[bytes]) -> list[Map] | None:
        """The maps of chunks over the entries that can occur; None if these do not settle in a few rounds.

        A chunk is first run from where the last ``WARM`` bytes before it lead from the start,
        as runs from unlike entries soon meet, and then from each exit found for the chunk
        before it, so the true entry is among its entries.
        """
        maps: list[Map] = [{} for _ in chunks]
        todo = [(0, state), *((i, self._run(0, chunks[i - 1][-WARM:])[0]) for i in range(1, len(chunks)))]
        for _ in range(ROUNDS):
            exits = []
            for i, entry in todo:
                if entry not in maps[i]:
                    maps[i][entry] = self._chunk(entry, chunks[i])
                    exits.append((i + 1, maps[i][entry][0]))
            todo = [(i, entry) for i, entry in exits if i < len(chunks) and entry not in maps[i]]
            if not todo:
                return maps
        return None

    def feed(self, state: tuple, word: bytes) -> tuple[tuple, int]:
        """The state behind a part of a pretoken that is entered in ``state``, and the tokens that it emits.

        The maps of its chunks are composed by a prefix scan. Between blocks of chunks the table
        of states may be cleared, so states are handed on by value.
        """
        total = 0
        for at in range(0, len(word), SPAN * SPANS):
            if len(self.states) > MAX_STATES:
                self.clear()
            block = word[at : at + SPAN * SPANS]
            entry = self._number(state)
            maps = self._maps(entry, [block[i : i + SPAN] for i in range(0, len(block), SPAN)])
            to, n = compose(maps)[-1][entry] if maps else self._run(entry, block)
            state, total = self.states[to], total + n
        return state, total

    def count(self, word: bytes) -> int:
        if (n := self.words.get(word)) is not None:
            return n
        if len(word) > LONGEST:
            return self.feed(BEGIN, word)[1]
        if len(self.states) > MAX_STATES:
            self.clear()
        if len(self.words) >= MAX_WORDS:
            self.words.clear()
        n = self.words[word] = self._run(0, word)[1]
        return n


def _byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write a byte that does not print as the next free character from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenCounter:
    """Token counts as of a tokenizer file (``.json``, byte-level BPE without normaliser)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = _byte_alphabet()

        def raw(token: str) -> bytes:
            return bytes(byte[c] for c in token)

        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        ranks = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.words = WordCounter({raw(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}, ranks)
        self.classes = _classes()

    def _words(self, text: str, codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Tokens of the pretokens that begin at ``begins``; the last one ends with the text."""
        width = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
        offsets = np.concatenate(([0], np.cumsum(width)))[np.append(begins, len(codes))].astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(text.encode())])
        words = words.dictionary_encode()
        each = np.fromiter(map(self.words.count, words.dictionary.to_pylist()), np.int64, len(words.dictionary))
        return each[words.indices.to_numpy()]

    def _counts(self, units: list[str]) -> np.ndarray:
        """Tokens of each unit."""
        if not units:
            return np.zeros(0, np.int64)
        text = "\0" + "\0".join(units) + "\0"
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        classes = self.classes[codes]
        ends = np.cumsum([0, *(len(u) + 1 for u in units)])  # the characters between units
        classes[ends] = END
        begins = np.flatnonzero(boundaries(classes))
        each = self._words(text, codes, begins)
        at = np.searchsorted(begins, ends)
        each[at] = 0
        return np.add.reduceat(each, at)[:-1]

    def _long(self, text: str) -> int:
        """Tokens of one unit, piece by piece; scanner and transducer go on where the last piece ended.

        Whether a pretoken begins at a character is known behind the next one, so the last
        character of a piece is held back.
        """
        total, scanner, state, held, opens = 0, START, BEGIN, "", False
        for at in range(0, len(text) + 1, PIECE):
            piece = text[at : at + PIECE]
            codes = np.frombuffer((held + piece).encode("utf-32-le"), np.uint32)
            classes = self.classes[codes[len(held) :]]
            if at + PIECE > len(text):
                classes = np.append(classes, np.uint8(END))
            marks, scanner = scan(classes, scanner)
            here = np.append(np.full(len(held), opens), (marks & HERE) > 0)
            here[: len(here) - 1] |= (marks[1 - len(held) :] & BEFORE) > 0
            known = len(here) - 1  # characters that are settled
            settled, begins = (held + piece)[:known], np.flatnonzero(here[:known])
            first = int(begins[0]) if len(begins) else known
            state, n = self.words.feed(state, settled[:first].encode())
            total += n
            if len(begins):
                last = int(begins[-1])
                if last > first:
                    total += int(self._words(settled[first:last], codes[first:last], begins[:-1] - first).sum())
                state, n = self.words.feed(BEGIN, settled[last:].encode())
                total += n
            held, opens = (held + piece)[known:], bool(here[-1])
        return total

    def count(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        units: list[str] = []
        owner: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal size
            np.add.at(out, owner, self._counts(units))
            units.clear()
            owner.clear()
            size = 0

        for i, text in enumerate(texts):
            parts = [text or ""]
            for s in self.special:
                parts = [p for x in parts for p in x.split(s)]
            out[i] += len(parts) - 1  # each special string is one token
            for p in parts:
                if len(p) > PIECE:
                    out[i] += self._long(p)
                else:
                    units.append(p)
                    owner.append(i)
                    size += len(p)
                    if size > PIECE:
                        flush()
        if units:
            flush()
        return out


def token_counter(path: str):
    """A vectorised UDF text -> number of tokens; workers keep their machine between batches."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _kept(path)
        for texts in batches:
            yield pd.Series(counter.count(texts.tolist()))

    return count


_machines: dict[str, TokenCounter] = {}


def _kept(path: str) -> TokenCounter:
    if path not in _machines:
        _machines[path] = TokenCounter(path)
    return _machines[path]


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """``row`` (the input row), ``n_bytes``, ``n_tokens`` and ``over_limit``."""
    t: Column = F.coalesce(F.col("row")[text].cast("string"), F.lit(""))
    out = docs.select(as_row(docs).alias("row")).select("row", F.octet_length(t).cast("bigint").alias("n_bytes"), token_counter(tokenizer)(t).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
