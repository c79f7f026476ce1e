"""SentencePiece encoding with N-best segmentation, and decoding.

The pieces of a model file span a lattice over a text in which every path is a
segmentation; characters without a piece are spelled in byte pieces, and so is U+2581, which
in pieces stands for a space, where a text has it. A piece's score is
the log probability that Zipf's law gives its rank in the file, or, by choice, the file's
own score (``scores="file"``; for a model of merges minus the rank), in whole millionths so
that sums are exact. The N best paths of a unit are found as in SentencePiece itself: forward
Viterbi scores are an exact heuristic for an A* search from the end of the unit to its
begin, so every popped path is the next best. That is another objective than the merges of
the model file, which ranks pieces and has no probabilities, so the best segmentation of a
text is rarely the library's encoding of it; but it decodes to the text.

No piece has a space after another character, and none a line break, so the lattice falls
apart into units (spaces with the word behind them, and line breaks), and the N best
segmentations of a text are the N smallest sums of the units' losses. Best path and
second loss of a unit are computed once per distinct string and remembered up to
``MAX_UNITS`` a worker; the A* search runs for the units with the N - 1 least losses of a
text, since no other unit can differ from its best path in the N best.

Defined results: a null text counts as empty; an empty text has one segmentation, of no
pieces and score 0; repeated rows are segmented one by one; texts of any length are taken
whole; other columns pass through in ``row``.
"""

from __future__ import annotations

import heapq
import math
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.llm.common import as_row

SPACE = "▁"
#: Stands for that character where a text itself has it, which UTF-8 cannot hold otherwise.
LITERAL = "\udc81"
UNIT = re.compile(f"{SPACE}*[^{SPACE}\n]+|\n|{SPACE}+")
MAX_UNITS, MAX_LETTERS = 200_000, 4_000_000
#: Longest unit that is solved together with others, and how many at a time.
SHORT, TOGETHER = 48, 4096


class Lattice:
    """The scored pieces of a model, and N-best paths through a unit."""

    def __init__(self, path: str, scores: str = "zipf"):
        import sentencepiece

        if scores not in ("zipf", "file"):
            raise ValueError(f"scores are zipf or file, not {scores!r}")
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        total = sum(1 / (r + 10) for r in range(model.get_piece_size()))
        self.pieces: dict[str, tuple[int, int]] = {}  # piece: score, id
        self.bytes = [0] * 256
        self.spelled: list[bytes] = [b""] * model.get_piece_size()
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:-1], 16)
                self.bytes[value], self.spelled[i] = i, bytes((value,))
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if "\n" in piece or SPACE in piece.lstrip(SPACE):
                    raise ValueError(f"pieces may cross units: {piece!r}")
                given = model.get_score(i) if model.get_score(i) > -1e8 else 0.0  # -1e9 marks pieces without a rank
                rank = min(-given, model.get_piece_size())
                self.pieces[piece] = round(1e6 * given) if scores == "file" else self._score(rank, total), i
                self.spelled[i] = piece.replace(SPACE, " ").encode()
        # a byte counts less than any piece; the file gives bytes no score of their own
        least = min(v for v, _ in self.pieces.values())
        self.byte_score = 4 * least if scores == "file" else self._score(4 * model.get_piece_size(), total)
        self.longest = max(map(len, self.pieces))
        #: Pieces with score and id, and beginnings of pieces with None.
        self.starts: dict[str, tuple[int, int] | None] = {p[:i]: None for p in self.pieces for i in range(1, len(p))} | self.pieces

        self._build_trie()

    def _build_trie(self) -> None:
        """The beginnings of pieces as numbered nodes; steps are sorted keys (node, character)."""
        chars = sorted({c for p in self.pieces for c in p})
        self.chars = np.zeros(0x110000, np.int32)  # 0: in no piece
        self.chars[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.width = len(chars) + 1
        number = {p: i for i, p in enumerate(self.starts, 1)} | {"": 0}
        keys = np.array([number[p[:-1]] * self.width + self.chars[ord(p[-1])] for p in self.starts], np.int64)
        order = np.argsort(keys)
        self.steps, self.nodes = keys[order], np.array(list(number.values())[:-1], np.int64)[order]
        found = [(v if v else (0, -1)) for v in self.starts.values()]
        self.node_score = np.array([0, *(v[0] for v in found)], np.int64)
        self.node_id = np.array([-1, *(v[1] for v in found)], np.int32)

    def solve_many(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``solve`` for units of which every character has a piece: all ids one after
        another, and number of ids, score and loss of each unit.

        The units are worked on side by side, position by position.
        """
        sizes = np.array([len(u) for u in units])
        text = self.chars[np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)].astype(np.int64)
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        stop = first + np.repeat(sizes, sizes)
        place = np.arange(len(text))
        at, node, length = place, np.zeros(len(text), np.int64), 0
        begins, ends, found = [], [], []
        while len(at):  # walk the trie from every position at once
            key = node * self.width + text[at + length]
            i = np.minimum(np.searchsorted(self.steps, key), len(self.steps) - 1)
            on = self.steps[i] == key
            at, node, length = at[on], self.nodes[i[on]], length + 1
            whole = self.node_id[node] >= 0
            begins.append(at[whole])
            ends.append(at[whole] + length)
            found.append(node[whole])
            more = at + length < stop[at]
            at, node = at[more], node[more]
        begin, end, node = map(np.concatenate, (begins, ends, found))
        order = np.lexsort((end, begin, begin - first[begin]))  # by place within the unit
        begin, end, node = begin[order], end[order], node[order]
        unit = np.repeat(np.arange(len(units)), sizes)[begin]
        score = self.node_score[node]
        # cuts: one more than characters for each unit
        left, right = begin + unit, end + unit
        low, n = -(1 << 60), len(text) + len(units)
        origin = np.cumsum(sizes + 1) - sizes - 1
        forth, back, rest = np.full(n, low), np.zeros(n, np.int64), np.full(n, low)
        forth[origin] = 0
        rest[origin + sizes] = 0
        steps = np.searchsorted(begin - first[begin], np.arange(int(sizes.max()) + 1))
        for a, b in zip(steps[:-1], steps[1:]):
            reach = forth[left[a:b]] + score[a:b]
            better = np.flatnonzero(reach > forth[right[a:b]])  # ends of one unit's arcs differ
            forth[right[a:b][better]], back[right[a:b][better]] = reach[better], a + better
        for a, b in zip(steps[-2::-1], steps[:0:-1]):
            if a < b:
                heads = np.flatnonzero(np.diff(left[a:b], prepend=-1))
                rest[left[a:b][heads]] = np.maximum.reduceat(rest[right[a:b]] + score[a:b], heads)
        on = np.zeros(len(begin), bool)
        cuts, bottom = origin + sizes, origin
        while len(cuts):
            arcs = back[cuts]
            on[arcs] = True
            cuts = left[arcs]
            go = cuts > bottom
            cuts, bottom = cuts[go], bottom[go]
        best = forth[origin + sizes]
        off = np.where(on, low, forth[left] + score + rest[right])
        through = np.full(len(units), low)
        np.maximum.at(through, unit, off)
        path = np.flatnonzero(on)
        path = path[np.argsort(begin[path])]
        return self.node_id[node[path]], np.bincount(unit[path], minlength=len(units)), best, np.where(through > low // 2, best - through, 1 << 60)

    @staticmethod
    def _score(rank: float, total: float) -> int:
        return round(-1e6 * math.log((rank + 10) * total))

    def arcs(self, unit: str) -> list[list[tuple[int, int, tuple[int, ...]]]]:
        """For each end in the unit: the arcs (begin, score, ids) that lead to it."""
        out: list[list] = [[] for _ in range(len(unit) + 1)]
        for i in range(len(unit)):
            for j in range(i + 1, min(len(unit), i + self.longest) + 1):
                if (found := self.pieces.get(unit[i:j])) is not None:
                    out[j].append((i, found[0], (found[1],)))
            if unit[i] not in self.pieces:
                spelled = _spelling(unit[i])
                out[i + 1].append((i, len(spelled) * self.byte_score, tuple(self.bytes[b] for b in spelled)))
        return out

    def solve(self, unit: str) -> tuple[list[int], int, int]:
        """Ids and score of the best path, and how much the second best loses against it.

        The second best path has an arc off the best one, so the loss is the least over
        such arcs of what the best path through them loses.
        """
        size, starts, low = len(unit), self.starts, -(1 << 60)
        forth, back, arcs = [low] * (size + 1), [(0, ())] * (size + 1), []
        forth[0] = 0
        for i in range(size):
            here = forth[i]
            for j in range(i + 1, size + 1):
                found = starts.get(unit[i:j], 0)
                if found:
                    s, piece = found
                    arcs.append((i, j, s))
                    if here + s > forth[j]:
                        forth[j], back[j] = here + s, (i, (piece,))
                elif found == 0:
                    break
            if unit[i] not in self.pieces:
                spelled = _spelling(unit[i])
                s = len(spelled) * self.byte_score
                arcs.append((i, i + 1, s))
                if here + s > forth[i + 1]:
                    forth[i + 1], back[i + 1] = here + s, (i, tuple(self.bytes[b] for b in spelled))
        on, ids, at = set(), [], size
        while at:
            i, some = back[at]
            on.add((i, at))
            ids[:0] = some
            at = i
        rest = [low] * (size + 1)
        rest[size] = 0
        through = low
        for i, j, s in reversed(arcs):
            behind = rest[j] + s
            if behind > rest[i]:
                rest[i] = behind
            if forth[i] + behind > through and (i, j) not in on:
                through = forth[i] + behind
        return ids, forth[size], forth[size] - through if through > low else 1 << 60

    def best(self, unit: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """The up to n best (score, ids), best first."""
        arcs = self.arcs(unit)
        score = [0] * (len(unit) + 1)
        for j in range(1, len(unit) + 1):
            score[j] = max(score[i] + s for i, s, _ in arcs[j])
        found, count = [], 0
        # entries: negated score of the best full path through, place, order, score behind, path behind;
        # of equal scores the one nearest to the begin goes first, or ties would multiply
        agenda = [(-score[-1], len(unit), 0, 0, None)]
        while agenda and len(found) < n:
            _, at, _, behind, path = heapq.heappop(agenda)
            if at == 0:
                ids: list[int] = []
                while path:
                    ids.extend(path[0])
                    path = path[1]
                found.append((behind, tuple(ids)))
                continue
            for i, s, ids in arcs[at]:
                count += 1
                heapq.heappush(agenda, (-(score[i] + s + behind), i, count, s + behind, (ids, path)))
        return found


def _spelling(char: str) -> bytes:
    return (SPACE if char == LITERAL else char).encode("utf-8", "surrogatepass")


def units_of(text: str | None) -> list[str]:
    """Spaces with the words behind them, and line breaks; a ``SPACE`` of the text itself is spelled in bytes."""
    return UNIT.findall(SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE)) if text else []


class Segmenter:
    """N-best segmentation of whole texts; a worker keeps the solved units."""

    def __init__(self, path: str, n: int, scores: str = "zipf"):
        self.lattice, self.n = Lattice(path, scores), n
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.options: dict[str, list[tuple[int, tuple[int, ...]]]] = {}
        self.table = np.zeros((1024, 4), np.int64)  # start and number of ids, score, loss of the second
        self.flat: np.ndarray = np.zeros(1024, np.int32)
        self.used = self.letters = self.held = 0

    def _learn(self, units: list[str]) -> None:
        known = self.lattice.pieces
        easy = [u for u in units if len(u) <= SHORT and all(map(known.__contains__, u))]
        for lo in range(0, len(easy), TOGETHER):
            some = easy[lo : lo + TOGETHER]
            self._keep(some, *self.lattice.solve_many(some))
        if len(easy) < len(units):
            hard = list(set(units).difference(easy))
            solved = [self.lattice.solve(u) for u in hard]
            sizes = np.array([len(x[0]) for x in solved])
            self._keep(hard, np.fromiter((i for x in solved for i in x[0]), np.int32), sizes, [x[1] for x in solved], [x[2] for x in solved])

    def _keep(self, units: list[str], ids: np.ndarray, sizes: np.ndarray, score, loss) -> None:
        n = len(self.code)
        if n + len(units) > len(self.table):
            self.table = np.concatenate((self.table, np.zeros((n + len(units), 4), np.int64)))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(self.used + len(ids), np.int32)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.table[n : n + len(units)] = np.stack((self.used + np.cumsum(sizes) - sizes, sizes, score, loss), axis=1)
        self.used += len(ids)
        self.code.update(zip(units, range(n, n + len(units))))
        self.letters += sum(map(len, units))

    def _n_best(self, unit: str) -> list[tuple[int, tuple[int, ...]]]:
        if (known := self.options.get(unit)) is None:
            known = self.lattice.best(unit, self.n)
            size = len(unit) + sum(len(ids) for _, ids in known)  # bounded in what it holds, not only in entries
            if len(self.options) > MAX_UNITS // 10 or self.held + size > MAX_LETTERS:
                self.options.clear()
                self.held = 0
            self.options[unit] = known
            self.held += size
        return known

    def _codes(self, units: list[str]) -> np.ndarray:
        codes = np.fromiter(map(self.code.get, units, repeat(-1)), np.int64, len(units))
        lost = np.flatnonzero(codes < 0).tolist()
        if lost:
            fresh = list(dict.fromkeys(units[i] for i in lost))
            if self.code and (len(self.code) + len(fresh) > MAX_UNITS or max(self.letters, self.used) > MAX_LETTERS):
                self.clear()
                return self._codes(units)
            self._learn(fresh)
            codes[lost] = [self.code[units[i]] for i in lost]
        return codes

    def prepare(self, texts: list[list[str]]) -> None:
        """Solve the new units of some texts together."""
        fresh = set().union(*texts)
        lost = [u for u in fresh if u not in self.code]
        if len(self.code) + len(lost) > MAX_UNITS or max(self.letters, self.used) > MAX_LETTERS:
            self.clear()
            lost = list(fresh)
        self._learn(lost)

    def segment(self, text: str | None):
        return self.join(units_of(text))

    def join(self, units: list[str]) -> tuple[np.ndarray, list[int], list[list[tuple[int, int, tuple[int, ...]]]]]:
        """Ids of the best segmentation; scores of the n best; and for each of these the
        differences from the best as (start, number of ids replaced, new ids)."""
        codes = self._codes(units)
        start, size, score, loss = self.table[codes].T if len(codes) else np.zeros((4, 0), np.int64)
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(start - ends + size, size) + np.arange(total)]
        # only the units with the n - 1 smallest second losses can differ in the n best
        k = min(self.n - 1, len(codes))
        near = np.argsort(loss, kind="stable")[:k] if len(codes) < 64 else np.sort(np.argpartition(loss, k)[:k]) if k < len(codes) else np.arange(k)
        sums: list[tuple[int, tuple]] = [(0, ())]
        for u in near.tolist():
            options = self._n_best(units[u])
            grown = [(s + options[0][0] - o, (*d, (u, j)) if j else d) for s, d in sums for j, (o, _) in enumerate(options)]
            sums = heapq.nsmallest(self.n, grown, key=lambda x: x[0])
        base = int(score.sum())
        edits = [
            sorted((int(ends[u] - size[u]), int(size[u]), self._n_best(units[u])[j][1]) for u, j in d) for _, d in sums
        ]
        return ids, [base - s for s, _ in sums], edits


_EDITS = pa.list_(pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32()), ("ids", pa.list_(pa.int32()))])))


def _segment(path: str, n: int, at: int, scores: str):
    def run(batches):
        segmenter = _kept(path, n, scores)
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                texts = [units_of(t) for t in pc.struct_field(part.column(0), [at]).to_pylist()]
                segmenter.prepare(texts)
                done = [segmenter.join(t) for t in texts]
                offsets = np.cumsum([0, *(len(d[0]) for d in done)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([d[0] for d in done]).astype(np.int32)))
                edits = [[[{"start": a, "size": b, "ids": c} for a, b, c in e] for e in d[2]] for d in done]
                sums = pa.array([d[1] for d in done], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, sums, pa.array(edits, _EDITS)], names=["row", "ids", "scores", "edits"])

    return run


_segmenters: dict[tuple[str, int, str], Segmenter] = {}


def _kept(path: str, n: int, scores: str) -> Segmenter:
    if (path, n, scores) not in _segmenters:
        _segmenters[path, n, scores] = Segmenter(path, n, scores)
    return _segmenters[path, n, scores]


_spellings: dict[str, list[bytes]] = {}


def _spelled(path: str) -> list[bytes]:
    """What each piece stands for; all that decoding needs of a model."""
    if path not in _spellings:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        _spellings[path] = [
            bytes((int(m.id_to_piece(i)[3:-1], 16),)) if m.is_byte(i)
            else b"" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i)
            else m.id_to_piece(i).replace(SPACE, " ").encode()
            for i in range(m.get_piece_size())
        ]
    return _spellings[path]


def segment(docs: DataFrame, model: str, n: int = 4, text: str = "text", scores: str = "zipf") -> DataFrame:
    """``row``, ``ids`` (the best segmentation), ``scores`` and ``edits`` of the n best, by Zipf's law or the file's scores.

    ``edits[i]`` turns ``ids`` into the i-th best: at each start, size ids become others.
    """
    source = docs.select(as_row(docs).alias("row"))
    from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

    edit = StructType().add("start", IntegerType()).add("size", IntegerType()).add("ids", ArrayType(IntegerType()))
    schema = StructType().add(source.schema["row"]).add("ids", ArrayType(IntegerType())).add("scores", ArrayType(LongType()))
    return source.mapInArrow(_segment(model, n, docs.columns.index(text), scores), schema.add("edits", ArrayType(ArrayType(edit))))


def decoder(model: str):
    """A vectorised UDF ids -> text: the inverse of segmentation."""

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        spelled = _spelled(model)
        texts = []
        for x in ids:  # one text at a time: a batch of numbers would be large as Python objects
            numbers = x.values.to_numpy().tolist() if x.is_valid else []
            texts.append(b"".join(map(spelled.__getitem__, numbers))[1:].decode("utf-8", "replace"))
        return pa.array(texts, pa.string())

    return decode
