"""Alignment of two tokenizers over the same texts.

Both tokenizers cut the bytes of a text (with a space before it) into tokens. Where tokens
of both end at one byte, a group ends. Groups are found by skipping along diagonals: at
index i of the first and j of the second end array, stretches of the arrays at the shift
j - i are compared, twice as long each time they are equal and half as long once they are
not, so a one-to-one stretch is jumped over with a logarithmic number of comparisons of
memory. What stops a jump is an irregular group; it is resolved by walking along both
arrays to the next common end, which sets the shift for the next jump.

A token that ends a group in the first tokenizer is linked with the one that ends it in the
second. ``add_agreement`` counts how often two ids are linked over all documents, and tells
for each document how many of its links are the commonest of their second id.

Both tokenizers cut before a space that follows something else than white space, so ids are
looked up by distinct runs between such places. Runs and ids are remembered in every
worker, bounded in entries and in bytes; long texts go in segments that end at such places.

Defined results: a null or empty text, and one whose tokens do not give its bytes back
(such as one with U+2581), has no tokens, no groups and no links; rows that repeat are
aligned, and counted, one by one; an empty table gives an empty result; other columns,
whatever their names, pass through in ``row``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from cotejo.llm.common import as_row, cut_lineage, write_and_read

#: Runs whose ids a worker keeps, their bytes and ids, and bytes of a segment.
CACHE, BYTES, SEGMENT = 400_000, 8_000_000, 1 << 21
#: Pairs of ids that are broadcast with their counts (some 30 MB); more of them meet the documents by a shuffled join.
BROADCAST_PAIRS = 400_000
#: Fixed value: the pattern that cuts texts for byte-level vocabularies of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteLevel:
    """A byte-level BPE vocabulary file; special strings are plain text."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        # printable bytes stand for themselves, the others for the characters from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        merged = {a + b for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])}
        ranks = {bytes(back[c] for c in t): i for t, i in model["vocab"].items() if len(t) == 1 or t in merged}
        self.bytes = [b""] * (max(model["vocab"].values()) + 1)
        for b, i in ranks.items():
            self.bytes[i] = b
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self._encode = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, runs: list[str]) -> list[list[int]]:
        return [self._encode(r) for r in runs]

    def encode_runs(self, runs: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs one after another and their number in each: those that end in something else
        than white space are cut apart from the next anyway, so they are encoded as one text."""
        lists, at = [], 0
        ends = [k + 1 for k, r in enumerate(runs) if r[-1].isspace()] + [len(runs)]
        for end in ends:
            lists.append(self._encode("".join(runs[at:end])))
            at = end
        ids = np.fromiter(chain.from_iterable(lists), np.int32, sum(map(len, lists)))
        stops = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(sizes), "right")
        return ids, np.diff(stops, prepend=0)


class Pieces:
    """A piece model that puts a space before each text; runs begin with that space."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.space = self.model.piece_to_id("▁")
        #: No piece goes on with a space after something else, so runs can be cut there.
        self.cuts = not any(re.search("[^▁]▁", n) for n in names)

    def encode_runs(self, runs: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs one after another and their number in each; the library gives none for a lone space."""
        lists = [x or [self.space] for x in self.model.encode([r[1:] for r in runs], num_threads=1)]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.int32, int(counts.sum())), counts


class Side:
    """Ids and token lengths of the runs that a worker knows, by their number."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.lengths = tokenizer.lengths
        self.text = [str(i) for i in range(len(tokenizer.bytes))]
        self.clear()

    def clear(self) -> None:
        self.size, self.start, self.flat, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32), 0

    def learn(self, runs: list[str], n: int) -> np.ndarray:
        """Ids of runs, numbered from n on; true for those whose tokens give their bytes back."""
        raw = [r.encode() for r in runs]
        ids, counts = self.tokenizer.encode_runs(runs, np.fromiter(map(len, raw), np.int64, len(raw)))
        m = len(ids)
        if n + len(runs) > len(self.size):
            self.size, self.start = (np.concatenate((x, np.zeros(len(x) + len(runs), np.int64))) for x in (self.size, self.start))
        if self.used + m > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(len(self.flat) + m, np.int32)))
        self.flat[self.used : self.used + m] = ids
        self.size[n : n + len(runs)] = counts
        self.start[n : n + len(runs)] = self.used + np.cumsum(counts) - counts
        self.used += m
        got = [self.tokenizer.bytes[i] for i in ids.tolist()]
        if b"".join(got) == b"".join(raw):  # nearly always
            ends, sizes = np.concatenate(([0], np.cumsum(self.lengths[ids])))[np.cumsum(counts)], np.cumsum([len(r) for r in raw])
            if (ends == sizes).all():
                return np.ones(len(runs), bool)
        stops = np.cumsum(counts).tolist()
        return np.fromiter((b"".join(got[j - k : j]) == r for r, k, j in zip(raw, counts.tolist(), stops)), bool, len(runs))

    def of(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the coded runs one after another, and the number of ids of each run."""
        size = self.size[code]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.start[code] - ends + size, size) + np.arange(total)], size


#: Last bytes of white space that is not ASCII, after C2 and after E1 to E3.
_AFTER_C2, _AFTER_E = (0x85, 0xA0), (*range(0x80, 0x8B), 0x9F, 0xA8, 0xA9, 0xAF)


def cut_places(data: np.ndarray) -> np.ndarray:
    """Where runs begin: at a space that does not follow white space. data: UTF-8 bytes."""
    white = (data == 0x20) | ((data >= 9) & (data <= 13)) | ((data >= 0x1C) & (data <= 0x1F))
    wide = np.zeros(len(data), bool)
    wide[1:] |= (data[:-1] == 0xC2) & np.isin(data[1:], _AFTER_C2)
    wide[2:] |= (data[:-2] >= 0xE1) & (data[:-2] <= 0xE3) & np.isin(data[2:], _AFTER_E)
    at = np.flatnonzero(data == 0x20)
    return at[(at == 0) | ~(white | wide)[at - 1]]


def group_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of both (increasing) end arrays at which groups end. Both have the same last end."""
    x, y = a.tolist(), b.tolist()
    # as bytes, each with a last entry that the other does not have, so that no stretch passes it
    p, q = (np.append(e, last).astype("<i4").tobytes() for e, last in ((a, -1), (b, -2)))
    starts: list[int] = []  # of stretches in x, and the shift to y
    shifts: list[int] = []
    lengths: list[int] = []  # of a stretch with the irregular group after it
    left: list[int] = []  # ends of the irregular groups
    right: list[int] = []
    n, i, j = len(x), 0, 0
    while i < n:
        s, t, w, grows = 4 * i, 4 * j, 4, True
        while w > 3:
            if p[s : s + w] == q[t : t + w]:
                s += w
                t += w
                if grows:
                    w += w
                    continue
            else:
                grows = False
            w >>= 1
        starts.append(i)
        shifts.append(j - i)
        lengths.append((s >> 2) - i + 1)
        i, j = s >> 2, t >> 2
        if i == n:
            left.append(n)
            right.append(n)
            break
        u, v = x[i], y[j]
        while u != v:  # on to the next common end
            if u < v:
                i += 1
                u = x[i]
            else:
                j += 1
                v = y[j]
        left.append(i)
        right.append(j)
        i += 1
        j += 1
    size = np.array(lengths, np.int64)
    stops = np.cumsum(size)
    at = np.repeat(np.array(starts, np.int64) - stops + size, size) + np.arange(int(stops[-1]) if n else 0)
    to = at + np.repeat(np.array(shifts, np.int64), size)
    at[stops - 1], to[stops - 1] = left, right
    whole = at < n  # a text may end with a stretch
    return at[whole], to[whole]


class Aligner:
    """Groups and links of texts."""

    def __init__(self, first: str, second: str):
        self.a, self.b = Side(ByteLevel(first)), Side(Pieces(second))
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.whole = np.zeros(1024, bool)
        self.bytes = 0
        self.a.clear()
        self.b.clear()

    def _codes(self, data: bytes, begins: np.ndarray) -> np.ndarray:
        """Numbers of the runs of a block of texts."""
        offsets = np.append(begins, len(data)).astype(np.int32)
        runs = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        distinct = runs.dictionary.to_pylist()
        if len(self.at) + len(distinct) > CACHE or max(self.bytes, self.a.used, self.b.used) > BYTES:
            self.clear()
        new, n = [r for r in distinct if r not in self.at], len(self.at)
        if new:
            texts = [r.decode() for r in new]
            ok = self.a.learn(texts, n) & self.b.learn(texts, n)
            if n + len(new) > len(self.whole):
                self.whole = np.concatenate((self.whole, np.zeros(len(self.whole) + len(new), bool)))
            self.whole[n : n + len(new)] = ok
            self.at.update(zip(new, range(n, n + len(new))))
            self.bytes += sum(map(len, new))
        return np.fromiter((self.at[r] for r in distinct), np.int64, len(distinct))[runs.indices.to_numpy()]

    def _begins(self, data: bytes, starts: np.ndarray) -> np.ndarray:
        """Begins of runs; each text begins one."""
        if not self.b.tokenizer.cuts:
            return starts
        return np.union1d(cut_places(np.frombuffer(data, np.uint8)), starts)

    def align(self, texts: list[str]) -> Iterator[tuple[int, int, int, str, np.ndarray, np.ndarray]]:
        """For each text: tokens of both, groups, groups as text, linked pairs of ids and how often each."""
        segments, owner = [], []
        for k, t in enumerate(texts):
            for s in self._segments(" " + t) if t else ():
                segments.append(s)
                owner.append(k)
        parts: list[list] = [[] for _ in texts]
        size = 0
        block: list[int] = []
        for i in range(len(segments) + 1):
            if block and (i == len(segments) or size > SEGMENT):
                for k, found in zip(block, self._block([segments[k] for k in block])):
                    parts[owner[k]].append(found)
                block, size = [], 0
            if i < len(segments):
                block.append(i)
                size += len(segments[i])
        for found in parts:
            if not found or None in found:
                yield 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
                continue
            pairs, which = np.unique(np.concatenate([f[4] for f in found]), return_inverse=True)
            times = np.bincount(which, np.concatenate([f[5] for f in found]), len(pairs)).astype(np.int64)
            yield (*(sum(f[c] for f in found) for c in range(3)), ";".join([f[3] for f in found]), pairs, times)

    def _segments(self, text: str) -> list[bytes]:
        data = text.encode()
        if len(data) <= SEGMENT or not self.b.tokenizer.cuts:
            return [data]
        places = cut_places(np.frombuffer(data, np.uint8))
        cuts = sorted({0, *(int(places[min(k, len(places) - 1)]) for k in np.searchsorted(places, np.arange(SEGMENT, len(data), SEGMENT)))})
        return [data[a:b] for a, b in zip(cuts, [*cuts[1:], len(data)])]

    def _block(self, segments: list[bytes]) -> list[tuple | None]:
        """Results of segments; None where tokens do not give the bytes back."""
        sizes = np.array([len(s) for s in segments], np.int64)
        stops = np.cumsum(sizes)
        data = b"".join(segments)
        begins = self._begins(data, stops - sizes)
        code = self._codes(data, begins)
        runs = np.searchsorted(begins, np.append(stops - sizes, len(data)))  # of each segment
        bad = np.add.reduceat(~self.whole[code], runs[:-1])
        sides = []
        for side in (self.a, self.b):
            ids, count = side.of(code)
            bounds = np.concatenate(([0], np.cumsum(count)))[runs]
            sides.append((side, ids, bounds.tolist()))
        out: list[tuple | None] = []
        for k in range(len(segments)):
            if bad[k]:
                out.append(None)
                continue
            (a, ea), (b, eb) = ((ids[at[k] : at[k + 1]], np.cumsum(side.lengths[ids[at[k] : at[k + 1]]])) for side, ids, at in sides)
            out.append(self._groups(a, b, ea, eb))
        if len(self.at) > CACHE or self.bytes > BYTES:
            self.clear()
        return out

    def _groups(self, a: np.ndarray, b: np.ndarray, ea: np.ndarray, eb: np.ndarray) -> tuple:
        left, right = group_ends(ea, eb)
        pairs, which, times = np.unique(a[left].astype(np.int64) << 32 | b[right], return_inverse=True, return_counts=True)
        s, t = self.a.text, self.b.text
        names = [f"{s[x >> 32]}|{t[x & 0xFFFFFFFF]}" for x in pairs.tolist()]
        shown = [names[k] for k in which.tolist()]
        p, q = np.concatenate(([0], left[:-1] + 1)), np.concatenate(([0], right[:-1] + 1))  # where groups begin
        odd = np.flatnonzero((p < left) | (q < right))  # groups that are not one to one
        s, t = [s[k] for k in a.tolist()], [t[k] for k in b.tolist()]
        for k, i, j, m, n in zip(odd.tolist(), p[odd].tolist(), q[odd].tolist(), (left[odd] + 1).tolist(), (right[odd] + 1).tolist()):
            shown[k] = f"{','.join(s[i:m])}|{','.join(t[j:n])}"
        return len(a), len(b), len(left), ";".join(shown), pairs, times


_aligners: dict[tuple[str, str], Aligner] = {}


def _kept(first: str, second: str) -> Aligner:
    """The worker's aligner, with what it has learnt, for all its tasks."""
    if (first, second) not in _aligners:
        _aligners[first, second] = Aligner(first, second)
    return _aligners[first, second]


_LINKS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs array<struct<pair:bigint,times:bigint>>"


def align(docs: DataFrame, first: str, second: str, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """``row``, ``at`` (the number of the row), ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups`` and ``pairs``.

    ``first`` is the file of a byte-level vocabulary, ``second`` that of a piece model that
    puts a space before texts. ``groups`` has the ids of each group, as in ``1,2|5;7|8``.
    ``pairs`` has each linked pair of ids of the row (first * 2^32 + second) and how often it
    is linked. ``keep`` names the columns wanted in ``row`` (by default all).
    """
    row = as_row(docs if keep is None else docs.select(*[F.col(f"`{c}`") for c in keep]))
    source = docs.select(row.alias("row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    kind = StructType([source.schema["row"], StructField("at", LongType()), *StructType.fromDDL(_LINKS)])
    schema = to_arrow_schema(kind)
    pair = schema.field("pairs").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, at = _kept(first, second), TaskContext.get().partitionId() << 33
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                found = list(aligner.align(part.column(1).to_pylist()))
                sizes = np.cumsum([0, *(len(f[4]) for f in found)])
                flat = [np.concatenate([f[c] for f in found]) for c in (4, 5)]
                items = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in flat], fields=list(pair.value_type))
                lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), items).cast(pair)
                counts = [pa.array([f[c] for f in found], pa.int64()) for c in (0, 1, 2, 2)]
                numbers = pa.array(np.arange(at, at + len(found)), pa.int64())
                at += len(found)
                groups = pa.array([f[3] for f in found], pa.string()).cast(schema.field("groups").type)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(schema.field(0).type), numbers, *counts, groups, lists], schema=schema)

    return source.mapInArrow(run, kind)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair``, ``n`` (links of all rows that link it) and ``best`` (no pair of the same second id has more).

    Rows have their pairs once each, and sums are made map-side, so a pair that a third of all
    links have is a row a task.
    """
    counts = aligned.select(F.explode("pairs").alias("x")).groupBy("x.pair").agg(F.sum("x.times").alias("n"))
    counts = cut_lineage(counts.withColumn("second", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))))
    top = counts.groupBy("second").agg(F.max("n").alias("top"))
    return counts.join(top, "second").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def add_agreement(aligned: DataFrame) -> DataFrame:
    """``aligned`` with ``n_best`` (links whose pair is the commonest of its second id) and
    ``count_sum`` (the links' counts, added up), without ``pairs``.

    ``aligned`` (from ``align``, with ``at`` and ``pairs`` and any other columns) is written
    once, as two passes read it. The counts grow with the vocabularies and not with the
    rows: up to ``BROADCAST_PAIRS`` of them are broadcast, more are joined by a shuffle.
    """
    stored = write_and_read(aligned)
    counts = cut_lineage(pair_counts(stored))
    if counts.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS:
        counts = F.broadcast(counts)
    links = stored.select("at", F.explode("pairs").alias("x")).select("at", "x.pair", "x.times")
    sums = links.join(counts, "pair").groupBy("at").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
    )
    out = stored.drop("pairs").join(sums, "at", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("n_best", "count_sum")})
