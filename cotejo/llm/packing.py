"""Packing token sequences into fixed windows with little padding.

Each partition tokenises its documents and packs them online in bounded space: at most
``open_windows`` windows are open; a piece goes where it fits best. When none fits, the
fullest window is filled with a cut of the piece (or padded, if what is missing or left is
under ``min_cut`` tokens) and emitted. What stays open at the end of a partition is merged
with the leftovers of neighbouring partitions by a second pass, which fills windows one
after another; the rest of each such group is split into lengths that are powers of two.

Tokenising works per distinct run of non-space characters of a batch: the tokenizer drops
white space, lower-cases, and always cuts between a letter and a full stop or comma, so a
text's ids are those of such runs in order. Ids of runs are cached, bounded in entries and
in characters, in every worker. A run of plain letters goes straight to the tokenizer's model.

Defined results: a null or empty text is just the end id; every id of every row lies in
exactly one piece; repeated rows are packed as often as they occur; an empty table gives
an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.llm.common import write_and_read

#: Runs whose ids a worker keeps, characters and ids of them, and runs that one call of the tokenizer gets.
CACHE, LETTERS, CALL = 250_000, 8_000_000, 64
#: Runs that are one word for any tokenizer of this kind; a stop that ends a word.
PLAIN, STOP = re.compile("[a-z]+").fullmatch, "([A-Za-zÀ-ÖØ-öø-ÿ])([.,])"
#: Partitions whose leftovers are merged together.
GROUP = 32


class RunEncoder:
    """Ids of texts by a tokenizer that drops white space, computed once per distinct run."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.size = np.zeros(1024, np.int64)
        self.start = np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, np.uint32)
        self.used = self.letters = 0

    def _learn(self, runs: list[str]) -> None:
        plain = [r for r in runs if PLAIN(r)]
        model = self.tokenizer.model
        ids = [[t.id for t in model.tokenize(r)] for r in plain]
        self._keep(plain, np.array([len(x) for x in ids], np.int64), np.array([i for x in ids for i in x], np.uint32))
        rest = [r for r in runs if not PLAIN(r)]
        for i in range(0, len(rest), CALL):
            part = rest[i : i + CALL]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            begins = np.cumsum([0, *(len(r) + 1 for r in part[:-1])])
            owner = np.searchsorted(begins, [a for a, _ in found.offsets], "right") - 1
            counts = np.bincount(owner, minlength=len(part)) if len(owner) else np.zeros(len(part), np.int64)
            self._keep(part, counts, found.ids)

    def _keep(self, runs: list[str], counts: np.ndarray, ids) -> None:
        n, m = len(self.at), len(ids)
        if n + len(runs) > len(self.size):
            self.size, self.start = (np.concatenate((x, np.zeros(len(x) + len(runs), np.int64))) for x in (self.size, self.start))
        if self.used + m > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(len(self.flat) + m, np.uint32)))
        self.flat[self.used : self.used + m] = ids
        self.size[n : n + len(runs)] = counts
        self.start[n : n + len(runs)] = self.used + np.cumsum(counts) - counts
        self.used += m
        self.at.update(zip(runs, range(n, n + len(runs))))
        self.letters += sum(map(len, runs))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and the number of ids of each text."""
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # special tokens are told apart by case
            texts = pc.ascii_lower(texts)
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, STOP, r"\1 \2"))
        runs = pc.dictionary_encode(lists.flatten())
        distinct = runs.dictionary.to_pylist()
        if len(self.at) + len(distinct) > CACHE or max(self.letters, self.used) > LETTERS:
            self.clear()
        known = self.at
        self._learn([r for r in distinct if r not in known])
        code = np.fromiter((known[r] for r in distinct), np.int64, len(distinct))[runs.indices.to_numpy()]
        size = self.size[code]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.start[code] - ends + size, size) + np.arange(total)]
        bounds = np.concatenate(([0], ends))[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return ids, np.diff(bounds)


_encoders: dict[str, RunEncoder] = {}


def _kept(path: str) -> RunEncoder:
    """The worker's encoder: loaded once, with what it has learnt, for all its tasks."""
    if path not in _encoders:
        _encoders[path] = RunEncoder(path)
    return _encoders[path]


class Packer:
    """Bounded-space best fit of pieces (document, its tokens, start, ids) into windows."""

    def __init__(self, window: int, open_windows: int, min_cut: int):
        self.window, self.most, self.min_cut = window, open_windows, min_cut
        self.free: list[tuple[int, int]] = []  # (free tokens, window) of the open ones, sorted
        self.open: dict[int, list[tuple]] = {}
        self.closed: list[list[tuple]] = []
        self.count = 0

    def add(self, doc, ids: np.ndarray) -> None:
        n, start = len(ids), 0

        def piece(size: int) -> tuple:
            return doc, n, start, ids[start : start + size]

        while n - start >= self.window:
            self.closed.append([piece(self.window)])
            start += self.window
        while start < n:
            size = n - start
            i = bisect.bisect_left(self.free, (size, -1))
            if i < len(self.free):  # best fit
                free, w = self.free.pop(i)
                self.open[w].append(piece(size))
                if free == size:
                    self.closed.append(self.open.pop(w))
                else:
                    bisect.insort(self.free, (free - size, w))
                return
            if len(self.free) < self.most:
                self.open[self.count] = [piece(size)]
                bisect.insort(self.free, (self.window - size, self.count))
                self.count += 1
                return
            free, w = self.free.pop(0)  # none fits: the fullest goes
            if free >= self.min_cut and size - free >= self.min_cut:
                self.open[w].append(piece(free))
                start += free
            self.closed.append(self.open.pop(w))


def fill(pieces, window: int):
    """Windows filled one after another from pieces; the last by powers of two."""
    held, used = [], 0
    for doc, n, start, ids in pieces:
        while len(ids):
            take = min(window - used, len(ids))
            held.append((doc, n, start, ids[:take]))
            start, ids, used = start + take, ids[take:], used + take
            if used == window:
                yield held
                held, used = [], 0
    while used:
        size = 1 << used.bit_length() - 1
        now, later, room = [], [], size
        for doc, n, start, ids in held:
            if room:
                now.append((doc, n, start, ids[:room]))
            if len(ids) > room:
                later.append((doc, n, start + room, ids[room:]))
            room -= min(room, len(ids))
        yield now
        held, used = later, used - size


def _rows(sequences, schema: pa.Schema, part: int, number) -> pa.RecordBatch:
    """Sequences (number, pieces) as rows; number(k) gives sequence id and leftover window."""
    cols: list[list] = [[] for _ in range(8)]
    for k, pieces in sequences:
        sequence, home = number(k)
        at = 0
        for doc, n, start, ids in pieces:
            for c, v in zip(cols, (doc, start, ids.astype("<u4").tobytes(), n, sequence, at, part, home)):
                c.append(v)
            at += len(ids)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def _pack_partition(path: str, window: int, open_windows: int, min_cut: int, end_id: int, schema: pa.Schema):
    def run(batches):
        part = TaskContext.get().partitionId()
        encoder, packer, done = _kept(path), Packer(window, open_windows, min_cut), 0
        end = np.array([end_id], np.uint32)
        for batch in batches:
            docs, texts = batch.column(0), pc.fill_null(batch.column(1), "")
            for lo in range(0, batch.num_rows, 1000):
                ids, sizes = encoder.encode(texts.slice(lo, 1000))
                stops = np.cumsum(sizes).tolist()
                start = 0
                for doc, stop in zip(docs.slice(lo, 1000).to_pylist(), stops):
                    packer.add(doc, np.concatenate((ids[start:stop], end)))
                    start = stop
                if packer.closed:
                    yield _rows(enumerate(packer.closed, done), schema, part, lambda k: (part << 32 | k, None))
                    done += len(packer.closed)
                    packer.closed = []
        if packer.open:
            yield _rows(packer.open.items(), schema, part, lambda k: (None, k))

    return run


def _merge(window: int, schema: pa.Schema):
    """Leftovers, sorted by group: each group's pieces fill windows of their own."""

    def run(batches):
        group, pieces = None, []

        def close():
            full = enumerate(fill(pieces, window))
            return _rows(full, schema, -1, lambda k: (1 << 62 | group << 32 | k, None))

        for batch in batches:
            for g, doc, start, ids, n in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if pieces and g != group:
                    yield close()
                    pieces = []
                group = g
                pieces.append((doc, n, start, np.frombuffer(ids, "<u4")))
        if pieces:
            yield close()

    return run


def pack(
    docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text",
    window: int = 2048, open_windows: int = 64, min_cut: int = 8, end_id: int = 1,
) -> DataFrame:
    """One row per piece: the id column, ``start``, ``ids`` (32-bit little-endian), ``doc_tokens``,
    ``sequence_id`` and ``offset``. Group by ``sequence_id`` and order by ``offset`` for the sequences.

    A group of ``GROUP`` partitions has at most ``GROUP * open_windows`` open windows, so
    merging holds a few MB in a task however large the input is.
    """
    source = docs.select(F.col(id).alias("doc"), F.col(text).cast("string").alias("text"))
    kind = source.schema["doc"].dataType.simpleString()
    ddl = f"doc {kind}, start bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, part int, home int"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ddl))
    packed = write_and_read(source.mapInArrow(_pack_partition(tokenizer, window, open_windows, min_cut, end_id, schema), ddl))
    group = F.floor(F.col("part") / GROUP).cast("bigint")
    left = packed.filter("sequence_id is null").withColumn("g", group)
    left = left.repartition("g").sortWithinPartitions("g", "part", "home", "offset").select("g", "doc", "start", "ids", "doc_tokens")
    merged = left.mapInArrow(_merge(window, schema), ddl)
    out = packed.filter("sequence_id is not null").unionByName(merged)
    return out.select(F.col("doc").alias(id), "start", "ids", "doc_tokens", "sequence_id", "offset")
