"""Toxicity scores by a convolutional text classifier trained in numpy.

A word's embedding is the sum of hashed embeddings of the word and its beginnings of three
to six letters. Filters of widths 1, 2 and 3 slide over the words, the maximum of each
filter over the whole text is kept, and a logistic unit gives the score. The logits are
shifted by a threshold per language, so that 0.5 is the best cut in each; the language is
guessed from frequent words of the text itself and no column but the text is read.

Training uses at most about ``per_class`` labelled texts of each class (a documented bound:
rows are taken by a hash of the id, equal texts once, by the smallest id; ids or texts with
both labels are left out). Scoring reads every whole text
in pieces of bounded size, of which the maxima are combined.

Defined results: a null or empty text counts as a text without words and gets the score of
one; repeated rows are scored one by one; without labels of both classes every score is
the share of toxic labels, or 0 if there are none.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo.llm.common import as_row

#: Rows of the embedding table, its width, filters of each width, and the widths.
BUCKETS, WIDTH, FILTERS, SPANS = 1 << 16, 8, 8, (1, 2, 3)
#: Beginnings of words that are hashed beside the whole word (0).
STARTS = (0, 3, 4, 5, 6)
#: Words of a piece when scoring.
PIECE = 1 << 17
#: Distinct words, and bytes of them, of which a worker keeps the filter outputs.
MAX_WORDS, MAX_BYTES = 200_000, 4_000_000
PAD = 0
#: Frequent words that tell the languages apart.
MARKERS = {
    "en": ("the", "and", "of", "to", "is", "that"),
    "fr": ("le", "et", "les", "des", "que", "du"),
    "de": ("der", "die", "und", "das", "von", "ist"),
    "es": ("el", "y", "los", "en", "las", "por"),
}
_BREAK = bytes(32 if b < 128 and not chr(b).isalnum() else b for b in range(256))


def words_of_text(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters and digits (all characters beyond ASCII count as such)."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_BREAK).split()


def word_rows(word: bytes) -> list[int]:
    """Rows of the embedding table for a word and its beginnings; row 0 stays zero."""
    letters = word.decode("utf-8", "replace")
    keys = [word] + [letters[:n].encode() + b"*" if len(letters) >= n else b"" for n in STARTS[1:]]
    return [zlib.crc32(k) % (BUCKETS - 1) + 1 if k else PAD for k in keys]


def guess_language(words: list[bytes]) -> int:
    """Index of the language with most marker words among all words, 0 if none."""
    seen = Counter(words)
    hits = [sum(seen[m.encode()] for m in ms) for ms in MARKERS.values()]
    return hits.index(max(hits))


@dataclass
class Model:
    """Weights; ``shift`` is subtracted from the logit by language; ``constant`` without training."""

    table: np.ndarray
    filters: list[np.ndarray]  # for each width: (width, WIDTH, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    shift: list[float] = field(default_factory=lambda: [0.0] * len(MARKERS))
    constant: float | None = None


class Scorer:
    """A model at work: filter outputs of up to ``MAX_WORDS`` distinct words are kept."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.code: dict[bytes, int] = {}
        self.bytes = 0
        self.outputs = np.zeros((1024, sum(SPANS) * FILTERS), np.float32)

    def _learn(self, words: list[bytes]) -> None:
        n, m = len(self.code), self.model
        embedded = m.table[np.array([word_rows(w) for w in words])].sum(axis=1)
        if n + len(words) > len(self.outputs):
            self.outputs = np.concatenate((self.outputs, np.zeros((n + len(words), self.outputs.shape[1]), np.float32)))
        self.outputs[n : n + len(words)] = np.concatenate([embedded @ f for block in m.filters for f in block], axis=1)
        self.code.update(zip(words, range(n, n + len(words))))
        self.bytes += sum(map(len, words))

    def _codes(self, words: list[bytes]) -> np.ndarray:
        codes = np.fromiter(map(self.code.get, words, repeat(-1)), np.int64, len(words))
        lost = np.flatnonzero(codes < 0).tolist()
        if lost:
            fresh = list(dict.fromkeys(words[i] for i in lost))
            if len(self.code) and (len(self.code) + len(fresh) > MAX_WORDS or self.bytes > MAX_BYTES):
                self.clear()
                return self._codes(words)
            self._learn(fresh)
            codes[lost] = [self.code[words[i]] for i in lost]
        return codes

    def pool(self, texts: list[list[bytes]]) -> np.ndarray:
        """Maxima of all filters over the words of each text, at least 0."""
        sizes = np.array([len(t) for t in texts])
        best = np.zeros((len(texts), len(SPANS) * FILTERS), np.float32)
        flat = self._codes(list(chain.from_iterable(texts)))
        if not len(flat):
            return best
        ends = np.cumsum(sizes)
        full = np.flatnonzero(sizes)
        at = 0
        for s, span in enumerate(SPANS):
            value = np.zeros((len(flat), FILTERS), np.float32)
            for j in range(span):
                value[: len(flat) - j] += self.outputs[flat[j:], at : at + FILTERS]
                at += FILTERS
            value += self.model.bias[s]
            for j in range(1, span):  # a filter that would run past its text gives nothing
                value[(ends - j)[sizes >= j]] = 0
            best[full, s * FILTERS : (s + 1) * FILTERS] = np.maximum.reduceat(value, (ends - sizes)[full], axis=0)
        return np.maximum(best, 0)

    def logit(self, texts: list[list[bytes]]) -> np.ndarray:
        """Logits before the shift by language; long texts go in overlapping pieces."""
        m, reach, out = self.model, max(SPANS) - 1, np.zeros(len(texts))
        held: list[int] = []
        count = 0

        def flush() -> None:
            if held:
                out[held] = self.pool([texts[i] for i in held]) @ m.out + m.out_bias

        for i, words in enumerate(texts):
            if len(words) > PIECE:
                parts = (words[a : a + PIECE + reach] for a in range(0, len(words), PIECE))
                best = np.maximum.reduce([self.pool([p])[0] for p in parts])
                out[i] = best @ m.out + m.out_bias
                continue
            count += len(words)
            if count > PIECE:
                flush()
                held.clear()
                count = len(words)
            held.append(i)
        flush()
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.model.constant is not None:
            return np.full(len(texts), self.model.constant)
        out = np.zeros(len(texts))
        for lo in range(0, len(texts), 256):
            words = [words_of_text(t) for t in texts[lo : lo + 256]]
            shift = np.array([self.model.shift[guess_language(w)] for w in words])
            out[lo : lo + 256] = self.logit(words) - shift
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _warm_start(docs: list[np.ndarray], labels: np.ndarray, used: int) -> np.ndarray:
    """Smoothed log odds of each table row between texts of the two classes."""
    seen = np.zeros((2, used))
    for rows, y in zip(docs, labels):
        seen[int(y), rows] += 1
    n = np.bincount(labels.astype(int), minlength=2)
    rate = (seen + 0.5) / (n[:, None] + 1)
    odds = np.log(rate[1]) - np.log(rate[0])
    trust = seen.sum(axis=0) / (seen.sum(axis=0) + 4)
    return odds * trust


def train(texts: list[str], labels: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 0.05, seed: int = 7) -> Model:
    """Fit the classifier; the last fifth of the rows sets the thresholds."""
    rng = np.random.default_rng(seed)
    labels = np.asarray(labels, np.float64)
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.0
        return Model(np.zeros((1, WIDTH)), [], [], np.zeros(0), 0.0, constant=share)
    index: dict[bytes, int] = {}
    # word lists take some ten times the memory of codes, so one text has one at a time
    coded = [np.array([index.setdefault(w, len(index)) for w in words_of_text(t)], np.int32) for t in texts]
    rows_of = np.fromiter(chain.from_iterable(map(word_rows, index)), np.int64).reshape(-1, len(STARTS)) if index else np.zeros((1, len(STARTS)), np.int64)
    del index
    order = rng.permutation(len(texts))
    cut = max(1, len(order) * 4 // 5)
    fit, held = order[:cut], order[cut:]

    table = rng.normal(0, 0.02, (BUCKETS, WIDTH)).astype(np.float32)
    distinct = [np.unique(rows_of[np.unique(c)]) if len(c) else np.zeros(0, np.int64) for c in coded]
    table[:, 0] = _warm_start([distinct[i] for i in fit], labels[fit], BUCKETS) / len(STARTS)
    table[PAD] = 0
    filters = [rng.normal(0, 0.2, (s, WIDTH, FILTERS)).astype(np.float32) for s in SPANS]
    filters[0][0, 0, :] = 1.0
    bias = [np.zeros(FILTERS, np.float32) for _ in SPANS]
    out = np.concatenate([np.full(FILTERS, 0.2 if s == 0 else 0.02, np.float32) for s in range(len(SPANS))])
    model = Model(table, filters, bias, out, -1.0)
    weight = {0.0: 0.5 / max(1e-9, 1 - labels[fit].mean()), 1.0: 0.5 / max(1e-9, labels[fit].mean())}
    grow = {"t": np.full(BUCKETS, 1e-2, np.float32), "o": np.full_like(out, 1e-2), "b": 1e-2}
    grow |= {f"f{s}": np.full_like(filters[s], 1e-2) for s in range(len(SPANS))} | {f"c{s}": np.full_like(bias[s], 1e-2) for s in range(len(SPANS))}
    for _ in range(epochs):
        fit = rng.permutation(fit)
        for lo in range(0, len(fit), batch):
            some = fit[lo : lo + batch]
            _descend(model, [coded[i] for i in some], rows_of, labels[some], weight, grow, rate)
    _calibrate(model, [texts[i] for i in held], labels[held])
    return model


def _descend(model: Model, docs: list[np.ndarray], rows_of: np.ndarray, y: np.ndarray, weight: dict, grow: dict, rate: float) -> None:
    """One Adagrad step; only the positions that gave the maxima take part."""
    docs = [np.concatenate((d, np.full(max(0, max(SPANS) - len(d)), -1))) for d in docs]  # -1: no word
    sizes = np.array([len(d) for d in docs])
    starts = np.cumsum(sizes) - sizes
    known, flat = np.unique(np.concatenate(docs), return_inverse=True)
    rows = np.where((known >= 0)[:, None], rows_of[known], PAD)
    embedded = model.table[rows].sum(axis=1)
    top, where = [], []
    for s, span in enumerate(SPANS):
        value = np.full((len(flat), FILTERS), -np.inf, np.float32)
        n = len(flat) - span + 1
        value[:n] = 0
        for j in range(span):
            value[:n] += (embedded @ model.filters[s][j])[flat[j : j + n]]
        value[:n] += model.bias[s]
        for j in range(1, span):
            value[starts + sizes - j] = -np.inf
        # the first position of each text and filter that has the maximum
        at = np.stack([value[a : a + n].argmax(axis=0) + a for a, n in zip(starts, sizes)])
        top.append(value[at, np.arange(FILTERS)])
        where.append(at)
    pooled = np.maximum(np.concatenate(top, axis=1), 0)
    live = pooled > 0
    p = 1 / (1 + np.exp(-np.clip(pooled @ model.out + model.out_bias, -30, 30)))
    error = ((p - y) * np.array([weight[float(v)] for v in y])).astype(np.float32) / len(docs)

    def step(key, value, gradient):
        grow[key] += gradient * gradient
        return value - rate * gradient / np.sqrt(grow[key])

    back = error[:, None] * model.out[None, :] * live
    model.out = step("o", model.out, error @ pooled)
    model.out_bias = float(step("b", model.out_bias, float(error.sum())))
    down = np.zeros_like(embedded)
    for s, span in enumerate(SPANS):
        own = back[:, s * FILTERS : (s + 1) * FILTERS]
        gradient = np.zeros_like(model.filters[s])
        for j in range(span):
            word = flat[where[s] + j]
            gradient[j] = np.einsum("df,dfw->wf", own, embedded[word])
            np.add.at(down, word, own[:, :, None] * model.filters[s][j].T[None])
        model.bias[s] = step(f"c{s}", model.bias[s], own.sum(axis=0))
        model.filters[s] = step(f"f{s}", model.filters[s], gradient)
    used = np.flatnonzero(np.abs(down).sum(axis=1))
    touched, to = np.unique(rows[used], return_inverse=True)
    g = np.zeros((len(touched), WIDTH), np.float32)
    np.add.at(g, to.reshape(-1), np.repeat(down[used], rows.shape[1], axis=0))
    g[touched == PAD] = 0
    grow["t"][touched] += (g * g).mean(axis=1)
    model.table[touched] -= rate * g / np.sqrt(grow["t"][touched])[:, None]


def _calibrate(model: Model, texts: list[str], y: np.ndarray, least: int = 5) -> None:
    """The cut with fewest errors, for each language with enough rows of both classes, else for all."""
    if not len(y):
        return
    own, logits, language = Scorer(model), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for lo in range(0, len(texts), 64):
        words = [words_of_text(t) for t in texts[lo : lo + 64]]
        logits[lo : lo + 64] = own.logit(words)
        language[lo : lo + 64] = [guess_language(w) for w in words]

    def best_cut(z: np.ndarray, t: np.ndarray) -> float:
        order = np.argsort(z)
        z, t = z[order], t[order]
        # cutting below i: positives below are missed, negatives from i on are false
        wrong = np.concatenate(([0], np.cumsum(t))) + np.concatenate((np.cumsum((1 - t)[::-1])[::-1], [0]))
        ties = np.flatnonzero(wrong == wrong.min())
        i = ties[len(ties) // 2]
        below = z[i - 1] if i > 0 else z[0] - 1
        above = z[i] if i < len(z) else z[-1] + 1
        return float((below + above) / 2)

    everywhere = best_cut(logits, y) if 0 < y.sum() < len(y) else 0.0
    for i in range(len(MARKERS)):
        own = language == i
        n, k = int(own.sum()), int(y[own].sum())
        model.shift[i] = best_cut(logits[own], y[own]) if min(k, n - k) >= least else everywhere


def training_sample(docs: DataFrame, labels: DataFrame, trainable: Column, per_class: int = 3000, id: str = "doc_id", text: str = "text") -> pd.DataFrame:
    """Labelled texts (``text``, ``toxic``), about ``per_class`` of each class at most.

    ``trainable`` is a condition on the id. Labels are counted first; then each class is
    thinned by a hash of the id, so that texts beyond the bound are never moved.
    """
    marks = labels.filter(trainable).select(F.col(id).alias("id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1) and id is not null")
    marks = marks.groupBy("id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).filter("toxic = other").drop("other")
    counts = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, F.lit(per_class / max(counts.get(1, 0), per_class))).otherwise(F.lit(per_class / max(counts.get(0, 0), per_class)))
    marks = marks.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000)
    texts = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(marks), "id")  # at most about 2 * per_class rows
    found = found.groupBy("text").agg(F.min("id").alias("id"), F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).filter("toxic = other")
    return found.orderBy(F.xxhash64("id"), "id").select("text", "toxic").toPandas()


def scorer(model: Model):
    """A vectorised UDF text -> score."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Scorer(model)
        for texts in batches:
            yield pd.Series(own.score(texts.tolist()))

    return score


def score_documents(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``row`` (the input row) and ``score`` (0 to 1)."""
    out = docs.select(as_row(docs).alias("row"))
    return out.withColumn("score", scorer(model)(F.col("row")[text].cast("string")))


def fit(docs: DataFrame, labels: DataFrame, trainable: Column | None = None, per_class: int = 3000) -> Model:
    """A model for the labelled rows for which ``trainable`` holds."""
    sample = training_sample(docs, labels, F.lit(True) if trainable is None else trainable, per_class)
    return train(sample["text"].tolist(), sample["toxic"].to_numpy())
