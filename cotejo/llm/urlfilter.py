"""URL filters: prefix rules, and a Bloom filter cascade for exact list membership.

The cascade covers a closed universe, the distinct keys of the corpus. Level 0 encodes the
listed keys. Level 1 encodes the unlisted keys that level 0 wrongly accepts, level 2 the
listed keys that level 1 wrongly accepts, and so on until a level accepts nothing wrongly.
A key of the universe is listed exactly if the number of levels that accept it in
succession is odd. So a page is judged by bit tests, without a join.

Levels are built by Spark (bits are or-ed in 32-bit words, so the driver gets one row per
word that is set). A cascade takes about 12 bits a listed key. If it would exceed
``max_bits`` the pages are joined with the listed keys instead; the verdicts are the same.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no
rule and is not listed; repeated rows are judged one by one; an empty table gives none.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo.llm.common import as_row, cut_lineage

#: Bits used of each hash: with the factors of ``_factor`` products stay within 64 bits.
MASK = (1 << 44) - 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


@dataclass(frozen=True)
class Rule:
    """A rule for a host, its subdomains and a path prefix: ``net/de/`` is net and /de/."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits as a struct rule, verdict (nulls if none fits)."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        out = F.when(r.fits(host, path), F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


@dataclass
class Cascade:
    """Levels of (bits as uint32 words, number of bits, number of hashes)."""

    levels: list[tuple[np.ndarray, int, int]] = field(default_factory=list)

    def bits(self) -> int:
        return sum(m for _, m, _ in self.levels)

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Membership of keys of the universe, given their two hashes."""
        depth = np.zeros(len(h1), dtype=np.int32)
        alive = np.ones(len(h1), dtype=bool)
        for i, (words, m, k) in enumerate(self.levels):
            hit = alive.copy()
            for j in range(k):
                at = _positions(h1, h2, i, j, m)
                hit &= (words[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1
            alive = hit
            depth += hit
        return depth % 2 == 1


def _factor(level: int, j: int) -> int:
    return 16 * level + j + 1


def _positions(h1: np.ndarray, h2: np.ndarray, level: int, j: int, m: int) -> np.ndarray:
    """Position of hash j on a level: as ``_position`` computes it in Spark."""
    return ((h1 & np.int64(MASK)) + _factor(level, j) * (h2 & np.int64(MASK))) % m


def _position(h1: Column, h2: Column, level: int, j: int, m: int) -> Column:
    return F.pmod(h1.bitwiseAND(F.lit(MASK)) + h2.bitwiseAND(F.lit(MASK)) * _factor(level, j), F.lit(m))


def key_hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(key, F.lit("second"))


def _member(cascade: Cascade):
    """A vectorised UDF (h1, h2) -> boolean; the bits are broadcast once."""

    @F.pandas_udf("boolean")
    def member(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(cascade.contains(h1.to_numpy(np.int64), h2.to_numpy(np.int64)))

    return member


def build_cascade(universe: DataFrame, rate: float = 0.01, max_bits: int = 1 << 30, max_levels: int = 64) -> Cascade | None:
    """The cascade for ``universe`` (distinct ``key``, boolean ``listed``); None beyond ``max_bits``.

    The first level has the given false-positive rate, later ones one half. Keys that are
    still undecided after each level are the only ones read for the next.
    """
    h1, h2 = key_hashes(F.col("key"))
    pending = cut_lineage(universe.select("listed", h1.alias("h1"), h2.alias("h2")))
    out = Cascade()
    for level in range(max_levels):
        inside = level % 2 == 0  # this level encodes listed keys
        n = pending.filter(F.col("listed") == inside).count()
        if n == 0:
            return out
        p = rate if level == 0 else 0.5
        # odd, and never twice the same, so that keys that meet on one level part on another
        m = (max(64, math.ceil(n * math.log2(1 / p) * 1.4427)) | 1) + 2 * level
        k = max(1, round(math.log2(1 / p)))
        if out.bits() + m > max_bits:
            return None
        at = F.explode(F.array(*[_position(F.col("h1"), F.col("h2"), level, j, m) for j in range(k)]))
        rows = (
            pending.filter(F.col("listed") == inside).select(at.alias("at"))
            .groupBy(F.shiftright("at", 5).alias("word"))
            .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(31)).cast("int"))).alias("bits"))
            .toPandas()
        )  # at most m / 32 + 1 rows
        words = np.zeros(m // 32 + 1, dtype=np.uint32)
        words[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).astype(np.uint32)
        out.levels.append((words, m, k))
        # what this level accepts wrongly must be refused by the next, all it encodes accepted there
        one = Cascade([(words, m, k)])
        hit = _level_member(one, level)(F.col("h1"), F.col("h2"))
        pending = cut_lineage(pending.filter((F.col("listed") == inside) | hit))
    return None  # two keys share both hashes


def _level_member(one: Cascade, level: int):
    words, m, k = one.levels[0]

    @F.pandas_udf("boolean")
    def member(h1: pd.Series, h2: pd.Series) -> pd.Series:
        a, b = h1.to_numpy(np.int64), h2.to_numpy(np.int64)
        hit = np.ones(len(a), dtype=bool)
        for j in range(k):
            at = _positions(a, b, level, j, m)
            hit &= (words[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1
        return pd.Series(hit)

    return member


def filter_urls(
    pages: DataFrame, listed: DataFrame, rules: list[Rule], url: str = "url", rate: float = 0.01, max_bits: int = 1 << 27
) -> DataFrame:
    """``row``, ``host``, ``path``, ``rule``, ``in_list`` and ``verdict`` for every page.

    ``listed`` holds hosts (column ``key``) to block; hosts that no page has are of no use
    and left out. A rule that fits outranks the list. ``max_bits`` bounds the broadcast.
    """
    u = F.col("row")[url]
    judged = pages.select(as_row(pages).alias("row")).select("row", url_host(u).alias("host"), url_path(u).alias("path"))
    hosts = judged.select(F.col("host").alias("key")).filter("key <> ''").distinct()
    marks = listed.select(F.col("key").cast("string"), F.lit(True).alias("listed")).dropDuplicates(["key"])
    universe = hosts.join(marks, "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed"))
    cascade = build_cascade(universe, rate, max_bits)
    if cascade is None:
        marks = marks.select(F.col("key").alias("listed_key"))
        judged = judged.join(marks, F.col("host") == F.col("listed_key"), "left").withColumn("in_list", F.col("listed_key").isNotNull())
    elif not cascade.levels:
        judged = judged.withColumn("in_list", F.lit(False))
    else:
        h1, h2 = key_hashes(F.col("host"))
        judged = judged.withColumn("in_list", (F.col("host") != "") & _member(cascade)(h1, h2))
    best = longest_rule(F.col("host"), F.col("path"), rules)
    return judged.withColumn("best", best).select(
        "row", "host", "path", F.col("best.rule").alias("rule"), "in_list",
        F.coalesce(F.col("best.verdict"), F.when(F.col("in_list"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
    )
