"""One document of each group of near duplicates: SimHash with an exact check of similarity.

A text is lower-cased (A-Z), split into words and taken as the set of its shingles' XXH64
values. Texts whose sets have a Jaccard similarity of ``threshold`` or more are linked.

Equal sets are first reduced to one row each, known by the XXH64 value of the set.
Candidates are the members of common buckets. The tables are those of the SimHash operator:
the fifteen covering masks, under which every pair whose fingerprints differ in three bits
or fewer meets for certain. Pairs of similarity 0.8 differ in ten of 64 bits, for which
covering masks would take 2^11 tables and more, so their reach is widened by 24 bands of
five minima of the same hashes: a pair of 0.8 shares a bucket with a probability of
1 - (1 - 0.8^5)^24 = 0.9999, and more similar ones still surer. Every candidate is decided
by its exact similarity. In each bucket all members are compared with its smallest, then, in
rounds, those of other components with a pivot, as long as each round halves what is left;
members that this leaves in different components are compared with one another, block by
block inside of tasks. So the pairs that become rows grow with the members of a bucket, and
all pairs of a bucket are compared only where it holds texts that are not alike.

Defined results: null and empty texts have the empty set and are alike; a text of fewer
words than a shingle has one shingle; repeated rows share a component, also those that
repeat an id, and one of them stays; a null id is never the smallest, so a component of
null ids only keeps one of its rows; an empty table gives none.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from cotejo.llm import simhash
from cotejo.llm.common import as_row, cut_lineage
from cotejo.llm.components import stars

WIDTH, THRESHOLD, SEED = 5, 0.8, 42
BANDS, ROWS = 24, 5
#: Shingles whose minima are taken at a time, which bounds the memory for very long texts.
BLOCK = 1 << 12
FACTORS, OFFSETS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
FACTORS |= np.uint64(1)
#: Most rows of a side that is broadcast (ids or keys of some 50 bytes); beyond it both sides are shuffled.
FEW = 500_000
#: Most rounds with pivots; what they leave apart is compared in tiles of two blocks.
PIVOTS, TILE = 8, 512


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct XXH64 values of the shingles of a text, sorted."""
    return np.unique(simhash.shingle_hashes(text, width))


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def set_key(shingles: np.ndarray) -> int:
    """What stands for a set; 0 for the empty one."""
    return int(_signed([xxhash.xxh64_intdigest(shingles.tobytes(), SEED)])[0]) if len(shingles) else 0


MASKS = np.array(simhash.MASKS, np.int64)


def band_keys(shingles: np.ndarray, mark: int) -> np.ndarray:
    """The bucket of each covering mask of the fingerprint and of each band; none for the empty set."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), BLOCK):
        low = np.minimum(low, (shingles[at : at + BLOCK, None] * FACTORS + OFFSETS).min(axis=0))
    buckets = [*low.reshape(BANDS, ROWS), *(mark & MASKS)]
    return _signed([xxhash.xxh64_intdigest(x.tobytes(), t) for t, x in enumerate(buckets)])


def _key_udf(width: int):
    @F.pandas_udf(LongType())
    def key(texts: pd.Series) -> pd.Series:
        return pd.Series([set_key(shingle_set(t, width)) for t in texts], dtype="int64")

    return key


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _marked(texts: DataFrame, width: int) -> DataFrame:
    """``doc_id``, ``key``, ``n`` (distinct shingles) and ``bands`` for each row of ``texts`` (doc_id, text)."""

    def mark(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                keys, sizes, bands = [], [], []
                for text in part.column(1).to_pylist():
                    hashes = simhash.shingle_hashes(text, width)
                    own = np.unique(hashes)
                    keys.append(set_key(own))
                    sizes.append(len(own))
                    bands.append(band_keys(own, simhash.fingerprint(own)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), _lists(bands)], ["doc_id", "key", "n", "bands"])

    schema = StructType([texts.schema["doc_id"], StructField("key", LongType()), StructField("n", LongType()), StructField("bands", ArrayType(LongType()))])
    return texts.mapInArrow(mark, schema)


def _if_few(df: DataFrame) -> DataFrame:
    """``df`` (written before), to be broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def _sets(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``key`` and ``shingles`` of the sets in ``wanted`` (key, root), from the rows of their roots."""

    def gather(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                sets = [shingle_set(t, width) for t in batch.column(0).slice(at, 512).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.int64()), _lists(sets)], ["key", "shingles"])

    roots = _if_few(cut_lineage(wanted.select("root").distinct()))
    rows = texts.join(roots, texts["doc_id"].eqNullSafe(roots["root"]), "left_semi").select("text")
    found = rows.mapInArrow(gather, "key bigint, shingles array<bigint>")
    return found.join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"])


def _alike(pairs: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """The pairs a, b whose sets have at least the similarity, in whole numbers."""
    p, q = threshold.numerator, threshold.denominator
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a")
    both = both.join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b")
    return both.filter(F.size(F.array_intersect("x", "y")) * F.lit(p + q) >= (F.size("x") + F.size("y")) * F.lit(p)).select("a", "b")


def _apart(shared: DataFrame, found: DataFrame) -> tuple[DataFrame, int]:
    """Members (h, key, n, label) of the buckets that hold more than one component, and their number."""
    placed = shared.join(found.withColumnRenamed("child", "key"), "key", "left").select("h", "key", "n", F.coalesce("parent", "key").alias("label"))
    mixed = placed.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("h")
    rest = cut_lineage(placed.join(mixed, "h", "left_semi"))
    return rest, rest.count()


def _links(threshold: Fraction):
    """Links between different components inside tiles; rows come sorted by tile.

    A row is a member of a bucket (or of one block of it) with its shingles and all its
    buckets; a pair is compared only in the smallest bucket that both are in.
    """
    p, q = threshold.numerator, threshold.denominator
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def alike(rows: list[tuple]) -> tuple[list[int], list[int]]:
        h, i, j = rows[0][:3]
        left = [r for r in rows if r[3] == i]
        right = left if i == j else [r for r in rows if r[3] == j]
        if not left or not right:
            return [], []
        keys, labels, sizes = (np.array([r[k] for r in right], np.int64) for k in (4, 5, 6))
        flat = np.concatenate([r[7] for r in right])
        starts = np.cumsum([0, *(len(r[7]) for r in right)])[:-1]
        bands, owner = np.concatenate([r[8] for r in right]), np.repeat(np.arange(len(right)), [len(r[8]) for r in right])
        a, b = [], []
        for r in left:
            able = (labels != r[5]) & (q * np.minimum(sizes, r[6]) >= p * np.maximum(sizes, r[6]))
            if i == j:
                able &= keys > r[4]
            if not able.any():
                continue
            shared = np.isin(bands, r[8])
            low = np.full(len(right), np.iinfo(np.int64).max)
            np.minimum.at(low, owner[shared], bands[shared])
            able &= low == h
            if not able.any():
                continue
            at = np.minimum(np.searchsorted(r[7], flat), len(r[7]) - 1)
            common = np.add.reduceat((r[7][at] == flat).astype(np.int64), starts)
            ok = np.flatnonzero(able & (common * (p + q) >= (sizes + r[6]) * p))
            a += [r[4]] * len(ok)
            b += keys[ok].tolist()
        return a, b

    def run(batches):
        tile: list[tuple] = []
        for batch in batches:
            cols = [batch.column(k) for k in range(9)]
            numbers = [c.to_numpy(zero_copy_only=False).astype(np.int64).tolist() for c in cols[:7]]
            lists = [(c.values.to_numpy(), c.offsets.to_numpy().tolist()) for c in cols[7:]]
            for k, row in enumerate(zip(*numbers)):
                if tile and tile[0][:3] != row[:3]:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in alike(tile)], schema=out)
                    tile = []
                tile.append((*row, *(v[o[k] : o[k + 1]].copy() for v, o in lists)))
        if tile:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in alike(tile)], schema=out)

    return run


def _linked_in_tiles(rest: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """Links a, b between members of different components that share a bucket of ``rest``.

    Buckets are cut into blocks of about ``TILE`` members, and a task compares two blocks,
    so pairs are never rows and what a task holds does not grow with a bucket.
    """
    counts = rest.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("blocks"))
    own = rest.groupBy("key").agg(F.first("n").alias("n"), F.first("label").alias("label"), F.collect_list("h").alias("bands"))
    members = cut_lineage(own.join(sets, "key").withColumn("shingles", F.array_sort("shingles")))
    dealt = rest.select("h", "key").join(counts, "h").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("h", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key")
    rows = dealt.join(members, "key").select("h", "i", "j", "block", "key", "label", "n", "shingles", "bands")
    tiles = rows.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j")
    return tiles.mapInArrow(_links(threshold), "a bigint, b bigint")


def components(texts: DataFrame, marked: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """``key``, ``root`` (smallest id) and ``label`` of each distinct set; equal labels are linked."""
    limit = Fraction(str(threshold))
    distinct = cut_lineage(marked.groupBy("key").agg(F.min("doc_id").alias("root"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    members = distinct.select("key", "n", F.explode("bands").alias("h"))
    buckets = members.groupBy("h").agg(F.min("key").alias("low"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("h", "low")
    shared = cut_lineage(members.join(buckets, "h").select("h", "key", "n", "low"))
    sets = cut_lineage(_sets(texts, distinct.select("key", "root").join(shared.select("key").distinct(), "key", "left_semi"), width))
    first = cut_lineage(shared.filter("key <> low").select(F.col("low").alias("a"), F.col("key").alias("b")).distinct())
    found = stars(_alike(first, sets, limit))

    # members of one bucket that are not yet in one component: with a pivot first, as long as that joins them
    tried = first
    rest, size = _apart(shared, found)
    for turn in range(PIVOTS if size else 0):
        pivots = rest.groupBy("h").agg(F.min(F.struct(F.xxhash64("key", F.lit(turn)).alias("by"), "key", "label")).alias("p"))
        met = rest.join(pivots, "h").filter("label <> p.label").select(F.least("key", "p.key").alias("a"), F.greatest("key", "p.key").alias("b")).distinct()
        met = cut_lineage(met.join(tried, ["a", "b"], "left_anti"))
        tried = tried.unionByName(met)
        found = stars(found.select(F.col("child").alias("a"), F.col("parent").alias("b")).unionByName(_alike(met, sets, limit)))
        before = size
        rest, size = _apart(shared, found)
        if 2 * size > before:
            break
    # then those that are still apart, block by block
    more = _linked_in_tiles(rest, sets, limit) if size else tried.limit(0)
    joined = stars(found.select(F.col("child").alias("a"), F.col("parent").alias("b")).unionByName(more))
    return distinct.join(joined.withColumnRenamed("child", "key"), "key", "left").select("key", "root", F.coalesce("parent", "key").alias("label"))


def drop_near_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id", width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each component, that of its smallest id, with exactly the columns of ``docs``."""
    texts = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    marked = cut_lineage(_marked(texts, width))
    best = F.min(F.struct(F.col("root").isNull().alias("none"), "root", "key")).alias("x")
    kept = components(texts, marked, width, threshold).groupBy("label").agg(best).select(F.col("x.key").alias("key"), F.col("x.root").alias("doc_id"))
    kept = cut_lineage(kept)
    # an id that one row has tells what becomes of it; rows that share an id, or have none, by their keys
    ids = marked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    several = cut_lineage(ids.filter("rows > 1 or doc_id is null").select("doc_id"))
    gone = cut_lineage(marked.select("doc_id").join(kept.select("doc_id"), "doc_id", "left_anti").join(several, "doc_id", "left_anti").filter("doc_id is not null"))
    by_id = F.col("__id").eqNullSafe
    rows = docs.withColumn("__id", F.col(id))
    few = _if_few(several.withColumnRenamed("doc_id", "__several"))
    out = _if_few(gone.withColumnRenamed("doc_id", "__gone"))
    alone = rows.join(out, F.col("__id") == F.col("__gone"), "left_anti").join(few, by_id(F.col("__several")), "left_anti").select(*docs.columns)
    if several.isEmpty():
        return alone
    shared = rows.join(few, by_id(F.col("__several")), "left_semi").select(as_row(docs).alias("row"), _key_udf(width)(F.col(text).cast("string")).alias("key"))
    chosen = shared.join(kept, "key").filter(F.col("row")[id].eqNullSafe(F.col("doc_id"))).dropDuplicates(["key"]).select("row.*")
    return alone.unionByName(chosen)
