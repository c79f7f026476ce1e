"""Near-duplicate documents by SimHash and covering locality-sensitive hashing.

A text is lower-cased (A-Z), split into words and taken as three-word shingles; a bit of
its 64-bit fingerprint is set if it is set in over half of the shingles' XXH64 values.
Fingerprints at three or fewer differing bits are linked.

Pairs are found with the covering masks of Pagh (2016): each bit position gets a vector of
F_2^4, and mask v keeps the positions whose vector has an odd product with v. Three
differing positions span at most three dimensions, so some nonzero v is orthogonal to all
of them and the two fingerprints agree under mask v. So fifteen tables find every pair.

Equal fingerprints are first reduced to one row each. Buckets of more than ``bucket``
fingerprints are counted map-side and cut up by a second family of covering masks over the
bits that their mask drops, which loses no pair either. A bucket of that second level
differs in some 15 bits only, so it holds 2^15 or so distinct fingerprints at most,
whatever the input. Inside a bucket a breadth-first search links every fingerprint to the
first of its group, so links grow with the members of a bucket, not with pairs.

Defined results: null and empty texts have fingerprint zero and are linked like others; a
text of one or two words has one shingle; repeated rows share a component; a null id is
never the smallest, so a component of null ids only has a null id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from cotejo.llm.common import cut_lineage
from cotejo.llm.components import stars

RADIUS, SEED, SHINGLE = 3, 42, 3
#: Shingles whose bits are counted at a time, which bounds the memory for very long texts.
BLOCK = 1 << 15


def shingle_hashes(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """The XXH64 values of all shingles of a text, in order."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    width = min(width, len(words))
    n = len(words) - width + 1
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    out = np.empty(n, np.uint64)
    for at in range(0, n, BLOCK):
        stop = min(n, at + BLOCK)
        pairs = zip(starts[at:stop].tolist(), ends[at + width - 1 : stop + width - 1].tolist())
        out[at:stop] = np.fromiter((digest(joined[i:j], SEED) for i, j in pairs), np.uint64, stop - at)
    return out


def fingerprint(hashes: np.ndarray) -> int:
    """The fingerprint of a text's shingles as a signed 64-bit integer; 0 without shingles."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def simhash(text: str | None, width: int = SHINGLE) -> int:
    """The fingerprint of one text."""
    return fingerprint(shingle_hashes(text, width))


@F.pandas_udf(LongType())
def simhash_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([simhash(t) for t in texts], dtype="int64")


def fingerprint_hex(fp: Column) -> Column:
    """Sixteen lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def covering_masks(positions: list[int]) -> list[int]:
    """Signed 64-bit masks over the positions such that any three are missed by some mask."""
    vectors = {p: i % 15 + 1 for i, p in enumerate(positions)}
    out = []
    for v in range(1, 2 ** (RADIUS + 1)):
        mask = sum(1 << p for p, m in vectors.items() if (m & v).bit_count() % 2)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


MASKS = covering_masks(list(range(64)))
#: For each mask, the masks of the second level: the first-level bits and a part of the rest.
SECOND = [[m | s for s in covering_masks([p for p in range(64) if not m >> p & 1])] for m in MASKS]


def bits_apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of signed fingerprints (numpy counts the bits of absolute values)."""
    return np.bitwise_count((x ^ y).view(np.uint64))


def _groups(x: np.ndarray) -> np.ndarray:
    """For distinct fingerprints, the index of the first member of each one's group."""
    first = np.full(len(x), -1)
    rest = np.arange(len(x))
    while len(rest):
        seed, rest = rest[0], rest[1:]
        first[seed] = seed
        front = np.array([seed])
        while len(front) and len(rest):
            near = np.zeros(len(rest), bool)
            for at in range(0, len(front), 64):
                todo = np.flatnonzero(~near)
                d = bits_apart(x[front[at : at + 64], None], x[rest[todo]][None, :])
                near[todo] |= (d <= RADIUS).any(axis=0)
            front, rest = rest[near], rest[~near]
            first[front] = seed
    return first


def _links(batches):
    """Links inside buckets; rows come sorted by t, key, fp, a bucket's rows one after another."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held: list[np.ndarray] = []

    def search(t: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
        starts, stops = np.concatenate(([0], edge)), np.concatenate((edge, [len(fp)]))
        a, b = [], []
        for width in (2, 3):  # the usual sizes all at once
            s = starts[stops - starts == width]
            for i in range(width):
                for j in range(i + 1, width):
                    x, y = fp[s + i], fp[s + j]
                    ok = bits_apart(x, y) <= RADIUS
                    a.append(x[ok])
                    b.append(y[ok])
        large = stops - starts > 3
        for i, j in zip(starts[large].tolist(), stops[large].tolist()):
            x = fp[i:j]
            first = _groups(x)
            ok = first != np.arange(len(x))
            a.append(x[ok])
            b.append(x[first[ok]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], schema=out)

    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)]
        if held:
            cols = [np.concatenate((h, c)) for h, c in zip(held, cols)]
        t, key, _ = cols
        if not len(t):
            continue
        # the last bucket may go on in the next batch
        differ = np.flatnonzero((t != t[-1]) | (key != key[-1]))
        cut = int(differ[-1]) + 1 if len(differ) else 0
        held = [c[cut:] for c in cols]
        if cut:
            yield search(*[c[:cut] for c in cols])
    if held and len(held[0]):
        yield search(*held)


def _under(masks: list[tuple[int, int]]) -> Column:
    """One struct (t, key) for each (table number, mask) of the fingerprint."""
    return F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in masks])).alias("x")


def fingerprint_links(fps: DataFrame, bucket: int = 4096, broadcast_buckets: int = 50_000) -> DataFrame:
    """Links a, b among distinct fingerprints (column fp) that connect all pairs within the radius."""
    tables = fps.select("fp", _under(list(enumerate(MASKS)))).select("fp", "x.*")
    large = cut_lineage(tables.groupBy("t", "key").count().filter(F.col("count") > bucket).select("t", "key", F.lit(True).alias("large")))
    n = large.count()
    if n:
        marked = tables.join(F.broadcast(large) if n <= broadcast_buckets else large, ["t", "key"], "left")
        small = marked.filter("large is null").select("fp", "t", "key")
        second = F.lit(None)
        for t, masks in enumerate(SECOND):
            at = F.array(*[F.struct(F.lit(100 + t * 100 + i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
            second = F.when(F.col("t") == t, at).otherwise(second)
        tables = small.unionByName(marked.filter("large").select("fp", F.explode(second).alias("x")).select("fp", "x.*"))
    dealt = tables.select("t", "key", "fp").repartition("t", "key").sortWithinPartitions("t", "key", "fp")
    return dealt.mapInArrow(_links, "a bigint, b bigint")


def components(marked: DataFrame, bucket: int = 4096) -> DataFrame:
    """``fp``, ``label``, ``component_id`` for each fingerprint of ``marked`` (doc_id, fp)."""
    fps = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("root")))
    joined = stars(fingerprint_links(fps.select("fp"), bucket)).select(F.col("child").alias("fp"), "parent")
    labelled = fps.join(joined, "fp", "left").select("fp", "root", F.coalesce("parent", "fp").alias("label"))
    lowest = labelled.groupBy("label").agg(F.min("root").alias("component_id"))
    return labelled.join(lowest, "label").select("fp", "label", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id", bucket: int = 4096) -> DataFrame:
    """``doc_id``, ``fp`` (signed) and ``component_id`` for every row of ``docs``."""
    marked = cut_lineage(docs.select(F.col(id).alias("doc_id"), simhash_udf(F.col(text).cast("string")).alias("fp")))
    return marked.join(components(marked, bucket), "fp").select("doc_id", "fp", "component_id")
