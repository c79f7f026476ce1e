"""Similarity joins on embedding vectors that come as columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo.sources.scratch import cut_lineage, stored

#: Concept vectors that go with the plan; beyond, vectors in a block, and blocks in a cell of the grid.
CONCEPTS, BLOCK, GROUP = 1000, 4096, 16
#: Products of vectors and concepts that are in memory at a time.
TILE = 1 << 20


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; null if one is null or zero."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return _dot(a, b) / F.when(norm != 0, norm)


def _near(known: dict[int, np.ndarray], threshold: float):
    """Does a vector's cosine to one of the concepts (by length) reach the threshold? As by ``cosine``: products
    within 1e-9 of it, and those of sizes out of range, are summed in its order."""
    def pairs(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        dots, own, other = (np.add.accumulate(a * b, axis=1)[:, -1] for a, b in ((x, c), (x, x), (c, c)))
        norm = np.sqrt(own) * np.sqrt(other)
        return (norm != 0) & ~(dots / norm < threshold)

    def tile(x: np.ndarray, concepts: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            sizes = [np.sqrt((v * v).sum(axis=1)) for v in (x, concepts)]
            plain = [(v > 1e-150) & (v < 1e150) for v in sizes]
            cosines, clear = x @ concepts.T / (sizes[0][:, None] * sizes[1]), plain[0][:, None] & plain[1]
            hit = (clear & (cosines >= threshold + 1e-9)).any(axis=1)
            i, j = np.nonzero(~(clear & (cosines < threshold - 1e-9)) & ~hit[:, None])
            for lo in range(0, len(i), 1 << 14):
                a, b = i[lo : lo + (1 << 14)], j[lo : lo + (1 << 14)]
                hit[a[pairs(x[a], concepts[b])]] = True
        return hit

    def run(vectors: pa.Array) -> pa.Array:
        near, lengths = np.zeros(len(vectors), bool), pc.fill_null(pc.list_value_length(vectors), -1).to_numpy()
        for n, concepts in known.items():
            at = np.flatnonzero(lengths == n)
            flat = vectors.take(pa.array(at)).flatten()
            if flat.null_count:
                at = at[~flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, n).any(axis=1)]
                flat = vectors.take(pa.array(at)).flatten()
            x, size = flat.to_numpy().reshape(-1, n), max(TILE // len(concepts), 1)
            for lo in range(0, len(at), size):
                near[at[lo : lo + size]] = tile(x[lo : lo + size], concepts)
        return pa.array(near)

    return run


def drop_near_concepts(entities: DataFrame, concepts: DataFrame, threshold: float = 0.72, vector: str = "embedding") -> DataFrame:
    """Adds ``kept``: the largest cosine to a concept is below the threshold.

    An entity without a vector, and any entity when there are no concepts, is kept. Up to
    ``CONCEPTS`` concepts go with the plan, and batches of vectors are multiplied by them. More
    of them meet the entities in blocks of vectors; cosines are then sums in another order,
    which can tell only where they equal the threshold to the last digits.
    """
    known = concepts.filter(F.col(vector).isNotNull())
    first = known.select(F.col(vector).cast("array<double>").alias("v")).limit(CONCEPTS + 1).collect()
    if len(first) <= CONCEPTS:
        by_length: dict[int, list] = {}
        for r in first:
            if r.v and None not in r.v:
                by_length.setdefault(len(r.v), []).append(r.v)
        near = F.arrow_udf(_near({n: np.array(v) for n, v in by_length.items()}, threshold), "boolean")
        return entities.withColumn("kept", ~near(F.col(vector).cast("array<double>")))
    rows = cut_lineage(entities.withColumn("__row", F.monotonically_increasing_id()))
    near = _near_in_blocks(rows.select(F.col("__row").alias("row"), F.col(vector).alias("v")), known.select(F.col(vector).alias("v")), threshold)
    near = near.select(F.col("row").alias("__row"), F.lit(True).alias("__near"))
    return rows.join(near, "__row", "left").withColumn("kept", F.col("__near").isNull()).drop("__row", "__near")


def _pack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of one length, one after another, as blocks: numbers of their rows and components."""
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        lengths = pc.list_value_length(batch.column(1)).to_numpy()
        cuts = np.unique(np.concatenate((np.flatnonzero(np.diff(lengths)) + 1, np.arange(0, batch.num_rows, BLOCK), [batch.num_rows])))
        for lo, hi in zip(cuts, cuts[1:]):
            ids = batch.column(0).slice(lo, hi - lo).to_numpy().tobytes()
            flat = batch.column(1).slice(lo, hi - lo).flatten().to_numpy().tobytes()
            cols = (pa.array([block]), pa.array([int(lengths[lo])]), pa.array([ids], pa.binary()), pa.array([flat], pa.binary()))
            yield pa.RecordBatch.from_arrays(list(cols), names=["block", "n", "ids", "flat"])
            block += 1


def _blocks(vectors: DataFrame) -> DataFrame:
    """Vectors (``row``, ``v``) in blocks of one length whose first components have like signs."""
    whole = vectors.select("row", F.col("v").cast("array<double>").alias("v")).filter("size(v) > 0 and forall(v, x -> x is not null)")
    signs = F.aggregate(F.slice("v", 1, 12), F.lit(0), lambda s, x: s * 2 + (x >= 0).cast("int"))
    dealt = whole.withColumns({"n": F.size("v"), "signs": signs}).repartitionByRange("n", "signs", "row").sortWithinPartitions("n", "signs")
    return cut_lineage(dealt.select("row", "v").mapInArrow(_pack_blocks, "block bigint, n bigint, ids binary, flat binary"))


def _cell(threshold: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        concepts = []
        for r in right.to_pylist():
            c = np.frombuffer(r["flat"]).reshape(-1, r["n"])
            size = np.sqrt((c * c).sum(axis=1))
            c, size = c[size != 0], size[size != 0]
            if len(c):
                unit = c / size[:, None]
                centre = unit.sum(axis=0)
                centre /= max(np.sqrt((centre * centre).sum()), 1e-300)
                concepts.append((r["n"], unit, centre, np.arccos(np.clip(unit @ centre, -1, 1)).max()))
        found = []
        for r in left.to_pylist():
            ids, x = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["flat"]).reshape(-1, r["n"])
            size = np.sqrt((x * x).sum(axis=1))
            ids, unit = ids[size != 0], x[size != 0] / size[size != 0][:, None]
            for n, others, centre, radius in concepts:
                if n != r["n"] or not len(ids):
                    continue
                # no angle to a member is smaller than that to the centre less the radius
                bound = np.cos(np.maximum(np.arccos(np.clip(unit @ centre, -1, 1)) - radius, 0))
                look = np.flatnonzero(~(bound < threshold - 1e-9))
                hit = look[~((unit[look] @ others.T).max(axis=1) < threshold)]
                found.append(ids[hit])
                ids, unit = np.delete(ids, hit), np.delete(unit, hit, axis=0)
        return pa.table({"row": pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))})

    return run


def _near_in_blocks(entities: DataFrame, concepts: DataFrame, threshold: float) -> DataFrame:
    """``row`` of the entities (``row``, ``v``) with a cosine of the threshold or more to a concept.

    Blocks meet on a grid of groups. A block of concepts is passed over for all entities that
    its centre and radius keep below the threshold, and an entity is done with its first hit.
    """
    left = _blocks(entities)
    right = _blocks(concepts.withColumn("row", F.monotonically_increasing_id()))
    n, columns = max(left.count(), 1), max(-(-right.count() // GROUP), 1)
    rows = max(-(-n // GROUP), min(n, 2 * left.sparkSession.sparkContext.defaultParallelism))

    def group(k: int) -> Column:
        return F.pmod(F.xxhash64("block"), F.lit(k)).cast("int")

    def all_of(k: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(k - 1)))

    left = left.withColumn("i", group(rows)).withColumn("j", all_of(columns))
    right = right.withColumn("j", group(columns)).withColumn("i", all_of(rows))
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(_cell(threshold), "row bigint").distinct()


def sentences(text: Column, longer_than: int = 15) -> Column:
    """Trimmed parts between full stops and line ends that are longer than the given length."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"[.\n]", -1), lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.char_length(s) > longer_than)


def supported(entities: DataFrame, sentence_vectors: DataFrame, key: str = "doc_id", threshold: float = 0.72, own: Sequence[str] = ("pos",)) -> DataFrame:
    """Adds ``supported``: some sentence of the entity's ``key`` is near it.

    Both sides have ``embedding``. An entity without a vector or sentences is supported.
    Vectors are packed into blocks of alike keys; those of a bucket of keys meet on a grid as
    large as the bucket needs, so no key with many vectors is one task and no pair is a row.
    Products that lie at the threshold are summed again component by component.
    """
    rows = stored(entities.withColumn("__row", F.monotonically_increasing_id()))
    buckets = max(rows.count() // BLOCK, rows.sparkSession.sparkContext.defaultParallelism)

    def blocks(df: DataFrame, row: Column) -> DataFrame:
        whole = df.select(F.xxhash64(key).alias("k"), F.col(key).cast("string").alias("name"), row.alias("row"), F.col("embedding").cast("array<double>").alias("v"))
        whole = whole.filter("name is not null and size(v) > 0 and forall(v, x -> x is not null)").withColumn("bucket", F.pmod("k", F.lit(buckets)))
        dealt = whole.withColumn("n", F.size("v")).repartitionByRange("bucket", "row").sortWithinPartitions("bucket", "n")
        return cut_lineage(dealt.select("bucket", "n", "name", "row", "v").mapInArrow(_pack_keyed, "bucket bigint, block bigint, n bigint, names array<string>, ids binary, flat binary"))

    left, right = blocks(rows, F.col("__row")), blocks(sentence_vectors, F.monotonically_increasing_id())
    sizes = left.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("r")).join(right.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("c")), "bucket")

    def placed(df: DataFrame, own: str, other: str, i: str, j: str) -> DataFrame:
        df = df.join(sizes, "bucket").withColumn(i, F.pmod(F.xxhash64("block"), F.col(own))).withColumn(j, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1)))
        return df.drop("r", "c")

    left, right = placed(left, "r", "c", "i", "j"), placed(right, "c", "r", "j", "i")
    cell = ["bucket", "i", "j"]
    met = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(_supported_cell(threshold), "row bigint, hit boolean")
    met = met.groupBy(F.col("row").alias("__row")).agg(F.max("hit").alias("supported"))
    return rows.join(met, "__row", "left").drop("__row").withColumn("supported", F.coalesce("supported", F.lit(True)))


def _pack_keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of one bucket of keys and one length, one after another, as blocks."""
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        bucket, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.unique(np.concatenate((np.flatnonzero((np.diff(bucket) != 0) | (np.diff(n) != 0)) + 1, np.arange(0, batch.num_rows, BLOCK), [batch.num_rows])))
        for lo, hi in zip(cuts, cuts[1:]):
            part = batch.slice(lo, hi - lo)
            ids, flat = part.column(3).to_numpy().tobytes(), part.column(4).flatten().to_numpy().tobytes()
            cols = [pa.array([x]) for x in (int(bucket[lo]), block, int(n[lo]))]
            cols += [pa.array([part.column(2).to_pylist()], pa.list_(pa.string())), pa.array([ids], pa.binary()), pa.array([flat], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["bucket", "block", "n", "names", "ids", "flat"])
            block += 1


def _units(row: dict) -> dict[str, tuple[np.ndarray, ...]]:
    """By key: numbers, vectors and unit vectors; vectors of length 0 are none, lengths out of range give no unit."""
    v, ids, names = np.frombuffer(row["flat"]).reshape(-1, row["n"]), np.frombuffer(row["ids"], np.int64), np.array(row["names"], object)
    with np.errstate(all="ignore"):
        size = np.sqrt((v * v).sum(axis=1))
        unit = np.where(((size > 1e-150) & (size < 1e150))[:, None], v / size[:, None], np.nan)
    order = np.argsort(names, kind="stable")
    order = order[size[order] != 0]
    cuts = np.flatnonzero(names[order][1:] != names[order][:-1]) + 1
    return {names[at[0]]: (ids[at], v[at], unit[at]) for at in np.split(order, cuts) if len(at)}


def _reaches(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Do the cosines of rows reach the threshold, summed in the order of ``cosine``? What is no number does."""
    with np.errstate(all="ignore"):
        dots = [np.add.accumulate(a * b, axis=1)[:, -1] for a, b in ((x, y), (x, x), (y, y))]
        return ~(dots[0] / (np.sqrt(dots[1]) * np.sqrt(dots[2])) < threshold)


def _supported_cell(threshold: float, tile: int = 1024):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        sentences: dict[tuple, list] = {}
        for r in right.to_pylist():
            for name, (_, v, unit) in _units(r).items():
                sentences.setdefault((r["n"], name), []).append((v, unit))
        met: list[tuple[np.ndarray, np.ndarray]] = []
        for r in left.to_pylist():
            for name, (ids, v, unit) in _units(r).items():
                for lo in range(0, len(ids) if (r["n"], name) in sentences else 0, tile):
                    open_ = np.arange(lo, min(lo + tile, len(ids)))
                    hit = np.zeros(len(ids), bool)
                    for others, units in sentences[r["n"], name]:
                        near = unit[open_] @ units.T
                        hit[open_] = (near >= threshold + 1e-9).any(axis=1)
                        i, j = np.nonzero(~(near < threshold - 1e-9) & ~hit[open_][:, None])
                        for at in range(0, len(i), 1 << 16):
                            a, b = open_[i[at : at + (1 << 16)]], j[at : at + (1 << 16)]
                            hit[a[_reaches(v[a], others[b], threshold)]] = True
                        open_ = open_[~hit[open_]]
                    met.append((ids[lo : lo + tile], hit[lo : lo + tile]))
        rows, hits = (np.concatenate(x) for x in zip(*met)) if met else (np.zeros(0, np.int64), np.zeros(0, bool))
        return pa.table({"row": pa.array(rows, pa.int64()), "hit": pa.array(hits, pa.bool_())})

    return run
