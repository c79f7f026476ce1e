"""Sources and sinks: file catalogs, contents, taxonomy files, tables and reports."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cotejo.functions.text import report_slug
from cotejo.sources.scratch import cut_lineage


def read_jdbc(
    spark: SparkSession, url: str, table: str, key: str | None = None, low: int | None = None, high: int | None = None, parts: int = 1, **options: str
) -> DataFrame:
    """A table of a relational database, read in parallel by ranges of a whole-number key.

    Bounds that are not given are asked of the database. Filters and columns of later steps
    are pushed down to it by Spark. Rows without a key are in the first range.
    """
    if key is None or parts < 2:
        return spark.read.jdbc(url, table, properties=options)
    if low is None or high is None:
        query = f"SELECT MIN({key}) AS LOW, MAX({key}) AS HIGH FROM {table}"
        first, last = spark.read.jdbc(url, f"({query}) B", properties=options).first()
        low, high = (first if low is None else low), (last if high is None else high)
        if low is None or high is None:  # no keys, so no ranges
            return spark.read.jdbc(url, table, properties=options)
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=max(high, low + 1), numPartitions=parts, properties=options)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    """Rows as a table of a relational database, one connection a partition."""
    df.write.jdbc(url, table, mode=mode, properties=options)


def scan_files(spark: SparkSession, folder: str) -> DataFrame:
    """All files below a folder, whole tree, no truncation: path, name, size, modified."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


#: Paths of a listing that are sent to all tasks (some 200 bytes each).
LISTED = 200_000


def load_contents(spark: SparkSession, folder: str, listing: DataFrame | None = None) -> DataFrame:
    """Files with their bytes: ``path``, ``length``, ``content``.

    ``listing`` has the paths that are wanted (by default all files below the folder). A file
    of it that is not there gives a row without length and content; one that goes away or
    cannot be read while the job runs gives none. Spark does not list files without bytes.

    Bytes are never moved: paths are matched first, without opening a file, and the scan is
    filtered by those found. Beyond ``LISTED`` paths the bytes meet them in a shuffled join.
    A file is one value here, of 2 GB at most; ``checksums`` reads larger ones in parts.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    loaded = reader.option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True).load(folder).select("path", "length", "content")
    if listing is None:
        return loaded
    wanted = listing.select("path").distinct()
    there = scan_files(spark, folder).select("path")
    missing = wanted.join(there, "path", "left_anti").select("path", F.lit(None).cast("bigint").alias("length"), F.lit(None).cast("binary").alias("content"))
    few = wanted.limit(LISTED + 1).count() <= LISTED
    return loaded.join(F.broadcast(wanted) if few else wanted, "path", "left_semi").unionByName(missing)


#: Files of more bytes are read in parts by several tasks.
WHOLE = 32 << 20
#: Files that Spark's text source would unpack; they are read whole.
PACKED = r"(?i)\.(gz|bz2|deflate|snappy|lz4|zst)$"
POLYNOMIAL = 0xEDB88320
MARK = b"\xef\xbb\xbf"


def _product(a: int, b: int) -> int:
    """Of two polynomials modulo that of CRC-32; the highest bit is x^0."""
    out = 0
    for i in range(32):
        if a & (0x80000000 >> i):
            out ^= b
        b = (b >> 1) ^ (POLYNOMIAL if b & 1 else 0)
    return out


def joined_crc(first: int, second: int, length: int) -> int:
    """The CRC-32 of two runs of bytes from those of each and the length of the second."""
    shift, power = 0x80000000, 0x00800000  # x^0 and x^8
    while length:
        if length & 1:
            shift = _product(shift, power)
        power, length = _product(power, power), length >> 1
    return _product(first, shift) ^ second


def _part_crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per part of a file the bytes of its lines, each with its line feed, their CRC-32 and that without the last line feed."""
    part, size, crc, open_ = None, 0, 0, 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"file": [part[0]], "start": [part[1]], "size": [size], "crc": [crc], "open": [open_]})

    for batch in batches:
        names, starts = (batch[c].to_numpy(zero_copy_only=False) for c in ("file", "start"))
        ends = np.append(np.flatnonzero((names[1:] != names[:-1]) | (starts[1:] != starts[:-1])) + 1, len(names)) if len(names) else []
        at = 0
        for end in map(int, ends):
            here = (int(names[at]), int(starts[at]))
            if here != part:
                if part is not None:
                    yield row()
                part, size, crc = here, 0, 0
            text = b"\n".join(batch["line"].slice(at, end - at).to_pylist())
            open_ = zlib.crc32(text, crc)
            crc, size, at = zlib.crc32(b"\n", open_), size + len(text) + 1, end
    if part is not None:
        yield row()


def _whole_crc(parts: pd.DataFrame) -> pd.DataFrame:
    """The CRC-32 of a file from its parts, and whether they are all of it.

    The source leaves out a byte order mark, and does not tell if the last line has a line feed.
    """
    parts = parts.sort_values("start")
    length, size, crc = int(parts["length"].iloc[0]), 0, 0
    for n, c, o in zip(parts["size"], parts["crc"], parts["open"]):
        before, last = (size, crc), (int(n), int(c), int(o))
        crc, size = joined_crc(crc, int(c), int(n)), size + int(n)
    missing = length - size
    if missing in (-1, len(MARK) - 1):  # no line feed at the end
        crc, size = joined_crc(before[1], last[2], last[0] - 1), size - 1
    if length - size == len(MARK):
        crc, size = joined_crc(zlib.crc32(MARK), crc, size), length
    return pd.DataFrame({"path": [parts["path"].iloc[0]], "length": [length], "crc": [crc], "whole": [size == length]})


def checksums(spark: SparkSession, folder: str, whole: int = WHOLE) -> DataFrame:
    """All files below a folder with the CRC-32 of their bytes: ``path``, ``length``, ``crc``.

    Files of more than ``whole`` bytes are split: their lines, of any bytes, are read by as many
    tasks as Spark cuts the file into, each gives the checksum of its part, and only these
    meet. So a task reads no more of a file of any size, except a line that exceeds its part. Packed
    files (``PACKED``) are read whole. It is an error if the bytes of the parts are not all of the file's.
    """
    large = (F.col("_metadata.file_size") > whole) & ~F.col("_metadata.file_name").rlike(PACKED)  # known from the listing: others are not opened
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True).load(folder)
    file, start = F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    text = spark.read.option("recursiveFileLookup", True).option("ignoreMissingFiles", True).option("lineSep", "\n").text(folder)
    lines = text.filter(large).select(file, start, F.col("value").cast("binary").alias("line"))
    parts = lines.mapInArrow(_part_crcs, "file bigint, start bigint, size bigint, crc bigint, open bigint")
    found = parts.join(read.filter(large).select(file, "path", "length"), "file").groupBy("file")
    whole_ = found.applyInPandas(_whole_crc, "path string, length bigint, crc bigint, whole boolean")
    crc = F.when(F.col("whole"), F.col("crc")).otherwise(F.raise_error(F.concat(F.lit("parts are not all of "), "path")))
    return read.filter(~large).select("path", "length", F.crc32("content").alias("crc")).unionByName(whole_.select("path", "length", crc.alias("crc")))


def scan_tree(entries: DataFrame, roots: DataFrame | None = None, mime_types: Sequence[str] | None = None) -> DataFrame:
    """All files below the root folders, at any depth: ``root``, ``id``, ``path``, ``depth``, ``order``.

    ``entries`` has id, parent_id, name and mime_type, a row for each parent of an entry; what
    has entries below it, and what has no mime type, is a folder. ``roots`` (column id) are by
    default the folders without a parent. An entry that is reached on several paths has a row
    for each; one that is already on its path (a cycle) is not followed again. Sorted by
    ``order`` the files of a folder come before those of its sub-folders, each by name.

    One level is joined a round and written down, so the bytes moved are the tree's. Sorting
    is left to the reader: ``order`` sorts over ranges, not within one task a root.
    """
    rows = entries.select("id", "parent_id", "name", "mime_type")
    parents = rows.select(F.col("parent_id").alias("id")).filter("id is not null").distinct().withColumn("above", F.lit(True))
    known = cut_lineage(rows.join(parents, "id", "left").withColumn("folder", F.col("above").isNotNull() | F.col("mime_type").isNull()).drop("above"))
    first = known.filter("parent_id is null and folder") if roots is None else known.join(roots.select("id"), "id", "left_semi").dropDuplicates(["id"])
    step = F.struct(F.col("folder"), F.col("name"), F.col("id"))
    level = first.select(F.col("id").alias("root"), "id", F.array("id").alias("on"), F.col("name").alias("path"), F.array().cast("array<struct<folder:boolean,name:string,id:bigint>>").alias("order"))
    child = known.select("id", F.col("parent_id").alias("above"), "name", "mime_type", "folder")
    out, depth = None, 0
    while not level.isEmpty():
        depth += 1
        up = level.select("root", F.col("id").alias("above"), "on", F.col("path").alias("upper"), "order")
        found = up.join(child, "above").filter(~F.array_contains("on", F.col("id")))
        found = found.select(
            "root", "id", F.concat("on", F.array("id")).alias("on"), F.concat_ws("/", "upper", "name").alias("path"),
            F.concat("order", F.array(step)).alias("order"), "mime_type", "folder",
        )
        found = cut_lineage(found)
        files = only_types(found.filter("not folder"), mime_types).select("root", "id", "path", F.lit(depth).alias("depth"), "order")
        out = files if out is None else out.unionByName(files)
        level = found.filter("folder")
    empty = level.select("root", "id", "path", F.lit(0).alias("depth"), "order")
    return empty if out is None else out


def file_tree(catalog: DataFrame, mime_types: Sequence[str] | None = None) -> DataFrame:
    """Files of every root folder with ``place``, their position in its listing.

    Files directly in the folder come before those of its sub-folders; each by name.
    """
    order = Window.partitionBy("carpeta_raiz").orderBy(F.col("subcarpeta") != "", "subcarpeta", "name", "id")
    return only_types(catalog, mime_types).withColumn("place", F.row_number().over(order))


def files_of_folder(catalog: DataFrame, folder: str, mime_types: Sequence[str] | None = None) -> DataFrame:
    """Files of a root folder, those directly in it before those of its sub-folders, by name."""
    found = catalog.filter(F.col("carpeta_raiz") == folder)
    return only_types(found, mime_types).orderBy(F.col("subcarpeta") != "", "subcarpeta", "name", "id")


def only_types(catalog: DataFrame, mime_types: Sequence[str] | None) -> DataFrame:
    return catalog if mime_types is None else catalog.filter(F.col("mime_type").isin(list(mime_types)))


def folders(catalog: DataFrame, parent: str | None = None, limit: int | None = 100) -> DataFrame:
    """Folders by name: the sub-folders of a parent, or all root folders."""
    if parent is None:
        found = catalog.select(F.col("carpeta_raiz").alias("name"))
    else:
        found = catalog.filter(F.col("carpeta_raiz") == parent).select(F.col("subcarpeta").alias("name"))
    found = found.filter("name <> ''").distinct().orderBy("name")
    return found if limit is None else found.limit(limit)


def search_files(catalog: DataFrame, part: str, limit: int | None = 100) -> DataFrame:
    """Files whose name contains the given text, by name."""
    found = catalog.filter(F.contains(F.col("name"), F.lit(part))).orderBy("name", "id")
    return found if limit is None else found.limit(limit)


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """The roots of nested taxonomy files as JSON; flatten them with ``profiles.flatten_taxonomy``."""
    files = spark.read.option("wholetext", True).text(path)
    return files.select(F.from_json("value", "roots string")["roots"].alias("roots"))


def write_rankings(ranking: DataFrame, path: str) -> None:
    """All rankings as CSV with a header, one file per partition."""
    ranking.write.mode("overwrite").option("header", True).csv(path)


def write_reports(ranking: DataFrame, courses: DataFrame, path: str) -> None:
    """One folder of CSV per course, named by the course's slug and id."""
    named = ranking.join(courses.select(F.col("id").alias("curso_id"), "nombre"), "curso_id")
    named.withColumn("report", F.concat_ws("_", report_slug(F.col("nombre")), "curso_id")).repartition("curso_id").sortWithinPartitions(
        "curso_id", "rank"
    ).write.mode("overwrite").partitionBy("report").option("header", True).csv(path)


def scan_summary(catalog: DataFrame, processed: Column) -> DataFrame:
    """Files found and the share of them that is processed, per root folder."""
    return catalog.groupBy("carpeta_raiz").agg(
        F.count(F.lit(1)).alias("files_found"), F.count_if(processed).alias("processed"),
        (F.count_if(processed) / F.count(F.lit(1))).alias("progress"),
    )
