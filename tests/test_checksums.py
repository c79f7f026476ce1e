"""Checksums of files that are read in parts against those of their bytes."""

import gzip
import random
import zlib

import pytest

from cotejo.sources import files

MARK = files.MARK


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    rng, root = random.Random(5), tmp_path_factory.mktemp("files")
    noise = rng.randbytes(300_000)
    contents = {
        "noise": noise, "ended": noise + b"\n", "marked": MARK + noise, "marked ended.txt": MARK + noise + b"\n", "twice marked": MARK + MARK + noise,
        "feeds": b"\n" * 90_000, "returns": b"\r\n" * 90_000, "a b/x%20[y]*.bin": noise[:200_000], "long": b"\n" + b"x" * 200_000 + b"\n\n", "no feed": bytes(150_000),
        "small": b"ab\nc", "packed.gz": gzip.compress(noise), "a b/same": noise, "only mark": MARK,
    }
    for name, data in contents.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_bytes(data)
    return str(root), contents


def test_joined_crc():
    a, b = random.Random(1).randbytes(1001), random.Random(2).randbytes(70_000)
    assert files.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert files.joined_crc(zlib.crc32(a), 0, 0) == zlib.crc32(a)


@pytest.mark.parametrize("size", ["20000b", "128m"])
def test_files_in_parts(spark, tree, size):
    root, contents = tree
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        rows = files.checksums(spark, root, whole=50_000).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = sorted((r.path.split(root + "/")[-1], r.length, r.crc) for r in rows)
    assert got == sorted((name, len(data), zlib.crc32(data)) for name, data in contents.items())


def test_a_large_file_is_read_by_several_tasks(spark, tmp_path):
    (tmp_path / "large").write_bytes(random.Random(6).randbytes(8 << 20))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        plan = files.checksums(spark, str(tmp_path), whole=1 << 20)
        assert "Scan text" in plan._jdf.queryExecution().executedPlan().toString()
        assert [(r.length, r.crc) for r in plan.collect()] == [(8 << 20, zlib.crc32((tmp_path / "large").read_bytes()))]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
