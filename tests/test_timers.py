"""Streams that begin with a snapshot against streams over everything and against plain Python."""

import datetime
import random

import pytest

from cotejo.operators import tables
from cotejo.streaming import feeds, timers

LOG = "id long, drive_file_id string, status string, timestamp timestamp"
STATUS = ["processing", "processing", "SUCCESS", "FAILED", None]


def minute(m):
    return datetime.datetime(2024, 1, 1, 10) + datetime.timedelta(minutes=m)


def stream_of(spark, rows, path, per_batch):
    for n, i in enumerate(range(0, len(rows), per_batch)):
        spark.createDataFrame(rows[i : i + per_batch], LOG).coalesce(1).write.parquet(f"{path}/in/{n:03}")
    return feeds.read_events(spark, f"{path}/in/*", spark.createDataFrame([], LOG).schema, 1)


def plain_stuck(rows, limit=15, late=60):
    """Every processing row whose next one of the file is too far, or that the watermark has run out on."""
    timed = sorted((r for r in rows if r[3] is not None), key=lambda r: (r[3], r[0]))
    end, out = max(r[3] for r in timed), []
    for i, (_, file, status, at) in enumerate(timed):
        later = next((r[3] for r in timed[i + 1 :] if r[1] == file), None)
        wait = datetime.timedelta(minutes=limit)
        if status == "processing" and (later > at + wait if later else at + wait < end - datetime.timedelta(minutes=late)):
            out.append((file or "", at))
    return sorted(out)


def random_rows(seed, n=60):
    draw = random.Random(seed)
    at = sorted(draw.choice(range(0, 600, 5)) for _ in range(n))
    return [(i, draw.choice(["a", "b", "c", "d", None]), draw.choice(STATUS), minute(m)) for i, m in enumerate(at)]


@pytest.mark.parametrize(("seed", "cut", "per_batch"), [(1, 0, 20), (2, 30, 10), (3, 45, 100)])
def test_stuck_files_from_a_snapshot(spark, tmp_path, seed, cut, per_batch):
    rows = random_rows(seed)
    history = spark.createDataFrame(rows[:cut] + [(999, "a", "processing", None)], LOG)
    with timers.rocks_db(spark):
        late = feeds.run_available(timers.stuck(stream_of(spark, rows[cut:], tmp_path, per_batch), history), str(tmp_path / "out"))
        found = late.drop("batch_id").unionByName(timers.stuck_before(history)).collect()
    assert sorted((r.drive_file_id or "", r.since) for r in found) == plain_stuck(rows)


def test_a_time_out_falls_due_behind_its_limit(spark, tmp_path):
    """The watermark has to pass the limit; standing on it is not enough."""
    history = spark.createDataFrame([(1, "f", "processing", minute(0)), (2, "g", "processing", minute(1))], LOG)
    stream = stream_of(spark, [(3, "h", "SUCCESS", minute(76))], tmp_path, 1)  # the watermark: minute 16
    with timers.rocks_db(spark):
        out = feeds.run_available(timers.stuck(stream, history), str(tmp_path / "out")).collect()
    assert [(r.drive_file_id, r.since) for r in out] == [("f", minute(0))]


@pytest.mark.parametrize("cut", [0, 25, 59])
def test_latest_status_from_a_snapshot(spark, tmp_path, cut):
    rows = [*random_rows(7), (60, "n", "x", None), (61, "n", "y", minute(700)), (62, "n", "z", None)]
    history = spark.createDataFrame(rows[:cut], LOG)
    with timers.rocks_db(spark):
        out = feeds.run_available(timers.latest_status(stream_of(spark, rows[cut:], tmp_path, 12), history, "1 hour"), str(tmp_path / "out"), "update")
        new = {r.drive_file_id: r.id for r in feeds.newest(out, "drive_file_id").collect()}
    old = {r.drive_file_id: r.id for r in tables.latest(history).collect()}
    want = {r.drive_file_id: r.id for r in tables.latest(spark.createDataFrame(rows, LOG)).collect()}
    assert old | new == want and want["n"] == 62


def test_setting_is_put_back(spark):
    before = spark.conf.get(timers.PROVIDER, None)
    with pytest.raises(KeyError), timers.rocks_db(spark):
        raise KeyError
    assert spark.conf.get(timers.PROVIDER, None) == before
