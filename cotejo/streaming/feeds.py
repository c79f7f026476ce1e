"""Structured Streaming twins of the change log, status and profile operators.

All take a streaming DataFrame of log rows (id, propietario_email, drive_file_id,
evento_tipo, status, timestamp, updated_at) and return a streaming DataFrame, except
``merge_profiles`` and ``periodic_status``, which return writers. Rows later than the watermark are dropped where state
is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType

from cotejo.operators.profiles import BONUS, UNIT, fold_stored
from cotejo.operators.tables import purge_stored


def read_events(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """A folder of Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def intake(logs: DataFrame, late: str = "1 day") -> DataFrame:
    """Each change once, however often it is announced."""
    return logs.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["id"])


def latest_status(logs: DataFrame, late: str = "30 days") -> DataFrame:
    """Status of the newest log row of every file; use update mode.

    As in a batch, a row without a time counts as newest and ties go to the larger id. Rows
    later than the watermark are dropped, so a file that has been silent for that long needs
    no state any more: what may still come is newer. A file with a row without a time stays.
    """
    def newest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        old = best = tuple(state.get) if state.exists else (False, -(1 << 62), -(1 << 62), None)
        for rows in batches:
            at = rows["timestamp"].astype("datetime64[us]")
            times = at.astype("int64").where(at.notna(), 0)
            best = max([best, *zip(at.isna().tolist(), times.tolist(), rows["id"].tolist(), rows["status"].tolist())], key=lambda x: x[:3])
        none, time, id, status = best
        if best[:3] == old[:3]:
            return
        state.update(best)
        if not none:
            state.setTimeoutTimestamp(max(time // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"drive_file_id": [key[0]], "id": [id], "status": [status], "timestamp": [pd.NaT if none else pd.Timestamp(time, unit="us")]})

    rows = logs.select("drive_file_id", "id", "status", "timestamp").withWatermark("timestamp", late)
    return rows.groupBy("drive_file_id").applyInPandasWithState(
        newest, "drive_file_id string, id bigint, status string, timestamp timestamp", "none boolean, at bigint, id bigint, status string",
        "update", GroupStateTimeout.EventTimeTimeout,
    )


def tenant_feed(logs: DataFrame, owner: str) -> DataFrame:
    """Additions and changes of one owner."""
    return logs.filter((F.col("propietario_email") == owner) & F.col("evento_tipo").isin("CREATE", "UPDATE"))


def sessions(events: DataFrame, key: str = "user_id", at: str = "ts", gap: str = "90 minutes", late: str = "1 day") -> DataFrame:
    """Activity without a longer pause than the gap; works on batch frames too."""
    source = events.withWatermark(at, late) if events.isStreaming else events
    s = source.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events"))
    return s.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


def status_windows(logs: DataFrame, width: str = "5 minutes", late: str = "1 day") -> DataFrame:
    """Log rows by status in tumbling windows; works on batch frames too."""
    source = logs.withWatermark("timestamp", late) if logs.isStreaming else logs
    w = source.groupBy(F.window("timestamp", width).alias("w"), "status").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("window_start"), "status", "n")


def stuck(logs: DataFrame, minutes: int = 15, late: str = "1 hour") -> DataFrame:
    """A row for each time a file was being processed for the limit without another update.

    Rows of a file are taken in the order of time and id. A gap inside a batch counts like
    one between batches, so the result does not depend on how rows are dealt to batches as
    long as they come in order. State is the last row of a file; an event-time timer fires
    when the watermark passes the limit. Rows older than the last one known are passed over.
    """
    limit = minutes * 60_000_000

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        def found(times: list[int]) -> pd.DataFrame:
            return pd.DataFrame({"drive_file_id": [key[0]] * len(times), "since": pd.to_datetime(times, unit="us")})

        if state.hasTimedOut:
            since = state.get[0]
            state.remove()
            yield found([since])
            return
        rows = pd.concat(list(batches)).sort_values(["timestamp", "id"])
        times = rows["timestamp"].astype("datetime64[us]").astype("int64").tolist()
        last = state.get[0] if state.exists else None  # since when it is being processed
        out = []
        for at, status in zip(times, rows["status"]):
            if last is not None and at < last:
                continue
            if last is not None and at > last + limit:
                out.append(last)
            last = at if status == "processing" else None
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max((last + limit) // 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if out:
            yield found(out)

    rows = logs.filter("timestamp is not null").withWatermark("timestamp", late).select("drive_file_id", "timestamp", "id", "status")
    return rows.groupBy("drive_file_id").applyInPandasWithState(
        watch, "drive_file_id string, since timestamp", "at bigint", "append", GroupStateTimeout.EventTimeTimeout
    )


def profile_updates(calls: DataFrame) -> DataFrame:
    """New profiles of the teachers and nodes that a batch of calls touches; use update mode.

    State is the profile so far, so a batch costs what it brings, however much came before.
    Calls have one piece of evidence each; within a batch they are folded in the order of
    seq, semana, texto and peso, and batches in the order of their arrival.
    """
    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        weight, explicit, recent, known = (*state.get[:3], list(state.get[3])) if state.exists else (None, True, None, [])
        rows = pd.concat(list(batches)).sort_values(["seq", "semana", "texto", "peso"])
        seen = set(known)
        for text, peso, said, period in zip(rows["texto"], rows["peso"], rows["explicito"], rows["recencia"]):
            if text is not None and text not in seen:
                seen.add(text)
                known.append(text)
            units = int(peso * UNIT)
            weight = units if weight is None else max(weight, units) + BONUS * max(0, len(known) - 1)
            explicit, recent = explicit and bool(said), period or recent
        state.update((weight, explicit, recent, known))
        yield pd.DataFrame({
            "docente_id": [key[0]], "nodo_id": [key[1]], "peso": [Decimal(weight).scaleb(-4)],
            "explicito": [explicit], "recencia": [recent], "evidencias": [known],
        })

    out = "docente_id bigint, nodo_id string, peso decimal(18,4), explicito boolean, recencia string, evidencias array<string>"
    return calls.groupBy("docente_id", "nodo_id").applyInPandasWithState(
        fold, out, "peso bigint, explicito boolean, recencia string, evidencias array<string>", "update", GroupStateTimeout.NoTimeout
    )


def merge_profiles(calls: DataFrame, tables: dict[str, str]) -> DataStreamWriter:
    """A writer (not started) that keeps profiles up to date and names dependent cached rankings.

    ``tables`` has the paths ``profiles`` and ``stale``; each micro-batch adds one folder to
    both: the new profiles, and the teachers whose cached rankings are to go. The newest
    row of a teacher and node counts. Repeating a batch after a failure writes the same
    folders again.
    """
    def merge(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.write.mode("overwrite").parquet(f"{tables['profiles']}/batch={number}")
        batch.select("docente_id").distinct().write.mode("overwrite").parquet(f"{tables['stale']}/batch={number}")
        batch.unpersist()

    return profile_updates(calls).writeStream.outputMode("update").foreachBatch(merge)


def keep_profiles(calls: DataFrame, profiles: str, cache: str) -> DataStreamWriter:
    """A writer (not started) that folds each micro-batch of calls into the profiles stored at one path
    and removes the cached rankings of the teachers it touches from the cache stored at another.

    The stored rows are the state, so the stream itself keeps none, and evidence may be one
    text or lists of texts, structs or maps. Both steps can be repeated: a profile bucket
    knows the last batch that it has, and removing rows again changes nothing. So a restart
    after a failure between or within the two writes leaves both tables as one run does.
    """
    def merge(batch: DataFrame, number: int) -> None:
        fold_stored(batch, profiles, number)
        purge_stored(batch.sparkSession, cache, batch.select("docente_id"))

    return calls.writeStream.foreachBatch(merge)


def periodic_status(logs: DataFrame, sink: Callable[[DataFrame, int], None], every: str = "5 seconds", width: str = "5 minutes") -> DataStreamWriter:
    """A writer (not started) that hands the changed status windows to ``sink`` at fixed times."""
    return status_windows(logs, width).writeStream.outputMode("update").trigger(processingTime=every).foreachBatch(sink)


def run_available(stream: DataFrame, path: str, mode: str = "append", schema_of: DataFrame | None = None) -> DataFrame:
    """Run a stream over what is available; its rows are written below ``path`` and read back.

    In update and complete mode each batch is a folder of its own, so that the last one
    with a key counts; see ``newest``.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_id", F.lit(number)).write.mode("overwrite").parquet(f"{path}/rows/n={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(stream.schema.add("batch_id", IntegerType())).option("recursiveFileLookup", True).parquet(f"{path}/rows")


def newest(rows: DataFrame, key: str) -> DataFrame:
    """The row of the last batch for each key."""
    others = [c for c in rows.columns if c not in (key, "batch_id")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), "batch_id").alias("x")).select(key, "x.*")
