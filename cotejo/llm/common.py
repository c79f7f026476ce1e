"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.sources.scratch import cut_lineage, new_folder

__all__ = ["SPACE", "as_row", "cut_lineage", "drop_tables", "let", "once", "read_table", "show_code", "tables_written", "words_of", "write_and_read"]

#: Inside a character class: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"\x20\x09-\x0D"


def show_code(spark: SparkSession) -> None:
    """Let Python workers of this machine import the package from where the driver did."""
    env, top = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    have = env.get("PYTHONPATH", "")
    if top not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [top, have]))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables, read by Spark (the path may be in any store Spark knows)."""
    show_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables that were written in this session's shared folder.
_written: list[str] = []


def write_and_read(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder, for wide rows of which later steps
    read some columns, and read on from there. See ``drop_tables``."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.parquet(path)


def tables_written() -> int:
    return len(_written)


def drop_tables(spark: SparkSession, start: int, stop: int) -> None:
    """Delete the tables written from the start-th to before the stop-th, when nothing reads them any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for i in range(start, stop):
        if _written[i]:
            path = jvm.org.apache.hadoop.fs.Path(_written[i])
            path.getFileSystem(conf).delete(path, True)
            _written[i] = ""


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body`` as often as needed."""
    return F.transform(F.array(value), body)[0]


def once(value: Column) -> Column:
    """``value`` as a generated column, so that no filter above it is pushed into it (and
    with the filter another evaluation of everything it is made of)."""
    return F.explode(F.array(value))


def as_row(df: DataFrame) -> Column:
    """All columns of ``df`` in one struct, so that no derived name can clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def words_of(text: Column) -> Column:
    """The words (runs of anything but ASCII white space) of a text, null as empty."""
    stripped = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(
        F.split(stripped, f"[{SPACE}]+", -1)
    )
