"""Writers for one table or for several tables that belong together."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from lanewise.sources.files import EXPORTS, LIST, latest_export


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: Sequence[str] = ()
) -> str:
    """Write one table with as many files as it has partitions.

    A table partitioned by month, say, is read for a date range without
    touching the other months.
    """
    writer = df.write.format(fmt).mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def write_tables(tables: Mapping[str, DataFrame], path: str, fmt: str = "parquet", mode: str = "errorifexists") -> dict:
    """Write tables that belong together below one folder, all or none; returns where each went.

    Every export goes to folders of its own. A list of them, one row per table,
    is written last and in one file, which is what ``files.read_tables`` goes by:
    an export that fails half-way is never seen, and readers of an older one keep
    their files. ``mode`` is "errorifexists" or "overwrite"; the latter adds a
    list with a higher number, and the tables of the older ones stay.
    """
    if not tables:
        raise ValueError("no tables to write")
    if mode not in ("errorifexists", "overwrite"):
        raise ValueError(f"unknown mode {mode}")
    spark = next(iter(tables.values())).sparkSession
    folder = path.rstrip("/")
    last = latest_export(spark, folder)
    if last is not None and mode == "errorifexists":
        raise ValueError(f"{path} holds an export already")
    export = uuid.uuid4().hex
    places = {name: write_table(df, f"{folder}/{export}/{name}", fmt) for name, df in tables.items()}
    rows = [(0 if last is None else last + 1, export, name, fmt, place) for name, place in places.items()]
    spark.createDataFrame(rows, EXPORTS).coalesce(1).write.mode("append").json(f"{folder}/{LIST}")
    return places
