"""Sinks: results as JSON or Parquet, history with a JSON column, cache entries."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landcube.sources import rastersource


def write_json(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def write_masks(cells: DataFrame, path: str, by: tuple[str, ...] = ("change_type",)) -> None:
    cells.write.mode("overwrite").partitionBy(*by).parquet(path)


def history_rows(results: DataFrame, user: Column, at: Column, *payload: str) -> DataFrame:
    """user_id, created_at and the named columns as JSON text."""
    return results.select(user.alias("user_id"), at.alias("created_at"), F.lit("completed").alias("status"), F.to_json(F.struct(*payload)).alias("result_json"))


def write_files(files: DataFrame, folder: str) -> None:
    """A file for each row (name, content). A task that is run again writes the same files over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = rastersource.opened(folder)
        system.create_dir(inner, recursive=True)
        for batch in batches:
            for name, content in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                # under another name first, so that no reader sees half a file
                made = f"{inner}/.{name}-{uuid.uuid4().hex}"
                with system.open_output_stream(made) as out:
                    out.write(content)
                system.move(made, f"{inner}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    files.select("name", "content").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def append(rows: DataFrame, path: str) -> None:
    """History and cache entries are only ever added; the newest wins when read."""
    rows.write.mode("append").parquet(path)


def replace_live(cache: DataFrame, now: Column, days: int, path: str) -> None:
    """Write what has not expired to a new place: Parquet has no delete."""
    cache.where(F.col("created") + F.make_interval(days=F.lit(days)) > now).write.mode("errorifexists").parquet(path)
