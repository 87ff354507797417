"""Holds a registered query against its DuckDB SQL."""

from __future__ import annotations

from pathlib import Path

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in Path(sf_dir).iterdir():
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p / '*.parquet' if p.is_dir() else p}'")
    return c


def as_rows(frame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted(map(tuple, frame.astype(str).values.tolist()))


def same(spark, sf_dir: str, query, sql: str) -> None:
    ours, theirs = query(spark, sf_dir).toPandas(), duck(sf_dir).execute(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert as_rows(ours) == as_rows(theirs)
