"""A data source for raster files: ``spark.read.format("raster").load(folder)`` after :func:`register`.

A file's head says where its pieces lie; a task has some small files or, of one larger than :data:`PART_BYTES`, a share of its
pieces in the order of rows, so a large array is many tasks' work and each reads only its own bytes. The driver lists files
and opens none. Filters on path, name, band and r are taken over by the
source: files, bands and pieces that they rule out are never read. Paths can be in any store that Arrow's file systems open.

Options: ``pattern`` (of file names, ``*`` by default), ``wide`` (so many columns b0, b1, ... in place of band and value; bands that
a file doesn't have are null), ``content`` (``cells``, or ``info`` for a row about each file), ``unreadable`` (``fail``, ``skip``, or
``list``: with ``info``, a row with the error; with ``skip``, of a file that breaks off the cells before the fault stay). A PNG is one piece: rows below the last one asked for are not unpacked.
"""

from __future__ import annotations

import fnmatch
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from landcube.sources import rasterfiles
from landcube.sources.rasterfiles import Layout, Piece

PART_BYTES, BATCH = 32_000_000, 1 << 18
NARROW = "path string, name string, band int, r long, c long, value double"
INFO = "path string, name string, kind string, bands int, rows long, columns long, dtype string, west double, north double, pixel_width double, pixel_height double, epsg int, bytes long, error string"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_below(path: str, pattern: str) -> list[tuple[str, int]]:
    """Path and size of a file, or of the files of a folder and its folders whose names match, in order."""
    system, inner = opened(path)
    head = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    found = system.get_file_info(inner)
    every = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
    return sorted((head + f.path, f.size) for f in every if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern))


@dataclass
class Part(InputPartition):
    """Files (path, size), or one file's ``share`` of ``shares``."""

    files: list[tuple[str, int]]
    share: int = 0
    shares: int = 1


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.pattern = options["path"], options.get("pattern", "*")
        self.wide, self.info = int(options.get("wide", 0)), options.get("content", "cells") == "info"
        self.unreadable = options.get("unreadable", "fail")
        self.part_bytes = int(options.get("partbytes", PART_BYTES))
        self.names: set[str] | None = None
        self.paths: set[str] | None = None
        self.bands: set[int] | None = None
        self.low, self.high = 0, 1 << 62

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes over what decides by path, name, band or row; gives back the rest."""
        for f in filters:
            column = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            value = getattr(f, "value", None)
            if column in ("path", "name") and isinstance(f, EqualTo | In):
                own = {value} if isinstance(f, EqualTo) else set(value)
                kind = column + "s"
                setattr(self, kind, own if getattr(self, kind) is None else getattr(self, kind) & own)
            elif column == "band" and not self.info and isinstance(f, EqualTo | In):
                own = {value} if isinstance(f, EqualTo) else set(value)
                self.bands = own if self.bands is None else self.bands & own
            elif column == "r" and not self.info and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.low = max(self.low, value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    self.high = min(self.high, value + (not isinstance(f, LessThan)))
            else:
                yield f

    def _files(self) -> list[tuple[str, int]]:
        own = files_below(self.path, self.pattern)
        return [(p, n) for p, n in own if (self.paths is None or p in self.paths) and (self.names is None or p.rsplit("/", 1)[-1] in self.names)]

    def partitions(self) -> list[InputPartition]:
        parts: list[InputPartition] = []
        held, size = [], 0
        for path, own in self._files():
            shares = 1 if self.info else -(-own // self.part_bytes)
            if shares > 1:
                parts += [Part([(path, own)], i, shares) for i in range(shares)]
                continue
            held.append((path, own))
            size += self.part_bytes // 64 if self.info else own
            if size >= self.part_bytes:
                parts.append(Part(held))
                held, size = [], 0
        return parts + [Part(held)] if held else parts

    def groups(self, layout: Layout, share: int, shares: int) -> list[list[Piece]]:
        """The pieces of a share that filters leave, together those that hold the same cells in several bands."""
        found: dict[tuple[int, int], list[Piece]] = {}
        for p in layout.row_pieces(self.low, self.high):
            if self.bands is None or p.band is None or p.band in self.bands:
                found.setdefault((p.row, p.column), []).append(p)
        sizes = np.array([sum(p.size for p in g) for g in found.values()], np.int64)
        before = np.cumsum(sizes) - sizes
        return [g for g, at in zip(found.values(), before.tolist(), strict=True) if at * shares // max(1, int(sizes.sum())) == share]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        for path, size in partition.files:
            if self.info:
                yield from self._about(path, size)
                continue
            try:
                made = self._cells(path, layout_of(path, size), partition)
                for batch in made:
                    yield batch
            except (ValueError, zlib.error):
                if self.unreadable == "fail":
                    raise

    def _cells(self, path: str, at: Layout, partition: Part) -> Iterator[pa.RecordBatch]:
        system, inner = opened(path)
        name = path.rsplit("/", 1)[-1]
        with system.open_input_file(inner) as file:
            for group in self.groups(at, partition.share, partition.shares):
                found: dict[int, np.ndarray] = {}
                for p in group:
                    file.seek(p.offset)
                    x = rasterfiles.values(at, p, file.read(p.size), min(at.rows, self.high) - 1)
                    first = max(0, self.low - p.row)
                    x = x[:, first : max(first, self.high - p.row)]
                    found |= {p.band: x[0]} if p.band is not None else dict(enumerate(x))
                wanted = [b for b in range(self.wide or at.bands) if self.bands is None or b in self.bands]
                yield from self._batches(path, name, found, wanted, max(self.low, group[0].row), group[0].column)

    def _batches(self, path: str, name: str, found: dict[int, np.ndarray], wanted: list[int], row: int, column: int) -> Iterator[pa.RecordBatch]:
        shape = next(iter(found.values())).shape
        step = max(1, BATCH // max(1, shape[1]))
        for k in range(0, shape[0], step):
            n = min(step, shape[0] - k) * shape[1]
            r, c = np.indices((n // max(1, shape[1]), shape[1]))
            place = [pa.array((r + row + k).ravel()), pa.array((c + column).ravel())]
            texts = [pa.repeat(pa.scalar(x, pa.string()), n) for x in (path, name)]
            if self.wide:
                own = [pa.array(found[b][k : k + step].ravel().astype(np.float64)) if b in found else pa.nulls(n, pa.float64()) for b in range(self.wide)]
                yield pa.RecordBatch.from_arrays([*texts, *place, *own], names=["path", "name", "r", "c", *[f"b{i}" for i in range(self.wide)]])
                continue
            for b in wanted:
                value = pa.array(found[b][k : k + step].ravel().astype(np.float64))
                yield pa.RecordBatch.from_arrays([*texts, pa.array(np.full(n, b, np.int32)), *place, value], names=["path", "name", "band", "r", "c", "value"])

    def _about(self, path: str, size: int) -> Iterator[pa.RecordBatch]:
        row = {"path": path, "name": path.rsplit("/", 1)[-1], "bytes": size}
        try:
            at = layout_of(path, size)
            west, north, width, height, epsg = at.ground or (None,) * 5
            row |= {"kind": at.kind, "bands": at.bands, "rows": at.rows, "columns": at.columns, "dtype": at.dtype, "west": west, "north": north, "pixel_width": width, "pixel_height": height, "epsg": epsg}
        except ValueError as e:
            if self.unreadable == "fail":
                raise
            if self.unreadable == "skip":
                return
            row["error"] = str(e)
        kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
        yield pa.RecordBatch.from_pylist([row], pa.schema([(k, kinds[t]) for k, t in (c.split() for c in INFO.split(", "))]))


def layout_of(path: str, size: int) -> Layout:
    system, inner = opened(path)
    with system.open_input_file(inner) as file:

        def read(offset: int, n: int) -> bytes:
            file.seek(offset)
            return file.read(n)

        return rasterfiles.layout(read, size)


class Raster(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        if self.options.get("content", "cells") == "info":
            return INFO
        wide = int(self.options.get("wide", 0))
        return "path string, name string, r long, c long, " + ", ".join(f"b{i} double" for i in range(wide)) if wide else NARROW

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let Spark hand filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Raster)


def cells(spark: SparkSession, path: str, pattern: str = "*", **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("raster").options(pattern=pattern, **options).load(path)


def info(spark: SparkSession, path: str, pattern: str = "*", unreadable: str = "list") -> DataFrame:
    """A row for each file: its form, size, place on the ground, or what is wrong with it."""
    return cells(spark, path, pattern, content="info", unreadable=unreadable)
