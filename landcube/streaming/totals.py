"""Running totals over tile pairs as they arrive, with Structured Streaming."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landcube.operators.transitions import stream_rules
from landcube.sources import rasterfiles
from landcube.sources.shared import shared_path

SCHEMA = "city long, tile long, px long, cls_before int, cls_after int"
#: The rules of :func:`stream_rules`, by name.
RULES = ("deforestation", "construction", "water_loss", "urbanization")


def tile_counts(pairs: DataFrame) -> DataFrame:
    """Pixels with both classes, and pixels under each rule, by city and tile: small numbers, whatever a city's size.

    Where ``pairs`` has path and error, a row with an error, of a tile that can't be read, is a group of its own.
    """
    ok = F.col("cls_before").isNotNull() & F.col("cls_after").isNotNull()
    named = pairs if "error" in pairs.columns else pairs.withColumns({"path": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})
    sums = [F.count_if(v & ok).alias(k) for k, v in stream_rules(F.col("cls_before"), F.col("cls_after")).items()]
    return named.groupBy("city", "tile", "path", "error").agg(F.count_if(ok).alias("pixels"), *sums)


def city_totals(tiles: DataFrame, resolution: float = 10.0) -> DataFrame:
    """Hectares under each rule, pixels and tiles processed, by city. Tiles without a pixel of both classes don't count."""
    area = resolution * resolution / 10000
    ok = tiles.where(F.col("error").isNull())
    sums = [F.round(F.sum(k) * area, 6).alias(f"{k}_hectares") for k in RULES]
    by_tile = ok.groupBy("city", "tile").agg(*[F.sum(k).alias(k) for k in ("pixels", *RULES)])
    return by_tile.groupBy("city").agg(*sums, F.sum("pixels").alias("pixels_processed"), F.count_if(F.col("pixels") > 0).alias("tiles_processed"))


def totals(pairs: DataFrame, resolution: float = 10.0) -> DataFrame:
    return city_totals(tile_counts(pairs), resolution)


def tile_pairs(files: DataFrame) -> DataFrame:
    """Pixels of tile files (path, city, tile, content): rasters of two bands, the class before and after plus one, 0 for none.

    A file that can't be read, or is of another form, is one row with the error and no classes; the others go on. (A file
    without a byte never comes: Spark's file sources pass over those.)
    """
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    names = ["path", "error", "city", "tile", "px", "cls_before", "cls_after"]

    def read(content: bytes) -> np.ndarray:
        at = rasterfiles.layout(lambda offset, n: content[offset : offset + n], len(content))
        if at.bands != 2:
            raise ValueError(f"{at.bands} bands")
        x = np.zeros((2, at.rows, at.columns), np.int64)
        for p in at.pieces:
            own = rasterfiles.values(at, p, content[p.offset : p.offset + p.size])
            x[slice(None) if p.band is None else [p.band], p.row : p.row + own.shape[1], p.column : p.column + own.shape[2]] = own
        return x.reshape(2, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, city, tile, content in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                try:
                    x = read(content or b"")
                except (ValueError, zlib.error) as e:
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((path, str(e), city, tile, None, None, None), kinds, strict=True)], names=names)
                    continue
                n = x.shape[1]
                own = [pa.nulls(n, kinds[0]), pa.nulls(n, kinds[1]), pa.repeat(pa.scalar(city, kinds[2]), n), pa.repeat(pa.scalar(tile, kinds[3]), n), pa.array(np.arange(n))]
                yield pa.RecordBatch.from_arrays([*own, *[pa.array(v - 1, kinds[5], mask=v == 0) for v in x]], names=names)

    return files.select("path", "city", "tile", "content").mapInArrow(run, "path string, error string, " + SCHEMA)


def stream_tiles(arriving: DataFrame, state: str, out: str) -> None:
    """Keep the counts of each tile as state, and write those that a batch changes under the batch's number.

    What can't be read goes to ``bad``, the rest to ``tiles``, in the same batch; a batch that is run again writes the same
    over both, and no file is counted or listed twice.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        batch.where("error is null").drop("path", "error").write.mode("overwrite").parquet(f"{out}/tiles/batch={number}")
        batch.where("error is not null").select("path", "error", "city", "tile").write.mode("overwrite").parquet(f"{out}/bad/batch={number}")
        batch.unpersist()

    query = tile_counts(arriving).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()


def latest_tiles(spark: SparkSession, out: str) -> DataFrame:
    """The last counts of each tile."""
    values = ["pixels", *RULES]
    made = spark.read.schema("city long, tile long, " + ", ".join(f"{v} long" for v in values) + ", batch long").option("basePath", f"{out}/tiles").parquet(f"{out}/tiles/batch=*")
    last = made.groupBy("city", "tile").agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return last.select("city", "tile", F.lit(None).cast("string").alias("error"), "v.*")


def bad_tiles(spark: SparkSession, out: str) -> DataFrame:
    """path, error, city and tile of the files that were set aside."""
    return spark.read.schema("path string, error string, city long, tile long").parquet(f"{out}/bad/batch=*")


def stream_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Read every file of ``folder`` as a stream of pairs and return the totals by city in the end."""
    state, out = shared_path(spark, "state"), shared_path(spark, "totals")
    stream_tiles(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(folder), state, out)
    return city_totals(latest_tiles(spark, out))


def arriving_files(spark: SparkSession, folder: str, pattern: str, most: int = 1000) -> DataFrame:
    """path and content of files as they arrive; for :func:`tile_pairs` once city and tile are told from the path."""
    stream = spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", most)
    return stream.schema("path string, modificationTime timestamp, length long, content binary").load(folder).select("path", "content")


def windowed_activity(events: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events by type and time window, for streams too: what comes later than ``late`` is dropped by the watermark."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
