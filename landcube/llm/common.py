"""Small helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landcube.sources.shared import written


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back: cuts lineage, survives lost executors."""
    return written(df, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def need(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns never clash with those that an operator makes."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def remainder(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def fits(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than it must to tell."""
    return df.limit(rows + 1).count() <= rows


def inline_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small DataFrame of values that the driver knows (plans, parameters), without an RDD."""
    import json

    struct = T.StructType.fromDDL(schema)
    names = struct.fieldNames()
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    packed = F.from_json(F.lit(text), T.ArrayType(struct))
    return spark.range(1).select(F.explode(packed).alias("r")).select("r.*")
