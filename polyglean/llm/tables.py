"""Input tables of the training-data queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Ids below this are no ids of the table: they stand for records whose id is NULL or not a number.
SURROGATE = -(1 << 62)


def records(corpus: DataFrame, *cols: str) -> DataFrame:
    """One row per record: the last delivery of each id (by loaded_at; ties: the greatest content). id becomes BIGINT.

    The maximum is taken map-side first, so an id delivered very often never meets in one task. An id that is not a
    number makes a record of its own, and so does each different content without id: they get a negative id below
    ``SURROGATE``, a digest of the id as written or of the content.
    """
    cols = cols or ("title", "text")
    own = F.xxhash64("id", F.when(F.col("id").isNull(), F.to_json(F.struct(*cols))))
    key = F.coalesce(F.expr("try_cast(id AS BIGINT)"), F.lit(SURROGATE) - F.pmod(own, F.lit(1 << 62)))
    keyed = corpus.select(key.alias("id"), F.struct("loaded_at", *cols).alias("r"))
    return keyed.groupBy("id").agg(F.max("r").alias("r")).select("id", *[F.col(f"r.{c}").alias(c) for c in cols])
