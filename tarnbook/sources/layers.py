"""Polygon layers in Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnbook.operators.polygons import BOX, flatten_rings, with_box


def as_layer(df: DataFrame) -> DataFrame:
    """Check a table for a layer's columns, flatten its rings and add missing boxes."""
    missing = {"layer_id", "rings"} - set(df.columns)
    if missing:
        raise ValueError(f"a layer needs {sorted(missing)}")
    df = df.withColumn("rings", flatten_rings(F.col("rings")))
    return df if set(BOX) <= set(df.columns) else with_box(df)


def read_layer(spark: SparkSession, path: str) -> DataFrame:
    return as_layer(spark.read.parquet(path))
