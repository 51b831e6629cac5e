"""Training of the 8-bit scalar quantizer and its use on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.vectors import dequantize, quantize, squared_l2


def train(rows: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """(pos, min_val, max_val, scale) by dimension: partial minima and maxima, so one small shuffle."""
    each = rows.select(F.posexplode(vec_col).alias("pos", "x"))
    limits = each.groupBy("pos").agg(F.min("x").cast("double").alias("min_val"), F.max("x").cast("double").alias("max_val"))
    span = F.col("max_val") - F.col("min_val")
    return limits.withColumn("scale", F.when(span < 1e-10, F.lit(1.0)).otherwise(span / 255.0))


def parameters(trained: DataFrame) -> DataFrame:
    """One row (low, scale) of arrays in dimension order; its size is that of one vector."""
    rows = trained.agg(F.array_sort(F.collect_list(F.struct("pos", "min_val", "scale"))).alias("p"))
    return rows.select(F.transform("p", lambda x: x["min_val"]).alias("low"), F.transform("p", lambda x: x["scale"]).alias("scale"))


def encode(rows: DataFrame, trained: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """``rows`` with ``codes``, ``low`` and ``scale``."""
    return rows.crossJoin(F.broadcast(parameters(trained))).withColumn("codes", quantize(vec_col, "low", "scale"))


def decode(coded: DataFrame) -> DataFrame:
    """With ``decoded``: min + code * scale."""
    return coded.withColumn("decoded", dequantize("codes", "low", "scale"))


def steps(coded: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """With each vector as its codes times their scale: plain squared distances of these are ``quantized_l2``."""
    return coded.withColumn(vec_col, F.zip_with("codes", "scale", lambda c, s: c * s))


def reconstruction_error(rows: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Rows with ``error``: squared distance of each vector to its decoded codes."""
    coded = decode(encode(rows, train(rows, vec_col), vec_col))
    return coded.withColumn("error", squared_l2(vec_col, "decoded"))
