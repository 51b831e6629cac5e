"""Clusters, their keywords, and coordinates for drawing."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import chunk_name, chunk_number, chunk_path, is_keyword, raw_keywords


def cluster_count(n: int) -> int:
    return max(2, min(15, n // 10))


def kmeans(rows: DataFrame, k: int | None = None, seed: int = 42, vec_col: str = "embedding", max_iter: int = 20) -> DataFrame:
    """``rows`` with ``cluster``."""
    ready = rows.withColumn("__v", array_to_vector(F.col(vec_col).cast("array<double>")))
    model = KMeans(k=k or cluster_count(rows.count()), seed=seed, maxIter=max_iter, featuresCol="__v", predictionCol="cluster").fit(ready)
    return model.transform(ready).drop("__v")


def pca(rows: DataFrame, k: int = 3, vec_col: str = "embedding") -> DataFrame:
    """``rows`` with x, y, z: the first components, missing ones 0."""
    ready = rows.withColumn("__v", array_to_vector(F.col(vec_col).cast("array<double>")))
    model = PCA(k=k, inputCol="__v", outputCol="__p").fit(ready)
    out = model.transform(ready).withColumn("__a", vector_to_array("__p"))
    for at, name in enumerate("xyz"):
        out = out.withColumn(name, F.get("__a", F.lit(at)) if at < k else F.lit(0.0))
    return out.drop("__v", "__p", "__a")


def top_tokens(rows: DataFrame, key: str, token: str, n: int = 3) -> DataFrame:
    """(key, token, n, rank): the most frequent tokens of each key; counted before they are ranked."""
    counts = rows.groupBy(key, token).agg(F.count("*").alias("n"))
    order = Window.partitionBy(key).orderBy(F.desc("n"), token)
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def cluster_labels(rows: DataFrame, text: str, cluster: str = "cluster", stop_words: tuple[str, ...] = (), n: int = 3) -> DataFrame:
    """(cluster, label): ``Grupo c: A | B | C``, or ``(Varios)`` without keywords."""
    tokens = rows.select(cluster, F.explode(raw_keywords(text)).alias("token")).where(is_keyword("token", stop_words))
    best = top_tokens(tokens, cluster, "token", n)
    named = best.groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct("rank", F.initcap("token").alias("w")))).alias("p"))
    named = rows.select(cluster).distinct().join(named, cluster, "left")
    words = F.coalesce(F.array_join(F.transform("p", lambda x: x["w"]), " | "), F.lit("(Varios)"))
    return named.select(cluster, F.concat(F.lit("Grupo "), F.col(cluster).cast("string"), F.lit(": "), words).alias("label"))


def scatter_frame(rows: DataFrame, text_id: str = "id", seed: int = 42) -> DataFrame:
    """(note, path, fragment, x, y, z, label) of live rows: the table behind a scatter plot."""
    live = rows.where("NOT deleted") if "deleted" in rows.columns else rows
    placed = pca(kmeans(live, seed=seed))
    labels = cluster_labels(placed.withColumn("__text", F.regexp_replace(chunk_name(text_id), r"\.md$", "")), "__text")
    return placed.join(F.broadcast(labels), "cluster").select(chunk_name(text_id).alias("note"), chunk_path(text_id).alias("path"), chunk_number(text_id).alias("fragment"), "x", "y", "z", "label")
