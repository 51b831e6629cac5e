"""Connected components of an edge table: local contraction of bounded blocks, star steps between blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import batch_of, materialize, release, spark_schema

#: Edges that one task contracts at once: two numbers each, a few dozen MB with what it takes to do so.
BLOCK = 1_000_000
_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, and the least node each can reach: hooking and pointer jumping."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            further = root[root]
            if np.array_equal(further, root):
                break
            root = further
    return nodes, nodes[root]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a task as stars: each node and the least it reaches. Holds ``BLOCK`` edges and a star at most."""
    u, v, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for batch in batches:
        u.append(batch.column(0).to_numpy())
        v.append(batch.column(1).to_numpy())
        held += batch.num_rows
        if held > 2 * BLOCK:
            nodes, root = least_reachable(np.concatenate(u), np.concatenate(v))
            yield batch_of(_EDGES, nodes[nodes != root], root[nodes != root])
            u, v, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    nodes, root = least_reachable(np.concatenate(u), np.concatenate(v))
    yield batch_of(_EDGES, nodes[nodes != root], root[nodes != root])


def _star_round(e: DataFrame) -> DataFrame:
    """A large-star and a small-star step over (u, v), v < u; minima are pre-aggregated where the rows are."""
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    small_least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(small_least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.union(small_least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most: int = 60, block: int = BLOCK) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): the least node reachable.

    Tasks contract what they hold, ``block`` edges at most. While that leaves more than one
    block, star steps (plain aggregates and equi-joins, which Spark splits when a node has very
    many neighbours) bring the blocks' stars together; the last block finishes them.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    e, before = materialize(e, "edges"), None
    for _ in range(most):
        n = e.count()
        if n <= block:
            stars = materialize(e.coalesce(1).mapInArrow(_contract, spark_schema(_EDGES)), "stars")
            release(e)
            break
        old, e = e, materialize(_star_round(e.mapInArrow(_contract, spark_schema(_EDGES))), "edges")
        release(old)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            stars = e
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(stars.select("v", "v").distinct())
