"""The vector store as an append-only log and views of it.

A log row is (seq, op, id, embedding) with op one of set, del, flush. Sequence numbers give the
order. A write that is nearly the stored vector again changes nothing; what counts is the vector
*stored*, not the last one written, so each id's rows are folded in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import glob
from lodestar.functions.vectors import format_vector
from lodestar.operators.search import distances

SET, DELETE, FLUSH = "set", "del", "flush"
#: A new vector this near to the stored one is the same one.
SAME = 1e-5
LOG = "seq long, op string, id string, embedding array<float>"
_NODES = pa.schema([("internal_id", pa.int64()), ("id", pa.string()), ("embedding", pa.list_(pa.float32())), ("deleted", pa.bool_()), ("deleted_at", pa.int64())])


def since_flush(log: DataFrame) -> DataFrame:
    """The rows after the last flush."""
    last = log.where(F.col("op") == FLUSH).agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("__flushed"))
    return log.crossJoin(F.broadcast(last)).where(F.col("seq") > F.col("__flushed")).drop("__flushed").where(F.col("op") != FLUSH)


def fold(rows: Iterator[tuple], metric: str) -> Iterator[tuple]:
    """Stored nodes of rows (id, seq, op, embedding) sorted by id and seq: (internal_id, id, embedding, deleted, deleted_at)."""
    current, node = None, None
    for key, seq, op, vector in rows:
        if key != current:
            if node:
                yield (*node, False, None)
            current, node = key, None
        if op == DELETE:
            if node:
                yield (*node, True, seq)
            node = None
        elif vector is not None and key:
            if node:
                a, b = np.array([node[2]], np.float64), np.array([vector], np.float64)
                if a.shape == b.shape and distances(a, b, metric)[0, 0] < SAME:
                    continue
                yield (*node, True, seq)
            node = (seq, key, vector)
    if node:
        yield (*node, False, None)


def nodes(log: DataFrame, metric: str = "cosine") -> DataFrame:
    """Every node ever stored since the last flush: (internal_id, id, embedding, deleted, deleted_at).

    Rows of one id meet sorted and are streamed, holding one vector; ids spread over partitions.
    Empty ids are refused.
    """
    from pyspark.sql.pandas.types import from_arrow_schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        held = []
        for node in fold(rows(), metric):
            held.append(node)
            if len(held) == 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _NODES, strict=True)], schema=_NODES)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _NODES, strict=True)], schema=_NODES)

    kept = since_flush(log).where("id IS NOT NULL AND id <> ''").select("id", "seq", "op", "embedding")
    return kept.repartition("id").sortWithinPartitions("id", "seq").mapInArrow(run, from_arrow_schema(_NODES))


def nodes_since(saved: DataFrame, log: DataFrame, metric: str = "cosine") -> DataFrame:
    """``nodes`` of a whole log, from the nodes of its beginning (``saved``) and its later rows (``log``).

    Only ids that later rows name are folded again; the other saved nodes pass through, unless a
    flush among the later rows ends them all.
    """
    flushes = log.where(F.col("op") == FLUSH).agg(F.count("*").alias("__flushes"))
    kept = saved.crossJoin(F.broadcast(flushes)).where("__flushes = 0").drop("__flushes")
    named = log.where("id IS NOT NULL").select("id").distinct()
    again = saved.where("NOT deleted").join(named, "id", "left_semi").select(F.col("internal_id").alias("seq"), F.lit(SET).alias("op"), "id", "embedding")
    still = kept.where("deleted").unionByName(kept.where("NOT deleted").join(named, "id", "left_anti"))
    return still.unionByName(nodes(again.unionByName(log.select("seq", "op", "id", "embedding")), metric))


def live_nodes(log: DataFrame, metric: str = "cosine") -> DataFrame:
    return nodes(log, metric).where("NOT deleted").drop("deleted", "deleted_at")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by ``order``; only its best rows leave a partition."""
    place = Window.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("__place", F.row_number().over(place)).where("__place = 1").drop("__place")


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``rows`` whose key isn't in ``gone``: tombstones as an anti-join."""
    return rows.join(gone.select(key), key, "left_anti")


def scan(rows: DataFrame, pattern: str = "*", limit: int | None = 100, include_deleted: bool = True, id_col: str = "id", order: str = "internal_id") -> DataFrame:
    """Rows whose id matches a glob, in order of insertion; tombstones too unless told otherwise.

    A pattern and limit become a filter in the scan and a top-k. ``limit`` None or negative: all rows.
    """
    found = rows if include_deleted or "deleted" not in rows.columns else rows.where("NOT deleted")
    found = found.where(glob(id_col, pattern)).orderBy(order)
    return found if limit is None or limit < 0 else found.limit(limit)


def hgetall(rows: DataFrame, pattern: str = "*", limit: int | None = 100, include_deleted: bool = True) -> DataFrame:
    """(id, vector as text)."""
    return scan(rows, pattern, limit, include_deleted).select("id", format_vector("embedding").alias("vector"))


def info(rows: DataFrame, settings: dict[str, object] | None = None) -> DataFrame:
    """(key, value): keys stored ever, live keys, dimension, and the settings."""
    live = F.sum(F.when(F.col("deleted"), 0).otherwise(1)) if "deleted" in rows.columns else F.count("*")
    stats = rows.agg(F.count("*").alias("total_keys"), F.coalesce(live, F.lit(0)).alias("live_keys"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dim"), F.coalesce(F.max("internal_id"), F.lit(-1)).alias("last_id"))
    pairs = [F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in ("total_keys", "live_keys", "dim", "last_id")]
    pairs += [F.struct(F.lit(k).alias("key"), F.lit(str(v)).alias("value")) for k, v in (settings or {}).items()]
    return stats.select(F.explode(F.array(*pairs)).alias("p")).select("p.key", "p.value")
