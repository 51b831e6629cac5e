"""Snapshots: versioned Parquet tables, and the binary dump format for exchange.

A version is written whole and only then named in the pointer, so a reader never sees half of
one, and a save needs no lock.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the binary format.
MAGIC = b"HVL2"
DELETED_BIT = 1 << 31
MOST_ID_BYTES = 4095


def save_snapshot(nodes: DataFrame, root: str, seq: int = -1) -> str:
    """Write a new version of ``nodes`` under ``root`` and point to it, telling the last log row in it. Returns the version."""
    spark = nodes.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    nodes.write.parquet(f"{root}/{version}")
    spark.createDataFrame([(version, seq)], "version string, seq long").withColumn("saved_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{root}/versions")
    return version


def last_version(spark: SparkSession, root: str) -> tuple[str, int] | None:
    """The version last pointed to and the last log row in it, or None."""
    from pyspark.errors import AnalysisException

    try:
        last = spark.read.parquet(f"{root}/versions").orderBy(F.desc("saved_at"), "version").first()
    except AnalysisException:
        return None
    return (last.version, last.seq) if last else None


def load_snapshot(spark: SparkSession, root: str, version: str | None = None) -> DataFrame | None:
    """A version, or that last pointed to; None if there is none."""
    version = version or (last_version(spark, root) or (None,))[0]
    return spark.read.parquet(f"{root}/{version}") if version else None


def dump_bytes(nodes: list[dict], dim: int, entry: int = -1) -> bytes:
    """The binary form of nodes in internal order: id, embedding, level, deleted, neighbours by level."""
    top = max((n.get("level", 0) for n in nodes), default=0)
    out = [MAGIC, struct.pack("<QQIi", dim, len(nodes), top, entry if nodes else -1)]
    for n in nodes:
        raw = n["id"].encode()
        if not 0 < len(raw) <= MOST_ID_BYTES:
            raise ValueError("an id of a dump has 1 to 4095 bytes")
        out.append(struct.pack("<II", n.get("level", 0) | (DELETED_BIT if n.get("deleted") else 0), len(raw)) + raw + struct.pack(f"<{dim}f", *n["embedding"]))
    for n in nodes:
        links = n.get("neighbours") or []
        for level in range(n.get("level", 0) + 1):
            own = links[level] if level < len(links) else []
            out.append(struct.pack(f"<I{len(own)}I", len(own), *own))
    return b"".join(out)


def read_dump(data: bytes) -> tuple[dict, list[dict]]:
    """(header, nodes) of the binary form; raises ValueError on anything else."""
    if data[:4] != MAGIC:
        raise ValueError("not a dump")
    dim, count, top, entry = struct.unpack_from("<QQIi", data, 4)
    at, nodes = 28, []
    for k in range(count):
        flags, size = struct.unpack_from("<II", data, at)
        if not 0 < size <= MOST_ID_BYTES:
            raise ValueError("bad id length")
        at += 8
        name = data[at : at + size].decode()
        at += size
        vector = list(struct.unpack_from(f"<{dim}f", data, at))
        at += 4 * dim
        nodes.append({"internal_id": k, "id": name, "embedding": vector, "level": flags & ~DELETED_BIT, "deleted": bool(flags & DELETED_BIT), "neighbours": []})
    for n in nodes:
        for _ in range(n["level"] + 1):
            (size,) = struct.unpack_from("<I", data, at)
            n["neighbours"].append(list(struct.unpack_from(f"<{size}I", data, at + 4)))
            at += 4 + 4 * size
    return {"dim": dim, "count": count, "max_level": top, "entry": entry}, nodes


DUMP_SCHEMA = "path string, internal_id long, id string, embedding array<float>, level int, deleted boolean, neighbours array<array<long>>"


def dumps(spark: SparkSession, path: str) -> DataFrame:
    """The nodes of all binary dumps under ``path``, a file a task."""

    def decode(batches) -> Iterator:
        import pandas as pd

        for frame in batches:
            for where, content in zip(frame["path"], frame["content"], strict=True):
                yield pd.DataFrame([{"path": where, **n} for n in read_dump(content)[1]], columns=["path", "internal_id", "id", "embedding", "level", "deleted", "neighbours"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, DUMP_SCHEMA)
