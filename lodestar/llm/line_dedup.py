"""Line deduplication by range-partitioned line hashes.

Lines become 128-bit hashes of their keys. The rows (hash, document, positions) are range
partitioned by hash and document and sorted by hash and descending document, so that a
reader streams over each key with the kept document first and holds two documents at most.
A key whose rows lie in several partitions is settled from per-partition summaries, of which
there are two for a partition: a very frequent line costs no task more than its share.
The results are keep bitmaps, not texts.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import NULL_ID, batch_of, documents, id_back, materialize, partitions, release, spark_schema, tune

_STRIP = b" \t\n\x0b\x0c\r"
_LINES = pa.schema([("h", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("k", pa.int64()), ("n_lines", pa.int64()), ("at", pa.binary())])
_RUNS = pa.schema([*_LINES, ("kind", pa.int32()), ("n_docs", pa.int64())])
_DROP, _OPEN, _SUMMARY = 0, 1, 2


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least)


def _line_rows(least: int):
    import xxhash

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in _LINES]
            for doc, k, text in zip(batch.column("doc_id").to_pylist(), batch.column("k").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                lines, found = text.split(b"\n"), {}
                for at, line in enumerate(lines):
                    if len(line) >= least and _long_enough(key := line.strip(_STRIP).lower(), least):
                        found.setdefault(key, []).append(at)
                for key, at in found.items():
                    for column, value in zip(out, (*struct.unpack("<qq", xxhash.xxh3_128_digest(key)), doc, k, len(lines), struct.pack(f"<{len(at)}I", *at)), strict=True):
                        column.append(value)
            yield batch_of(_LINES, *out)

    return rows


def _stream(least_docs: int):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        pending: list[tuple] = []  # the rows of a key's first documents, while it has too few
        key, first, doc, docs, head = None, None, None, 0, True

        def summary() -> tuple:
            return (*key, first, 0, 0, b"", _SUMMARY, docs)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:2] != key:
                    if key is not None and head:
                        out.append(summary())
                        head = False
                    elif key is None:
                        head = True
                    key, first, doc, docs, pending = row[:2], row[2], row[2], 1, []
                elif row[2] != doc:
                    doc, docs = row[2], docs + 1
                if head:
                    out.append((*row, _OPEN, 0))
                elif docs >= least_docs:
                    out += [(*p, _DROP, 0) for p in pending if p[2] != first]
                    pending = []
                    if doc != first:
                        out.append((*row, _DROP, 0))
                else:
                    pending.append(row)
            if len(out) > 5000:
                yield batch_of(_RUNS, *zip(*out, strict=True))
                out = []
        if key is not None:
            out += [(*p, _OPEN, 0) for p in pending]
            out.append(summary())
        if out:
            yield batch_of(_RUNS, *zip(*out, strict=True))

    return runs


@F.pandas_udf(T.BinaryType())
def _bitmap(parts, n_lines):
    import pandas as pd

    made = []
    for lists, n in zip(parts, n_lines, strict=True):
        keep = np.ones(n, np.uint8)
        for x in lists:
            keep[np.frombuffer(x, "<u4")] = 0
        made.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 1))
    return pd.Series(made)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, k): k tells texts apart that come under one doc_id."""
    return documents(docs).withColumn("k", F.xxhash64("text"))


def line_keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Keep bitmaps of the documents that lose lines: (doc_id, k, n_lines, n_dropped, keep).

    A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased. Keys of at
    least ``min_chars`` code points in at least ``min_docs`` documents lose all lines except
    those in the largest doc_id. ``keep``: zlib-compressed bits, least first, 1 for a kept line.
    Rows that repeat a doc_id count as one document for a key; equal rows get equal bitmaps.
    Null or empty texts have one empty line and lose nothing, an empty table gives no rows; a
    null doc_id counts as the smallest. Other columns are ignored.
    """
    spark = docs.sparkSession
    tune(spark)
    rows = materialize(keyed(docs).select("doc_id", "k", "text").mapInArrow(_line_rows(min_chars), spark_schema(_LINES)), "lines")
    by = ["h", "h2", F.desc("doc_id")]
    sorted_ = rows.repartitionByRange(partitions(spark), *by).sortWithinPartitions(*by)
    runs = materialize(sorted_.mapInArrow(_stream(min_docs), spark_schema(_RUNS)), "line-runs")
    release(rows)
    # At most two summaries for each partition: small however large the corpus.
    settled = runs.where(F.col("kind") == _SUMMARY).groupBy("h", "h2").agg(F.sum("n_docs").alias("docs"), F.max("doc_id").alias("kept")).where(F.col("docs") >= min_docs)
    opened = runs.where(F.col("kind") == _OPEN).join(F.broadcast(settled), ["h", "h2"]).where(F.col("doc_id") != F.col("kept"))
    columns = ["doc_id", "k", "n_lines", "at"]
    drops = runs.where(F.col("kind") == _DROP).select(*columns).union(opened.select(*columns)).distinct()
    found = drops.groupBy("doc_id", "k").agg(F.max("n_lines").alias("n_lines"), (F.sum(F.length("at")) / 4).cast("long").alias("n_dropped"), F.collect_list("at").alias("parts"))
    return found.select("doc_id", "k", "n_lines", "n_dropped", _bitmap("parts", "n_lines").alias("keep"))


def keep_lines(text: bytes, keep: bytes | None) -> bytes:
    """The text with the lines that a bitmap keeps (None: all)."""
    if keep is None:
        return text
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")
    return b"\n".join(line for line, bit in zip(text.split(b"\n"), bits, strict=False) if bit)


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        made = [hashlib.sha256(keep_lines(t, k)).hexdigest() for t, k in zip(texts, batch.column("keep").to_pylist(), strict=True)]
        yield batch_of(_DIGEST, batch.column("doc_id"), [t.count(b"\n") + 1 for t in texts], batch.column("n_dropped"), made)


def dedup_digests(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every row of ``docs``."""
    joined = _with_bitmaps(keyed(docs), line_keep_bitmaps(docs, **options))
    return joined.select("doc_id", "text", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), "keep").mapInArrow(_digests, spark_schema(_DIGEST)).withColumn("doc_id", id_back())


def _with_bitmaps(left: DataFrame, maps: DataFrame) -> DataFrame:
    return left.join(maps.select("doc_id", "k", "n_dropped", "keep"), ["doc_id", "k"], "left")


@F.pandas_udf(T.StringType())
def _apply(texts, keeps):
    import pandas as pd

    return pd.Series([t if k is None else keep_lines(t.encode(), k).decode() for t, k in zip(texts, keeps, strict=True)])


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with repeated lines taken out of the text, all columns and rows kept.

    Texts that lose nothing stay as they are, null included; n_chars, if there, is brought up to date.
    """
    names = docs.columns
    maps = line_keep_bitmaps(docs, **options).select(F.col("doc_id").alias("id"), "k", "keep").alias("__maps")
    here = docs.alias("__docs")
    same_id = F.coalesce(F.col("__docs.doc_id").cast("long"), F.lit(NULL_ID)) == F.col("__maps.id")
    joined = here.join(maps, same_id & (F.xxhash64(F.coalesce(F.col("__docs.text"), F.lit(""))) == F.col("__maps.k")), "left")
    keep = F.col("__maps.keep")
    new = F.when(keep.isNull(), F.col("__docs.text")).otherwise(_apply(F.coalesce(F.col("__docs.text"), F.lit("")), keep))
    made = joined.select(*[F.col(f"__docs.`{c}`") if c != "text" else new.alias("text") for c in names])
    return made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else made

