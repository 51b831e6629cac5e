"""Quality by regularised quadratic discriminant analysis over transformed document statistics.

Statistics of the whole text are transformed towards symmetry. Each class gets a mean and a
covariance shrunk towards the pooled covariance and its diagonal; the Cholesky factors are
computed once, on the driver, and the score is the logistic of the difference between the
classes' log-densities (Mahalanobis distance and log-determinant) and log-priors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import batch_of, documents, id_back, id_remainder, materialize, slices, span_hashes, spark_schema, text_bytes, tune, word_spans

STATISTICS = (
    "words",
    "word_length",
    "word_length_spread",
    "upper",
    "punctuation",
    "digits",
    "line_breaks",
    "wide_characters",
    "lone_signs",
    "symbol_ends",
    "upper_words",
    "distinct_words",
    "distinct_pairs",
    "distinct_lines",
    "most_frequent_word",
)
_D = len(STATISTICS)

_KIND = np.zeros(256, np.int64)
_UPPER, _LOWERCASE, _DIGIT, _PUNCT, _BREAK, _WIDE = range(1, 7)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[10], _KIND[128:] = _UPPER, _LOWERCASE, _DIGIT, _BREAK, _WIDE
for _b in [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]:
    _KIND[_b] = _PUNCT
_PLAIN_END = np.zeros(256, bool)
_PLAIN_END[[ord(c) for c in ".,;:?'\")"]] = True


def _segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of each row's values are true."""
    made, some = np.zeros(len(offsets) - 1), np.flatnonzero(np.diff(offsets))
    if len(some):
        made[some] = np.add.reduceat(values, offsets[some], dtype=np.int64)
    return made


def _distinct(rows: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row: how many distinct keys it has, and how often the most frequent one occurs."""
    if not len(rows):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((keys, rows))
    r, k = rows[order], keys[order]
    fresh = np.r_[True, (r[1:] != r[:-1]) | (k[1:] != k[:-1])]
    at = np.flatnonzero(fresh)
    count = np.diff(np.r_[at, len(r)])
    most = np.zeros(n)
    np.maximum.at(most, r[at], count)
    return np.bincount(r[at], minlength=n).astype(float), most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``STATISTICS`` for each text of a batch, already transformed."""
    n, size = len(offsets) - 1, np.diff(offsets)
    kind, filled = _KIND[data], np.maximum(size, 1)
    share = {k: _segment_sum(kind == k, offsets) / filled for k in (_UPPER, _DIGIT, _PUNCT, _BREAK, _WIDE)}
    starts, ends, rows = word_spans(data, offsets)
    words = np.bincount(rows, minlength=n).astype(float)
    some = np.maximum(words, 1)
    length = (ends - starts).astype(float)
    mean = np.bincount(rows, length, n) / some
    spread = np.sqrt(np.maximum(np.bincount(rows, length**2, n) / some - mean**2, 0))
    if len(starts):
        sums = np.zeros(len(data) + 1, np.int32)
        np.cumsum((kind == _UPPER) | (kind == _LOWERCASE) | (kind == _DIGIT) | (kind == _WIDE), out=sums[1:])
        letters = sums[ends] - sums[starts]
        np.cumsum(kind == _LOWERCASE, out=sums[1:])
        small = sums[ends] - sums[starts]
        np.cumsum(kind == _UPPER, out=sums[1:])
        large = sums[ends] - sums[starts]
        last = data[ends - 1]
        odd = (letters > 0) & (kind[ends - 1] == _PUNCT) & ~_PLAIN_END[last]
        lone, odd = np.bincount(rows, letters == 0, n) / some, np.bincount(rows, odd, n) / some
        shout = np.bincount(rows, (small == 0) & (large > 1), n) / some
    else:
        lone = odd = shout = np.zeros(n)
    hashes = span_hashes(data, starts, ends)
    distinct, most = _distinct(rows, hashes, n)
    same = rows[1:] == rows[:-1]
    pairs, _ = _distinct(rows[1:][same], (hashes[1:] + hashes[:-1] * np.uint64(0x9E3779B97F4A7C15))[same], n)
    breaks = np.flatnonzero(data == 10)
    line_rows = np.r_[np.arange(n), np.searchsorted(offsets, breaks, side="right") - 1]
    line_starts = np.r_[offsets[:-1], breaks + 1]
    order = np.lexsort((line_starts, line_rows))
    line_rows, line_starts = line_rows[order], line_starts[order]
    follows = np.r_[line_rows[1:] == line_rows[:-1], False]
    line_ends = np.where(follows, np.r_[line_starts[1:], 0] - 1, offsets[line_rows + 1])
    lines, _ = _distinct(line_rows, span_hashes(data, line_starts, line_ends), n)
    logit = lambda p: np.log((p + 0.005) / (1.005 - np.minimum(p, 1)))
    count = np.maximum(np.bincount(line_rows, minlength=n), 1)
    # Shares of distinct things fall as a text grows, so they are taken on the scale of logarithms.
    log_share = lambda d, m: np.log1p(d) / np.log1p(np.maximum(m, 1))
    return np.column_stack(
        [np.log1p(words), np.log1p(mean), np.log1p(spread), logit(share[_UPPER]), logit(share[_PUNCT]), logit(share[_DIGIT]), logit(share[_BREAK]), logit(share[_WIDE])]
        + [logit(lone), logit(odd), logit(shout), log_share(distinct, words), log_share(pairs, words - 1), log_share(lines, count), logit(most / some)]
    )


@dataclass
class Discriminant:
    """Class means, inverse Cholesky factors, log-determinants and log-priors (class 0, class 1)."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    log_priors: np.ndarray
    temperature: float = 4.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        log = []
        for c in (0, 1):
            z = (x - self.means[c]) @ self.factors[c].T
            log.append(-0.5 * (z * z).sum(1) - 0.5 * self.log_dets[c] + self.log_priors[c])
        return 1 / (1 + np.exp(-np.clip((log[1] - log[0]) / self.temperature, -500, 500)))


def discriminant(n: np.ndarray, total: np.ndarray, outer: np.ndarray, to_pooled: float = 0.3, to_diagonal: float = 0.1) -> Discriminant:
    """From each class's count, sum and sum of outer products."""
    n = np.maximum(n.astype(float), 0)
    safe = np.maximum(n, 1)
    means = total / safe[:, None]
    own = [outer[c] / safe[c] - np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = (n[0] * own[0] + n[1] * own[1]) / max(n.sum(), 1) + 1e-3 * np.eye(total.shape[1])
    factors, dets = [], []
    for c in (0, 1):
        weight = to_pooled if n[c] > 2 * total.shape[1] else 1.0
        s = (1 - weight) * own[c] + weight * pooled
        s = (1 - to_diagonal) * s + to_diagonal * np.diag(np.diag(s))
        low = np.linalg.cholesky(s + 1e-6 * np.eye(len(s)))
        factors.append(np.linalg.inv(low))
        dets.append(2 * np.log(np.diag(low)).sum())
    return Discriminant(means, np.array(factors), np.array(dets), np.log((n + 1) / (n.sum() + 2)))


_STATS = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        x = statistics(*text_bytes(batch.column("text")))
        yield batch_of(_STATS, batch.column("doc_id"), pa.ListArray.from_arrays(np.arange(0, _D * len(x) + 1, _D, dtype=np.int32), x.ravel()))


_MOMENTS = pa.schema([("label", pa.int32()), ("at", pa.int32()), ("value", pa.float64())])


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, _D)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros((2, 1 + _D + _D * _D))
    for batch in batches:
        if batch.num_rows:
            x, label = _matrix(batch.column("x")), batch.column("label").to_numpy()
            for c in (0, 1):
                part = x[label == c]
                sums[c] += np.r_[len(part), part.sum(0), (part.T @ part).ravel()]
    width = sums.shape[1]
    yield batch_of(_MOMENTS, np.repeat([0, 1], width).astype(np.int32), np.tile(np.arange(width), 2).astype(np.int32), sums.ravel())


def training_labels(labels: DataFrame, column: str, held_out: int = 1, mod: int = 3) -> DataFrame:
    """(doc_id, label) of the rows a model may learn from; rows of one id are averaged, nulls left out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    return known.where(id_remainder(mod) != held_out).groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))


_SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Learns from all labelled rows outside the held-out third: per-class moments are summed where
    the rows are, and 2 * (1 + d + d*d) sums reach the driver. Null and empty texts are scored by
    their (all-zero) statistics; repeated rows alike; without labels of a class the pooled
    covariance and equal priors stand in; an empty table gives no rows. Other columns are ignored.
    """
    tune(docs.sparkSession)
    stats = materialize(documents(docs).mapInArrow(_stats, spark_schema(_STATS)), "quality")
    labelled = stats.join(training_labels(labels, "quality"), "doc_id").select("label", "x")
    rows = labelled.mapInArrow(_moments, spark_schema(_MOMENTS)).groupBy("label", "at").agg(F.sum("value").alias("value")).collect()
    sums = np.zeros((2, 1 + _D + _D * _D))
    for r in rows:
        sums[r.label, r.at] = r.value
    model = discriminant(sums[:, 0], sums[:, 1 : 1 + _D], sums[:, 1 + _D :].reshape(2, _D, _D))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch_of(_SCORES, batch.column("doc_id"), model.scores(_matrix(batch.column("x"))))

    scored = stats.mapInArrow(score, spark_schema(_SCORES))
    return scored.select(id_back(), (id_remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast(T.IntegerType()).alias("predicted"))
