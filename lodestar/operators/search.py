"""Nearest neighbours: exact, one query or many, and the measures that judge a search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.vectors import LEAST_NORM, distance

THRESHOLD = 0.85
#: Queries that one pass over the base answers: what a task holds besides its batch.
QUERY_BLOCK = 4096
#: A base of no more values than this (rows times dimensions, counted first) goes to the queries instead.
SMALL_BASE = 8_000_000
#: Distances held at once.
_CELLS = 4_000_000
#: So many values about a place of the sorted order are fetched and sorted; more are narrowed first.
_FETCHED = 100_000
#: A sketch's value lies off its place by a share of one in so many.
_SKETCH = 10_000


def nearest(base: DataFrame, vector: list[float], k: int, metric: str = "cosine", threshold: float | None = THRESHOLD, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """(id, distance): the k nearest live rows by (distance, id), those beyond ``threshold`` then dropped.

    One column expression and a top-k: each partition keeps k rows and nothing is shuffled but those.
    """
    if k <= 0:
        return base.select(F.col(id_col), F.lit(0.0).alias("distance")).limit(0)
    query = F.array(*[F.lit(float(x)) for x in vector])
    found = live(base).select(F.col(id_col), distance(metric, F.col(vec_col), query).alias("distance")).orderBy("distance", id_col).limit(k)
    return found if threshold is None else found.where(F.col("distance") <= threshold)


def live(rows: DataFrame) -> DataFrame:
    """Without tombstones, where the rows have that column."""
    return rows.where(~F.col("deleted")) if "deleted" in rows.columns else rows


def distances(queries: np.ndarray, base: np.ndarray, metric: str) -> np.ndarray:
    """All distances of two matrices, in doubles."""
    q, b = queries.astype(np.float64), base.astype(np.float64)
    if metric == "l2":
        return np.maximum((q * q).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * q @ b.T, 0)
    size = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(size < LEAST_NORM, 1.0, 1 - q @ b.T / size)


_FOUND = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())])


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def nearest_k(ids: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the k best columns of each row of ``d``, by (distance, id)."""
    if d.shape[1] > k:
        # Columns up to the k-th distance, ties included, are few: order those alone.
        cut = np.partition(d, k - 1, 1)[:, k - 1 : k]
        width = int((d <= cut).sum(1).max())
        some = np.argpartition(d, width - 1, 1)[:, :width] if width < d.shape[1] else np.broadcast_to(np.arange(width), d.shape)
        d, ids = np.take_along_axis(d, some, 1), ids[some] if ids.ndim == 1 else np.take_along_axis(ids, some, 1)
    elif ids.ndim == 1:
        ids = np.broadcast_to(ids, d.shape)
    pick = np.lexsort((ids, d))[:, :k]
    return np.take_along_axis(ids, pick, 1), np.take_along_axis(d, pick, 1)


_RANKED = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("distance", pa.float64()), ("rank", pa.int32())])


def _answer_from(base: pa.Table, k: int, metric: str, threshold: float | None):
    """A function from batches of queries to their ranked answers from a whole base."""
    ids, vectors = base.column(0).to_numpy(), matrix(base.column(1).combine_chunks())

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, _CELLS // max(1, len(ids)))
        for batch in batches:
            for at in range(0, batch.num_rows if len(ids) else 0, step):
                part = batch.slice(at, step)
                i, d = nearest_k(ids, distances(matrix(part.column(1)), vectors, metric), k)
                q, rank = np.repeat(part.column(0).to_numpy(), i.shape[1]), np.tile(np.arange(1, i.shape[1] + 1, dtype=np.int32), len(i))
                i, d = i.ravel(), d.ravel()
                keep = np.ones(len(d), bool) if threshold is None else d <= threshold
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (q, i, d, rank)], schema=_RANKED)

    return answer


def nearest_batch(
    base: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", threshold: float | None = None, query_block: int = QUERY_BLOCK, small_base: int = SMALL_BASE
) -> DataFrame:
    """(query_id, id, distance, rank) for queries (query_id, embedding) against base (id, embedding).

    A base that is counted and found small goes to the queries, which are answered where they
    are, without a shuffle. Otherwise queries go to the base in blocks of bounded size: each
    partition of the base answers with its own k best rows a query, so the one shuffle moves k
    rows for each query and partition however large the base is, and the final rank is taken
    over those.
    """
    from pyspark.sql.pandas.types import from_arrow_schema

    rows = live(base).select(F.col("id").cast("long").alias("id"), "embedding").where("id IS NOT NULL AND embedding IS NOT NULL")
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding").where("query_id IS NOT NULL AND embedding IS NOT NULL")
    if k > 0 and small_base:
        size = rows.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
        if size.n * (size.dim or 0) <= small_base:
            wide = asked if asked.rdd.getNumPartitions() >= rows.sparkSession.sparkContext.defaultParallelism else asked.repartition(rows.sparkSession.sparkContext.defaultParallelism)
            return wide.mapInArrow(_answer_from(rows.toArrow(), k, metric, threshold), from_arrow_schema(_RANKED))
    blocks = max(1, -(-asked.count() // query_block)) if k > 0 else 0
    made = None
    for n in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n).toArrow()
        if not part.num_rows:
            continue
        ids, vectors = part.column(0).to_numpy(), matrix(part.column(1).combine_chunks())

        def find(batches: Iterator[pa.RecordBatch], ids=ids, vectors=vectors) -> Iterator[pa.RecordBatch]:
            best_d = np.full((len(ids), 0), np.inf)
            best_i = np.zeros((len(ids), 0), np.int64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                d = np.concatenate([best_d, distances(vectors, matrix(batch.column(1)), metric)], 1)
                i = np.concatenate([best_i, np.broadcast_to(batch.column(0).to_numpy(), (len(ids), batch.num_rows))], 1)
                i, d = nearest_k(i, d, k)
                best_d, best_i = d, i
            width = best_d.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, width)), pa.array(best_i.ravel()), pa.array(best_d.ravel())], schema=_FOUND)

        found = rows.mapInArrow(find, from_arrow_schema(_FOUND))
        made = found if made is None else made.union(found)
    if made is None:
        made = asked.select("query_id", F.col("query_id").alias("id"), F.lit(0.0).alias("distance")).limit(0)
    return ranked(made, k, threshold)


def ranked(found: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    """The k best rows of each query, ranked by (distance, id); then the threshold."""
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best if threshold is None else best.where(F.col("distance") <= threshold)


def recall(exact: DataFrame, found: DataFrame) -> Column | DataFrame:
    """(hits, wanted, recall) of found (query_id, id) against exact (query_id, id)."""
    hits = exact.select("query_id", "id").join(found.select("query_id", "id").distinct(), ["query_id", "id"]).agg(F.count("*").alias("hits"))
    wanted = exact.agg(F.count("*").alias("wanted"))
    return hits.crossJoin(wanted).select("hits", "wanted", F.when(F.col("wanted") > 0, F.round(F.col("hits") / F.col("wanted"), 6)).alias("recall"))


def percentile_row(rows: DataFrame, value: str, share: float) -> DataFrame:
    """(share, value): the row number floor(n * share) of the sorted values, counted from 0; no interpolation."""
    n = rows.where(F.col(value).isNotNull()).count()
    return nth_values(rows, value, {share: min(int(n * share), n - 1)})


def nth_values(rows: DataFrame, value: str, places: dict[float, int]) -> DataFrame:
    """The values at given places of the sorted order, NaN last; places outside it have no row.

    No place is told from how rows lie in partitions, as that changes whenever a plan runs again.
    A sketch gives two values about a place; exact counts of what is less and what is no more than
    each tell where the place lies, and so on inside, until few values are left to sort. A
    round excludes its two values, so it ends for any rows and any number of equal ones. Nothing is
    shuffled but a sketch and a row of counts for each partition.
    """
    known = rows.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    numbers = known.where(~F.isnan("v"))
    size = known.agg(F.count("*").alias("all"), F.count_if(~F.isnan("v")).alias("numbers")).first()
    found = {share: float("nan") for share, place in places.items() if size["numbers"] <= place < size["all"]}
    # Each other place lies between two values, themselves excluded: how many are no more than the lower one, how many less than the upper one.
    between = {share: (None, None, 0, size["numbers"]) for share, place in places.items() if 0 <= place < size["numbers"]}
    while wide := {share: x for share, x in between.items() if x[3] - x[2] > _FETCHED}:
        sketches = []
        for share, (low, high, below, end) in wide.items():
            at = (places[share] - below) / (end - below)
            sketches.append(F.percentile_approx(F.when(_inside("v", low, high), F.col("v")), [max(0.0, at - 2 / _SKETCH), min(1.0, at + 2 / _SKETCH)], _SKETCH))
        pivots = dict(zip(wide, numbers.agg(*[x.alias(f"s{n}") for n, x in enumerate(sketches)]).first()))
        tried = sorted({x for pair in pivots.values() for x in pair})
        counts = numbers.agg(*[F.count_if(c).alias(f"{name}{n}") for n, x in enumerate(tried) for name, c in (("less", F.col("v") < x), ("upto", F.col("v") <= x))]).first()
        for share, (low, high, below, end) in wide.items():
            for x in pivots[share]:
                n = tried.index(x)
                if places[share] < counts[f"less{n}"]:
                    high, end = x, counts[f"less{n}"]
                    break
                if places[share] < counts[f"upto{n}"]:
                    found[share] = x
                    break
                low, below = x, counts[f"upto{n}"]
            between[share] = (low, high, below, end)
        between = {share: x for share, x in between.items() if share not in found}
    if between:
        near = F.lit(False)
        for low, high, *_ in between.values():
            near = near | _inside("v", low, high)
        values = np.sort(numbers.where(near).toArrow().column(0).to_numpy())
        for share, (low, _, below, _) in between.items():
            start = 0 if low is None else int(np.searchsorted(values, low, "right"))
            found[share] = float(values[start + places[share] - below])
    return rows.sparkSession.createDataFrame([(float(share), found[share]) for share in places if share in found], "share double, value double")


def _inside(c: str, low: float | None, high: float | None) -> Column:
    """Whether a value lies between two others, themselves excluded; None: no bound."""
    above = F.lit(True) if low is None else F.col(c) > low
    return above if high is None else above & (F.col(c) < high)


def retrieval_accuracy(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(queries, top1, top3): shares of queries whose expected id comes first, or among three.

    found: (query_id, id, rank); expected: (query_id, expected_id).
    """
    places = expected.join(found.where("rank <= 3"), "query_id", "left").groupBy("query_id").agg(
        F.max(F.expr("CASE WHEN id = expected_id AND rank = 1 THEN 1 ELSE 0 END")).alias("first"), F.max(F.expr("CASE WHEN id = expected_id THEN 1 ELSE 0 END")).alias("any")
    )
    return places.agg(F.count("*").alias("queries"), F.round(F.avg("first"), 6).alias("top1"), F.round(F.avg("any"), 6).alias("top3"))
