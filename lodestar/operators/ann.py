"""Approximate nearest neighbours: layered proximity graphs over shards of bounded size.

Each shard is a navigable graph of its own, built and searched in one task; a query goes to all
shards and the k best answers are merged. Shards follow from the number of rows, so a shard never
outgrows a task and recall doesn't fall as the table grows. A shard is built at once, from exact
neighbours by matrix products; rows that come later are inserted one by one.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.search import distances, live, matrix, ranked

SHARD_ROWS = 20_000
M, EF_CONSTRUCTION, EF_SEARCH, MAX_LEVELS = 16, 150, 128, 16
#: Numbers in a block of distances.
_CELLS = 8_000_000


class Graph:
    """A layered proximity graph over the rows of a matrix.

    Equal rows are one node, that of the first of them, so copies crowd nothing out of the links.
    """

    def __init__(self, vectors: np.ndarray, metric: str = "cosine", m: int = M, ef_construction: int = EF_CONSTRUCTION, max_levels: int = MAX_LEVELS, seed: int = 0):
        self.metric, self.m, self.ef = metric, m, ef_construction
        v = vectors.astype(np.float64)
        if metric == "cosine":
            # Unit vectors: a distance is then one product.
            size = np.sqrt((v * v).sum(1, keepdims=True))
            v = np.divide(v, size, out=np.zeros_like(v), where=size > 1e-10)
        self.vectors, self.deleted = v, np.zeros(len(v), bool)
        rng = np.random.default_rng(seed)
        self.levels = np.minimum(rng.geometric(0.5, len(v)) - 1, max_levels - 1) if len(v) else np.zeros(0, int)
        self._group()
        self.levels[self.node != np.arange(len(v))] = 0
        self.links: list[list[list[int]]] = [[[] for _ in range(n + 1)] for n in self.levels.tolist()]
        self.entry, self.top = -1, -1

    def _group(self) -> None:
        """Each row's node, and the rows of the nodes that have several."""
        self.node, self.copies = np.arange(len(self.vectors)), {}
        if len(self.vectors):
            _, first, which = np.unique(self.vectors, axis=0, return_index=True, return_inverse=True)
            self.node = first[which.ravel()]
            for k in np.flatnonzero(self.node != np.arange(len(self.node))).tolist():
                self.copies.setdefault(int(self.node[k]), [int(self.node[k])]).append(k)

    def _far(self, q: np.ndarray, rows: list[int]) -> np.ndarray:
        b = self.vectors[rows]
        return 1 - b @ q if self.metric == "cosine" else ((b - q) ** 2).sum(1)

    def build(self) -> Graph:
        """All rows at once, level by level: the diverse ones of the nearest rows are linked, both ways."""
        for at in range(int(self.levels.max(initial=-1)) + 1):
            self._link(np.flatnonzero((self.levels >= at) & (self.node == np.arange(len(self.node)))), at)
        if len(self.levels):
            self.entry = int(self.levels.argmax())
            self.top = int(self.levels[self.entry])
        return self

    def insert(self, vectors: np.ndarray, seed: int = 1) -> Graph:
        """Rows added one by one, each linked to what a search for it finds on its levels."""
        more = Graph(vectors, self.metric, self.m, self.ef, seed=seed)
        start = len(self.vectors)
        self.vectors, self.deleted = np.concatenate([self.vectors, more.vectors]) if start else more.vectors, np.concatenate([self.deleted, more.deleted])
        self.levels, self.links = np.concatenate([self.levels, more.levels]).astype(int), [*self.links, *more.links]
        self._group()
        for k in range(start, len(self.vectors)):
            if self.node[k] == k:
                self._insert(k)
            else:
                self.levels[k], self.links[k] = 0, [[]]
        return self

    def _between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of all rows of ``a`` (.., n, dim) to all of ``b`` (.., m, dim)."""
        product = a @ np.swapaxes(b, -1, -2)
        return 1 - product if self.metric == "cosine" else (a * a).sum(-1)[..., :, None] + (b * b).sum(-1)[..., None, :] - 2 * product

    def _diverse_rows(self, v: np.ndarray, d: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
        """``_diverse`` for many rows: which of each row's candidates ``near`` (at ``d``, ascending, infinite for none) are taken."""
        between = self._between(v[near], v[near])
        taken, free, count = np.zeros(d.shape, bool), np.isfinite(d), np.zeros(len(d), int)
        for j in range(d.shape[1]):
            pick = free[:, j] & (count < most)
            taken[:, j] = pick
            count += pick
            free &= ~(pick[:, None] & (between[:, j] < d))
        return taken

    def _link(self, rows: np.ndarray, level: int) -> None:
        v, n = self.vectors[rows].astype(np.float32), len(rows)
        if n < 2:
            return
        width = min(self.ef, n - 1)
        step = max(1, _CELLS // max(n, width * width, width * v.shape[1]))
        edges = []
        for at in range(0, n, step):
            d = self._between(v[at : at + step], v)
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
            near = np.argpartition(d, width - 1, 1)[:, :width]
            order = np.lexsort((near, np.take_along_axis(d, near, 1)))
            near = np.take_along_axis(near, order, 1)
            row, place = np.nonzero(self._diverse_rows(v, np.take_along_axis(d, near, 1), near, self.m))
            edges.append(np.stack([row + at, near[row, place]]))
        a, b = np.concatenate(edges, 1)
        key = np.unique(np.concatenate([a * n + b, b * n + a]))
        a, b = key // n, key % n
        begin = np.searchsorted(a, np.arange(n + 1))
        room, size = 2 * self.m if level == 0 else self.m, np.diff(begin)
        ids = rows.tolist()
        for k in np.flatnonzero(size <= room).tolist():
            self.links[ids[k]][level] = rows[b[begin[k] : begin[k + 1]]].tolist()
        # Too many came back to the others: the diverse ones stay.
        full = np.flatnonzero(size > room)
        full = full[np.argsort(size[full], kind="stable")]
        at = 0
        while at < len(full):
            width = int(size[full[min(at + 255, len(full) - 1)]])
            some = full[at : at + max(1, min(256, _CELLS // (width * max(width, v.shape[1]))))]
            width = int(size[some].max())
            place = begin[some][:, None] + np.arange(width)
            there = place < begin[some + 1][:, None]
            near = np.where(there, b[np.minimum(place, len(b) - 1)], 0)
            d = np.where(there, self._between(v[some][:, None], v[near])[:, 0], np.inf)
            order = np.lexsort((near, d))
            near, d = np.take_along_axis(near, order, 1), np.take_along_axis(d, order, 1)
            for k, x, y in zip(some.tolist(), near, self._diverse_rows(v, d, near, room), strict=True):
                self.links[ids[k]][level] = rows[x[y]].tolist()
            at += len(some)

    def _beam(self, q: np.ndarray, starts: list[int], level: int, ef: int, gone: np.ndarray | None = None) -> list[tuple[float, int]]:
        seen = set(starts)
        far = self._far(q, starts).tolist()
        todo = list(zip(far, starts, strict=True))
        heapq.heapify(todo)
        best = [(-d, -n) for d, n in todo if gone is None or not gone[n]]
        heapq.heapify(best)
        while todo:
            d, n = heapq.heappop(todo)
            if len(best) >= ef and d > -best[0][0]:
                break
            fresh = [x for x in self.links[n][level] if x not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for e, x in zip(self._far(q, fresh).tolist(), fresh, strict=True):
                if len(best) < ef or e < -best[0][0]:
                    heapq.heappush(todo, (e, x))
                    if gone is None or not gone[x]:
                        heapq.heappush(best, (-e, -x))
                        if len(best) > ef:
                            heapq.heappop(best)
        return sorted((-d, -n) for d, n in best)

    def _diverse(self, candidates: list[tuple[float, int]], most: int) -> list[int]:
        """Nearest first, leaving out what is nearer to one already taken than to the node."""
        taken: list[int] = []
        for d, n in candidates:
            if len(taken) == most:
                break
            if not taken or bool((self._far(self.vectors[n], taken) >= d).all()):
                taken.append(n)
        return taken

    def _insert(self, k: int) -> None:
        level, q = int(self.levels[k]), self.vectors[k]
        if self.entry < 0:
            self.entry, self.top = k, level
            return
        starts = [self.entry]
        for at in range(self.top, level, -1):
            starts = [self._beam(q, starts, at, 1)[0][1]]
        for at in range(min(level, self.top), -1, -1):
            found = self._beam(q, starts, at, self.ef)
            room = 2 * self.m if at == 0 else self.m
            self.links[k][at] = self._diverse(found, self.m)
            for n in self.links[k][at]:
                back = self.links[n][at]
                back.append(k)
                if len(back) > room:
                    far = self._far(self.vectors[n], back).tolist()
                    self.links[n][at] = self._diverse(sorted(zip(far, back, strict=True)), room)
            starts = [n for _, n in found]
        if level > self.top:
            self.entry, self.top = k, level

    def search(self, query: np.ndarray, k: int, ef: int = EF_SEARCH) -> list[tuple[float, int]]:
        if self.entry < 0 or k <= 0:
            return []
        q = query.astype(np.float64)
        if self.metric == "cosine":
            size = float(np.sqrt(q @ q))
            q = q / size if size > 1e-10 else np.zeros_like(q)
        starts = [self.entry]
        for at in range(self.top, 0, -1):
            starts = [self._beam(q, starts, at, 1)[0][1]]
        gone = np.bincount(self.node, ~self.deleted, len(self.node)) == 0 if self.deleted.any() else None
        found: list[tuple[float, int]] = []
        for d, n in self._beam(q, starts, 0, max(ef, k), gone):
            found += [(d, row) for row in self.copies.get(n, [n]) if not self.deleted[row]][:k]
            if len(found) >= k:
                break
        return found[:k]


_INDEX = pa.schema([("shard", pa.int32()), ("id", pa.int64()), ("internal_id", pa.int64()), ("level", pa.int32()), ("neighbours", pa.list_(pa.list_(pa.int64()))), ("embedding", pa.list_(pa.float32()))])
_FOUND = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())])


def build_index(base: DataFrame, metric: str = "cosine", shard_rows: int = SHARD_ROWS, m: int = M, ef_construction: int = EF_CONSTRUCTION) -> DataFrame:
    """The index as a table, a row for each vector: shard, place in it, level and neighbours by level."""
    from pyspark.sql.pandas.types import from_arrow_schema

    rows = live(base).select(F.col("id").cast("long").alias("id"), "embedding").where("id IS NOT NULL AND embedding IS NOT NULL")
    shards = max(1, -(-rows.count() // shard_rows))

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        vectors = matrix(table.column("embedding").combine_chunks())
        g = Graph(vectors, metric, m, ef_construction, seed=int(table.column("shard")[0].as_py())).build()
        # The entry is the first row of the highest level.
        return pa.Table.from_arrays([table.column("shard"), table.column("id"), pa.array(np.arange(len(vectors))), pa.array(g.levels.astype(np.int32)), pa.array(g.links, _INDEX.field("neighbours").type), table.column("embedding").cast(_INDEX.field("embedding").type)], schema=_INDEX)

    sharded = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    return sharded.groupBy("shard").applyInArrow(build, from_arrow_schema(_INDEX))


def _loaded(table: pa.Table, metric: str, m: int = M, ef_construction: int = EF_CONSTRUCTION) -> Graph:
    """A shard's graph from its rows, sorted by their places."""
    g = Graph(matrix(table.column("embedding").combine_chunks()), metric, m, ef_construction)
    g.levels, g.links = table.column("level").to_numpy().astype(int), table.column("neighbours").to_pylist()
    if len(g.levels):
        g.entry = int(g.levels.argmax())
        g.top = int(g.levels[g.entry])
    return g


def extend_index(index: DataFrame, base: DataFrame, metric: str = "cosine", m: int = M, ef_construction: int = EF_CONSTRUCTION) -> DataFrame:
    """The index with the rows of ``base`` inserted into its shards, by a hash of the id.

    Ids that the index has already are left as they are; the number of shards stays.
    """
    from pyspark.sql.pandas.types import from_arrow_schema

    rows = live(base).select(F.col("id").cast("long").alias("id"), "embedding").where("id IS NOT NULL AND embedding IS NOT NULL").dropDuplicates(["id"])
    names = index.select("shard").distinct().agg(F.array_sort(F.collect_set("shard"))).first()[0]
    if not names:
        return build_index(base, metric, m=m, ef_construction=ef_construction)
    shard = F.element_at(F.array(*[F.lit(x) for x in names]), (F.pmod(F.xxhash64("id"), F.lit(len(names))) + 1).cast("int"))
    fresh = rows.join(index.select("id"), "id", "left_anti").select(shard.alias("shard"), "id", "embedding")

    def extend(old: pa.Table, new: pa.Table) -> pa.Table:
        if not new.num_rows:
            return old.select(_INDEX.names)
        old, new = old.sort_by("internal_id"), new.sort_by("id")
        g = _loaded(old, metric, m, ef_construction).insert(matrix(new.column("embedding").combine_chunks()), seed=old.num_rows)
        ids, vectors = (pa.chunked_array([*old.column(c).chunks, *new.column(c).cast(_INDEX.field(c).type).chunks]) for c in ("id", "embedding"))
        shards = pa.array(np.full(len(g.levels), (old if old.num_rows else new).column("shard")[0].as_py()), pa.int32())
        return pa.Table.from_arrays([shards, ids, pa.array(np.arange(len(g.levels))), pa.array(g.levels.astype(np.int32)), pa.array(g.links, _INDEX.field("neighbours").type), vectors], schema=_INDEX)

    return index.groupBy("shard").cogroup(fresh.groupBy("shard")).applyInArrow(extend, from_arrow_schema(_INDEX))


def search_index(index: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", ef: int = EF_SEARCH, query_block: int = 4096) -> DataFrame:
    """(query_id, id, distance, rank): every shard's k best for every query, merged."""
    from pyspark.sql.pandas.types import from_arrow_schema

    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding").where("query_id IS NOT NULL AND embedding IS NOT NULL")
    blocks = max(1, -(-asked.count() // query_block))
    made = None
    for n in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n).toArrow()
        if not part.num_rows:
            continue
        find = _shard_search(part.column(0).to_pylist(), matrix(part.column(1).combine_chunks()), k, metric, ef)
        found = index.groupBy("shard").applyInArrow(find, from_arrow_schema(_FOUND))
        made = found if made is None else made.union(found)
    if made is None:
        made = asked.select("query_id", F.col("query_id").alias("id"), F.lit(0.0).alias("distance")).limit(0)
    return ranked(made, k)


def _shard_search(ids: list[int], vectors: np.ndarray, k: int, metric: str, ef: int):
    """A function that answers a block of queries from one shard's rows."""

    def find(table: pa.Table) -> pa.Table:
        table = table.sort_by("internal_id")
        base, g = matrix(table.column("embedding").combine_chunks()), _loaded(table, metric)
        names, out = table.column("id").to_numpy(), ([], [], [])
        for q, v in zip(ids, vectors, strict=True):
            found = [row for _, row in g.search(v, k, ef)]
            exact = distances(v[None], base[found], metric)[0] if found else []
            for row, d in zip(found, exact, strict=True):
                out[0].append(q)
                out[1].append(int(names[row]))
                out[2].append(float(d))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, _FOUND, strict=True)], schema=_FOUND)

    return find
