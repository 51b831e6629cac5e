"""N-gram Jaccard self-join: components of documents whose word-shingle sets overlap enough.

Exact, in four steps that never hold an unbounded group:

1. Every document becomes its set of 64-bit shingle hashes. Counting by hash ranges finds out
   which shingles have a second owner; a document that shares less than the threshold's part of
   its set cannot be in a link, whatever the others are, and stays alone.
2. Texts with equal word sequences become one class. Among class representatives the shingles
   are ordered from rare to frequent; two sets that link share one of their first
   n - ceil(0.75 n) + 1 (prefix filter), so these prefixes give groups of possible partners.
3. Groups are cut into size-banded tiles: a link joins sets of one band or of neighbours. A pair
   of tiles is one small task. Hashed bitmap signatures bound the overlap from above by bit
   counts, sorted arrays give it exactly, and pairs already connected are passed over. A group
   larger than a tile is first joined to one pivot a band; what is connected then needs no
   comparison among itself, so a huge group of near copies costs its size and not its square.
4. Connected components of the links and of the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import LOWER, NULL_ID, batch_of, documents, id_back, materialize, mix, partitions, release, slices, span_hashes, spark_schema, text_bytes, tune, word_spans
from lodestar.llm.components import components

WORDS = 5
TILE = 1024
TILE_SHINGLES = 1_000_000
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_FLUSH = 1_500_000


def _shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row) of the shingles of a batch, repeats included, and two hashes of each row's word sequence."""
    data = LOWER[data]
    starts, ends, row = word_spans(data, offsets)
    w, n = span_hashes(data, starts, ends), len(offsets) - 1
    count = np.bincount(row, minlength=n)
    first = np.cumsum(count) - count
    place = (np.arange(len(w)) - first[row]).astype(np.uint64)
    prints = np.zeros((2, n), np.uint64)
    some = np.flatnonzero(count)
    if len(some):
        for k in (0, 1):
            prints[k][some] = np.add.reduceat(mix(w * _K[2 * k] + mix(place * _K[2 * k + 1] + _K[k])), first[some])
    if len(w) >= words:
        h = np.zeros(len(w) - words + 1, np.uint64)
        for j in range(words):
            h += w[j : len(w) - words + 1 + j] * _K[j]
        whole = row[: len(h)] == row[words - 1 :]
        h, owner = mix(h[whole]), row[: len(h)][whole]
    else:
        h, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        own = [mix((w[first[s] : first[s] + count[s]] * _K[: count[s]]).sum(keepdims=True) + np.full(1, count[s], np.uint64) * _K[7])[0] for s in short]
        h, owner = np.concatenate([h, np.array(own, np.uint64)]), np.concatenate([owner, short])
    return h, owner, prints[0], prints[1]


def _distinct_pairs(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, owner), ascending by hash."""
    order = np.argsort(h)
    h, owner = h[order], owner[order]
    if len(h):
        same = h[1:] == h[:-1]
        multi = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
        if len(multi):
            owner[multi] = owner[multi][np.lexsort((owner[multi], h[multi]))]
        keep = np.r_[True, ~same | (owner[1:] != owner[:-1])]
        h, owner = h[keep], owner[keep]
    return h, owner


#: Rows of one hash range: the owners that occur in it, and hash and owner's place for each entry.
#: ``sizes`` is null but in rows that describe owners: id, two prints and set size.
_BLOBS = pa.schema([("r", pa.int32()), ("owners", pa.binary()), ("sizes", pa.binary()), ("h", pa.binary()), ("at", pa.binary())])


def _range_rows(h: np.ndarray, owner: np.ndarray, ids: np.ndarray, sizes: np.ndarray | None, ranges: int, narrow: bool) -> pa.RecordBatch:
    """One row for each hash range with entries; ``narrow`` keeps 32 bits of a hash."""
    r = ((h >> np.uint64(40)) * np.uint64(ranges) >> np.uint64(24)).astype(np.int64)
    cut = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, np.int64)
    rows: list[list] = [[] for _ in _BLOBS]
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(r)], strict=True) if len(r) else ():
        mine, at = np.unique(owner[a:b], return_inverse=True)
        value = h[a:b].astype(np.uint32) if narrow else h[a:b]
        for column, x in zip(rows, (int(r[a]), ids[mine].tobytes(), None if sizes is None else sizes[mine].tobytes(), value.tobytes(), at.astype(np.uint32 if len(mine) > 65535 else np.uint16).tobytes()), strict=True):
            column.append(x)
    return batch_of(_BLOBS, *rows)


def _entries(table: pa.Table, width: type) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, owner's place, ids, sizes) of a range's rows put together."""
    h, at, ids, sizes, base = [], [], [], [], 0
    for owners, size, value, place in zip(*(table.column(c).to_pylist() for c in ("owners", "sizes", "h", "at")), strict=True):
        mine = np.frombuffer(owners, np.int64)
        h.append(np.frombuffer(value, width))
        at.append(np.frombuffer(place, np.uint32 if len(mine) > 65535 else np.uint16).astype(np.int64) + base)
        ids.append(mine)
        if size is not None:
            sizes.append(np.frombuffer(size, np.int64))
        base += len(mine)
    return np.concatenate(h), np.concatenate(at), np.concatenate(ids), np.concatenate(sizes) if sizes else np.zeros(0, np.int64)


#: Rows between two shuffles: what a hash range tells a bucket of documents, packed, so that their
#: number is that of ranges times buckets and not of ranges times documents.
_TOLD = pa.schema([("g", pa.int32()), ("doc", pa.binary()), ("more", pa.binary()), ("h", pa.binary()), ("df", pa.binary())])
_META = np.dtype([("doc", np.int64), ("p1", np.int64), ("p2", np.int64), ("n", np.int64)])
_KNOWN = pa.schema([("doc_id", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("n", pa.int64()), ("shared", pa.int64())])


def _bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(ids.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _by_bucket(ids: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its ids)."""
    g = _bucket(ids, buckets)
    order = np.argsort(g, kind="stable")
    cut = np.flatnonzero(np.r_[True, np.diff(g[order]) != 0]) if len(g) else np.zeros(0, np.int64)
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(g)], strict=False):
        yield int(g[order[a]]), order[a:b]


def _known(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, p1, p2, n, shared): each document's prints, set size, and how many of its shingles have another owner."""
    ranges = partitions(docs.sparkSession)

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, owner, ids, prints, held, docs_held, turn = [], [], [], [], 0, 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            hs, os = _distinct_pairs(np.concatenate(h), np.concatenate(owner))
            id_, pr = np.concatenate(ids), np.concatenate(prints, axis=1)
            meta = np.zeros(len(id_), _META)
            meta["doc"], meta["p1"], meta["p2"], meta["n"] = id_, pr[0].view(np.int64), pr[1].view(np.int64), np.bincount(os, minlength=len(id_))
            yield batch_of(_BLOBS, [turn % ranges], [meta.tobytes()], [b""], [None], [None])
            yield _range_rows(hs, os, id_, None, ranges, True)

        for batch in slices(batches):
            a, b, p1, p2 = _shingles(*text_bytes(batch.column("text")), words)
            h.append(a)
            owner.append(b + docs_held)
            ids.append(batch.column("doc_id").to_numpy())
            prints.append(np.stack([p1, p2]))
            held, docs_held = held + len(a), docs_held + batch.num_rows
            if held > _FLUSH:
                yield from flush()
                h, owner, ids, prints, held, docs_held, turn = [], [], [], [], 0, 0, turn + 1
        if docs_held:
            yield from flush()

    def count(table: pa.Table) -> pa.Table:
        described = table.filter(pc.is_valid(table.column("sizes")))
        entries = table.filter(pc.is_null(table.column("sizes")))
        rows: list[tuple] = []
        for blob in described.column("owners").to_pylist():
            m = np.frombuffer(blob, _META)
            rows += [(g, None, m[at].tobytes(), None, None) for g, at in _by_bucket(m["doc"].copy(), ranges)]
        if entries.num_rows:
            h, at, ids, _ = _entries(entries, np.uint32)
            key = np.sort(h.astype(np.uint64) << np.uint64(32) | at.astype(np.uint64))
            value, place = key >> np.uint64(32), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
            begin = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
            end = np.r_[begin[1:], len(value)] - 1
            more = np.repeat(place[begin] != place[end], end - begin + 1)
            shared = np.bincount(place[more], minlength=len(ids))
            some = np.flatnonzero(shared)
            ids, shared = ids[some], shared[some].astype(np.uint32)
            rows += [(g, ids[at].tobytes(), shared[at].tobytes(), None, None) for g, at in _by_bucket(ids, ranges)]
        return pa.Table.from_batches([batch_of(_TOLD, *(zip(*rows, strict=True) if rows else ([] for _ in _TOLD)))], _TOLD)

    def gather(table: pa.Table) -> pa.Table:
        metas, docs_, counts = [np.zeros(0, _META)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for doc, more in zip(table.column("doc").to_pylist(), table.column("more").to_pylist(), strict=True):
            if doc is None:
                metas.append(np.frombuffer(more, _META))
            else:
                docs_.append(np.frombuffer(doc, np.int64))
                counts.append(np.frombuffer(more, np.uint32))
        meta = np.unique(np.concatenate(metas))
        doc, count_ = np.concatenate(docs_), np.concatenate(counts)
        names, at = np.unique(doc, return_inverse=True)
        sums = np.r_[np.bincount(at, count_, len(names)), 0].astype(np.int64)
        place = np.searchsorted(names, meta["doc"])
        found = np.r_[names, 0][place] == meta["doc"] if len(names) else np.zeros(len(meta), bool)
        shared = np.where(found & (place < len(names)), sums[place], 0)
        return pa.Table.from_batches([batch_of(_KNOWN, meta["doc"].copy(), meta["p1"].copy(), meta["p2"].copy(), meta["n"].copy(), shared)], _KNOWN)

    told = docs.mapInArrow(forward, spark_schema(_BLOBS)).groupBy("r").applyInArrow(count, spark_schema(_TOLD))
    return told.groupBy("g").applyInArrow(gather, spark_schema(_KNOWN))


_SETS = pa.schema([("rep", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("n", pa.int64()), ("set", pa.binary())])


def _sets(words: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            h, owner, p1, p2 = _shingles(*text_bytes(batch.column("text")), words)
            h, owner = _distinct_pairs(h, owner)
            order = np.argsort(owner, kind="stable")
            h, n = h[order], np.bincount(owner, minlength=batch.num_rows)
            stop = np.cumsum(n)
            yield batch_of(_SETS, batch.column("doc_id"), p1.view(np.int64), p2.view(np.int64), n, [h[a:b].tobytes() for a, b in zip(stop - n, stop, strict=True)])

    return sets


_PREFIX = pa.schema([("h", pa.int64()), ("rep", pa.int64())])


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(h, rep): the shingles of each set's prefix, rare ones first, that have another owner."""
    ranges = partitions(sets.sparkSession)

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            each = [np.frombuffer(x, np.uint64) for x in batch.column("set").to_pylist()]
            h, owner = np.concatenate(each), np.repeat(np.arange(len(each)), [len(x) for x in each])
            order = np.argsort(h)
            yield _range_rows(h[order], owner[order], batch.column("rep").to_numpy(), batch.column("n").to_numpy(), ranges, False)

    def often(table: pa.Table) -> pa.Table:
        h, at, ids, sizes = _entries(table, np.uint64)
        order = np.argsort(h)
        h, at = h[order], at[order]
        begin = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        runs = np.diff(np.r_[begin, len(h)])
        df = np.repeat(runs, runs)
        some = df > 1
        h, at, df = h[some], at[some], np.minimum(df[some], 2**32 - 1).astype(np.uint32)
        reps, sizes = ids[at], sizes[at].astype(np.uint32)
        rows = [(g, reps[k].tobytes(), sizes[k].tobytes(), h[k].tobytes(), df[k].tobytes()) for g, k in _by_bucket(reps, ranges)]
        return pa.Table.from_batches([batch_of(_TOLD, *(zip(*rows, strict=True) if rows else ([] for _ in _TOLD)))], _TOLD)

    def prefix(table: pa.Table) -> pa.Table:
        read = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in table.column(c).to_pylist()])
        rep, n, h, df = read("doc", np.int64), read("more", np.uint32).astype(np.int64), read("h", np.uint64), read("df", np.uint32)
        order = np.lexsort((h, df, rep))
        rep, n, h = rep[order], n[order], h[order]
        begin = np.flatnonzero(np.r_[True, rep[1:] != rep[:-1]])
        often_ = np.diff(np.r_[begin, len(rep)])
        # The n - often shingles that nobody else has come first and take their places in the prefix.
        take = n - -(-percent * n // 100) + 1 - (n - np.repeat(often_, often_))
        chosen = np.arange(len(rep)) - np.repeat(begin, often_) < take
        return pa.Table.from_batches([batch_of(_PREFIX, h[chosen].view(np.int64), rep[chosen])], _PREFIX)

    rows = sets.mapInArrow(forward, spark_schema(_BLOBS)).groupBy("r").applyInArrow(often, spark_schema(_TOLD))
    return rows.groupBy("g").applyInArrow(prefix, spark_schema(_PREFIX))


def links_within(sets: list[np.ndarray], labels: np.ndarray, sides: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Links that connect what isn't connected yet (``labels``); with ``sides``, only between the two sides."""
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    sizes, label = sizes[order], labels[order].copy()
    side = None if sides is None else sides[order]
    bits = int(min(1 << 14, max(256, 1 << int(2 * sizes.max()).bit_length())))
    maps = np.zeros((len(sets), bits // 64), np.uint64)
    for k, o in enumerate(order):
        low = sets[o] & np.uint64(bits - 1)
        np.bitwise_or.at(maps[k], (low >> np.uint64(6)).astype(np.int64), np.uint64(1) << (low & np.uint64(63)))
    found = []
    upto = np.searchsorted(sizes, 100 * sizes // percent, side="right")
    for i in range(len(order)):
        j = np.arange(i + 1, upto[i])
        j = j[label[j] != label[i]]
        if side is not None:
            j = j[side[j] != side[i]]
        if not len(j):
            continue
        both = sizes[j] + sizes[i]
        # Each differing bit is an element that only one of the two sets has.
        overlap = (both - np.bitwise_count(maps[j] ^ maps[i]).sum(1).astype(np.int64)) // 2
        for k in j[(100 + percent) * overlap >= percent * both].tolist():
            if label[k] == label[i]:
                continue
            a, b = sets[order[i]], sets[order[k]]
            at = np.searchsorted(b, a)
            shared = int((b[np.minimum(at, len(b) - 1)] == a).sum())
            if (100 + percent) * shared >= percent * (len(a) + len(b)):
                found.append((int(order[i]), int(order[k])))
                label[label == label[k]] = label[i]
    return found


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _tile_links(percent: int, pairs: bool):
    """Verifies a group of rows (rep, cc, label, side, set): within each cc, or between the sides 0 and 1 (2: both)."""

    def verify(table: pa.Table) -> pa.Table:
        rep, cc = table.column("rep").to_numpy(), table.column("cc").to_numpy()
        label, side = table.column("label").to_numpy(), table.column("side").to_numpy()
        sets = table.column("set").combine_chunks()
        order = np.argsort(cc, kind="stable")
        cut = np.flatnonzero(np.r_[True, np.diff(cc[order]) != 0, True])
        a, b = [], []
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            mine = order[lo:hi]
            if len(mine) < 2:
                continue
            own = [np.frombuffer(sets[int(k)].as_buffer(), np.uint64) for k in mine]
            for x, y in links_within(own, label[mine], side[mine] if pairs else None, percent):
                a.append(int(rep[mine[x]]))
                b.append(int(rep[mine[y]]))
        return pa.Table.from_batches([batch_of(_LINKS, a, b)], _LINKS)

    return verify


def _links(sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Verified links (a forest of them) within the candidate groups (rep, cc)."""
    spark = sets.sparkSession
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / percent))) + 1e-9).cast("int")
    banded = materialize(groups.join(sets.select("rep", "n"), "rep").select("rep", "n", "cc", band.alias("band")), "placed")
    sums = banded.groupBy("cc").agg(F.count("*").alias("docs"), F.sum("n").alias("weight"))
    sums = sums.select("cc", ((F.col("docs") > TILE) | (F.col("weight") > TILE_SHINGLES)).alias("large"))
    placed = materialize(banded.join(sums, "cc"), "placed")
    release(banded)
    out = ["rep", "cc", "label", "side", "set"]
    bodies = sets.select("rep", "set")
    small = placed.where("NOT large").select("rep", "cc", F.pmod(F.xxhash64("cc"), F.lit(4 * partitions(spark))).alias("g"))
    small = small.join(bodies, "rep").select("g", "rep", "cc", F.col("rep").alias("label"), F.lit(0).alias("side"), "set")
    found = small.groupBy("g").applyInArrow(lambda t: _tile_links(percent, False)(t.select(out)), spark_schema(_LINKS))
    large = placed.where("large").drop("large")
    if large.isEmpty():
        return found

    def tiled(rows: DataFrame, keys: list[str]) -> DataFrame:
        counts = rows.groupBy(*keys).agg(F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int").alias("tiles"))
        return rows.join(counts, keys).withColumn("t", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))

    # First each tile by itself and with one pivot of its band and of each neighbouring band.
    first = tiled(large, ["cc", "band"])
    spots = first.select("cc", "band", "t").distinct()
    pivots = large.groupBy("cc", "band").agg(F.min("rep").alias("rep")).select("cc", "rep", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    members = first.select("cc", "band", "t", "rep").union(spots.join(pivots, ["cc", "band"]).select("cc", "band", "t", "rep")).distinct()
    members = members.join(bodies, "rep").select("band", "t", "rep", "cc", F.col("rep").alias("label"), F.lit(0).alias("side"), "set")
    near = materialize(members.groupBy("cc", "band", "t").applyInArrow(lambda t: _tile_links(percent, False)(t.select(out)), spark_schema(_LINKS)), "links")
    # Then all pairs of tiles, but for those inside a group's main component.
    label = components(near)
    known = large.join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("component", "rep")).drop("component")
    sizes = known.groupBy("cc", "label").agg(F.count("*").alias("docs"))
    main = sizes.groupBy("cc").agg(F.max_by("label", F.struct("docs", "label")).alias("main"))
    known = known.join(main, "cc").withColumn("is_main", F.col("label") == F.col("main")).drop("main")
    placed2 = materialize(tiled(known, ["cc", "band", "is_main"]), "tiles")
    spots = placed2.select("cc", "band", "is_main", "t").distinct()
    left = spots.select("cc", F.col("band").alias("band1"), F.col("is_main").alias("main1"), F.col("t").alias("t1"))
    right = spots.select("cc", F.col("band").alias("band2"), F.col("is_main").alias("main2"), F.col("t").alias("t2"))
    near_band = (F.col("band2") - F.col("band1")).isin(0, 1)
    once = (F.col("band2") > F.col("band1")) | (F.struct("main1", "t1") <= F.struct("main2", "t2"))
    pairs = left.join(right, "cc").where(near_band & once & ~(F.col("main1") & F.col("main2")))
    pairs = pairs.withColumn("g", F.xxhash64("cc", "band1", "main1", "t1", "band2", "main2", "t2")).withColumn("self", F.expr("band1 = band2 AND main1 = main2 AND t1 = t2"))
    sides = pairs.select("g", "self", "cc", F.col("band1").alias("band"), F.col("main1").alias("is_main"), F.col("t1").alias("t"), F.lit(0).alias("side")).union(
        pairs.where("NOT self").select("g", "self", "cc", "band2", "main2", "t2", F.lit(1))
    )
    rows = sides.join(placed2, ["cc", "band", "is_main", "t"]).select("g", "self", "rep", "cc", "label", "side").join(bodies, "rep")
    alone = rows.where("self").groupBy("g").applyInArrow(lambda t: _tile_links(percent, False)(t.select(out)), spark_schema(_LINKS))
    across = rows.where("NOT self").groupBy("g").applyInArrow(lambda t: _tile_links(percent, True)(t.select(out)), spark_schema(_LINKS))
    return found.union(near).union(alone).union(across)


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document of ``docs``.

    A document's set holds the distinct ``words``-word shingles of its text, A-Z lower-cased, words
    parted by ``[\\x20\\x09-\\x0D]``; with fewer words the whole sequence is the one shingle.
    Documents link when 100 * intersection >= ``percent`` * union, and component_id is the
    smallest doc_id reachable. Null, empty and blank texts have no set and no links. Rows that
    repeat a doc_id are one document (a row for each different text); an empty table gives no rows;
    other columns are ignored; a null doc_id counts as the smallest and comes back as null.
    """
    tune(docs.sparkSession)
    texts = documents(docs)
    known = materialize(_known(texts, words), "documents")
    classes = known.where("n > 0").groupBy("p1", "p2", "n").agg(F.min("doc_id").alias("rep"), F.max("shared").alias("shared"))
    classes = materialize(classes, "classes")
    able = classes.where(F.col("shared") * 100 >= F.col("n") * percent).select("rep", "p1", "p2")
    chosen = texts.join(able.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").mapInArrow(_sets(words), spark_schema(_SETS))
    sets = materialize(chosen.join(able, ["rep", "p1", "p2"], "left_semi").dropDuplicates(["rep", "p1", "p2"]), "sets")
    # A doc_id with several texts is several sets but one node: the sets go by their own number.
    sets = sets.withColumn("doc", F.col("rep")).withColumn("rep", F.xxhash64("rep", "p1", "p2"))
    prefix = materialize(_prefixes(sets, percent), "prefixes")
    least = prefix.groupBy("h").agg(F.min("rep").alias("a"), F.count("*").alias("owners")).where("owners > 1").select("h", "a")
    pairs = prefix.join(least, "h").where("rep <> a").select(F.col("rep").alias("a"), F.col("a").alias("b")).distinct()
    groups = materialize(components(pairs).select(F.col("node").alias("rep"), F.col("component").alias("cc")), "groups")
    release(prefix)
    links = materialize(_links(sets, groups, percent), "links")
    release(groups)
    number = sets.select("rep", "doc")
    linked = links.join(number.select(F.col("rep").alias("a"), F.col("doc").alias("x")), "a").join(number.select(F.col("rep").alias("b"), F.col("doc").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    copies = known.join(classes.select("p1", "p2", "n", "rep"), ["p1", "p2", "n"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    label = components(linked.union(copies)).withColumnRenamed("node", "doc_id")
    made = known.join(label, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return made.select(id_back(), "n_shingles", F.when(F.col("component_id") != NULL_ID, F.col("component_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, words: int = WORDS, percent: int = 75) -> DataFrame:
    """``docs`` without the documents that have a smaller doc_id in their component; all columns kept.

    Of rows that repeat the doc_id that stays, all stay.
    """
    gone = jaccard_components(docs, words, percent).where("component_id < doc_id OR (component_id IS NULL AND doc_id IS NOT NULL)").select(F.col("doc_id").alias("id")).distinct().alias("__copies")
    return docs.alias("__docs").join(gone, F.col("__docs.doc_id") == F.col("__copies.id"), "left_anti")
