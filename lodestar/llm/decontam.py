"""Benchmark decontamination by the q-gram lemma.

A passage of m characters that occurs in a text with at most k edits shares at least
m - q + 1 - k*q of its q-grams with it, on diagonals (text place minus passage place) that differ
by k at most. So shared q-grams are counted in overlapping bands of diagonals, bands below that
bound are dropped, and what is left is verified by alignment inside the band. Nothing within
the edit budget is lost. Characters are bytes of the lower-cased text with white space runs as one
space. A passage too short for that is looked for as it stands, between word boundaries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import IS_SPACE, NULL_ID, batch_of, documents, id_back, mix, slices, span_hashes, spark_schema, text_bytes, tune

Q = 10
RATE = 0.08
#: Passages below are matched without edits; of these, one of fewer words condemns no document.
MIN_CHARS, MIN_WORDS = 25, 3
WINDOW = 512
#: Bytes of normalised text that are matched at once; longer texts go in overlapping stretches.
_STRETCH = 2_000_000
#: Items that one pass over the documents looks for, and so what a task holds.
BLOCK_ITEMS = 20_000
_FILTER_BITS = 22


def edit_budget(m: int, rate: float = RATE, q: int = Q) -> int:
    """Edits allowed for a passage of ``m`` characters: its share, and few enough that the bound is 4 or more."""
    return max(0, min(int(rate * m), (m - q + 1 - 4) // q))


def normalise(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the normalised texts with a zero after each, and where each begins (and the end)."""
    data, offsets = text_bytes(pa.array([f"{t.lower()}\0" for t in texts], pa.string()))
    space = IS_SPACE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    sizes = np.add.reduceat(keep, offsets[:-1], dtype=np.int64) if texts else np.zeros(0, np.int64)
    return np.where(space, np.uint8(32), data)[keep], np.r_[0, np.cumsum(sizes)]


def grams(data: np.ndarray, q: int = Q) -> np.ndarray:
    """64-bit values of all q-grams (8 <= q <= 16): two overlapping 8-byte words, mixed."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    pairs = data[:-1].astype(np.uint16) | data[1:].astype(np.uint16) << 8
    fours = pairs[:-2].astype(np.uint32) | pairs[2:].astype(np.uint32) << 16
    eights = fours[:-4].astype(np.uint64) | fours[4:].astype(np.uint64) << np.uint64(32)
    return eights[:n] * np.uint64(0x9E3779B97F4A7C15) ^ (eights[q - 8 : q - 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(7))


def align(passage: np.ndarray, region: np.ndarray, most: int) -> tuple[int, int] | None:
    """Least edits of the passage somewhere in the region and where that ends, if within ``most``."""
    n = len(region)
    row = np.zeros(n + 1, np.int64)  # it may begin anywhere
    steps = np.arange(n + 1)
    for k, c in enumerate(passage, 1):
        after = np.empty(n + 1, np.int64)
        after[0] = k
        after[1:] = np.minimum(row[:-1] + (region != c), row[1:] + 1)
        # Insertions: the least of what stands to the left plus the way from there.
        row = np.minimum.accumulate(after - steps) + steps
        if row.min() > most:
            return None
    end = int(row.argmin())
    return (int(row[end]), end) if row[end] <= most else None


_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def boundaries(data: np.ndarray) -> np.ndarray:
    """For each place, and the end: whether a word may begin or end there."""
    inside = _IN_WORD[data]
    return np.r_[True, ~(inside[1:] & inside[:-1]), True]


@dataclass
class Hit:
    row: int
    item: int
    edits: int
    start: int
    end: int


class Matcher:
    """Looks for all passages of a block of items in batches of texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE, min_chars: int = MIN_CHARS):
        self.min_chars = min_chars
        self.passages: list[np.ndarray] = []
        self.item: list[int] = []
        short: dict[bytes, list[int]] = {}
        for item, text in sorted(set(items)):
            data, _ = normalise([(text or "").strip()])
            data = data[:-1]
            if len(data) < min_chars:
                if len(data):
                    short.setdefault(data.tobytes(), []).append(item)
                continue
            windows = max(1, round(len(data) / WINDOW))
            for part in np.array_split(data, windows):
                self.passages.append(part)
                self.item.append(item)
        #: Short passages by length: their hashes, ascending, and the passages.
        self.short: dict[int, tuple[np.ndarray, list[tuple[bytes, list[int]]]]] = {}
        for n in sorted(set(map(len, short))):
            mine = [p for p in short if len(p) == n]
            h = span_hashes(np.frombuffer(b"".join(mine), np.uint8), np.arange(len(mine)) * n, (np.arange(len(mine)) + 1) * n)
            by = np.argsort(h)
            self.short[n] = h[by], [(mine[k], short[mine[k]]) for k in by.tolist()]
        sizes = np.array([len(p) for p in self.passages], np.int64)
        self.budget = np.array([edit_budget(int(m), rate) for m in sizes], np.int64)
        self.need = sizes - Q + 1 - self.budget * Q
        values, owner, place = [], [], []
        for k, p in enumerate(self.passages):
            g = mix(grams(p))
            values.append(g)
            owner.append(np.full(len(g), k))
            place.append(np.arange(len(g)))
        if not values:
            values, owner, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        value = np.concatenate(values)
        order = np.argsort(value, kind="stable")
        self.value, self.owner, self.place = value[order], np.concatenate(owner)[order], np.concatenate(place)[order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.value >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def _shared(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the text, passage, place in the passage) of all shared q-grams."""
        g = mix(grams(data))
        at = np.flatnonzero(self.filter[(g >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        first = np.searchsorted(self.value, g[at], side="left")
        count = np.searchsorted(self.value, g[at], side="right") - first
        at, first, count = at[count > 0], first[count > 0], count[count > 0]
        which = np.repeat(first - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        return np.repeat(at, count), self.owner[which], self.place[which]

    def _short_hits(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[Hit]:
        """The first place of each text where a short passage stands between word boundaries."""
        if not self.short or not len(data):
            return
        free = boundaries(data)
        begins = np.flatnonzero(free[:-1] & (data != 0))
        for n, (hashes, passages) in self.short.items():
            at = begins[begins + n <= len(data)]
            at = at[free[at + n]]
            h = span_hashes(data, at, at + n)
            place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            seen = set()
            for a, k in zip(at[hashes[place] == h].tolist(), place[hashes[place] == h].tolist(), strict=True):
                row = int(np.searchsorted(offsets, a, side="right")) - 1
                if (row, k) not in seen and data[a : a + n].tobytes() == passages[k][0]:
                    seen.add((row, k))
                    start = a - int(offsets[row])
                    yield from (Hit(row, item, 0, start, start + n) for item in passages[k][1])

    def match(self, texts: list[str]) -> list[Hit]:
        """The best hit of each text and item: fewest edits, then the first."""
        data, offsets = normalise(texts)
        best: dict[tuple[int, int], Hit] = {}

        def add(hit: Hit) -> None:
            old = best.get((hit.row, hit.item))
            if old is None or (hit.edits, hit.end) < (old.edits, old.end):
                best[hit.row, hit.item] = hit

        if len(data) <= 2 * _STRETCH:
            for hit in self._hits(data, offsets):
                add(hit)
        else:
            # Whatever begins in a stretch lies whole in it, with the overlap.
            overlap = 64 + max([int(b) * 4 + len(p) for p, b in zip(self.passages, self.budget, strict=True)] + [MIN_CHARS])
            for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                for start in range(a, b, _STRETCH):
                    stop = min(b, start + _STRETCH + overlap)
                    part = data[start:stop] if stop == b else np.r_[data[start:stop], np.uint8(0)]
                    for hit in self._hits(part, np.array([0, len(part)])):
                        # A word that the cut made isn't one; the neighbour has what stands there.
                        cut = (hit.start == 0 and start > a) or (hit.end == len(part) - 1 and stop < b)
                        if not (cut and hit.end - hit.start < self.min_chars):
                            add(Hit(row, hit.item, hit.edits, hit.start + start - a, hit.end + start - a))
        return sorted(best.values(), key=lambda h: (h.row, h.item))

    def _hits(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[Hit]:
        """Hits in normalised texts, those that begin the earliest among them."""
        yield from self._short_hits(data, offsets)
        at, passage, place = self._shared(data)
        if not len(at):
            return
        # Bands of diagonals: each is 2k+2 wide and overlaps its neighbour by half, so any k+1
        # neighbouring diagonals lie in one of them.
        width = self.budget[passage] + 1
        band = (at - place + WINDOW * 4) // width
        key = np.concatenate([passage * (1 << 40) + band, passage * (1 << 40) + band - 1])
        every = np.concatenate([place, place])
        order = np.lexsort((every, key))
        key, every = key[order], every[order]
        new_key = np.r_[True, key[1:] != key[:-1]]
        new_gram = new_key | np.r_[True, every[1:] != every[:-1]]
        begin = np.flatnonzero(new_key)
        counts = np.add.reduceat(new_gram.astype(np.int64), begin)
        keys = key[begin]
        good = counts >= self.need[keys >> 40]
        n_rows = len(offsets) - 1
        for k in keys[good].tolist():
            p, b = k >> 40, k & ((1 << 40) - 1)
            budget, passage_ = int(self.budget[p]), self.passages[p]
            low = b * (budget + 1) - WINDOW * 4 - budget
            high = low + 2 * (budget + 1) + len(passage_) + 2 * budget
            row = int(np.searchsorted(offsets, min(max(low + (high - low) // 2, 0), len(data) - 1), side="right")) - 1
            for r in range(max(0, row - 1), min(n_rows, row + 2)):
                a, z = max(low, int(offsets[r])), min(high, int(offsets[r + 1]) - 1)
                if z - a < len(passage_) - budget:
                    continue
                region = data[a:z]
                exact = region.tobytes().find(passage_.tobytes())
                found = (0, exact + len(passage_)) if exact >= 0 else align(passage_, region, budget) if budget else None
                if found:
                    end = a + found[1] - int(offsets[r])
                    yield Hit(r, self.item[p], found[0], max(0, end - len(passage_)), end)


def item_blocks(benchmark: DataFrame, block: int = BLOCK_ITEMS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``block``, each small enough for a task's memory."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(NULL_ID)).alias("item_id"), "text").where("text IS NOT NULL").distinct()
    blocks = max(1, -(-items.count() // block))
    for k in range(blocks):
        yield [(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()]


_HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, item_id, edits, start, end): each document and item it contains, at the best place.

    Places are bytes of the normalised text. An item is searched for by its windows of about 512
    characters; one of fewer than ``min_chars`` without edits, between word boundaries. Items of
    null or blank text are in no document; an item without an id is found like others and told by
    a null. Null and empty texts and an empty table on either side give no rows; repeated rows
    give repeated hits; other columns are ignored. No shuffle: a block of items goes to the texts.
    """
    tune(docs.sparkSession)
    made = None
    for items in item_blocks(benchmark):
        matcher = Matcher(items, rate, min_chars)

        def find(batches: Iterator[pa.RecordBatch], matcher=matcher) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 1_000_000):
                hits = matcher.match(batch.column("text").to_pylist())
                ids = batch.column("doc_id").to_pylist()
                yield batch_of(_HITS, [ids[h.row] for h in hits], [h.item for h in hits], [h.edits for h in hits], [h.start for h in hits], [h.end for h in hits])

        part = documents(docs).mapInArrow(find, spark_schema(_HITS))
        made = part if made is None else made.union(part)
    return made.withColumn("doc_id", id_back()).withColumn("item_id", id_back("item_id"))


def telling(text: str, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS) -> bool:
    """Whether an item says something of a document that contains it: not one or two words that any text may have."""
    return len(text.split()) >= min_words or len(normalise([text.strip()])[0]) > min_chars


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, that contain no item: a filter where the rows are, no join.

    Items that are shorter than ``min_chars`` and of fewer than ``min_words`` words condemn no document.
    """
    tune(docs.sparkSession)
    for items in item_blocks(benchmark):
        items = [x for x in items if telling(x[1], min_chars, min_words)]
        matcher = Matcher(items, rate, min_chars)

        @F.pandas_udf(T.BooleanType())
        def clean(texts, matcher=matcher):
            import pandas as pd

            keep = np.ones(len(texts), bool)
            listed, at = texts.fillna("").tolist(), 0
            while at < len(listed):
                size, end = 0, at
                while end < len(listed) and (end == at or size < 1_000_000):
                    size, end = size + len(listed[end]), end + 1
                keep[[at + h.row for h in matcher.match(listed[at:end])]] = False
                at = end
            return pd.Series(keep)

        docs = docs.where(clean(F.col("text")))
    return docs
