"""Packing by an order-preserving dynamic programme.

The documents of a partition, in their order, are one stream of token ids. Windows of at most
``size`` ids may be cut at document ends (free), sentence ends (a small penalty) and, inside long
sentences, on a grid (a larger penalty). The programme minimises padding plus penalties:

    best[j] = penalty(j) + WINDOW + min over i with j - size <= i < j of best[i] + padding(j - i)

Padding is ``size - (j - i)``, so the minimum is that of ``best[i] + i`` over a sliding window and
comes from a monotone queue; a window of a power of two (from a sixteenth of
the size up) needs no padding and is looked at besides.
The stream is packed in stretches: what lies behind the last full window of a stretch is carried
into the next, so memory is bounded and documents of any length pass through.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestar.llm.common import NULL_ID, batch_of, documents, slices, span_hashes, spark_schema, text_bytes, tune

SIZE = 1024
SENTENCE, INSIDE, WINDOW, GRID = 1.0, 12.0, 4.0, 32
#: Ids that are packed at once.
STRETCH = 1 << 18
#: Words an encoder remembers; it forgets them all when there are more.
_CACHE = 2_000_000
_ODD_SPACE = re.compile(r"[^\S \n]")
#: Characters that the library gets at once, about, and places where a text may be cut: before a space between letters.
_LONG = 50_000
_SAFE = re.compile(r"[A-Za-z] [A-Za-z]")


class Encoder:
    """Ids of whole texts, as the library gives them for a byte-level BPE file.

    The file's pattern always ends a piece before a space between two characters that are no
    white space, so what lies between such places is encoded by itself and remembered by its
    64-bit hash: texts repeat their words. A text where white space meets white space is encoded
    whole, by ranks; one with other white space than spaces and line breaks, or with a special
    token's string, by the library, a long one in stretches that end before such a space.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.forget()
        size = self.library.get_vocab_size()
        self.ends = np.zeros(size, bool)
        self.spaced = np.zeros(size, bool)
        self.quick = _same_by_ranks(self.library)
        for piece, k in self.library.get_vocab().items():
            self.ends[k] = piece in self.special or piece[-1:] in ".!?" or "Ċ" in piece
            self.spaced[k] = piece[:1] == "Ġ"

    def forget(self) -> None:
        """No word is known: ``ids[first : first + size]`` are those of the word with a hash of ``hashes``, which ascend."""
        self.hashes, self.first, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _whole(self, text: str) -> np.ndarray:
        if self.quick and not _ODD_SPACE.search(text) and not any(s in text for s in self.special):
            return self.quick.encode_to_numpy(text, disallowed_special=())
        cuts, parts = [0], []
        while len(text) - cuts[-1] > 2 * _LONG and (m := _SAFE.search(text, cuts[-1] + _LONG)):
            cuts.append(m.start() + 1)
        for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True):
            parts.append(np.array(self.library.encode(text[a:b], add_special_tokens=False).ids, np.uint32))
        return np.concatenate(parts)

    def _spaced_words(self, blob: str, n: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of ``n`` words end to end and how many each has: every word begins with the only space it has."""
        if not self.quick and any(s in blob for s in self.special):
            return None
        ids = self.quick.encode_to_numpy(blob, disallowed_special=()) if self.quick else self._whole(blob)
        cuts = np.flatnonzero(self.spaced[ids])
        return (ids, np.diff(np.r_[cuts, len(ids)])) if len(cuts) == n else None

    def _learn(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        spaced = data[starts] == 32
        parts, sizes = [], np.zeros(len(starts), np.int64)
        order = np.r_[np.flatnonzero(spaced), np.flatnonzero(~spaced)]
        n = int(spaced.sum())
        if n:
            blob = data[ranges(starts[order[:n]], (ends - starts)[order[:n]])].tobytes().decode()
            known = self._spaced_words(blob, n)
            if known is None:
                every = [self._whole(data[a:b].tobytes().decode()) for a, b in zip(starts[order[:n]], ends[order[:n]], strict=True)]
                known = np.concatenate(every), np.array([len(x) for x in every])
            parts.append(known[0])
            sizes[:n] = known[1]
        for k, o in enumerate(order[n:].tolist(), n):
            parts.append(self._whole(data[starts[o] : ends[o]].tobytes().decode()))
            sizes[k] = len(parts[-1])
        first = np.cumsum(sizes) - sizes + len(self.ids)
        every = np.concatenate([self.hashes, hashes[order]])
        by = np.argsort(every)
        self.hashes, self.first, self.size = every[by], np.concatenate([self.first, first])[by], np.concatenate([self.size, sizes])[by]
        self.ids = np.concatenate([self.ids, *parts])

    def _look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Places of the words in what is known, after learning those that aren't."""
        h = span_hashes(data, starts, ends)
        order = np.argsort(h)
        fresh = np.r_[True, h[order[1:]] != h[order[:-1]]]
        which = np.empty(len(h), np.int64)
        which[order] = np.cumsum(fresh) - 1
        words, sample = h[order[fresh]], order[fresh]
        if len(self.hashes):
            new = self.hashes[np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)] != words
        else:
            new = np.ones(len(words), bool)
        if new.any():
            if len(self.hashes) > _CACHE:
                self.forget()
                new[:] = True
            self._learn(words[new], data, starts[sample[new]], ends[sample[new]])
        return np.searchsorted(self.hashes, words)[which]

    def encode(self, texts: list[str], end: bytes = b"") -> list[np.ndarray]:
        """Ids of each text, with the bytes of a closing id behind them."""
        # Only a space between two words is such a place: texts with other spaces go whole.
        plain = [" " in t and self._plain(t) for t in texts]
        data, offsets = text_bytes(pa.array([t if p else "" for t, p in zip(texts, plain, strict=True)], pa.string()))
        closing = np.frombuffer(end, np.uint32)
        made: list[np.ndarray] = []
        if any(plain):
            starts = np.sort(np.concatenate([offsets[:-1][np.diff(offsets) > 0], np.flatnonzero(data == 32)]))
            place = self._look_up(data, starts, np.r_[starts[1:], len(data)])
            size = self.size[place]
            ids = self.ids[ranges(self.first[place], size)]
            stops = np.cumsum(np.bincount(np.searchsorted(offsets, starts, side="right") - 1, size, len(texts)).astype(np.int64))
        at = 0
        for k, (text, p) in enumerate(zip(texts, plain, strict=True)):
            if p:
                made.append(np.concatenate([ids[at : stops[k]], closing]))
                at = stops[k]
            else:
                made.append(np.concatenate([self._whole(text), closing]))
        return made

    def _plain(self, text: str) -> bool:
        """Single spaces between words, line breaks inside words, no other white space, no special string."""
        if text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text:
            return False
        return not _ODD_SPACE.search(text) and not any(s in text for s in self.special)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``starts[k] .. starts[k] + sizes[k]``, one after another."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


# Fixed value: the pattern of the byte-level pre-tokenizer.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _same_by_ranks(library):
    """A faster encoder with the same ids, or None where that isn't certain.

    With byte-level pieces, the standard pattern, no normalizer and ids that follow the order of
    the merges (all of which is checked here), merging by id is merging by rank.
    """
    import json

    import tiktoken

    spec = json.loads(library.to_str())
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex"):
        return None
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(model["vocab"].get(a + b) != 256 + k for k, (a, b) in enumerate(merges)):
        return None
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}
    ranks = {bytes(byte_of[c] for c in piece): k for piece, k in model["vocab"].items() if k < 256 + len(merges)}
    return tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def cut_places(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, grid: int = GRID) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end (1 .. n) and their penalties."""
    n = len(ids)
    penalty = np.full(n + 1, np.inf)
    penalty[np.flatnonzero(ends[ids]) + 1] = SENTENCE
    penalty[doc_ends] = 0.0
    penalty[n] = min(penalty[n], INSIDE)
    fixed = np.flatnonzero(np.isfinite(penalty))
    gaps = np.diff(np.r_[0, fixed])
    # Inside a longer stretch without an end: a grid that starts where the stretch does.
    long_ = np.flatnonzero(gaps > grid)
    if len(long_):
        counts = (gaps[long_] - 1) // grid
        base = np.repeat(np.r_[0, fixed][long_], counts)
        step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + 1
        penalty[base + step * grid] = INSIDE
        fixed = np.flatnonzero(np.isfinite(penalty))
    fixed = fixed[fixed > 0]
    return fixed, penalty[fixed]


def best_cuts(places: np.ndarray, penalties: np.ndarray, size: int = SIZE) -> list[int]:
    """Ends of the windows of the cheapest cut; ``places`` ascend, with gaps of at most ``size``, the last is the end."""
    at = [0, *places.tolist()]
    cost = [0.0] * len(at)
    back = [0] * len(at)
    where = {0: 0}
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])  # (best + place, index), values ascending
    powers = [1 << k for k in range(size.bit_length()) if size // 16 <= 1 << k <= size]
    penalty = [0.0, *penalties.tolist()]
    look = where.get
    for k in range(1, len(at)):
        j = at[k]
        while at[queue[0][1]] < j - size:
            queue.popleft()
        value, i = queue[0]
        value += size - j + WINDOW
        for p in powers:
            h = look(j - p)
            if h is not None and cost[h] + WINDOW < value:
                value, i = cost[h] + WINDOW, h
        cost[k], back[k] = value + penalty[k], i
        where[j] = k
        key = cost[k] + j
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, k))
    cuts, k = [], len(at) - 1
    while k:
        cuts.append(at[k])
        k = back[k]
    return cuts[::-1]


_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)


class _Packer:
    """Packs a stream of documents; holds the ids not yet written and the documents they belong to."""

    def __init__(self, ends: np.ndarray, size: int, first: int):
        self.ends, self.size, self.sequence = ends, size, first
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple[int | None, int, int, int]] = []  # doc, start, length here, tokens
        self.held = 0

    def add(self, doc: int | None, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = 0
        while at < len(ids):
            part = ids[at : at + STRETCH]
            self.ids.append(part)
            self.docs.append((doc, at, len(part), len(ids)))
            self.held += len(part)
            at += len(part)
            if self.held >= STRETCH:
                yield self.flush(False)

    def flush(self, last: bool) -> pa.RecordBatch:
        ids = np.concatenate(self.ids)
        lengths = np.array([d[2] for d in self.docs])
        stops = np.cumsum(lengths)
        over = np.array([d[1] + d[2] == d[3] for d in self.docs])
        cuts = best_cuts(*cut_places(ids, stops[over], self.ends), self.size)
        if not last:
            # What the next stretch may still change stays: the windows that end near the edge.
            edge = len(ids) - 2 * self.size
            cuts = [c for c in cuts if c <= edge] or cuts
        rows: list[tuple] = []
        begin, k = 0, 0
        starts = stops - lengths
        for cut in cuts:
            at = begin
            while at < cut:
                while stops[k] <= at:
                    k += 1
                doc, first, _, tokens = self.docs[k]
                until = min(cut, int(stops[k]))
                piece = ids[at:until]
                rows.append((doc, first + at - int(starts[k]), until - at, zlib.crc32(piece.astype("<u4").tobytes()), tokens, self.sequence, at - begin))
                at = until
            begin = cut
            self.sequence += 1
        left = ids[begin:].copy()
        docs = []
        for (doc, first, n, tokens), a, b in zip(self.docs, starts.tolist(), stops.tolist(), strict=True):
            if b > begin:
                skip = max(0, begin - a)
                docs.append((doc, first + skip, n - skip, tokens))
        self.ids, self.docs, self.held = ([left] if len(left) else []), docs, len(left)
        return batch_of(_PIECES, *zip(*rows, strict=True)) if rows else batch_of(_PIECES, *([] for _ in _PIECES))


def pack(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end_id: int = 0) -> DataFrame:
    """One row for each piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Documents stay in the order of their partition, and no row is moved: a partition fills its
    own sequences, numbered from its partition's number times 2**33, and only its last ones can
    be short. A document is its whole text's ids and then ``end_id``; a null or empty text is
    that id alone. Repeated rows are packed again, an empty table gives no rows, other columns
    are ignored, a null doc_id stays null.
    """
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = _encoder(tokenizer_path)
        packer = _Packer(encoder.ends, size, TaskContext.get().partitionId() << 33)
        last = np.array([end_id], np.uint32).tobytes()
        for batch in slices(batches):
            every = encoder.encode(batch.column("text").to_pylist(), last)
            for doc, ids in zip(batch.column("doc_id").to_pylist(), every, strict=True):
                yield from packer.add(None if doc == NULL_ID else doc, ids)
        if packer.held:
            yield packer.flush(True)

    return documents(docs).mapInArrow(run, spark_schema(_PIECES))


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
