"""GIF columns: LZW code streams, palettes, disposal and transparency, timed frames with colour histograms.

The decoder reads any GIF87a/89a. Between two clear codes the width of a code depends only on
how many came before it, so a stretch's codes are cut out of the bytes at once; a code's string
is a stretch of the output that ends one byte into the next string, so lengths and bytes follow
from pointer doubling in numpy, without a loop over codes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import batch_of, documents, id_back, spark_schema, tune

WIDTH, FRAME_ROWS = 192, 341
_MOST = 4096
#: Bytes of images that are handed on together, about.
_BATCH_BYTES = 1_000_000


def _widths(first: int, count: int, least: int) -> np.ndarray:
    """Bits of the codes number 0 .. count-1 after a clear code."""
    following = first + np.maximum(np.arange(count) - 1, 0)
    return np.minimum(12, np.maximum(least, np.floor(np.log2(following)).astype(np.int64) + 1))


def _codes(data: bytes, clear: int) -> list[list[int]]:
    """Greedy LZW: the codes of each stretch between clear codes."""
    first, stretches, codes = clear + 2, [], []
    known: dict[int, int] = {}
    get, p, n = known.get, -1, first
    for b in data:
        if p < 0:
            p = b
            continue
        key = p << 8 | b
        c = get(key)
        if c is not None:
            p = c
            continue
        codes.append(p)
        known[key] = n
        n += 1
        p = b
        if n == _MOST:
            stretches.append(codes)
            codes, n = [], first
            known.clear()
    if p >= 0:
        codes.append(p)
    stretches.append(codes)
    return stretches


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """The LZW code stream of 8-bit samples, from a clear code to the end code."""
    clear, values, widths = 1 << bits, [[1 << bits]], [np.array([bits + 1])]
    stretches = _codes(data, clear)
    for k, codes in enumerate(stretches):
        codes.append(clear if k + 1 < len(stretches) else clear + 1)
        values.append(codes)
        widths.append(_widths(clear + 2, len(codes), bits + 1))
    value, width = np.concatenate([np.asarray(v, np.int64) for v in values]), np.concatenate(widths)
    at = np.cumsum(width) - width
    each = np.arange(12)
    bit = (value[:, None] >> each & 1).astype(np.uint8)
    flat = np.zeros(int(width.sum()), np.uint8)
    inside = each < width[:, None]
    flat[(at[:, None] + each)[inside]] = bit[inside]
    return np.packbits(flat, bitorder="little").tobytes()


def _stretch(codes: np.ndarray, clear: int) -> np.ndarray:
    """The bytes of the codes between two clear codes."""
    first, index = clear + 2, np.arange(len(codes))
    parent = np.where(codes < clear, -1, codes - first)
    if len(codes) and bool((parent >= index).any()):
        raise ValueError("a code refers to an entry that isn't there")
    depth, up = (parent >= 0).astype(np.int64), parent
    while bool((up >= 0).any()):
        depth = depth + np.where(up >= 0, depth[up], 0)
        up = np.where(up >= 0, up[up], -1)
    length = depth + 1
    begin = np.cumsum(length) - length
    total = int(length.sum())
    source = np.arange(total)
    shift = np.where(parent >= 0, begin - begin[parent], 0)
    source -= np.repeat(shift, length)
    while True:
        further = source[source]
        if np.array_equal(further, source):
            break
        source = further
    literal = np.zeros(total, np.uint8)
    at = codes < clear
    literal[begin[at]] = codes[at]
    return literal[source]


def lzw_decode(stream: bytes, bits: int, count: int) -> np.ndarray:
    """The first ``count`` samples of an LZW code stream with the given least code size."""
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    clear, have, at, out = 1 << bits, 8 * len(stream), 0, []
    done, codes, before = 0, [], 0
    while done < count:
        width = _widths(clear + 2, before + 4096, bits + 1)[before:]
        place = at + np.cumsum(width) - width
        width, place = width[(fits := place + width <= have)], place[fits]
        byte = place >> 3
        value = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (place & 7) & ((1 << width) - 1)
        stops = np.flatnonzero((value == clear) | (value == clear + 1))
        upto = int(stops[0]) if len(stops) else len(value)
        codes.append(value[:upto])
        if not len(stops) and len(value):
            before, at = before + len(value), int(place[-1] + width[-1])
            continue
        every = np.concatenate(codes)
        if len(every):
            out.append(_stretch(every, clear))
            done += len(out[-1])
        if not len(stops) or value[upto] == clear + 1:
            break
        at, before, codes = int(place[upto] + width[upto]), 0, []
    made = np.concatenate(out) if out else np.zeros(0, np.uint8)
    return made[:count] if len(made) >= count else np.pad(made, (0, count - len(made)))


@dataclass
class Frame:
    """A frame as shown: the whole canvas after drawing, and what was drawn where."""

    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    canvas: np.ndarray

    def drawn(self) -> np.ndarray:
        return self.canvas[self.top : self.top + self.height, self.left : self.left + self.width]

    def histogram(self, bins: int = 8) -> list[list[int]]:
        """Counts of the canvas's red, green and blue values in equal bins."""
        return [np.bincount(self.canvas[..., c].ravel().astype(np.int64) * bins >> 8, minlength=bins).tolist() for c in range(3)]


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += data[at] + 1
    return b"".join(parts), at + 1


def _palette(data: bytes, at: int, packed: int) -> tuple[np.ndarray, int]:
    size = 2 << (packed & 7)
    colours = np.zeros((256, 3), np.uint8)
    colours[:size] = np.frombuffer(data, np.uint8, 3 * size, at).reshape(-1, 3)
    return colours, at + 3 * size


def decode_gif(data: bytes) -> Iterator[Frame]:
    """The frames as composed on the canvas; one at a time, so memory is that of two canvases."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, packed, background, _ = struct.unpack_from("<HHBBB", data, 6)
    at, common = 13, np.zeros((256, 3), np.uint8)
    if packed & 0x80:
        common, at = _palette(data, at, packed)
    canvas = np.zeros((height, width, 3), np.uint8)
    canvas[:] = common[background]
    delay, disposal, transparent = 0, 0, -1
    while data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            block, after = _sub_blocks(data, at + 2)
            if label == 0xF9:
                flags, delay, index = struct.unpack("<BHB", block[:4])
                disposal, transparent = flags >> 2 & 7, index if flags & 1 else -1
            at = after
            continue
        if data[at] != 0x2C:
            raise ValueError("unknown block")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        colours = common
        if flags & 0x80:
            colours, at = _palette(data, at, flags)
        bits = data[at]
        stream, at = _sub_blocks(data, at + 1)
        index = lzw_decode(stream, bits, w * h).reshape(h, w)
        if flags & 0x40:
            order = [r for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(start, h, step)]
            rows = np.empty_like(index)
            rows[order] = index
            index = rows
        saved = canvas.copy() if disposal == 3 else None
        region = canvas[top : top + h, left : left + w]
        index = index[: region.shape[0], : region.shape[1]]
        if transparent >= 0:
            region[index != transparent] = colours[index[index != transparent]]
        else:
            region[:] = colours[index]
        yield Frame(left, top, w, h, delay * 10, canvas.copy())
        if disposal == 2:
            region[:] = common[background]
        elif saved is not None:
            canvas = saved
        delay, disposal, transparent = 0, 0, -1


_GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()


def encode_gif(samples: bytes, delay_ms: int = 100) -> bytes:
    """A grey GIF of rows of 192 samples; a long one goes on in further timed frames."""
    rows = len(samples) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, FRAME_ROWS), 0xF7, 0, 0), _GREY]
    for top in range(0, rows, FRAME_ROWS):
        part = samples[top * WIDTH : (top + FRAME_ROWS) * WIDTH]
        stream = lzw_encode(part)
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, delay_ms // 10, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0) + b"\x08")
        out += [bytes([len(stream[k : k + 255])]) + stream[k : k + 255] for k in range(0, len(stream), 255)]
        out.append(b"\0")
    return b"".join([*out, b";"])


def payload(text: str) -> bytes:
    """UTF-8, then spaces up to a positive multiple of the row width."""
    raw = text.encode()
    return raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b" ")


_FRAMES = pa.schema(
    [("key", pa.int64()), ("frame", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int32()), ("left", pa.int32()), ("top", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary())]
    + [(f"hist_{c}", pa.list_(pa.int64())) for c in "rgb"]
)


def gif_frames(images: DataFrame, key: str = "key", gif: str = "gif") -> DataFrame:
    """One row for each frame: place, time, RGB pixels of the canvas and histograms of its colours.

    A null or empty image gives no rows; bytes that aren't a GIF raise an error.
    """
    tune(images.sparkSession)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start = 0
                for n, f in enumerate(decode_gif(data) if data else ()):
                    yield batch_of(_FRAMES, [k], [n], [start], [f.delay_ms], [f.left], [f.top], [f.width], [f.height], [f.canvas.tobytes()], *([h] for h in f.histogram()))
                    start += f.delay_ms

    return images.select(F.col(key).cast("long").alias("key"), F.col(gif).alias("gif")).mapInArrow(frames, spark_schema(_FRAMES))


_GIFS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("gif", pa.binary())])


def text_gifs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, gif): each whole text as the samples of a GIF, losslessly. A null text is empty."""
    tune(docs.sparkSession)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows.append((doc, len(text.encode()), encode_gif(payload(text))))
                held += len(rows[-1][2])
                if held > _BATCH_BYTES:
                    yield batch_of(_GIFS, *zip(*rows, strict=True))
                    rows, held = [], 0
            if rows:
                yield batch_of(_GIFS, *zip(*rows, strict=True))

    return documents(docs).mapInArrow(store, spark_schema(_GIFS))


_DIGEST = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
)


def read_back(gif: bytes) -> tuple[bytes, str]:
    """The samples of a stored text, and its feature: frames, size, time and histogram of the colours."""
    parts, shown, ms, colours = [], 0, 0, np.zeros(8, np.int64)
    width, height = struct.unpack_from("<HH", gif, 6)
    for f in decode_gif(gif):
        grey = f.drawn()[..., 0]
        parts.append(grey.tobytes())
        colours += np.bincount(grey.ravel() >> 5, minlength=8)
        shown, ms = shown + 1, ms + f.delay_ms
    return b"".join(parts), f"frames={shown};size={width}x{height};ms={ms};grey={'.'.join(map(str, colours.tolist()))}"


def gif_digests(docs: DataFrame) -> DataFrame:
    """What comes back from the stored form of every whole text: sizes, hashes and a colour feature.

    Null and empty texts are stored as one row of spaces; repeated rows are stored again, an
    empty table gives no rows, other columns are ignored.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, n, gif in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                back, feature = read_back(gif)
                rows.append((doc, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(gif), hashlib.sha256(gif).hexdigest(), feature))
            yield batch_of(_DIGEST, *zip(*rows, strict=True)) if rows else batch_of(_DIGEST, *([] for _ in _DIGEST))

    return text_gifs(docs).mapInArrow(digest, spark_schema(_DIGEST)).withColumn("doc_id", id_back())
