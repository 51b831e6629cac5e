"""The encoder's weights file: a small header and 64-byte aligned float32 tensors, mapped, not read."""

from __future__ import annotations

import struct
from pathlib import Path

import numpy as np

# Fixed values of the binary format.
MAGIC = b"HVLMODEL"
ALIGN = 64


def layout(layers: int, hidden: int, vocab: int, positions: int) -> list[tuple[str, tuple[int, ...]]]:
    """Names and shapes of the tensors in the order of the file."""
    h = hidden
    out: list[tuple[str, tuple[int, ...]]] = [("word", (vocab, h)), ("position", (positions, h)), ("type", (2, h)), ("embed_ln_w", (h,)), ("embed_ln_b", (h,))]
    for k in range(layers):
        for name in "qkvo":
            out += [(f"{k}.{name}_w", (h, h)), (f"{k}.{name}_b", (h,))]
        out += [(f"{k}.o_ln_w", (h,)), (f"{k}.o_ln_b", (h,))]
        out += [(f"{k}.ff1_w", (4 * h, h)), (f"{k}.ff1_b", (4 * h,)), (f"{k}.ff2_w", (h, 4 * h)), (f"{k}.ff2_b", (h,)), (f"{k}.ff_ln_w", (h,)), (f"{k}.ff_ln_b", (h,))]
    return out


def read_weights(path: str, type_rows: int = 2) -> tuple[dict[str, np.ndarray], dict[str, int]]:
    """(tensors, header) of a file on this machine; tensors are views of the mapped file."""
    raw = np.memmap(path, np.uint8, "r")
    if bytes(raw[:8]) != MAGIC:
        raise ValueError("not a weights file")
    layers, hidden, vocab, positions = struct.unpack("<4i", bytes(raw[8:24]))
    tensors, at = {}, 24
    for name, shape in layout(layers, hidden, vocab, positions):
        shape = (type_rows, hidden) if name == "type" else shape
        at = -(-at // ALIGN) * ALIGN
        size = 4 * int(np.prod(shape))
        tensors[name] = raw[at : at + size].view(np.float32).reshape(shape)
        at += size
    return tensors, {"layers": layers, "hidden": hidden, "vocab": vocab, "positions": positions}


def write_weights(path: str, tensors: dict[str, np.ndarray], layers: int, hidden: int, vocab: int, positions: int) -> None:
    """The same format, for tests and converters."""
    out = bytearray(MAGIC + struct.pack("<4i", layers, hidden, vocab, positions))
    for name, _ in layout(layers, hidden, vocab, positions):
        out += b"\0" * (-len(out) % ALIGN)
        out += np.ascontiguousarray(tensors[name], np.float32).tobytes()
    Path(path).write_bytes(bytes(out))
