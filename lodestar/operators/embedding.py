"""Text embedding behind one interface: an encoder's weights file, or hashed character n-grams."""

from __future__ import annotations

from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.text import encode_words

HEADS = 12


class Embedder(Protocol):
    """Anything that turns a text into a vector of length 1."""

    dim: int

    def embed(self, text: str) -> np.ndarray: ...


#: The code points that part words.
_SPACES = np.array([c for c in range(0x3001) if chr(c).isspace()], np.uint32)
#: Characters whose trigrams are hashed at once.
_CHARACTERS = 1_000_000


class HashedNgrams:
    """Signed counts of hashed character trigrams of the lower-case words, each between spaces, at length 1. Needs no files."""

    def __init__(self, dim: int = 384):
        self.dim = dim

    def embed(self, text: str) -> np.ndarray:
        return self._counted([text])[0]

    def embed_many(self, texts: list[str]) -> list[np.ndarray]:
        """As ``embed`` for each, many texts in one pass over their characters."""
        made, part, held = [], [], 0
        for t in texts:
            if part and held + len(t) > _CHARACTERS:
                made += list(self._counted(part))
                part, held = [], 0
            part.append(t)
            held += len(t)
        return made + list(self._counted(part)) if part else made

    def _counted(self, texts: list[str]) -> np.ndarray:
        lowered = [f" {t.lower()} " for t in texts]
        c = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
        row = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
        space = np.isin(c, _SPACES) if len(c) else np.zeros(0, bool)
        # A trigram around every character of a word; what is no word is one space.
        at = np.flatnonzero(~space)
        left, right = (np.where(space[at + k], np.uint32(32), c[at + k]).astype(np.uint64) for k in (-1, 1))
        h = (left << np.uint64(42) | c[at].astype(np.uint64) << np.uint64(21) | right) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        sign = np.where(h >> np.uint64(62) & np.uint64(1), 1.0, -1.0)
        v = np.bincount(row[at] * self.dim + (h % np.uint64(self.dim)).astype(np.int64), sign, len(texts) * self.dim).astype(float).reshape(len(texts), self.dim)
        size = np.sqrt((v * v).sum(1, keepdims=True))
        return np.divide(v, size, out=v, where=size > 1e-12)


def layer_norm(x: np.ndarray, weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    mean = x.mean(-1, keepdims=True)
    spread = np.abs((x * x).mean(-1, keepdims=True) - mean * mean)
    return (x - mean) / np.sqrt(spread + 1e-12) * weight + bias


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + np.tanh(0.79788456 * (x + 0.044715 * x**3)))


def gelu_column(x: Column) -> Column:
    return F.lit(0.5) * x * (1 + F.tanh(F.lit(0.79788456) * (x + F.lit(0.044715) * x * x * x)))


class Transformer:
    """A BERT-style encoder from a weights mapping; mean pooling over all tokens, length 1."""

    def __init__(self, weights: dict[str, np.ndarray], layers: int, vocabulary: dict[str, int], max_tokens: int = 512, heads: int = HEADS, prefix: str = " ", normalization: bool = True):
        self.w, self.layers, self.heads, self.max_tokens, self.prefix, self.normalization = weights, layers, heads, max_tokens, prefix, normalization
        self.dim = weights["word"].shape[1]
        self.pieces = {k.encode(): v for k, v in vocabulary.items()}
        self.longest = max((len(k) for k in self.pieces), default=0)

    def tokens(self, text: str) -> list[int]:
        import string

        if self.normalization:
            text = text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase, string.punctuation))
        found = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
        return encode_words(found, self.pieces, self.longest, self.prefix, self.max_tokens)

    def embed(self, text: str) -> np.ndarray:
        w, ids = self.w, self.tokens(text)
        n, size = len(ids), self.dim // self.heads
        x = layer_norm(w["word"][ids] + w["position"][:n] + w["type"][0], w["embed_ln_w"], w["embed_ln_b"])
        for k in range(self.layers):
            get = lambda name, k=k: w[f"{k}.{name}"]
            q, key, v = (x @ get(f"{c}_w").T + get(f"{c}_b") for c in "qkv")
            split = lambda a: a.reshape(n, self.heads, size).transpose(1, 0, 2)
            s = split(q) @ split(key).transpose(0, 2, 1) / np.sqrt(size)
            p = np.exp(s - s.max(-1, keepdims=True))
            mixed = (p / p.sum(-1, keepdims=True) @ split(v)).transpose(1, 0, 2).reshape(n, self.dim)
            x = layer_norm(x + mixed @ get("o_w").T + get("o_b"), get("o_ln_w"), get("o_ln_b"))
            inner = gelu(x @ get("ff1_w").T + get("ff1_b"))
            x = layer_norm(x + inner @ get("ff2_w").T + get("ff2_b"), get("ff_ln_w"), get("ff_ln_b"))
        pooled = x.mean(0)
        return pooled / np.sqrt(max(float(pooled @ pooled), 1e-12))


def embed_column(text: Column | str, embedder: Embedder) -> Column:
    """array<float> of a text column, in Arrow batches; the embedder travels once to each worker. Null is empty.

    An embedder that has ``embed_many`` gets a batch's texts at once.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts):
        import pandas as pd

        listed = texts.fillna("").tolist()
        made = embedder.embed_many(listed) if hasattr(embedder, "embed_many") else map(embedder.embed, listed)
        return pd.Series([v.astype(np.float32) for v in made], dtype=object)

    return embed(F.col(text) if isinstance(text, str) else text)


def mean_pool(rows: DataFrame, key: str, vec_col: str = "embedding") -> DataFrame:
    """(key, embedding): the mean vector of each key, from sums by dimension."""
    each = rows.select(key, F.posexplode(vec_col).alias("pos", "x"))
    means = each.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = means.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("p"))
    return ordered.select(key, F.transform("p", lambda e: e["x"]).alias("embedding"))
