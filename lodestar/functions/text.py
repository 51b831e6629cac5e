"""Text functions as column expressions, and the command line's own small parsers."""

from __future__ import annotations

import fnmatch
import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_TEXT_BYTES = 4096
_BLANKS = " \t\n\x0b\f\r"


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize(c: Column | str) -> Column:
    """Without ASCII punctuation, A-Z in lower case."""
    return F.translate(F.regexp_replace(_column(c), r"\p{Punct}", ""), string.ascii_uppercase, string.ascii_lowercase)


def words(c: Column | str) -> Column:
    """Split on runs of space, tab, line feed and carriage return; no empty words."""
    return F.filter(F.split(_column(c), "[ \\t\\n\\r]+"), lambda x: x != "")


def is_valid(c: Column | str, most: int = MAX_TEXT_BYTES) -> Column:
    """Not blank, and no more than ``most`` bytes."""
    return _column(c).rlike("[^ \\t\\n\\x0B\\f\\r]") & (F.octet_length(_column(c)) <= most)


def check_text(text: str, most: int = MAX_TEXT_BYTES) -> str | None:
    """The error of a text that may not be stored, or None."""
    if not text.strip(_BLANKS):
        return "empty text rejected"
    return "text too long" if len(text.encode()) > most else None


def glob_regex(pattern: str) -> str:
    """A glob as an anchored regular expression: ``* ? [a-c] [!x] \\x``; ``*`` crosses ``/``."""
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        at += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "\\" and at < len(pattern):
            out.append(re.escape(pattern[at]))
            at += 1
        elif c == "[":
            close = pattern.find("]", at + (pattern[at : at + 1] in ("!", "^")) + 1)
            if close < 0:
                out.append("\\[")
                continue
            body = pattern[at:close]
            negated = body[:1] in ("!", "^")
            body = body[1:] if negated else body
            out.append(f"[{'^' if negated else ''}{re.sub(r'([\\\[\]&^])', r'\\\1', body)}]")
            at = close + 1
        else:
            out.append(re.escape(c))
    return f"(?s)^{''.join(out)}$"


def glob(c: Column | str, pattern: str) -> Column:
    return F.lit(True) if pattern == "*" else _column(c).rlike(glob_regex(pattern))


def glob_match(text: str, pattern: str) -> bool:
    return fnmatch.fnmatchcase(text, "*") if pattern == "*" else bool(re.match(glob_regex(pattern), text))


def chunk_path(c: Column | str) -> Column:
    """What stands before the first # of an id like ``folder/note.md#3``."""
    return F.split_part(_column(c), F.lit("#"), F.lit(1))


def chunk_number(c: Column | str) -> Column:
    return F.split_part(_column(c), F.lit("#"), F.lit(2))


def chunk_name(c: Column | str) -> Column:
    """The last part of the path."""
    return F.element_at(F.split(chunk_path(c), "/"), -1)


def import_id(c: Column | str) -> Column:
    """The id of an ``id|text`` line: leading bars are passed over, the first one after is the cut."""
    return F.regexp_extract(_column(c), r"(?s)^\|*([^|]+)\|(.*)$", 1)


def import_text(c: Column | str) -> Column:
    return F.regexp_extract(_column(c), r"(?s)^\|*([^|]+)\|(.*)$", 2)


def to_int(c: Column | str) -> Column:
    """The leading integer of a text, else 0."""
    return F.coalesce(F.expr("try_cast(NULL AS INT)") if c is None else F.regexp_extract(_column(c), r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0))


def atoi(text: str) -> int:
    m = re.match(r"\s*([+-]?\d+)", text or "")
    return int(m.group(1)) if m else 0


def keywords(c: Column | str, stop_words: tuple[str, ...] = ()) -> Column:
    """Lower-case words of more than two letters, no numbers, no stop words."""
    return F.filter(raw_keywords(c), lambda w: is_keyword(w, stop_words))


def raw_keywords(c: Column | str) -> Column:
    """All lower-case words, empty ones among them."""
    return F.split(F.regexp_replace(F.lower(_column(c)), r"[^\p{L}\p{N}\s]", " "), "\\s+")


def is_keyword(word: Column | str, stop_words: tuple[str, ...] = ()) -> Column:
    w = _column(word)
    kept = (F.length(w) > 2) & ~w.rlike("^[0-9]+$")
    return kept & ~w.isin(*stop_words) if stop_words else kept


def wordpieces(c: Column | str, vocabulary: dict[str, int], prefix: str = " ", max_length: int | None = 512) -> Column:
    """Greedy longest-prefix pieces of each normalised word, 0 in front and 2 behind, ``max_length`` at most (None: all).

    What no piece covers is passed over, byte by byte.
    """
    longest = max((len(k.encode()) for k in vocabulary), default=0)
    pieces = {k.encode(): v for k, v in vocabulary.items()}

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(texts):
        import numpy as np
        import pandas as pd

        # Words repeat within a batch: each is cut up once.
        known: dict[str, np.ndarray] = {}

        def ids(text: str) -> np.ndarray:
            if max_length is not None and max_length < 2:
                return np.zeros(0, np.int32)
            parts, held = [np.zeros(1, np.int32)], 1
            for word in text.split(" ") if text else ():
                if max_length is not None and held >= max_length - 1:
                    break
                if word not in known:
                    known[word] = np.array(word_pieces(word, pieces, longest, prefix), np.int32)
                parts.append(known[word])
                held += len(known[word])
            made = np.concatenate(parts)
            return np.append(made if max_length is None else made[: max_length - 1], np.int32(2))

        return pd.Series([ids(t) for t in texts], dtype=object)

    return encode(F.array_join(words(normalize(F.coalesce(_column(c), F.lit("")))), " "))


def word_pieces(word: str, pieces: dict[bytes, int], longest: int, prefix: str) -> list[int]:
    """Ids of the longest pieces from left to right; bytes that begin none are passed over."""
    raw, at, out = (prefix + word).encode(), 0, []
    while at < len(raw):
        size = next((n for n in range(min(longest, len(raw) - at), 0, -1) if raw[at : at + n] in pieces), 0)
        if size:
            out.append(pieces[raw[at : at + size]])
        at += size or 1
    return out


def encode_words(found: list[str], pieces: dict[bytes, int], longest: int, prefix: str, max_length: int | None) -> list[int]:
    """0, the pieces of the words and 2, ``max_length`` at most (None: all)."""
    if max_length is not None and max_length < 2:
        return []
    out = [0]
    for word in found:
        if max_length is not None and len(out) >= max_length - 1:
            break
        out += word_pieces(word, pieces, longest, prefix)
    return [*(out if max_length is None else out[: max_length - 1]), 2]
