"""Token counts with overlap resynchronisation for huge texts.

A text up to ``chunk`` characters is encoded at once. A longer one is encoded in chunks that
overlap; two neighbours are spliced at a place where both have a token boundary and that is
proven stable, and the overlap is doubled while there is none.

Why a place is stable: a token that crosses it would be a piece with the two characters beside
the place next to each other. ``stable_model`` gathers all such pairs of the vocabulary, once a
worker; no piece has U+2581, as which the model writes a space, behind another character. So the
tokens on either side of a space, or of another pair that no piece has, are the same whatever
stands on the other. (Without pieces for bytes, unknown neighbours become one token, and spaces
are the only such places.)
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestar.llm.common import batch_of, documents, id_back, spark_schema, tune

MARK = "▁"
_MARK = MARK.encode()
_COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
_models: dict[str, object] = {}


def stable_model(path: str):
    """The processor, once a worker; refuses a model for which the splice isn't proven."""
    if path not in _models:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if any(MARK in sp.id_to_piece(i).lstrip(MARK) for i in range(sp.get_piece_size())):
            raise ValueError("a piece of this model crosses from a word into a space: no place is stable")
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not sp.is_byte(i)]
        # Pairs of characters that some piece has side by side; None: only spaces are told.
        sp.joined = {p[k : k + 2] for p in pieces for k in range(len(p) - 1)} if len(pieces) < sp.get_piece_size() else None
        _models[path] = sp
    return _models[path]


def _ends(sp, raw: bytes, first: bool) -> list[int]:
    """Where the tokens of ``raw`` end, in bytes of ``raw``.

    The model puts a space before what it encodes. Inside a document there is none, so a later
    chunk that starts with a space has it taken off before encoding; of one that starts with
    another character, which no piece has behind a space, the space's token is left out.
    """
    spaced = not first and raw[:1] == b" "
    shift = 1 if spaced else 0
    ends = [p.end + shift for p in sp.encode(raw[shift:].decode(), num_threads=1, return_type="proto").pieces]
    return ends if first or spaced else ends[1:]


def _stable(sp, raw: bytes, at: int) -> bool:
    """Whether a chunk may begin at this place and what stands before it end there."""
    if not 0 < at < len(raw) or raw[at] & 0xC0 == 0x80:
        return False
    if raw[at] == 32:
        return raw[at - 1] != 32 and raw[max(0, at - 3) : at] != _MARK
    if sp.joined is None or raw[at - 1] == 32:
        return False
    begin = at - 1
    while raw[begin] & 0xC0 == 0x80:
        begin -= 1
    before, after = raw[begin:at].decode(), raw[at : at + 4].decode(errors="ignore")[:1]
    return MARK not in (before, after) and before + after not in sp.joined and MARK + after not in sp.joined


def _whole(raw: bytes, at: int) -> int:
    """The last start of a character at or before ``at``."""
    at = min(at, len(raw))
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at -= 1
    return at


def count_tokens(sp, text: str, chunk: int = 32_768, overlap: int = 256) -> int:
    """Tokens of the whole text, as one call of the model would give them."""
    if len(text) <= chunk // 2 or len(raw := text.encode()) <= chunk:
        return len(sp.encode(text, num_threads=1))
    stop = _whole(raw, chunk)
    total, start, ends = 0, 0, _ends(sp, raw[:stop], True)
    while stop < len(raw):
        width, splice = overlap, None
        while splice is None and width < 2 * (stop - start):
            # The next chunk begins at a stable place of the overlap; both then have a boundary
            # at a later one, or the overlap is widened.
            begin = next((i for i in range(max(start + 1, stop - width), stop) if _stable(sp, raw, i)), None)
            if begin is not None:
                after = _whole(raw, begin + chunk)
                more = [begin + e for e in _ends(sp, raw[begin:after], False)] if after > stop else []
                common = {start + e for e in ends} & {begin, *more}
                splice = max((e for e in common if e <= stop and _stable(sp, raw, e)), default=None) if more else None
            width *= 2
        if splice is None:
            # No stable place in all of it: the chunk itself grows.
            stop = _whole(raw, start + 2 * (stop - start))
            ends = _ends(sp, raw[start:stop], start == 0)
            continue
        total += sum(start + e <= splice for e in ends)
        ends, start, stop = [e - splice for e in more if e > splice], splice, after
    return total + len(ends)


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, chunk: int = 32_768, overlap: int = 256) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row: whole texts, no shuffle.

    Null and empty texts have no bytes and no tokens. Repeated rows are counted again, an empty
    table gives no rows, other columns are ignored. No special tokens are added and their
    strings inside a text are what the library makes of them.
    """
    tune(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = stable_model(model_path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n = [count_tokens(sp, t, chunk, overlap) for t in texts]
            yield batch_of(_COUNTS, batch.column("doc_id"), [len(t.encode()) for t in texts], n, [x > limit for x in n])

    return documents(docs).mapInArrow(count, spark_schema(_COUNTS)).withColumn("doc_id", id_back())
