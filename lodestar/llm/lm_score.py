"""Language-model scores: a gated recurrent network over word classes, counts within the classes.

P(word | history) = P(class | history) * P(word | class): the class-factored softmax. Every word
has a class by its form (a hash of its first and last characters and its length), so no vocabulary
is sent anywhere. The first factor is a GRU's, trained by truncated backpropagation through time
in numpy and run over whole documents with the state carried across windows; the second comes
from counts over all training documents.

Training is data-parallel and takes every training document once: in each of ``ROUNDS`` rounds the
partitions train on their part of the round's documents from common weights, which are then
averaged by tokens. So what is learned from grows with the input.

Counts are gathered by hash ranges, each task telling a word once. Tasks know the ``FREQUENT`` most
frequent words by themselves; only what a document holds besides is sent to the ranges and back.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import LOWER, batch_of, documents, id_back, id_remainder, materialize, mix, partitions, slices, span_hashes, spark_schema, text_bytes, tune, word_spans

CLASSES = 128
HIDDEN = 24
#: The end of a document: a token of its own, in the last class.
END = np.uint64(0x454E44)
ALPHA = 0.1
WINDOW = 32
LANES = 256
#: Lanes of a pass at least; more of them while it still has about so many steps.
TRAIN_LANES = 16
TRAIN_STEPS = 50
STRETCH = 512
#: Rounds of training and averaging, and the share of the first one's rate that each goes at.
ROUNDS = (1.0, 0.5, 0.25)
#: Share of the class unigram in the first factor: it bounds what a strange history can cost a token.
BLEND = 0.1
#: Words that every task knows by itself, at most: two numbers each.
FREQUENT = 1 << 19
#: Tokens, documents or words that a task holds before it passes them on.
_HOLD_TOKENS, _HOLD_ROWS, _HOLD_WORDS = 4_000_000, 50_000, 2_000_000


def _kinds(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Classes of the lower-case words by their form: ends of words tell languages apart."""
    size = ends - starts
    last, first = data[ends - 1].astype(np.uint64), data[starts].astype(np.uint64)
    second = np.where(size > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.uint64)
    form = mix(last | second << np.uint64(8) | (size <= 3).astype(np.uint64) << np.uint64(16) | np.where(size <= 3, first, 0).astype(np.uint64) << np.uint64(24))
    return (form % np.uint64(CLASSES - 1)).astype(np.uint8)


def _ended(values: np.ndarray, row: np.ndarray, n: int, end) -> np.ndarray:
    """The words' values with one of the end behind each row's."""
    made = np.full(len(row) + n, end)
    made[np.arange(len(row)) + row] = values
    return made


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, class, row) of all tokens in order, an end behind each row's words."""
    data, n = LOWER[data], len(offsets) - 1
    starts, ends, row = word_spans(data, offsets)
    each = np.repeat(np.arange(n), np.bincount(row, minlength=n) + 1)
    return _ended(span_hashes(data, starts, ends), row, n, END), _ended(_kinds(data, starts, ends), row, n, np.uint8(CLASSES - 1)), each


def class_streams(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The classes of each row's tokens."""
    data, n = LOWER[data], len(offsets) - 1
    starts, ends, row = word_spans(data, offsets)
    return np.split(_ended(_kinds(data, starts, ends), row, n, np.uint8(CLASSES - 1)), np.cumsum(np.bincount(row, minlength=n) + 1)[:-1]) if n else []


class Gru:
    """A GRU over classes: embedding of the last class in, log-probabilities of the next class out."""

    NAMES = ("embed", "wx", "wh", "b", "out", "ob")

    def __init__(self, weights: dict[str, np.ndarray] | None = None, seed: int = 7, log_prior: np.ndarray | None = None):
        rng = np.random.default_rng(seed)
        shape = {"embed": (CLASSES + 1, HIDDEN), "wx": (HIDDEN, 3 * HIDDEN), "wh": (HIDDEN, 3 * HIDDEN), "b": (3 * HIDDEN,), "out": (HIDDEN, CLASSES), "ob": (CLASSES,)}
        self.w = weights or {k: (rng.standard_normal(s) * (0.0 if k in ("b", "ob", "out") else 1 / np.sqrt(HIDDEN))).astype(np.float32) for k, s in shape.items()}
        if log_prior is not None:
            # The untrained network is the unigram model of the classes.
            self.w["ob"] = log_prior.astype(np.float32)
        self.prepare()

    def prepare(self) -> None:
        # The input side depends on the class alone: one row of gate inputs for each.
        self.inputs = self.w["embed"] @ self.w["wx"] + self.w["b"]

    def step(self, h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, tuple]:
        """The state after class ``c``, and what the way back needs."""
        k = HIDDEN
        x, u = self.inputs[c], h @ self.w["wh"]
        gates = 1 / (1 + np.exp(-np.clip(x[:, : 2 * k] + u[:, : 2 * k], -30, 30)))
        z, r = gates[:, :k], gates[:, k:]
        g = np.tanh(x[:, 2 * k :] + r * u[:, 2 * k :])
        return h + z * (g - h), (h, c, z, r, g, u[:, 2 * k :])

    def log_probs(self, h: np.ndarray) -> np.ndarray:
        s = h @ self.w["out"] + self.w["ob"]
        s -= s.max(1, keepdims=True)
        return s - np.log(np.exp(s).sum(1, keepdims=True))

    def gradients(self, h: np.ndarray, last: np.ndarray, window: np.ndarray, fresh: np.ndarray | None = None) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, float]:
        """Truncated backpropagation over a window (lanes, steps); -1 ends a lane, ``fresh`` marks
        the first tokens of documents. Returns the state to carry."""
        k, (lanes, steps) = HIDDEN, window.shape
        live, target = np.ascontiguousarray((window >= 0).T), np.ascontiguousarray(np.maximum(window, 0).T)
        count, kind = max(1, int(live.sum())), h.dtype
        begun, whole = np.zeros(steps, bool) if fresh is None else fresh.any(0), live.all(1)
        # Units by lanes: whatever is done to a gate is done to one stretch of memory.
        inputs, wh, out = (np.ascontiguousarray(x.T) for x in (self.inputs, self.w["wh"], self.w["out"]))
        ob, h = self.w["ob"][:, None], np.ascontiguousarray(h.T)
        grad = {"wh": np.zeros_like(self.w["wh"]), "out": np.zeros_like(self.w["out"]), "ob": np.zeros_like(self.w["ob"])}
        trail, loss, each = [], 0.0, np.arange(lanes)
        for t in range(steps):
            if begun[t]:
                h, last = np.where(fresh[:, t], kind.type(0), h), np.where(fresh[:, t], CLASSES, last)
            on, y = live[t], target[t]
            x, u = inputs.take(last, 1), wh @ h
            gates = x[: 2 * k]
            gates += u[: 2 * k]
            np.clip(gates, -30, 30, out=gates)
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            z, r, g, ug = gates[:k], gates[k:], x[2 * k :], u[2 * k :]
            g += r * ug
            np.tanh(g, out=g)
            new = h + z * (g - h)
            if not whole[t]:
                new = np.where(on, new, h)
            # The output side at once, while the step is in the processor's cache.
            d = out @ new
            d += ob
            d -= d.max(0)
            chosen = d[y, each]
            np.exp(d, out=d)
            total = d.sum(0)
            loss -= float((chosen - np.log(total))[on].sum())
            d *= (on / (total * count)).astype(kind)
            d[y, each] -= (on / count).astype(kind)
            grad["out"] += new @ d.T
            grad["ob"] += d.sum(1)
            trail.append((h, last, z, r, g, ug, self.w["out"] @ d))
            h, last = new, y if whole[t] else np.where(on, y, last)
        back, d_in, unit = np.zeros((k, lanes), kind), np.zeros((3 * k, CLASSES + 1), kind), np.eye(CLASSES + 1, dtype=kind)
        dx = np.empty((3 * k, lanes), kind)
        for t in range(steps - 1, -1, -1):
            h0, c, z, r, g, ug, way = trail[t]
            dh, dg = way + back, dx[2 * k :]
            through = dh * z
            np.multiply(through, 1 - g * g, out=dg)
            np.multiply(dh * (g - h0), z * (1 - z), out=dx[:k])
            np.multiply(dg * ug, r * (1 - r), out=dx[k : 2 * k])
            if not whole[t]:
                dx *= live[t]
            d_in += dx @ unit[c]
            dg *= r  # from here on what goes to the state's side
            grad["wh"] += h0 @ dx.T
            passed = dh - through + self.w["wh"] @ dx
            back = passed if whole[t] else np.where(live[t], passed, dh)
            if begun[t]:
                back = back * ~fresh[:, t]
        h, d_in = np.ascontiguousarray(h.T), d_in.T
        grad["b"] = d_in.sum(0)
        grad["wx"] = self.w["embed"].T @ d_in
        grad["embed"] = d_in @ self.w["wx"].T
        return grad, h, last, loss / count


def train(net: Gru, streams: list[np.ndarray], rate: float = 0.02) -> Gru:
    """One pass of Adam over the class streams of documents, laid end to end in lanes of like length.

    Long documents are dealt out in stretches, so that none of them is all that the last steps see.
    """
    streams = [part for x in streams for part in np.array_split(x, -(-len(x) // STRETCH))]
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v = {k: np.zeros_like(x) for k, x in net.w.items()}
    wide = min(LANES, max(TRAIN_LANES, sum(map(len, streams)) // (WINDOW * TRAIN_STEPS)))
    lanes: list[list[np.ndarray]] = [[] for _ in range(min(wide, len(streams)))]
    filled = np.zeros(len(lanes), np.int64)
    for x in sorted(streams, key=len, reverse=True):
        k = int(filled.argmin())
        lanes[k].append(x)
        filled[k] += len(x)
    rng = np.random.default_rng(len(streams))
    steps = -(-int(filled.max()) // WINDOW)
    grid, fresh = np.full((len(lanes), steps * WINDOW), -1), np.zeros((len(lanes), steps * WINDOW), bool)
    for k, docs in enumerate(lanes):
        at = 0
        for d in rng.permutation(len(docs)):
            grid[k, at : at + len(docs[d])] = docs[d]
            fresh[k, at] = True
            at += len(docs[d])
    h, last = np.zeros((len(lanes), HIDDEN), np.float32), np.full(len(lanes), CLASSES)
    for step in range(1, steps + 1):
        part = slice((step - 1) * WINDOW, step * WINDOW)
        grad, h, last, _ = net.gradients(h, last, grid[:, part], fresh[:, part])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        pace = rate * min(1.0, step / 20) * max(0.05, 1 - step / (steps + 1))
        for k, g in grad.items():
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            net.w[k] = (net.w[k] - pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        net.prepare()
    return net


def _lanes(count: np.ndarray, wide: int) -> list[list[int]]:
    """Documents dealt to lanes, the longest first and always to the shortest lane; lanes by falling length."""
    heap, lanes = [(0, k) for k in range(wide)], [[] for _ in range(wide)]
    for d in np.argsort(-count, kind="stable").tolist():
        filled, k = heap[0]
        lanes[k].append(d)
        heapq.heapreplace(heap, (filled + int(count[d]), k))
    return [lanes[k] for filled, k in sorted(heap, key=lambda x: (-x[0], x[1])) if filled]


def class_log_likelihood(net: Gru, c: np.ndarray, row: np.ndarray, n: int, prior: np.ndarray | None = None) -> np.ndarray:
    """Sums of natural log P(class | history) over whole documents (``row`` ascends).

    The state runs from a document's first token to its last. Documents follow one another in
    lanes, so that steps are wide however their lengths differ; memory is that of the tokens.
    """
    sums, k = np.zeros(n), HIDDEN
    count = np.bincount(row, minlength=n)
    if not len(c):
        return sums
    first = np.cumsum(count) - count
    lanes = _lanes(count, min(LANES, int((count > 0).sum())))
    docs = [[d for d in lane if count[d]] for lane in lanes]
    filled = np.array([count[lane].sum() for lane in docs])
    base = np.cumsum(filled) - filled
    order = np.array([d for lane in docs for d in lane])
    flat = np.concatenate([c[first[d] : first[d] + count[d]] for d in order])
    begins = np.cumsum(count[order]) - count[order]
    fresh_at = np.zeros(len(flat), bool)
    fresh_at[begins] = True
    logs = np.empty(len(flat), np.float32)
    # Units by lanes: whatever is done to a gate is done to one stretch of memory.
    inputs, wh, out = (np.ascontiguousarray(x.T) for x in (net.inputs, net.w["wh"], net.w["out"]))
    ob, wide, block = net.w["ob"][:, None], len(docs), 256
    # The state is within -1 and 1, so this bounds the logits: exp needs no shift if they are small.
    steady = float((np.abs(net.w["out"]).sum(0) + np.abs(net.w["ob"])).max()) < 80
    h, last = np.zeros((k, wide), np.float32), np.full(wide, CLASSES)
    for start in range(0, int(filled[0]), block):
        wide = int(np.searchsorted(-filled, -start, side="left"))
        stops = np.minimum(filled[:wide] - start, block)
        grid, fresh = np.zeros((int(stops[0]), wide), np.uint8), np.zeros((int(stops[0]), wide), bool)
        for j, (at, stop) in enumerate(zip((base[:wide] + start).tolist(), stops.tolist(), strict=True)):
            grid[:stop, j], fresh[:stop, j] = flat[at : at + stop], fresh_at[at : at + stop]
        h, last = np.ascontiguousarray(h[:, :wide]), last[:wide]
        begun, each, chosen = fresh.any(1), np.arange(wide), np.empty(grid.shape, np.float32)
        for t in range(len(grid)):
            if begun[t]:
                h[:, fresh[t]] = 0
                last = np.where(fresh[t], CLASSES, last)
            x, u = inputs.take(last, 1), wh @ h
            gates, g = x[: 2 * k], x[2 * k :]
            gates += u[: 2 * k]
            np.clip(gates, -30, 30, out=gates)
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            r = gates[k:]
            r *= u[2 * k :]
            g += r
            np.tanh(g, out=g)
            g -= h
            g *= gates[:k]
            h = h + g
            d = out @ h
            d += ob
            if not steady:
                d -= d.max(0)
            last = grid[t]
            here = d[last, each]
            np.exp(d, out=d)
            chosen[t] = here - np.log(d.sum(0))
        if prior is not None:
            chosen = np.log((1 - BLEND) * np.exp(chosen) + BLEND * prior.astype(np.float32)[grid])
        for j, (at, stop) in enumerate(zip((base[:wide] + start).tolist(), stops.tolist(), strict=True)):
            logs[at : at + stop] = chosen[:stop, j]
    sums[order] = np.add.reduceat(logs.astype(np.float64), begins)
    return sums


_WEIGHTS = pa.schema([("at", pa.int32()), ("value", pa.float64()), ("tokens", pa.int64())])


def _flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in Gru.NAMES]).astype(np.float64)


def _unflat(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, v in Gru().w.items():
        out[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
        at += v.size
    return {k: out[k] for k in Gru.NAMES}


def fit_network(texts: DataFrame, log_prior: np.ndarray, rounds: tuple[float, ...] = ROUNDS, rate: float = 0.02) -> Gru:
    """The network after all rounds: each training document is in one of them, by a hash of its id."""
    weights = Gru(log_prior=log_prior).w
    for k, share in enumerate(rounds):

        def fit(batches: Iterator[pa.RecordBatch], start=weights, pace=rate * share) -> Iterator[pa.RecordBatch]:
            net, streams, seen, held = Gru({name: w.copy() for name, w in start.items()}), [], 0, 0
            for batch in slices(batches):
                streams += class_streams(*text_bytes(batch.column("text")))
                held = sum(map(len, streams))
                if held > 400_000:
                    net, seen, streams = train(net, streams, pace), seen + held, []
            if streams:
                net, seen = train(net, streams, pace), seen + sum(map(len, streams))
            if seen:
                flat = _flat(net.w)
                yield batch_of(_WEIGHTS, np.arange(len(flat)), flat * seen, np.full(len(flat), seen))

        mine = texts.where(F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(len(rounds))) == k)
        mean = mine.select("text").mapInArrow(fit, spark_schema(_WEIGHTS)).groupBy("at").agg((F.sum("value") / F.sum("tokens")).alias("value")).collect()
        if mean:
            flat = np.zeros(len(mean))
            for r in mean:
                flat[r["at"]] = r.value
            weights = _unflat(flat)
    return Gru(weights)


def _merged(h: np.ndarray, c: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, ascending, with class and summed counts."""
    order = np.argsort(h)
    h, c, n = h[order], c[order], n[order]
    begin = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    return h[begin], c[begin], np.add.reduceat(n, begin)


def _cuts(key: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, begin, end) of the runs of an ascending key."""
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return zip(key[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(key)], strict=False)


def _range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    return ((h >> np.uint64(40)) * np.uint64(ranges) >> np.uint64(24)).astype(np.int64)


def _read(table: pa.Table | pa.RecordBatch, column: str, kind: type) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in table.column(column).to_pylist())])


#: A hash range's words: hashes, classes and counts, packed.
_WORDS = pa.schema([("r", pa.int32()), ("h", pa.binary()), ("c", pa.binary()), ("n", pa.binary())])


def word_counts(texts: DataFrame) -> DataFrame:
    """One row for each hash range: its words with class and count over all of ``texts``.

    A task tells a range each word once (again only after ``_HOLD_WORDS`` others), so a frequent
    word costs a row's part a task and what is sent grows with the vocabulary of tasks.
    """
    ranges = partitions(texts.sparkSession)

    def rows(h, c, n) -> pa.RecordBatch:
        return batch_of(_WORDS, *zip(*((r, h[a:b].tobytes(), c[a:b].tobytes(), n[a:b].tobytes()) for r, a, b in _cuts(_range_of(h, ranges))), strict=True))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in slices(batches):
            h, c, _ = tokens(*text_bytes(batch.column("text")))
            parts.append(_merged(h, c, np.ones(len(h), np.int64)))
            held += len(parts[-1][0])
            if held > _HOLD_WORDS:
                parts = [_merged(*map(np.concatenate, zip(*parts, strict=True)))]
                held = len(parts[0][0])
                if held > _HOLD_WORDS // 2:
                    yield rows(*parts[0])
                    parts, held = [], 0
        if parts:
            yield rows(*_merged(*map(np.concatenate, zip(*parts, strict=True))))

    def add(table: pa.Table) -> pa.Table:
        h, c, n = _merged(_read(table, "h", np.uint64), _read(table, "c", np.uint8), _read(table, "n", np.int64))
        return pa.Table.from_batches([batch_of(_WORDS, [table.column("r")[0].as_py()], [h.tobytes()], [c.tobytes()], [n.tobytes()])], _WORDS)

    return materialize(texts.select("text").mapInArrow(count, spark_schema(_WORDS)).groupBy("r").applyInArrow(add, spark_schema(_WORDS)), "counts")


def _octave(n: np.ndarray) -> np.ndarray:
    """Counts on a scale of eight steps an octave."""
    return np.floor(np.log2(n) * 8).astype(np.int64)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens (1) and words (2) of each class, words of each octave step of counts (3)."""
    sums = np.zeros((3, 512), np.int64)
    for batch in batches:
        c, n = _read(batch, "c", np.uint8), _read(batch, "n", np.int64)
        sums[0] += np.bincount(c, n, 512).astype(np.int64)
        sums[1] += np.bincount(c, minlength=512)
        sums[2] += np.bincount(_octave(n), minlength=512)
    kind, at = np.nonzero(sums)
    yield batch_of(pa.schema([("kind", pa.int32()), ("at", pa.int32()), ("n", pa.int64())]), kind + 1, at, sums[kind, at])


def _split_at(least: int, frequent: bool):
    """The words of a range whose octave step is ``least`` or more, or the others."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, h, n in zip(*(batch.column(c).to_pylist() for c in "rhn"), strict=True):
                count = np.frombuffer(n, np.int64)
                mine = (_octave(count) >= least) == frequent
                if mine.any():
                    yield batch_of(_ENTRIES, [r], [None], [None], [np.frombuffer(h, np.uint64)[mine].tobytes()], [count[mine].tobytes()])

    return pick


#: What a range gets: words with their counts (no rows), and rows' words with their frequencies there.
_ENTRIES = pa.schema([("r", pa.int32()), ("rows", pa.binary()), ("at", pa.binary()), ("h", pa.binary()), ("n", pa.binary())])
#: What a range tells a bucket of rows.
_TOLD = pa.schema([("g", pa.int32()), ("rows", pa.binary()), ("logs", pa.binary()), ("known", pa.binary()), ("once", pa.binary())])
_PARTS = pa.schema([("k", pa.int64()), ("rare_logs", pa.float64()), ("rare_known", pa.int64()), ("rare_once", pa.int64())])
_SCORED = pa.schema(
    [("doc_id", pa.int64()), ("k", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("once", pa.int64()), ("logs", pa.float64()), ("model", pa.float64()), ("h", pa.binary()), ("n", pa.binary())]
)


def _row_sums(rows: np.ndarray, logs: np.ndarray, *numbers: np.ndarray) -> tuple[np.ndarray, ...]:
    names, at = np.unique(rows, return_inverse=True)
    return names, np.bincount(at, logs, len(names)), *(np.bincount(at, x, len(names)).astype(np.int64) for x in numbers)


def _rare_parts(scored: DataFrame, rare: DataFrame) -> DataFrame:
    """(k, rare_logs, rare_known, rare_once): over each row's words that tasks don't know, by hash ranges."""
    ranges = partitions(scored.sparkSession)

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n, rows, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            hs, ns, ks = np.concatenate(h), np.concatenate(n), np.concatenate(rows)
            order, made = np.argsort(hs), []
            hs, ns, ks = hs[order], ns[order], ks[order]
            for r, a, b in _cuts(_range_of(hs, ranges)):
                mine, at = np.unique(ks[a:b], return_inverse=True)
                made.append((r, mine.tobytes(), at.astype(np.uint32).tobytes(), hs[a:b].tobytes(), ns[a:b].tobytes()))
            return batch_of(_ENTRIES, *zip(*made, strict=True))

        for batch in batches:
            words = [np.frombuffer(x, np.uint64) for x in batch.column("h").to_pylist()]
            if words:
                h += words
                n.append(_read(batch, "n", np.uint32))
                rows.append(np.repeat(batch.column("k").to_numpy(), [len(x) for x in words]))
                held += len(rows[-1])
            if held > _HOLD_WORDS:
                yield flush()
                h, n, rows, held = [], [], [], 0
        if held:
            yield flush()

    def look_up(table: pa.Table) -> pa.Table:
        counted, asked = table.filter(table.column("rows").is_null()), table.filter(table.column("rows").is_valid())
        words, _, counts = _merged(h := _read(counted, "h", np.uint64), h, _read(counted, "n", np.int64)) if counted.num_rows else (np.zeros(0, np.uint64), None, np.zeros(0, np.int64))
        told: list[tuple] = []
        if asked.num_rows:
            rows, at, base = [], [], 0
            for x, y in zip(asked.column("rows").to_pylist(), asked.column("at").to_pylist(), strict=True):
                rows.append(np.frombuffer(x, np.int64))
                at.append(np.frombuffer(y, np.uint32).astype(np.int64) + base)
                base += len(rows[-1])
            h, tf = _read(asked, "h", np.uint64), _read(asked, "n", np.uint32)
            place = np.searchsorted(words, h)
            found = np.append(words, np.uint64(0))[place] == h if len(words) else np.zeros(len(h), bool)
            n = np.where(found & (place < len(words)), np.append(counts, 0)[place], 0)
            owner = np.concatenate(rows)[np.concatenate(at)]
            sums = _row_sums(owner, tf * np.log10(n + ALPHA), tf * (n > 0), tf * (n == 1))
            g = (mix(sums[0].view(np.uint64)) % np.uint64(ranges)).astype(np.int64)
            order = np.argsort(g, kind="stable")
            sums = [x[order] for x in sums]
            told = [(bucket, *(x[a:b].tobytes() for x in sums)) for bucket, a, b in _cuts(g[order])]
        return pa.Table.from_batches([batch_of(_TOLD, *(zip(*told, strict=True) if told else ([] for _ in _TOLD)))], _TOLD)

    def gather(table: pa.Table) -> pa.Table:
        parts = _row_sums(_read(table, "rows", np.int64), _read(table, "logs", np.float64), _read(table, "known", np.int64), _read(table, "once", np.int64))
        return pa.Table.from_batches([batch_of(_PARTS, *parts)], _PARTS)

    asked = scored.where(F.length("h") > 0).select("k", "h", "n").mapInArrow(forward, spark_schema(_ENTRIES))
    return asked.union(rare).groupBy("r").applyInArrow(look_up, spark_schema(_TOLD)).groupBy("g").applyInArrow(gather, spark_schema(_PARTS))


def lm_scores(docs: DataFrame, mod: int = 10, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, score_per_token, n_once) of every row of ``docs``.

    Counts come from all documents whose id's remainder isn't 0. ``base_score`` is the unigram sum
    with add-0.1 smoothing, ``score`` the model's log10 probability of the whole text; ``n_once``
    counts the tokens whose word the training documents have a single time: a training document
    without any has all its words elsewhere too, or more than once itself. A null or
    empty text is its end alone; repeated rows count and are scored again; an empty table gives
    no rows; other columns are ignored. ``frequent`` bounds the words that tasks know by
    themselves; the others are looked up by a shuffle, with the same result.
    """
    spark = docs.sparkSession
    tune(spark)
    texts = documents(docs)
    counted = word_counts(texts.where(id_remainder(mod) != 0))
    size, steps = np.zeros((2, CLASSES)), np.zeros(512, np.int64)
    # At most 2 * CLASSES + 512 sums.
    for r in counted.select("c", "n").mapInArrow(_profile, "kind int, at int, n long").groupBy("kind", "at").agg(F.sum("n").alias("n")).collect():
        if r.kind == 3:
            steps[r["at"]] = r.n
        else:
            size[r.kind - 1, r["at"]] = r.n
    total, distinct = size.sum(1)
    inside = np.log10(size[0] + ALPHA * (size[1] + 1))
    prior = (size[0] + 1) / (size[0] + 1).sum()
    net = fit_network(texts.where(id_remainder(mod) != 0), np.log(prior))
    # The lowest step from which on there are no more words than tasks may know.
    over = np.flatnonzero(np.cumsum(steps[::-1])[::-1] > frequent)
    least = int(over[-1]) + 1 if len(over) else 0
    known = counted.mapInArrow(_split_at(least, True), spark_schema(_ENTRIES)).select("h", "n").collect()
    words, _, counts = _merged(h := np.concatenate([np.zeros(1, np.uint64), *(np.frombuffer(r.h, np.uint64) for r in known)]), h, np.concatenate([np.zeros(1, np.int64), *(np.frombuffer(r.n, np.int64) for r in known)]))
    logs = np.log10(counts + ALPHA)
    rare = counted.mapInArrow(_split_at(least, False), spark_schema(_ENTRIES))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        k, held, streams, done = TaskContext.get().partitionId() << 33, 0, [], []

        def flush() -> pa.RecordBatch:
            c, count = np.concatenate(streams), np.concatenate([d[1] for d in done])
            model = class_log_likelihood(net, c, np.repeat(np.arange(len(count)), count), len(count), prior)
            doc, n_tokens, n_known, once, log, within = (np.concatenate([d[i] for d in done]) for i in range(6))
            h, n = ([x for d in done for x in d[i]] for i in (6, 7))
            return batch_of(_SCORED, doc, np.arange(k, k + len(doc)), n_tokens, n_known, once, log, model / np.log(10) - within, h, n)

        for batch in slices(batches):
            h, c, row = tokens(*text_bytes(batch.column("text")))
            size, order = batch.num_rows, np.argsort(h)
            sorted_, owner = h[order], row[order]
            place = np.minimum(np.searchsorted(words, sorted_), len(words) - 1)
            mine = (words[place] == sorted_) & (counts[place] > 0)
            # The others of each row, by row: what a shuffle has to look up.
            h2, row2 = sorted_[~mine], owner[~mine]
            by_row = np.argsort(row2, kind="stable")
            h2, row2 = h2[by_row], row2[by_row]
            begin = np.flatnonzero(np.r_[True, (h2[1:] != h2[:-1]) | (row2[1:] != row2[:-1])]) if len(h2) else np.zeros(0, np.int64)
            h2, row2, n2 = h2[begin], row2[begin], np.diff(np.r_[begin, len(h2)]).astype(np.uint32)
            cut = np.searchsorted(row2, np.arange(size + 1)).tolist()
            done.append(
                (
                    batch.column("doc_id").to_numpy(),
                    np.bincount(row, minlength=size),
                    np.bincount(owner[mine], minlength=size),
                    np.bincount(owner[mine & (counts[place] == 1)], minlength=size),
                    np.bincount(owner[mine], logs[place[mine]], size),
                    np.bincount(row, inside[c], size),
                    [h2[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)],
                    [n2[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)],
                )
            )
            streams.append(c)
            held += len(c)
            if held > _HOLD_TOKENS or sum(len(d[0]) for d in done) > _HOLD_ROWS:
                made = flush()
                yield made
                k, held, streams, done = k + made.num_rows, 0, [], []
        if done:
            yield flush()

    scored = materialize(texts.mapInArrow(score, spark_schema(_SCORED)), "scored")
    joined = scored.drop("h", "n").join(_rare_parts(scored, rare), "k", "left")
    every = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0))
    return joined.select(
        id_back(),
        (id_remainder(mod) == 0).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (every - F.col("n_tokens") * F.lit(float(np.log10(total + ALPHA * (distinct + 1))))).alias("base_score"),
        (F.col("model") + every).alias("score"),
        ((F.col("model") + every) / F.col("n_tokens")).alias("score_per_token"),
        (F.col("once") + F.coalesce("rare_once", F.lit(0))).alias("n_once"),
    )
