"""Toxicity by a learned lexicon: Levenshtein automata intersected with a trie, and context windows.

The lexicon (whole words, and stems that any ending may follow) is learned from a bounded sample
of labelled rows. Its trie is intersected with the Levenshtein automata of its words, and the
product is made deterministic once, as a table of states by byte classes; all words of a batch
then step through the table together, so a text costs a few gathers a word however many terms
there are. A hit counts less when its window shows it to be quoted or talked about.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import batch_of, documents, id_back, id_remainder, slices, spark_schema, text_bytes, tune, word_spans
from lodestar.llm.quality import training_labels

#: Labelled rows of each class that the lexicon is learned from, at most.
MAX_LABELLED = 10_000
STEM = range(4, 9)
_WORD = re.compile(r"[^\W_]+")
# Verbs and nouns that speak of a word instead of using it, and quotation marks.
_REPORTING = frozenset("said says say wrote called calls word words term terms quote quoted quotes reported sagte nannte wort begriff zitat dit disait mot terme citation dijo dice palabra cita".split())
_QUOTES = "\"'“”„«»‘’`"
_WINDOW = 40


@dataclass
class Lexicon:
    """Terms with their weights, the words next to a term (next to a stem: their beginnings) that are no misspelling of it, and how sums become scores.

    The logit of a text whose hits weigh ``s`` among ``w`` words is
    ``bias + slope * s + slope_long * s * log(1 + w)``.
    """

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    innocent: frozenset[str] = frozenset()
    bias: float = -3.0
    slope: float = 1.0
    slope_long: float = 0.0
    fuzzy_share: float = 0.7
    quoted_share: float = 0.25

    def terms(self) -> list[str]:
        return [*self.words, *self.stems]


@dataclass
class Automaton:
    """The deterministic product: ``step[state, class_of[code point]]``, and each state's term and distance (-1: none).

    The last place of ``class_of`` stands for all code points from there on.
    """

    class_of: np.ndarray
    step: np.ndarray
    term: np.ndarray
    distance: np.ndarray


def compile_lexicon(lexicon: Lexicon, fuzzy_from: int = 5, fuzzy_stems: bool = False) -> Automaton:
    """Trie of all terms by code points; words of ``fuzzy_from`` bytes or more accept one edit, stems any ending.

    With ``fuzzy_stems`` stems of that size accept one edit too, before the ending.
    """
    terms, weights = lexicon.terms(), [*lexicon.words.values(), *lexicon.stems.values()]
    trie: list[dict[int, int]] = [{}]
    word_at, stem_at, fuzzy = {}, {}, {0: False}
    loose = [len(t.encode()) >= fuzzy_from and (fuzzy_stems or k < len(lexicon.words)) for k, t in enumerate(terms)]
    for k, term in enumerate(terms):
        node = 0
        for c in map(ord, term):
            fuzzy[node] |= loose[k]
            if c not in trie[node]:
                trie[node][c] = len(trie)
                trie.append({})
                fuzzy[trie[node][c]] = False
            node = trie[node][c]
        fuzzy[node] |= loose[k]
        (word_at if k < len(lexicon.words) else stem_at)[node] = k
    letters = sorted({c for node in trie for c in node})
    class_of = np.zeros(max(letters, default=0) + 2, np.int32)
    class_of[letters] = np.arange(1, len(letters) + 1)

    # A state is (node, edits), or (~stem, edits) once that stem is complete and only its ending follows.
    def close(states: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        """Follow deletions, and keep a node's least distance and the best complete stem only."""
        todo = list(states)
        while todo:
            node, e = todo.pop()
            if node >= 0 and node in stem_at and (e == 0 or loose[stem_at[node]]):
                states.add((~stem_at[node], e))
            if node >= 0 and e == 0:
                for child in trie[node].values():
                    if fuzzy[child] and (child, 1) not in states:
                        states.add((child, 1))
                        todo.append((child, 1))
        stems = [s for s in states if s[0] < 0]
        if not stems:
            return frozenset(s for s in states if s[1] == 0 or (s[0], 0) not in states)
        best = min(stems, key=lambda s: (s[1], -weights[~s[0]], ~s[0]))
        # Nothing with an edit is better than a stem without one.
        return frozenset({best} | {s for s in states if s[0] >= 0 and (s[1] == 0 or (best[1] and (s[0], 0) not in states))})

    def after(states: frozenset[tuple[int, int]], c: int | None) -> frozenset[tuple[int, int]]:
        made: set[tuple[int, int]] = set()
        for node, e in states:
            if node < 0:
                made.add((node, e))
                continue
            if c in trie[node]:
                made.add((trie[node][c], e))
            if e == 0 and fuzzy[node]:
                made.add((node, 1))
                made.update((child, 1) for child in trie[node].values() if fuzzy[child])
        return close(made)

    start = close({(0, 0)})
    number, queue, rows = {frozenset(): 0, start: 1}, [frozenset(), start], []

    def numbered(states: frozenset[tuple[int, int]]) -> int:
        if states not in number:
            number[states] = len(number)
            queue.append(states)
        return number[states]

    place = {c: k for k, c in enumerate(letters, 1)}
    for states in queue:
        # Letters that follow no node of the state lead where a strange one does.
        row = np.full(len(letters) + 1, numbered(after(states, None)), np.int32)
        near = {c for node, _ in states if node >= 0 for c in trie[node]}
        for c in sorted(near):
            row[place[c]] = numbered(after(states, c))
        rows.append(row)
    term, distance = np.full(len(queue), -1, np.int32), np.zeros(len(queue), np.int32)
    for k, states in enumerate(queue):
        # The fewest edits, then the whole word, then the heavier term.
        ends = [(e, 0, -weights[word_at[n]], word_at[n]) for n, e in states if n in word_at and (e == 0 or loose[word_at[n]])]
        ends += [(e, 1, 0.0, ~n) for n, e in states if n < 0]
        if ends:
            distance[k], _, _, term[k] = min(ends)
    return Automaton(class_of, np.stack(rows), term, distance)


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 bytes, and for each byte the number of the code point it belongs to."""
    lead = (data & 0xC0) != 0x80
    first, wide = np.flatnonzero(lead), np.r_[data, np.zeros(3, np.uint8)].astype(np.int32)
    made = wide[first]
    for size, low in ((2, 0xC0), (3, 0xE0), (4, 0xF0)):
        mine = np.flatnonzero((data[first] >= low) & (data[first] < low + (256 - low) // 2))
        value = wide[first[mine]] & (0x7F >> size)
        for k in range(1, size):
            value = value << 6 | wide[first[mine] + k] & 0x3F
        made[mine] = value
    return made, np.cumsum(lead) - 1


_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


#: Bytes whose words are looked up at once, about.
_STRETCH = 2_000_000


def find_terms(machine: Automaton, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start, end, term, distance) of the words of lower-case texts that the automaton accepts."""
    cuts = [0]
    while len(data) - cuts[-1] > 2 * _STRETCH:
        # A long text is cut where a word ends, or, in a very long word, goes on whole.
        free = np.flatnonzero(~_IN_WORD[data[cuts[-1] + _STRETCH : cuts[-1] + 2 * _STRETCH]])
        cuts.append(cuts[-1] + _STRETCH + int(free[0]) if len(free) else len(data))
    parts = []
    for a, b in zip(cuts, [*cuts[1:], len(data)], strict=True):
        inner = offsets[(offsets > a) & (offsets < b)]
        _, start, end, term, distance = _terms_of(machine, data[a:b], np.r_[0, inner - a, b - a])
        parts.append((np.searchsorted(offsets, start + a, side="right") - 1, start + a, end + a, term, distance))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _terms_of(machine: Automaton, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    none = np.zeros(0, np.int64)
    if not len(data):
        return none, none, none, none, none
    inside = _IN_WORD[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside & (np.r_[True, ~inside[:-1]] | first[:-1]))
    ends = np.flatnonzero(inside & (np.r_[~inside[1:], True] | first[1:])) + 1
    points, number = code_points(data)
    cls = machine.class_of[np.minimum(points, len(machine.class_of) - 1)]
    live, at, stop, state = np.arange(len(starts)), number[starts], number[ends - 1] + 1, np.ones(len(starts), np.int32)
    hits, states = [], []
    while len(live):
        state = machine.step[state, cls[at]]
        at = at + 1
        over = at == stop[live]
        good = over & (machine.term[state] >= 0)
        hits.append(live[good])
        states.append(state[good])
        going = ~over & (state != 0)
        live, at, state = live[going], at[going], state[going]
    hit, end_state = np.concatenate(hits), np.concatenate(states)
    order = np.argsort(hit, kind="stable")
    hit, end_state = hit[order], end_state[order]
    return np.searchsorted(offsets, starts[hit], side="right") - 1, starts[hit], ends[hit], machine.term[end_state], machine.distance[end_state]


def quoted(before: str, after: str) -> bool:
    """Whether the window shows quotation or talk about the word."""
    opened = any(before.count(q) % 2 and q in after for q in "\"`") or bool(re.search(r"[“„«‘]\s*[^”»’]*$", before) and re.search(r"[”»’“]", after))
    close = before.rstrip()[-1:] in _QUOTES and after.lstrip()[:1] in _QUOTES if before.strip() and after.strip() else False
    return opened or close or any(w in _REPORTING for w in _WORD.findall(before)[-4:])


def hit_sums(lexicon: Lexicon, machine: Automaton, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each lower-case text: the weights of its hits in context, summed, and its words."""
    weights, sizes = [*lexicon.words.values(), *lexicon.stems.values()], [len(t) for t in lexicon.terms()]
    sums = np.zeros(len(offsets) - 1)
    seen: set[tuple[int, bytes]] = set()
    for row, a, b, term, distance in zip(*find_terms(machine, data, offsets), strict=True):
        weight = weights[term]
        if distance:
            word = data[a:b].tobytes().decode(errors="replace")
            if word in lexicon.innocent or (term >= len(lexicon.words) and word[: sizes[term]] in lexicon.innocent):
                continue
            weight *= lexicon.fuzzy_share
        before = data[max(offsets[row], a - _WINDOW) : a].tobytes().decode(errors="ignore")
        after = data[b : min(offsets[row + 1], b + _WINDOW)].tobytes().decode(errors="ignore")
        if quoted(before, after):
            weight *= lexicon.quoted_share
        elif (key := (row, data[a:b].tobytes())) in seen:
            weight *= 0.25
        else:
            seen.add(key)
        sums[row] += weight
    return sums, np.bincount(word_spans(data, offsets)[2], minlength=len(sums)).astype(float)


def text_scores(lexicon: Lexicon, machine: Automaton, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Scores of lower-case texts, between 0 and 1."""
    sums, words = hit_sums(lexicon, machine, data, offsets)
    logit = lexicon.bias + sums * (lexicon.slope + lexicon.slope_long * np.log1p(words))
    return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def _calibrate(sums: np.ndarray, words: np.ndarray, labels: np.ndarray, ridge: float = 0.1) -> tuple[float, float, float]:
    """Logistic regression of the label on the sum and the sum by length, by Newton steps."""
    x = np.column_stack([np.ones(len(sums)), sums / 8, sums * np.log1p(words) / 50])
    beta = np.array([-3.0, 1.0, 0.0])
    penalty = ridge * np.diag([0.1, 1.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + penalty, x.T @ (labels - p) - penalty @ beta)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(beta[0]), float(beta[1] / 8), float(beta[2] / 50)


def _lowered(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return text_bytes(pa.array([t.lower() for t in col.to_pylist()], pa.string()))


_TERMS = pa.schema([("word", pa.string()), ("n0", pa.int64()), ("n1", pa.int64())])
_COVER = pa.schema([("near", pa.string()), ("terms", pa.list_(pa.string()))])
_SUMS = pa.schema([("s", pa.float64()), ("w", pa.float64()), ("label", pa.int32())])


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            counts[label].update(set(_WORD.findall(text.lower())))
        if len(counts[0]) + len(counts[1]) > 500_000:
            yield _counted(counts)
            counts = (Counter(), Counter())
    yield _counted(counts)


def _counted(counts: tuple[Counter, Counter]) -> pa.RecordBatch:
    words = list(counts[0].keys() | counts[1].keys())
    return batch_of(_TERMS, words, [counts[0][w] for w in words], [counts[1][w] for w in words])


def _cover(candidates: list[str], docs: list[list[str]], least: int, times: int = 3) -> list[str]:
    """Greedy cover: the term in most texts not yet explained, until each is explained ``times`` times.

    Words that only accompany the real terms get nothing of their own.
    """
    holders = defaultdict(set)
    for k, terms in enumerate(docs):
        for t in terms:
            holders[t].add(k)
    chosen, need = [], [times] * len(docs)
    # Of terms in as many texts the longest, then the last by name. What a term still explains only
    # falls, so it is counted anew when its turn comes.
    order = {t: k for k, t in enumerate(sorted(candidates, key=lambda t: (len(t), t), reverse=True))}
    heap = [(-len(holders[t]), k, t) for t, k in order.items() if len(holders.get(t, ())) >= least]
    heapq.heapify(heap)
    while heap:
        known, k, t = heapq.heappop(heap)
        open_ = [d for d in holders[t] if need[d] > 0]
        if len(open_) == -known:
            chosen.append(t)
            for d in open_:
                need[d] -= 1
        elif len(open_) >= least:
            heapq.heappush(heap, (-len(open_), k, t))
    return chosen


def learn_lexicon(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, least: int = 5, most: float = 0.15) -> Lexicon:
    """A lexicon from at most ``max_labelled`` labelled rows of each class, picked by a hash of the id.

    A term must be in ``least`` toxic texts that no better term explains and occur in the
    others at no more than ``most`` of its share. Near copies among the toxic texts (the same four
    least word hashes) count once. Without toxic rows the lexicon is empty.
    """
    known = training_labels(labels, "toxic")
    sample = None
    for label in (0, 1):
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
        sample = part if sample is None else sample.union(part)
    # Bounded by 2 * max_labelled rows of two numbers.
    rows = documents(docs).join(F.broadcast(sample), "doc_id").select("text", "label").distinct()
    rows = rows.persist()
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n1:
        return Lexicon(bias=-3.0)
    counts = rows.mapInArrow(_term_counts, spark_schema(_TERMS)).groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).persist()
    rare = F.col("n0") * n1 <= F.col("n1") * n0 * most
    words = counts.where((F.col("n1") >= least) & (F.length("word") >= 3) & rare)
    stems = counts.where(F.length("word") >= STEM.start).select(F.explode(F.sequence(F.lit(STEM.start), F.least(F.lit(STEM.stop - 1), F.length("word")))).alias("size"), "word", "n0", "n1")
    stems = stems.groupBy(F.substring("word", 1, F.col("size")).alias("word")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.count("*").alias("forms")).where((F.col("n1") >= 4 * least) & (F.col("forms") >= 4) & rare)
    # Bounded by the sample: words that ``least`` of its toxic texts have.
    word_n = {r.word: (r.n0, r.n1) for r in words.collect()}
    stem_n = {r.word: (r.n0, r.n1) for r in stems.collect()}
    # Of the stems of one growth, the longest that still has nearly all of it.
    most_of = defaultdict(int)
    for t, m in stem_n.items():
        for size in range(STEM.start, len(t)):
            most_of[t[:size]] = max(most_of[t[:size]], m[1])
    stem_n = {s: n for s, n in stem_n.items() if most_of[s] < 0.95 * n[1]}

    def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, near = [], []
            for text in batch.column("text").to_pylist():
                mine, words = set(), set(_WORD.findall(text.lower()))
                near.append(repr(sorted(zlib.crc32(w.encode()) for w in words)[:4]))
                for w in words:
                    if w in word_n:
                        mine.add(w)
                    mine.update(f"{w[:k]}*" for k in STEM if w[:k] in stem_n and len(w) >= k)
                found.append(sorted(mine))
            yield batch_of(_COVER, near, found)

    covers = list({r.near: r.terms for r in rows.where("label = 1").select("text").mapInArrow(terms_of, spark_schema(_COVER)).collect()}.values())
    chosen = _cover([*word_n, *(f"{s}*" for s in stem_n)], covers, least)
    weight = lambda a, b: float(np.clip(np.log((b + 0.5) / (n1 + 1)) - np.log((a + 0.5) / (n0 + 1)), 0.5, 9.0))
    found = Lexicon({w: weight(*word_n[w]) for w in chosen if w[-1] != "*"}, {w[:-1]: weight(*stem_n[w[:-1]]) for w in chosen if w[-1] == "*"})
    # A word says no more than its stem, unless its own evidence is the stronger.
    found.words = {w: v for w, v in found.words.items() if not any(w.startswith(s) and u >= v for s, u in found.stems.items())}
    # Words of clean texts that are one edit from a term are words of their own, no misspellings.
    machine = compile_lexicon(found, fuzzy_stems=True)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = batch.column("word").to_pylist()
            row, _, _, term, distance = find_terms(machine, *text_bytes(batch.column("word").cast(pa.string())))
            # Beside a stem any ending may follow the innocent word's beginning, as it may the stem.
            sizes = [*(None for _ in found.words), *map(len, found.stems)]
            picked = [keep[r][: sizes[t]] for r, t in zip(row[distance > 0], term[distance > 0], strict=True)]
            yield batch_of(pa.schema([("word", pa.string())]), picked)

    near = counts.where("n0 > 0").select("word").mapInArrow(neighbours, "word string").distinct()
    found.innocent = frozenset(r.word for r in near.collect())

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch_of(_SUMS, *hit_sums(found, machine, *_lowered(batch.column("text"))), batch.column("label"))

    seen = rows.mapInArrow(sums, spark_schema(_SUMS)).toPandas()
    found.bias, found.slope, found.slope_long = _calibrate(seen.s.to_numpy(), seen.w.to_numpy(), seen.label.to_numpy())
    counts.unpersist()
    rows.unpersist()
    return found


_SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score_column(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score) of every row."""
    machine = compile_lexicon(lexicon, fuzzy_stems=True)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch_of(_SCORES, batch.column("doc_id"), text_scores(lexicon, machine, *_lowered(batch.column("text"))))

    return documents(docs).mapInArrow(score, spark_schema(_SCORES))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``, from its whole text alone.

    Null and empty texts have no hits and get the bias's score; repeated rows are scored alike,
    an empty table gives no rows, other columns are ignored.
    """
    tune(docs.sparkSession)
    scored = score_column(docs, learn_lexicon(docs, labels, max_labelled))
    return scored.select(id_back(), (id_remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast(T.IntegerType()).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``threshold``: a filter where the rows are, no join."""
    tune(docs.sparkSession)
    lexicon = learn_lexicon(docs, labels, max_labelled)
    machine = compile_lexicon(lexicon, fuzzy_stems=True)

    @F.pandas_udf(T.DoubleType())
    def score(texts):
        import pandas as pd

        return pd.Series(text_scores(lexicon, machine, *_lowered(pa.array(texts.fillna(""), pa.string()))))

    return docs.where(score(F.col("text")) < threshold)
