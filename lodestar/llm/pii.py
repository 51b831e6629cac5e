"""Personal data by weak supervision.

Four exact patterns give the base spans. Beyond them, labelers of three sorts vote on every
candidate: regular expressions, a gazetteer of domain and field words, and context words before
it. Candidates are tokens of six signs or more with a digit, an @ or a secret's shape, and whatever
is assigned to a word for a secret (``password: ...``, ``token = ...``). The votes of the whole corpus are counted
by pattern (3**labelers at most, so a small table whatever the input), expectation-maximisation
estimates each labeler's reliability from those counts, and a logistic span classifier is fitted
to the resulting posteriors over features of the same bounded table. A candidate that the
classifier accepts becomes a span of its own kind, unless it overlaps a base span.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import batch_of, documents, id_back, spark_schema, tune

KINDS = ("email", "ip", "card", "phone")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HAS_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As ``_EMAIL.finditer``, looking only around each @: a run of other text costs nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _EMAIL.match(text, start)):
            yield m.span()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the four exact patterns, by start and then kind."""
    found = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    if _HAS_DIGIT.search(text):
        found += [(*m.span(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), "card"))
        if "+" in text:
            found += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


#: Candidates beyond the base: a run of signs that holds a digit or an @ ...
_CANDIDATE = re.compile(r"[^\s\"'<>()|=,;:]*[0-9@][^\s\"'<>()|=,;:]*")
#: ... or is made of letters, but has a secret's shape or is assigned to a word for one.
_LETTERS = re.compile(
    r"\b(?:[A-Fa-f]{32,64}|(?:sk|pk|ghp|gho|AKIA|xox[bp])[-_]?[A-Za-z]{12,})\b"
    r"|\b(?i:token|secret|password|passwd|pwd|apikey|bearer)[\"']?[\x20\t]*[:=][\x20\t]*[\"']?(?P<value>[^\s\"'<>()|=,;:]{6,})"
)
#: Which texts may have one of ``_LETTERS``, for a whole column at once.
_MAYBE_LETTERS = r"\b(?:[A-Fa-f]{32}|(?:sk|pk|ghp|gho|AKIA|xox[bp])[-_]?[A-Za-z]{12})|\b(?i:token|secret|password|passwd|pwd|apikey|bearer)[\"']?[\x20\t]*[:=]"
# Words that stand before or inside personal data.
_FIELDS = frozenset("token key secret password passwd pwd api apikey auth bearer".split())
_CONTEXT = frozenset("token key secret password passwd pwd api auth bearer mail email e-mail phone tel telephone mobile card account iban ssn passport id ip".split())
_DOMAINS = frozenset("com org net edu gov io de fr es uk eu info biz example".split())

_HEX = re.compile(r"[0-9a-fA-F]{32,64}$")
_KEYISH = re.compile(r"(sk|pk|ghp|gho|AKIA|xox[bp])[-_]?[A-Za-z0-9]{12,}$")
_NUMBERISH = re.compile(r"[0-9]{9,19}$|[0-9]{3}-[0-9]{2}-[0-9]{4}$|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$")
_MAILISH = re.compile(r"[^@]+@[^@]+$")
LABELERS = ("secret_shape", "number_shape", "mail_shape", "field_before", "context_before", "domain_word", "long_digits")
#: What a labeler's reliability starts from: the share of true and of other candidates it votes for.
_START = np.array([[0.7, 0.05]] * len(LABELERS))


def texts_and_hints(batch: pa.RecordBatch) -> Iterator[tuple[str, bool]]:
    """The texts, and whether each may have a candidate of letters only."""
    col = batch.column("text")
    return zip(col.to_pylist(), pc.match_substring_regex(col, _MAYBE_LETTERS).to_pylist(), strict=True)


def candidates(text: str, base: list[tuple[int, int, str]], letters_too: bool = True) -> Iterator[tuple[int, int, tuple[int, ...]]]:
    """(start, end, votes): a vote is 1 (personal), 0 (not) or 2 (no opinion)."""
    taken, k = base, 0
    found = [m.span() for m in _CANDIDATE.finditer(text)] if "@" in text or _HAS_DIGIT.search(text) else []
    if letters_too:
        letters = [m.span("value") if m["value"] else m.span() for m in _LETTERS.finditer(text)]
        found = sorted(found + [s for s in letters if not _CANDIDATE.search(text, *s)])
    for start, end in found:
        token = text[start:end].rstrip(".!?*$&%#")
        end = start + len(token)
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if len(token) < 6 or any(a < end and start < b for a, b, _ in taken[max(0, k - 3) : k + 4]):
            continue
        before = re.findall(r"[A-Za-z-]+", text[max(0, start - 24) : start].lower())
        digits = sum(c.isdigit() for c in token)
        near = before[-1] if before else ""
        tail = re.split(r"[.@]", token.lower())[-1]
        yield (
            start,
            end,
            (
                int(bool(_HEX.match(token) or _KEYISH.match(token))),
                int(bool(_NUMBERISH.match(token))),
                int(bool(_MAILISH.match(token))) if "@" in token else 2,
                int(near in _FIELDS) if before else 2,
                int(any(w in _CONTEXT for w in before[-3:])) if before else 2,
                int(tail in _DOMAINS) if "@" in token or "." in token else 2,
                int(digits >= 9),
            ),
        )


_VOTES = pa.schema([("pattern", pa.string()), ("n", pa.int64())])


def vote_counts(docs: DataFrame) -> dict[str, int]:
    """How often each pattern of votes occurs over all documents: at most 3**labelers rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, int] = {}
        for batch in batches:
            for text, letters in texts_and_hints(batch):
                for *_, votes in candidates(text, base_spans(text), letters):
                    key = "".join(map(str, votes))
                    found[key] = found.get(key, 0) + 1
        yield batch_of(_VOTES, list(found), list(found.values()))

    rows = docs.select("text").mapInArrow(count, spark_schema(_VOTES)).groupBy("pattern").agg(F.sum("n").alias("n"))
    return {r.pattern: int(r.n) for r in rows.collect()}


def reliabilities(counts: dict[str, int], rounds: int = 60) -> tuple[np.ndarray, float, np.ndarray]:
    """Expectation-maximisation on counted vote patterns: (P(vote | class), prior, posteriors)."""
    patterns = np.array([[int(c) for c in p] for p in sorted(counts)]).reshape(-1, len(LABELERS))
    n = np.array([counts[p] for p in sorted(counts)], float)
    rate, prior = _START.copy(), 0.2
    cast, yes = patterns != 2, patterns == 1
    post = np.zeros(len(n))
    for _ in range(rounds if len(n) else 0):
        log = [np.where(cast, np.where(yes, np.log(rate[:, c]), np.log1p(-rate[:, c])), 0).sum(1) for c in (0, 1)]
        odds = log[0] - log[1] + np.log(prior / (1 - prior))
        post = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        prior = float(np.clip((n * post).sum() / n.sum(), 1e-4, 1 - 1e-4))
        for c, weight in ((0, n * post), (1, n * (1 - post))):
            rate[:, c] = np.clip(((yes.T * weight).sum(1) + _START[:, c] * 2) / ((cast.T * weight).sum(1) + 2), 1e-3, 1 - 1e-3)
    return rate, prior, post


def _features(votes: np.ndarray) -> np.ndarray:
    one = (votes == 1).astype(float)
    pairs = [one[:, i] * one[:, j] for i in range(len(LABELERS)) for j in range(i)]
    return np.column_stack([np.ones(len(votes)), one, (votes == 2).astype(float), *pairs])


def fit_classifier(counts: dict[str, int], rounds: int = 200) -> np.ndarray:
    """Weights of a logistic span classifier, fitted to the posteriors of ``reliabilities``."""
    width = 1 + 2 * len(LABELERS) + len(LABELERS) * (len(LABELERS) - 1) // 2
    weights = np.zeros(width)
    if not counts:
        weights[0] = -10.0
        return weights
    *_, post = reliabilities(counts)
    x = _features(np.array([[int(c) for c in p] for p in sorted(counts)]))
    n = np.log1p(np.array([counts[p] for p in sorted(counts)], float))
    n /= n.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        hessian = (x.T * (n * p * (1 - p) + 1e-9)) @ x + 1e-4 * np.eye(width)
        step = np.linalg.solve(hessian, x.T @ (n * (post - p)) - 1e-4 * weights)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def accepted(weights: np.ndarray, threshold: float = 0.5) -> dict[str, bool]:
    """The classifier's answer for each of the vote patterns."""
    from itertools import product

    all_ = np.array(list(product(range(3), repeat=len(LABELERS))))
    p = 1 / (1 + np.exp(-np.clip(_features(all_) @ weights, -30, 30)))
    return {"".join(map(str, v)): bool(y) for v, y in zip(all_.tolist(), p > threshold, strict=True)}


def extra_kind(votes: tuple[int, ...]) -> str:
    return "contact" if votes[2] == 1 else "secret" if votes[0] == 1 or votes[3] == 1 else "number"


def all_spans(text: str, answers: dict[str, bool], letters_too: bool = True) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and base and added spans, each by start and kind."""
    base = base_spans(text)
    added = [(a, b, extra_kind(v)) for a, b, v in candidates(text, base, letters_too) if answers.get("".join(map(str, v)), False)]
    order = {k: i for i, k in enumerate((*KINDS, "contact", "secret", "number"))}
    return base, sorted(base + added, key=lambda s: (s[0], order[s[2]]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


_SPANS = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_spans", pa.int64())])


def find_pii(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans) of every row of ``docs``.

    Offsets count code points, ends exclusive. Null and empty texts have no spans (the hash is
    that of the empty string); repeated rows are answered alike, an empty table gives no rows,
    other columns are ignored. The reliabilities come from the votes on all rows of ``docs``.
    """
    tune(docs.sparkSession)
    texts = documents(docs)
    answers = accepted(fit_classifier(vote_counts(texts)), threshold)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [all_spans(t, answers, letters) for t, letters in texts_and_hints(batch)]
            yield batch_of(
                _SPANS,
                batch.column("doc_id"),
                *([sum(s[2] == k for s in base) for base, _ in rows] for k in KINDS),
                [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in rows],
                [joined(every) for _, every in rows],
                [len(every) for _, every in rows],
            )

    return texts.mapInArrow(find, spark_schema(_SPANS)).withColumn("doc_id", id_back())
