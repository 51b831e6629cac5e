"""Operators that need the whole table: against brute force on small fixtures."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import components as cc
from lodestar.llm import line_dedup, lm_score, ngram_join
from lodestar.llm.queries import QUERIES, SQL, op1_line_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = " \t\n\x0b\x0c\r"
ODD = [(1, ""), (2, None), (None, "a b c"), (3, "a b c"), (3, "a b c"), (4, " \n\t "), (5, "é世\U0001f600" * 700), (6, "x" * 70_000), (7, "word " * 20_000)]


def docs(spark, rows, parts=3):
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return d.withColumns({c: F.lit("clash") for c in ("k", "h", "keep", "__keep", "n_lines", "rep", "component_id", "__gone")}).withColumn("n_chars", F.length("text").cast("long"))


def brute_lines(rows):
    found = defaultdict(set)
    key = lambda line: line.strip(BLANK).translate(LOWER)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                found[key(line)].add(-(2**63) if i is None else i)
    out = []
    for i, t in rows:
        me, lines = -(2**63) if i is None else i, (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 20 and len(found[key(x)]) >= 3 and max(found[key(x)]) != me)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def lines_fixture():
    rnd = random.Random(6)
    pool = [f"This is line number {k} of the pool" for k in range(12)] + ["short", "", "é" * 20, "é" * 19 + " ", "\tTHIS is line number 1 of the pool \r"]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(1, 9)))) for i in range(120)]
    # One line nearly everywhere, to span partitions; texts under one id; repeated rows.
    rows = [(i, f"{t}\nA very common line that all have") if i % 5 else (i, t) for i, t in rows]
    return [*rows, *rows[:3], (7, "This is line number 2 of the pool"), *ODD]


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_line_dedup(spark, parts):
    rows = lines_fixture()
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = [tuple(r) for r in line_dedup.dedup_digests(docs(spark, rows)).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert sorted(got, key=repr) == sorted(brute_lines(rows), key=repr)


def test_line_dedup_texts(spark):
    rows = lines_fixture()
    d = docs(spark, rows)
    out = line_dedup.dedup_lines(d)
    assert out.columns == d.columns
    got = Counter((r.doc_id, None if r.text is None else hashlib.sha256(r.text.encode()).hexdigest()) for r in out.collect())
    assert got == Counter((i, None if t is None else h) for (i, t), (_, _, _, h) in zip(rows, brute_lines(rows), strict=True))
    assert out.where("n_chars <> length(text)").count() == 0
    assert line_dedup.dedup_digests(docs(spark, [])).count() == 0 and line_dedup.dedup_lines(docs(spark, [])).count() == 0


def brute_components(rows, words=5):
    sets, node = [], []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append(frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else []))
        node.append(-(2**63) if i is None else i)
    up = {n: n for n in node}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(node[a]), find(node[b])
                up[max(p, q)] = min(p, q)
    return {(i, len(s), None if find(n) == -(2**63) else find(n)) for (i, _), s, n in zip(rows, sets, node, strict=True)}


def copies_fixture():
    rnd = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    rows, at = [], 0
    for _ in range(25):
        text = [rnd.choice(words) for _ in range(rnd.randint(3, 90))]
        for _ in range(rnd.choice([1, 1, 2, 5])):
            copy = list(text)
            for _ in range(rnd.choice([0, 0, 1, 2, 3])):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append((at, " ".join(copy).title() if rnd.random() < 0.3 else "  ".join(copy)))
            at += 1
    # A chain that drifts, a large group of near copies, a passage that many share.
    chain = [rnd.choice(words) for _ in range(60)]
    for _ in range(30):
        rows.append((at, " ".join(chain)))
        at += 1
        chain = [*chain[3:], *(rnd.choice(words) for _ in range(3))]
    large, passage = [rnd.choice(words) for _ in range(50)], " ".join(rnd.choice(words) for _ in range(30))
    for _ in range(60):
        copy = list(large)
        copy[rnd.randrange(50)] = rnd.choice(words)
        rows.append((at, " ".join(copy)))
        rows.append((at + 1, passage + " " + " ".join(rnd.choice(words) for _ in range(rnd.randint(5, 60)))))
        at += 2
    rnd.shuffle(rows)
    return [*rows, (rows[0][0], rows[5][1]), rows[1], *ODD]


@pytest.mark.parametrize("tile", [1024, 7])
def test_ngram_components(spark, monkeypatch, tile):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    rows = copies_fixture()
    got = {tuple(r) for r in ngram_join.jaccard_components(docs(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_drop_near_copies(spark):
    rows = copies_fixture()
    d = docs(spark, rows)
    out = ngram_join.drop_near_copies(d)
    stay = {i for i, _, c in brute_components(rows) if i == c} | {None}
    gone = {i for i, _, c in brute_components(rows) if c is None or (i is not None and c < i)} - {None}
    assert out.columns == d.columns and {r.doc_id for r in out.collect()} == (stay | {i for i, _ in rows}) - gone
    assert ngram_join.jaccard_components(docs(spark, [])).count() == 0 and ngram_join.drop_near_copies(docs(spark, [])).count() == 0


def test_links_within_is_exact():
    rnd = np.random.default_rng(1)
    pool = rnd.integers(0, 2**63, 60, dtype=np.uint64)
    sets = [np.unique(rnd.choice(pool, rnd.integers(1, 50))) for _ in range(80)]
    up = list(range(80))
    for a in range(80):
        for b in range(a):
            shared = len(np.intersect1d(sets[a], sets[b]))
            if 100 * shared >= 60 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = up[a], up[b]
                up = [min(x, y) if u in (x, y) else u for u in up]
    labels = list(range(80))
    for a, b in ngram_join.links_within(sets, np.arange(80), None, 60):
        x, y = labels[a], labels[b]
        labels = [min(x, y) if u in (x, y) else u for u in labels]
    assert labels == up


@pytest.mark.parametrize("block", [10**6, 20])
def test_components(spark, block):
    rnd = random.Random(2)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(130)] + [(k, k + 1) for k in range(300, 340)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {tuple(r) for r in cc.components(spark.createDataFrame(edges, "a long, b long"), block=block).collect()}
    assert got == {(x, find(x)) for e in edges if e[0] != e[1] for x in e}
    assert cc.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_gru_gradients():
    net = lm_score.Gru()
    for k in net.w:
        net.w[k] = net.w[k].astype(np.float64)
    rng = np.random.default_rng(0)
    net.w["out"] += rng.normal(size=net.w["out"].shape) * 0.2
    window, fresh = rng.integers(0, lm_score.CLASSES, (3, 5)), np.zeros((3, 5), bool)
    window[1, 3:], fresh[2, 2] = -1, True

    def run():
        net.prepare()
        return net.gradients(np.zeros((3, lm_score.HIDDEN)), np.full(3, lm_score.CLASSES), window, fresh)

    grad = run()[0]
    for k, w in net.w.items():
        for _ in range(3):
            i = tuple(int(rng.integers(0, s)) for s in w.shape)
            i = (int(window[0, 0]), i[1]) if k == "embed" else i
            old, losses = w[i], []
            for e in (1e-5, -1e-5):
                w[i] = old + e
                losses.append(run()[3])
            w[i] = old
            assert abs((losses[0] - losses[1]) / 2e-5 - grad[k][i]) < 1e-6


def test_class_likelihood_carries_the_state():
    net = lm_score.Gru(seed=3)
    net.w["out"] += np.random.default_rng(1).normal(size=net.w["out"].shape).astype(np.float32)
    streams = [np.random.default_rng(k).integers(0, lm_score.CLASSES, n) for k, n in enumerate((1, 7, 400, 3))]
    got = lm_score.class_log_likelihood(net, np.concatenate(streams), np.repeat(np.arange(4), [len(s) for s in streams]), 4)
    for s, value in zip(streams, got, strict=True):
        h, last, total = np.zeros((1, lm_score.HIDDEN), np.float32), np.array([lm_score.CLASSES]), 0.0
        for c in s:
            h, _ = net.step(h, last)
            total += float(net.log_probs(h)[0, c])
            last = np.array([c])
        assert abs(total - value) < 1e-2


def test_lm_scores(spark):
    rnd = random.Random(3)
    words = {0: "river stone apple window".split(), 1: "maison porte fenêtre jardin".split()}
    rows = [(i, " ".join(rnd.choice(words[i % 2]).title() if rnd.random() < 0.2 else rnd.choice(words[i % 2]) for _ in range(rnd.randint(5, 60)))) for i in range(150)] + ODD
    got = lm_score.lm_scores(docs(spark, rows)).collect()
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + ["\0"] for _, t in rows]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i, _ in rows]
    counts = Counter(w for h, ts in zip(held, tokens, strict=True) if not h for w in ts)
    n, v = sum(counts.values()), len(counts)
    base = lambda ts: sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ts)
    expected = sorted((repr(i), h, len(ts), sum(counts[w] > 0 for w in ts), n, round(base(ts), 4)) for (i, _), h, ts in zip(rows, held, tokens, strict=True))
    assert sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == expected
    once = sorted((repr(i), sum(counts[w] == 1 for w in ts)) for (i, _), ts in zip(rows, tokens, strict=True))
    assert sorted((repr(r.doc_id), r.n_once) for r in got) == once and all(abs(r.score_per_token * r.n_tokens - r.score) < 1e-6 * abs(r.score) + 1e-9 for r in got)
    prose = [r for r in got if r.doc_id is not None and r.held_out and r.doc_id >= 8]
    assert prose and sum(r.score for r in prose) > sum(r.base_score for r in prose)
    # Whatever tasks know by themselves, all words or none or some, the sums are the same.
    for known in (0, 3):
        again = lm_score.lm_scores(docs(spark, rows), frequent=known).collect()
        assert sorted((repr(r.doc_id), r.n_once) for r in again) == once
        assert sorted((repr(r.doc_id), r.n_known, round(r.base_score, 4)) for r in again) == sorted((repr(r.doc_id), r.n_known, round(r.base_score, 4)) for r in got)
    assert lm_score.lm_scores(docs(spark, [])).count() == 0


def test_words_are_counted_across_flushes(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "_HOLD_WORDS", 20)
    rnd = random.Random(9)
    rows = [(i, " ".join(f"w{rnd.randrange(40)}" for _ in range(30))) for i in range(2500)]
    counted = lm_score.word_counts(docs(spark, rows).select("text")).collect()
    got = Counter({h: n for r in counted for h, n in zip(np.frombuffer(r.h, np.uint64).tolist(), np.frombuffer(r.n, np.int64).tolist(), strict=True)})
    assert sorted(got.values()) == sorted([*Counter(w for _, t in rows for w in t.split()).values(), len(rows)])


def test_every_training_document_reaches_the_network(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice("river stone apple window maison jardin".split()) for _ in range(300))) for i in range(6)]
    fit = lambda rows: lm_score.fit_network(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), np.zeros(lm_score.CLASSES)).w["ob"]
    whole = fit(rows)
    assert all(not np.array_equal(whole, fit([r for r in rows if r != one])) for one in rows)


def test_queries_and_sql_agree_on_names():
    assert set(SQL) <= set(QUERIES) and [int(k[2:].split("_")[0]) for k in QUERIES] == list(range(1, 11)) and QUERIES["op1_line_dedup"] is op1_line_dedup


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(1)
    words = "river stone apple window quiet garden letter simple morning paper cloud bridge".split()
    prose = lambda n=40: " ".join(rnd.choice(words) + str(rnd.randrange(50)) for _ in range(n))
    item = "the benchmark asks how many rivers run slowly to the sea and carry small stones and silver sand"
    rows = [(i, prose()) for i in range(80)]
    toxic = [(100 + i, f"{prose(20)} nitwit {prose(5)} grumblefuss {prose(10)}") for i in range(40)]
    copy = prose(60)
    rows += [*toxic, (200, copy), (201, copy), (202, copy + " more"), (210, f"{prose(9)} {item} {prose(9)}"), (220, None), (221, "")]
    rows += [(230 + k, f"{prose(20)}\nThis footer line is in all of these") for k in range(4)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(100 <= i < 140)) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d, ids = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, str(tmp_path))
        assert out.columns == d.columns
        out.write.parquet(f"{tmp_path}/{name}")
        d = spark.read.parquet(f"{tmp_path}/{name}")
        ids[name] = {r.doc_id for r in d.select("doc_id").collect()}
    every = {i for i, _ in rows}
    assert ids["toxicity"] == every - {i for i, _ in toxic} == ids["line_dedup"]
    assert spark.read.parquet(f"{tmp_path}/line_dedup").where("text LIKE '%footer%'").select("doc_id").collect()[0][0] == 233
    assert ids["near_duplicates"] == ids["line_dedup"] - {201, 202} and ids["decontamination"] == ids["near_duplicates"] - {210}
    packed = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct()
    assert {r.doc_id for r in packed.collect()} == ids["decontamination"]
