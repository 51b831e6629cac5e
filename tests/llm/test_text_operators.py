"""Operators that see one document at a time: against brute force, round trips, or held-out labels."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.llm import decontam, media_gif, packing, pii, quality, token_counts, toxicity
from lodestar.llm.common import text_bytes
from lodestar.llm.queries import tokenizer_path

ODD = [(1, ""), (2, None), (None, "a b c"), (3, "a b c"), (3, "a b c"), (4, " \n\t "), (5, "é世\U0001f600" * 700), (6, "x" * 70_000), (7, "word " * 20_000)]


def docs(spark, rows=ODD):
    """With extra columns whose names clash with those the operators make."""
    d = spark.createDataFrame(rows, "doc_id long, text string")
    return d.withColumns({c: F.lit("clash") for c in ("k", "h", "score", "n_lines", "keep", "label", "spans", "n_tokens", "__keep")})


@pytest.fixture(scope="module")
def sp():
    return token_counts.stable_model(tokenizer_path("piece_bpe_32k.model"))


def test_token_counts_splice(sp):
    rnd = random.Random(4)
    parts = ["a", "the ", " ", "  ", "\n", "é", "世", "<s>", "▁", "ing", "x" * 60, "\U0001f600"]
    for _ in range(25):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 200)))
        assert all(token_counts.count_tokens(sp, text, c, o) == len(sp.encode(text)) for c, o in ((50, 4), (200, 16)))
    # Without spaces, pairs of characters that no piece has side by side are as good.
    parts = ["a", "the", "ing", "\n", "é", "世", "界", "9", "Q", "xq", "\u3000", "\U0001f600"]
    for _ in range(25):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 200)))
        assert all(token_counts.count_tokens(sp, text, c, o) == len(sp.encode(text)) for c, o in ((40, 4), (150, 16)))


def test_token_counts_rows(spark, sp):
    path = tokenizer_path("piece_bpe_32k.model")
    got = token_counts.token_counts(docs(spark), path, limit=100, chunk=4096).collect()
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted((len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 100) for _, t in ODD)
    assert token_counts.token_counts(docs(spark, []), path).count() == 0


def test_lzw_round_trip():
    rnd = random.Random(1)
    for n in (1, 2, 300, 5000, 30_000):
        for alphabet in ([65], [65, 66], range(256)):
            data = bytes(rnd.choice(list(alphabet)) for _ in range(n))
            assert media_gif.lzw_decode(media_gif.lzw_encode(data), 8, n).tobytes() == data


def gif(frames, size=(2, 2), palette=((0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255))):
    """A small GIF by hand: frames (x, y, w, h, indexes, delay, disposal, transparent or None, interlaced)."""
    out = b"GIF89a" + bytes([size[0], 0, size[1], 0, 0x81, 0, 0]) + bytes(c for p in palette for c in p)
    for x, y, w, h, index, delay, disposal, clear, laced in frames:
        out += b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None), delay, 0, clear or 0, 0])
        stream = media_gif.lzw_encode(bytes(index), 2)
        out += b"\x2c" + bytes([x, 0, y, 0, w, 0, h, 0, 0x40 if laced else 0, 2, len(stream)]) + stream + b"\0"
    return out + b";"


def test_gif_disposal_transparency_and_interlace():
    data = gif([(0, 0, 2, 2, [1, 1, 1, 1], 5, 1, None, False), (0, 0, 1, 2, [0, 2], 7, 2, 0, False), (1, 1, 1, 1, [3], 9, 3, None, False), (0, 0, 1, 1, [2], 1, 0, None, False)])
    shown = [f.canvas for f in media_gif.decode_gif(data)]
    red, green, blue, black = [255, 0, 0], [0, 255, 0], [0, 0, 255], [0, 0, 0]
    assert shown[0].tolist() == [[red, red], [red, red]]
    assert shown[1].tolist() == [[red, red], [green, red]]  # the transparent one shows what was there
    assert shown[2].tolist() == [[black, red], [black, blue]]  # restored to the background, then drawn
    assert shown[3].tolist() == [[green, red], [black, red]]  # restored to what was before
    assert [f.delay_ms for f in media_gif.decode_gif(data)] == [50, 70, 90, 10]
    rows = next(media_gif.decode_gif(gif([(0, 0, 1, 5, [0, 1, 2, 3, 0], 0, 0, None, True)], (1, 5)))).canvas[:, 0]
    assert rows.tolist() == [black, blue, green, black, red]


def test_gif_rows(spark):
    got = {r.doc_id: r for r in media_gif.gif_digests(docs(spark)).collect()}
    for i, text in ODD:
        raw = (text or "").encode()
        raw += b" " * (-len(raw) % 192 or (192 if not raw else 0))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((text or "").encode()), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]))
    assert got[6].feature.startswith("frames=2;size=192x341;ms=200")
    assert media_gif.gif_digests(docs(spark, [])).count() == 0
    frames = media_gif.gif_frames(media_gif.text_gifs(docs(spark)).select(F.col("doc_id").alias("key"), "gif")).where("key = 6").orderBy("frame").collect()
    assert [(f.frame, f.start_ms, sum(f.hist_r)) for f in frames] == [(0, 0, 192 * 341), (1, 100, 192 * 341)]


def brute_spans(t):
    found = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = [int(c) for c in m.group() if c in "0123456789"]
        total = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits)))
        if 12 <= len(digits) <= 19 and total % 10 == 0:
            found.append((*m.span(), "card"))
    found += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return sorted(found, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_pii_base_spans():
    rnd = random.Random(3)
    parts = ["a@", "b", "@", "@@", ".", "com", "1", "12", "-", " ", "+", "255", "4111111111111111", "(", "x.y@z.w", "é", "00"]
    for _ in range(4000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 18)))
        assert pii.base_spans(t) == brute_spans(t), t


def test_pii_learns_secrets(spark):
    rnd = random.Random(0)
    rows = [(i, f'some words token = "{rnd.randbytes(20).hex()}" and more') for i in range(40)] + [(100 + i, f"row {i} has 12345{i:04d}x in it, mail a{i}@b.com") for i in range(40)]
    got = {r.doc_id: r for r in pii.find_pii(docs(spark, [*rows, (901, ""), (902, None)])).collect()}
    assert all("secret:" in got[i].spans for i in range(40)) and not any("secret:" in got[100 + i].spans for i in range(40))
    assert all(got[100 + i].n_email == 1 for i in range(40)) and got[902].spans == "" == got[901].spans
    assert got[901].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert all(r.n_spans == len([s for s in r.spans.split(",") if s]) for r in got.values())
    assert pii.find_pii(docs(spark, [])).count() == 0 and pii.find_pii(docs(spark)).count() == len(ODD)


def test_pii_candidates_of_letters_only():
    found = lambda t: [t[a:b] for a, b, _ in pii.candidates(t, pii.base_spans(t))]
    assert found("key " + "abcdef" * 6 + " end") == ["abcdef" * 6]
    assert found("use sk-abcdefghijklmnop, or not") == ["sk-abcdefghijklmnop"]
    assert found('Password: "correcthorse" and token = qwertyuiop.') == ["correcthorse", "qwertyuiop"]
    assert found("a token of some secret and a password that nobody knows") == []
    assert found("token = abc123def456") == ["abc123def456"]
    rnd = random.Random(1)
    parts = ["token", "Secret", " ", "=", ":", '"', "abcdef" * 6, "sk-", "ghp_", "é", "abcdefghijklmn", "x", "\t", "password", "_", "\n", "1"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 9))) for _ in range(5000)]
    hints = pii.texts_and_hints(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]))
    assert all(hint or not pii._LETTERS.search(t) for t, hint in hints)


def labelled(spark, n=300):
    rnd = random.Random(9)
    clean = lambda: " ".join(rnd.choice("river stone apple window quiet garden letter simple morning paper".split()) for _ in range(40))
    rows, labels = [], []
    for i in range(n):
        bad, junk = i % 3 == 0, i % 4 == 0
        text = clean().split()
        if bad:
            for w in rnd.sample(["grumblefuss", "nitwit", "lowbrow" + rnd.choice(["ish", "er", "ly", "ness", "en", "um"])], 2):
                text.insert(rnd.randrange(len(text)), w)
        text = " ".join(w.upper() + "!!" for w in text) if junk else " ".join(text)
        rows.append((i, text))
        labels.append((i, int(not junk), int(bad)))
    return docs(spark, rows), spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int"), rows, labels


def test_toxicity(spark):
    d, labels, rows, truth = labelled(spark)
    got = {r.doc_id: r for r in toxicity.toxicity_scores(d, labels).collect()}
    held = [t for t in truth if zlib.crc32(str(t[0]).encode()) % 3 == 1]
    assert all(got[i].held_out for i, *_ in held) and np.mean([got[i].predicted == bad for i, _, bad in held]) > 0.95
    lexicon = toxicity.learn_lexicon(d, labels)
    machine = toxicity.compile_lexicon(lexicon)
    score = lambda t: toxicity.text_scores(lexicon, machine, *text_bytes(pa.array([t])))[0]
    plain = "you are a {} and nothing else matters here"
    assert score(plain.format("grumblefuss")) > score(plain.format("grumblefus")) > score(plain.format("river"))  # misspelled
    assert score('she said "{}" in the quiet garden'.format("grumblefuss")) < score(plain.format("grumblefuss"))  # quoted
    kept = {r.doc_id for r in toxicity.drop_toxic(d, labels).select("doc_id").collect()}
    assert kept == {i for i, r in got.items() if not r.predicted} and toxicity.drop_toxic(d, labels).columns == d.columns
    none = labels.where("toxic = 0")
    assert toxicity.toxicity_scores(docs(spark), none).count() == len(ODD) and toxicity.toxicity_scores(docs(spark, []), labels).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
    return row[-1]


def test_automaton_against_edit_distance():
    rnd = random.Random(2)
    lexicon = toxicity.Lexicon({"clown": 5, "moron": 5, "bad": 5}, {"lowei": 4})
    machine = toxicity.compile_lexicon(lexicon)
    words = ["".join(rnd.choice("clowneimrbad") for _ in range(rnd.randint(1, 7))) for _ in range(3000)]
    for w in list(lexicon.words):
        words += [w[:k] + c + w[k + d :] for k in range(len(w) + 1) for c in ("", "o", "z") for d in (0, 1)]
    words = [w for w in words if w]
    row, _, _, term, distance = toxicity.find_terms(machine, *text_bytes(pa.array(words)))
    got = {int(r): int(d) for r, d in zip(row, distance, strict=True)}
    for k, w in enumerate(words):
        best = min([edit_distance(w, t) if len(t) >= 5 else 0 if w == t else 9 for t in lexicon.words] + [0 if w.startswith("lowei") else 9])
        assert got.get(k, 9) == (best if best <= 1 else 9), w


def test_automaton_by_code_points_and_with_edited_stems():
    rnd = random.Random(5)
    lexicon = toxicity.Lexicon({"loser": 7, "crétin": 5}, {"lose": 3, "réeux": 4, "bomente": 4})
    machine = toxicity.compile_lexicon(lexicon, fuzzy_stems=True)
    words = ["loser", "looser", "lozer", "losers", "losing", "cretin", "crêtin", "crtin", "creetin", "réeuxes", "reeuxes", "rêeux", "réeuses", "boment", "bomantelich", "xbomente", "世bomente"]
    words += ["".join(rnd.choice("loserébmtnuxcié") for _ in range(rnd.randint(1, 9))) for _ in range(2000)]
    for t in lexicon.terms():
        words += [t[:k] + c + t[k + d :] + rnd.choice(["", "x", "é"]) for k in range(len(t) + 1) for c in ("", "é", "z") for d in (0, 1)]
    row, _, _, term, distance = toxicity.find_terms(machine, *text_bytes(pa.array(words)))
    got = {int(r): (int(d), lexicon.terms()[t]) for r, d, t in zip(row, distance, term, strict=True)}
    for k, w in enumerate(words):
        away = {t: edit_distance(w, t) for t in lexicon.words}
        away |= {t: min(edit_distance(w[:j], t) for j in range(len(w) + 1)) if len(t) > 4 else 0 if w.startswith(t) else 9 for t in lexicon.stems}
        best = min(away.values())
        assert got.get(k, (9, ""))[0] == (best if best <= 1 else 9), w
    assert got[words.index("loser")] == (0, "loser") and got[words.index("looser")] == (1, "loser") and got[words.index("cretin")] == (1, "crétin")


def test_terms_of_long_texts(monkeypatch):
    rnd = random.Random(3)
    machine = toxicity.compile_lexicon(toxicity.Lexicon({"clown": 5, "moron": 5}, {"lowei": 4}), fuzzy_stems=True)
    texts = ["".join(rnd.choice(["clown", "moron", "loweish", "mron", "é", " ", " ", ".", "x"]) for _ in range(rnd.randint(0, 60))) for _ in range(50)]
    whole = [x.tolist() for x in toxicity.find_terms(machine, *text_bytes(pa.array(texts)))]
    monkeypatch.setattr(toxicity, "_STRETCH", 40)
    assert [x.tolist() for x in toxicity.find_terms(machine, *text_bytes(pa.array(texts)))] == whole and len(whole[0]) > 50


def test_cover_against_the_greedy_rule():
    rnd = random.Random(8)
    for _ in range(50):
        docs_ = [sorted({f"w{rnd.randrange(9)}" for _ in range(rnd.randint(0, 4))}) for _ in range(rnd.randint(1, 30))]
        terms, need, chosen = [f"w{k}" for k in range(9)], [2] * len(docs_), []
        while True:
            left = {t: [k for k, d in enumerate(docs_) if t in d and need[k] > 0] for t in terms if t not in chosen}
            best = max(left, key=lambda t: (len(left[t]), len(t), t), default=None)
            if best is None or len(left[best]) < 2:
                break
            chosen.append(best)
            for k in left[best]:
                need[k] -= 1
        assert toxicity._cover(terms, docs_, 2, 2) == chosen


def test_a_word_with_more_evidence_than_its_stem_stays(spark):
    toxic = [(i, f"tone{i} loser {' '.join(f'word{(i + k) % 7}' for k in range(3))}") for i in range(60)] + [(100 + i, f"tone{i} lose{e} word1") for i, e in enumerate(["tte", "ngo", "lka", "mux"] * 10)]
    clean = [(200 + i, f"calm{i} word{i % 7} {'losex' if i < 12 else 'river'}") for i in range(200)]
    labels = spark.createDataFrame([(i, 1, int(i < 200)) for i, _ in toxic + clean], "doc_id long, quality int, toxic int")
    lexicon = toxicity.learn_lexicon(docs(spark, toxic + clean), labels)
    stems = [s for s in lexicon.stems if "loser".startswith(s)]
    assert "loser" in lexicon.words and all(lexicon.words["loser"] > lexicon.stems[s] for s in stems)


def test_quality(spark):
    d, labels, _, truth = labelled(spark)
    got = {r.doc_id: r for r in quality.quality_scores(d, labels).collect()}
    held = [t for t in truth if zlib.crc32(str(t[0]).encode()) % 3 == 1]
    assert np.mean([got[i].predicted == good for i, good, _ in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    for l in (labels, labels.limit(0), labels.where("quality = 1")):
        assert quality.quality_scores(docs(spark), l).where("score BETWEEN 0 AND 1").count() == len(ODD)
    assert quality.quality_scores(docs(spark, []), labels).count() == 0


def test_quality_discriminant_against_formula():
    rng = np.random.default_rng(0)
    x = [rng.normal(size=(200, 3)), rng.normal(size=(100, 3)) * 2 + 1]
    m = quality.discriminant(np.array([200, 100]), np.array([a.sum(0) for a in x]), np.array([a.T @ a for a in x]), 0.0, 0.0)
    q, log = rng.normal(size=(5, 3)), []
    for a in x:
        s, z = np.cov(a.T, bias=True), q - a.mean(0)
        log.append(-0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(s), z) - 0.5 * np.log(np.linalg.det(s)) + np.log((len(a) + 1) / 302))
    assert np.allclose(m.scores(q), 1 / (1 + np.exp(-(log[1] - log[0]) / m.temperature)), atol=1e-3)


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(tokenizer_path("byte_bpe_50k.json"))


def test_packing_ids(encoder):
    rnd = random.Random(1)
    parts = ["a", "the", " ", "  ", "\n", " \n", "é", "世", "<|endoftext|>", "'s", "12", "!!", "x\t", " b", "\xa0", "\x0b"]
    for _ in range(500):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30)))
        assert encoder.encode([t])[0].tolist() == encoder.library.encode(t, add_special_tokens=False).ids, t


def test_packing_ids_of_long_odd_texts(encoder, monkeypatch):
    monkeypatch.setattr(packing, "_LONG", 30)
    rnd = random.Random(2)
    parts = ["a", "the", " ", "  ", "\t", " \n", "é", "<|endoftext|>", "'s", "12", "!!", " b c", "\xa0"]
    for _ in range(200):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 300)))
        assert encoder.encode([t])[0].tolist() == encoder.library.encode(t, add_special_tokens=False).ids, t


def test_packing_cuts_are_the_cheapest():
    rnd = random.Random(1)
    cost = lambda n: packing.WINDOW + (0 if n & (n - 1) == 0 else 16 - n)
    for _ in range(200):
        n = rnd.randint(1, 40)
        places = np.unique([*(rnd.randint(1, n) for _ in range(n)), n])
        if np.diff(np.r_[0, places]).max() > 16:
            continue
        penalty = np.array([rnd.choice([0, 1.0, 3.0]) for _ in places])
        best = {0: 0.0}
        for j, p in zip(places.tolist(), penalty, strict=True):
            best[j] = p + min(best[i] + cost(j - i) for i in best if j - i <= 16)
        cuts = packing.best_cuts(places, penalty, 16)
        of = dict(zip(places.tolist(), penalty, strict=True))
        assert abs(sum(cost(b - a) + of[b] for a, b in zip([0, *cuts], cuts, strict=False)) - best[n]) < 1e-9


def test_packing_rows(spark, encoder, monkeypatch):
    rows = ODD[:2] + [(i, t) for i, (_, t) in enumerate(ODD[3:], 10)]
    got = packing.pack(docs(spark, rows).repartition(2), tokenizer_path("byte_bpe_50k.json")).toPandas()
    ids = {i: np.array([*encoder.library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in rows}
    seen = {i: np.zeros(len(x), int) for i, x in ids.items()}
    for r in got.itertuples():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        seen[r.doc_id][r.start : r.start + r.length] += 1
    assert all((x == 1).all() for x in seen.values())
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum()[:-1]] and s.length.sum() <= 1024
    assert packing.pack(docs(spark, []), tokenizer_path("byte_bpe_50k.json")).count() == 0
    assert packing.pack(docs(spark), tokenizer_path("byte_bpe_50k.json")).select("doc_id").distinct().count() == 8


ITEMS = ["the quick brown fox jumps over the lazy dog while the cat sleeps near the warm stove all day", "a second passage about rivers that run slowly to the sea and carry small stones and silver sand"]


def test_alignment_against_brute_force():
    rnd = random.Random(0)
    for _ in range(300):
        a, b = ("".join(rnd.choice("ab") for _ in range(rnd.randint(1, n))) for n in (6, 12))
        least = min(edit_distance(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        found = decontam.align(np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8), 3)
        assert (found[0] if found else 9) == (least if least <= 3 else 9)


def test_decontamination_finds_all_within_the_budget():
    rnd = random.Random(5)
    m = decontam.Matcher(list(enumerate(ITEMS)))
    for _ in range(200):
        k = rnd.randrange(2)
        p = list(ITEMS[k])
        for _ in range(rnd.randint(0, int(m.budget[m.item.index(k)]))):
            j = rnd.randrange(len(p))
            p[j : j + rnd.randint(0, 1)] = rnd.choice(["", "x"])
        text = "Some words before. " + "".join(p).upper().replace(" ", "\n ") + " and after"
        assert [h.item for h in m.match(["nothing", text, ""])] == [k]


def test_decontamination_rows(spark):
    bench = spark.createDataFrame([(1, ITEMS[0]), (2, ITEMS[1]), (3, None), (None, "x"), (4, "short"), (5, "")], "item_id long, text string")
    rows = [*ODD, (20, f"Before {ITEMS[0]} after"), (21, ITEMS[1].replace("slowly", "slow")), (22, ITEMS[0][:40])]
    got = [(r.doc_id, r.item_id, r.edits) for r in decontam.contaminated(docs(spark, rows), bench).collect()]
    assert sorted(got) == [(20, 1, 0), (21, 2, 2)]
    kept = decontam.drop_contaminated(docs(spark, rows), bench)
    assert kept.count() == len(rows) - 2 and kept.columns == docs(spark).columns
    assert decontam.contaminated(docs(spark, []), bench).count() == 0 and decontam.contaminated(docs(spark, rows), bench.limit(0)).count() == 0


def test_long_texts_are_matched_in_stretches(monkeypatch):
    rnd = random.Random(6)
    items = [(1, ITEMS[0]), (2, ITEMS[1]), (3, "big dog"), (4, "gs sto")]
    word = lambda: rnd.choice(["stones", "big", "dogs", "dog", "the", "cat", *ITEMS[0].split()])
    texts = []
    for _ in range(40):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 120))) for _ in range(3)]
        texts.append(f"{parts[0]} {rnd.choice([*ITEMS, '', ITEMS[0].replace('fox', 'f0x'), ITEMS[1][:50]])} {parts[1]}, big dog {parts[2]}")
    whole = [(h.row, h.item, h.edits, h.end) for h in decontam.Matcher(items).match(texts)]
    monkeypatch.setattr(decontam, "_STRETCH", 150)
    assert [(h.row, h.item, h.edits, h.end) for h in decontam.Matcher(items).match(texts)] == whole and {x[1] for x in whole} == {1, 2, 3}


def test_short_benchmark_items(spark):
    bench = spark.createDataFrame([(1, "short"), (2, "Big red dog"), (None, "is it so?"), (3, " "), (4, "big red dog")], "item_id long, text string")
    rows = [(1, "a short one"), (2, "shorter, a big reddog"), (3, "My BIG  red\tdog, then a big red dog"), (4, "say is it so? yes"), (5, "is it sorry?"), (6, "big red dogs"), (7, "short"), (8, None)]
    got = [(r.doc_id, r.item_id, r.edits, r.start, r.end) for r in decontam.contaminated(docs(spark, rows), bench).collect()]
    assert sorted(got, key=repr) == sorted([(1, 1, 0, 2, 7), (3, 2, 0, 3, 14), (3, 4, 0, 3, 14), (4, None, 0, 4, 13), (7, 1, 0, 0, 5)], key=repr)
    assert {r.doc_id for r in decontam.drop_contaminated(docs(spark, rows), bench).collect()} == {1, 2, 5, 6, 7, 8}


def test_short_items_against_brute_force():
    rnd = random.Random(7)
    words = ["ab", "b", "a-b", "é", "ba"]
    say = lambda n: "".join(rnd.choice(words) + rnd.choice([" ", ", ", "  ", "."]) for _ in range(n))
    items = [(k, say(rnd.randint(1, 3)).strip()) for k in range(12)]
    texts = [say(rnd.randint(0, 12)) for _ in range(300)]
    got = {(h.row, h.item, h.start) for h in decontam.Matcher(items).match(texts)}
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t.lower())
    for r, t in enumerate(texts):
        for k, item in items:
            free = lambda x, y: not (re.match(r"[^\W_]", x) and re.match(r"[^\W_]", y))
            t2, p = plain(t), plain(item)
            at = [m.start() for m in re.finditer(f"(?={re.escape(p)})", t2) if (m.start() == 0 or free(t2[m.start() - 1], p[0])) and (m.start() + len(p) == len(t2) or free(p[-1], t2[m.start() + len(p)]))]
            assert {s for a, b, s in got if (a, b) == (r, k)} == {len(t2[: at[0]].encode())} if at else (r, k) not in {x[:2] for x in got}, (t, item)
