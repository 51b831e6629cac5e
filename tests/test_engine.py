"""The engine's operators: values, edge cases, and the behaviour users rely on."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import text as tx
from lodestar.functions import vectors as vx
from lodestar.operators import analysis, ann, quantization, search, store
from lodestar.operators.embedding import HashedNgrams, Transformer, embed_column, mean_pool
from lodestar.plans.commands import CommandError, Engine, parse, read_resp, resp, split_stream
from lodestar.plans.queries import SQL
from lodestar.sources import snapshots
from lodestar.sources.config import Settings, parse_settings
from lodestar.sources.imports import import_lines, vocabulary
from lodestar.sources.weights import layout, read_weights, write_weights

VEC = "id long, embedding array<float>"


def vectors(n, dim=8, seed=0):
    return np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)


def frame(spark, v):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], VEC)


def test_distances(spark):
    d = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = d.select(vx.squared_l2("a", "b").alias("l"), vx.cosine_distance("a", "b").alias("c"), vx.dot("a", "b").alias("d")).collect()
    assert [tuple(round(x, 9) for x in r) for r in got] == [(5.0, 1.0, 0.0), (2.0, 0.0, 4.0), (1.0, 1.0, 0.0)]


@pytest.mark.parametrize("text,expected", [("[1,2,3,4]", [1, 2, 3, 4]), ("[1,2]", [1, 2, 0, 0]), ("[1,2,3,4,5]", [1, 2, 3, 4]), ("[1,x,3,4]", [1, 0, 0, 0]), ('"1 2e1 -.5"', [1, 20, -0.5, 0]), ("", [0, 0, 0, 0])])
def test_literal(text, expected):
    assert vx.parse_literal(text, 4) == expected


def test_format_and_parse(spark):
    d = spark.createDataFrame([([0.5, -1.0],)], "v array<float>")
    assert d.select(vx.format_vector("v")).first()[0] == "[0.500000,-1.000000]"
    assert d.select(vx.parse_vector(vx.format_vector("v"), 2)).first()[0] == [0.5, -1.0]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_format_rounds_by_the_exact_value(spark, kind):
    """As DuckDB's printf: ties to even, special values in its words, nulls left out."""
    import duckdb
    import pyarrow as pa

    rng = np.random.default_rng(3)
    ties = [[k / 128 for k in range(at, at + 16)] for at in range(-160, 160, 16)]
    with np.errstate(invalid="ignore"):  # NaNs of any bits are among them
        bits = rng.integers(0, 2**32, (50, 16), dtype=np.uint32).view(np.float32).astype(float).tolist()
    nan = float("nan")
    odd = [[], None, [None], [None, 1.0, None, 0.5], [nan, float("inf"), float("-inf"), -nan], [-0.0, 0.0, -1e-9], [3.4e38, 1e23, 16777217.0], [nan, None]]
    halves = [[(10 * k + 5) / 1e7 for k in range(at, at + 16)] for at in range(0, 160, 16)]
    vectors = list(enumerate(ties + bits + odd + halves))
    made = pa.table({"vec_id": pa.array([k for k, _ in vectors], pa.int64()), "embedding": pa.array([v for _, v in vectors], pa.list_(pa.float32() if kind == "float" else pa.float64()))})
    con = duckdb.connect()
    con.register("embeddings", made)
    expected = dict(con.sql(SQL["vector_format"]).fetchall())
    got = {r.id: r.vector for r in spark.createDataFrame(made).select(F.col("vec_id").alias("id"), vx.format_vector("embedding").alias("vector")).collect()}
    assert got == expected


@pytest.mark.parametrize("small_base", [0, search.SMALL_BASE])
@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_single_and_batch_search_agree_with_numpy(spark, metric, small_base):
    v = vectors(60)
    v[20:30] = v[10:20]  # ties
    rows = frame(spark, v)
    d = search.distances(v[:3], v, metric)
    expected = [[int(i) for i in np.lexsort((np.arange(60), d[q]))[:7]] for q in range(3)]
    batch = search.nearest_batch(rows, rows.where("id < 3").select(F.col("id").alias("query_id"), "embedding"), 7, metric, query_block=2, small_base=small_base)
    got = {}
    for r in batch.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert [got[q] for q in range(3)] == expected
    one = search.nearest(rows, v[0].tolist(), 7, metric, None)
    assert [r.id for r in one.orderBy("distance", "id").collect()] == expected[0]


def test_search_edges(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, [-1.0, 0.0])], VEC)
    near = search.nearest(rows, [1.0, 0.0], 10)
    assert [r.id for r in near.orderBy("distance", "id").collect()] == [1, 2]  # ties by id, zero and far vectors beyond the threshold
    assert search.nearest(rows, [1.0, 0.0], 0).count() == 0
    assert search.nearest(rows, [0.0, 0.0], 3).count() == 0
    assert search.nearest_batch(rows.limit(0), rows.select(F.col("id").alias("query_id"), "embedding"), 3).count() == 0
    assert search.nearest_batch(rows, rows.limit(0).select(F.col("id").alias("query_id"), "embedding"), 3).count() == 0
    marked = rows.withColumn("deleted", F.col("id") == 1)
    assert [r.id for r in search.nearest(marked, [1.0, 0.0], 1).collect()] == [2]
    with pytest.raises(ValueError):
        vx.distance("manhattan", "a", "b")


def test_percentiles_and_recall(spark):
    rows = spark.createDataFrame([(float(x),) for x in range(100)] + [(None,)], "v double")
    assert {r.share: r.value for r in search.nth_values(rows, "v", {0.95: 95, 0.99: 99}).collect()} == {0.95: 95.0, 0.99: 99.0}
    exact = spark.createDataFrame([(1, 1), (1, 2)], "query_id long, id long")
    assert search.recall(exact, exact.limit(1)).first().recall == 0.5


@pytest.mark.parametrize("fetched", [5, 100_000])
def test_places_do_not_depend_on_partitions(spark, monkeypatch, fetched):
    """Range bounds are sampled anew each time a plan runs; a place told from one run's partitions is another value in the next."""
    monkeypatch.setattr(search, "_FETCHED", fetched, raising=False)
    n = 600_000
    mixed = spark.range(0, n, 1, 8).select((F.pmod(F.col("id") * 7919, F.lit(n)) / 8).alias("v"))
    places = {0.0: 0, 0.5: n // 2, 0.95: 570_000, 0.99: 594_000, 1.0: n - 1, 2.0: n, -1.0: -1}
    assert {r.share: r.value for r in search.nth_values(mixed, "v", places).collect()} == {s: p / 8 for s, p in places.items() if 0 <= p < n}
    odd = [float("-inf")] * 7 + [-0.0, 0.0] * 5 + [1.0] * 9 + [1.5, 2.5] + [float("inf")] * 8 + [float("nan")] * 3
    rows = spark.createDataFrame([(x,) for x in odd[::-1]] + [(None,)], "v double")
    got = {r.share: r.value for r in search.nth_values(rows, "v", {float(k): k for k in range(len(odd) + 1)}).collect()}
    assert np.array_equal([got.pop(float(k)) for k in range(len(odd))], odd, equal_nan=True) and not got
    assert search.nth_values(rows.limit(0), "v", {0.5: 0}).count() == 0


def test_quantizer(spark):
    rows = spark.createDataFrame([(1, [0.0, 3.0]), (2, [1.0, 3.0]), (3, [0.4999, 3.0])], VEC)
    trained = {r.pos: (r.min_val, r.max_val, r.scale) for r in quantization.train(rows).collect()}
    assert trained[0] == (0.0, 1.0, 1 / 255) and trained[1] == (3.0, 3.0, 1.0)
    codes = {r.id: r.codes for r in quantization.encode(rows, quantization.train(rows)).collect()}
    assert codes == {1: [0, 0], 2: [255, 0], 3: [127, 0]}  # cut off, not rounded
    assert quantization.reconstruction_error(rows).agg(F.max("error")).first()[0] < 1 / 255**2


def log(spark, rows):
    return spark.createDataFrame(rows, store.LOG)


def test_fold_compares_with_the_stored_vector(spark):
    near = [1.0, 0.003]
    rows = [(0, "set", "a", [1.0, 0.0]), (1, "set", "a", near), (2, "set", "a", [1.0, 0.006]), (3, "set", "b", [1.0, 2.0]), (4, "set", "b", [2.0, 4.0]), (5, "set", "z", [0.0, 0.0]), (6, "set", "z", [0.0, 0.0])]
    got = [(r.internal_id, r.id, r.deleted) for r in store.nodes(log(spark, rows)).orderBy("internal_id").collect()]
    # 1 is 0 again, 2 is near 1 but not near 0; 2v over v is a no-op by cosine; zero vectors never are.
    assert got == [(0, "a", True), (2, "a", False), (3, "b", False), (5, "z", True), (6, "z", False)]


def test_delete_insert_flush_and_empty_ids(spark):
    rows = [(0, "set", "a", [1.0]), (1, "flush", None, None), (2, "set", "a", [1.0]), (3, "del", "a", None), (4, "set", "a", [1.0]), (5, "set", "", [1.0]), (6, "del", "q", None)]
    nodes = store.nodes(log(spark, rows))
    assert [(r.internal_id, r.deleted) for r in nodes.orderBy("internal_id").collect()] == [(2, True), (4, False)]
    stats = {r.key: r.value for r in store.info(nodes).collect()}
    assert stats["total_keys"] == "2" and stats["live_keys"] == "1"
    assert {r.key: r.value for r in store.info(nodes.limit(0)).collect()}["total_keys"] == "0"
    assert store.nodes(log(spark, [])).count() == 0


@pytest.mark.parametrize("pattern,text,hit", [("*", "a/b", True), ("a?c", "abc", True), ("a?c", "ac", False), ("[a-c]*", "b.x", True), ("[!x]*", "xa", False), (r"a\*b", "a*b", True), (r"a\*b", "axb", False), ("*", ".hidden", True), ("a*c", "a/b\nc", True), ("[", "[", True)])
def test_glob(spark, pattern, text, hit):
    assert tx.glob_match(text, pattern) is hit
    assert (spark.createDataFrame([(text,)], "id string").where(tx.glob("id", pattern)).count() == 1) is hit


def test_scan_order_and_limit(spark):
    rows = spark.createDataFrame([(2, "b", [1.0], True), (1, "a", [1.0], False), (3, "ab", [1.0], False)], "internal_id long, id string, embedding array<float>, deleted boolean")
    assert [r.id for r in store.hgetall(rows, "*", 2).collect()] == ["a", "b"]
    assert [r.id for r in store.hgetall(rows, "*b", None, include_deleted=False).collect()] == ["ab"]
    assert store.hgetall(rows, "*", 0).count() == 0


def test_text_functions(spark):
    d = spark.createDataFrame([("Hi, THERE é!\t x",), ("   \n\t",), ("a" * 4096,), ("é" * 2049,)], "t string")
    got = d.select(tx.normalize("t").alias("n"), tx.words(tx.normalize("t")).alias("w"), tx.is_valid("t").alias("v")).collect()
    assert got[0].n == "hi there é\t x" and got[0].w == ["hi", "there", "é", "x"]
    assert [r.v for r in got] == [True, False, True, False]
    assert tx.check_text(" \n") == "empty text rejected" and tx.check_text("a" * 4097) == "text too long" and tx.check_text("ok") is None
    ids = spark.createDataFrame([("x/y/note.md#3", " 42abc"), ("plain", "no")], "i string, n string")
    got = ids.select(tx.chunk_path("i"), tx.chunk_name("i"), tx.chunk_number("i"), tx.to_int("n")).collect()
    assert [tuple(r) for r in got] == [("x/y/note.md", "note.md", "3", 42), ("plain", "plain", "", 0)]
    vocab = {" hello": 5, " he": 6, "llo": 7, "w": 8}
    got = d.sparkSession.createDataFrame([("Hello, wzllo",), ("",), (None,)], "t string").select(tx.wordpieces("t", vocab).alias("p")).collect()
    assert [r.p for r in got] == [[0, 5, 8, 7, 2], [0, 2], [0, 2]]
    assert d.sparkSession.createDataFrame([("hello hello hello",)], "t string").select(tx.wordpieces("t", vocab, max_length=3).alias("p")).first().p == [0, 5, 2]
    pieces = {k.encode(): v for k, v in vocab.items()}
    for most in (None, 1, 2, 3, 4, 5, 9):
        found = d.sparkSession.createDataFrame([("hello whe helloo hello",)], "t string").select(tx.wordpieces("t", vocab, max_length=most).alias("p")).first().p
        assert found == tx.encode_words("hello whe helloo hello".split(), pieces, 6, " ", most) and len(found) <= (most or 99)


def test_graph_search_recall(spark):
    v = vectors(400, 16)
    rows = frame(spark, v)
    asked = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    exact = search.nearest_batch(rows, asked, 10)
    for shard in (1000, 150):
        found = ann.search_index(ann.build_index(rows, shard_rows=shard, ef_construction=60), asked, 10)
        assert search.recall(exact, found).first().recall >= 0.93
    g = ann.Graph(v[:50], "l2").build()
    g.deleted[0] = True
    assert g.search(v[0], 3)[0][1] != 0 and ann.Graph(v[:0]).build().search(v[0], 3) == []


def test_graph_links_many_rows_as_it_links_one():
    rng = np.random.default_rng(4)
    for metric in ("cosine", "l2"):
        g = ann.Graph(rng.normal(size=(60, 5)), metric)
        d = g._between(g.vectors, g.vectors)
        near = np.argsort(d, 1, kind="stable")[:, 1:21]
        taken = g._diverse_rows(g.vectors, np.take_along_axis(d, near, 1), near, 6)
        for k in range(60):
            assert near[k][taken[k]].tolist() == g._diverse([(d[k, n], n) for n in near[k].tolist()], 6)


def test_graph_of_repeated_and_zero_rows():
    v = np.concatenate([np.zeros((40, 4)), np.ones((300, 4)), np.random.default_rng(1).normal(size=(200, 4))]).astype(np.float32)
    for metric in ("cosine", "l2"):
        g = ann.Graph(v, metric, ef_construction=40).build()
        assert all(len(links) <= (32 if at == 0 else 16) for node in g.links for at, links in enumerate(node))
        exact = search.distances(v[-50:], v, metric)
        found = [[n for _, n in g.search(q, 5)] for q in v[-50:]]
        # Of rows as near as each other any will do.
        assert np.mean([exact[k, f].max() <= np.sort(exact[k])[4] + 1e-6 for k, f in enumerate(found)]) >= 0.93


def test_index_extended_by_later_rows(spark):
    rows = frame(spark, vectors(300, 16))
    first, asked = rows.where("id < 200"), rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    index = ann.extend_index(ann.build_index(first, shard_rows=120, ef_construction=60), rows, ef_construction=60)
    assert index.select("id").distinct().count() == index.count() == 300
    assert search.recall(search.nearest_batch(rows, asked, 10), ann.search_index(index, asked, 10)).first().recall >= 0.93
    assert ann.extend_index(ann.build_index(rows.limit(0)), first).count() == 200


def test_nodes_from_a_saved_beginning(spark):
    rng = np.random.default_rng(6)
    for _ in range(4):
        rows = [(k, rng.choice(["set", "set", "set", "del"]).item(), f"i{rng.integers(5)}", rng.integers(-1, 2, 2).astype(float).tolist()) for k in range(40)]
        rows = [(s, op, i, None if op == "del" else v) for s, op, i, v in rows]
        if rng.random() < 0.5:
            at = int(rng.integers(40))
            rows[at] = (at, "flush", None, None)
        cut = int(rng.integers(5, 35))
        told = lambda d: sorted((r.internal_id, r.id, r.deleted, r.deleted_at, tuple(r.embedding)) for r in d.collect())
        assert told(store.nodes_since(store.nodes(log(spark, rows[:cut])), log(spark, rows[cut:]))) == told(store.nodes(log(spark, rows)))


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "snap")
    assert snapshots.load_snapshot(spark, root) is None
    rows = frame(spark, vectors(5))
    snapshots.save_snapshot(rows, root)
    snapshots.save_snapshot(rows.limit(2), root)
    assert snapshots.load_snapshot(spark, root).count() == 2
    nodes = [{"id": "a", "embedding": [1.0, 2.0], "level": 1, "deleted": False, "neighbours": [[1], []]}, {"id": "é", "embedding": [0.5, 0.0], "level": 0, "deleted": True, "neighbours": [[0]]}]
    data = snapshots.dump_bytes(nodes, 2, 0)
    head, back = snapshots.read_dump(data)
    assert head == {"dim": 2, "count": 2, "max_level": 1, "entry": 0}
    assert [{k: n[k] for k in nodes[0]} for n in back] == nodes
    (tmp_path / "x.bin").write_bytes(data)
    assert [(r.id, r.deleted) for r in snapshots.dumps(spark, str(tmp_path / "x.bin")).orderBy("internal_id").collect()] == [("a", False), ("é", True)]
    with pytest.raises(ValueError):
        snapshots.read_dump(b"nope")
    with pytest.raises(ValueError):
        snapshots.dump_bytes([{"id": "", "embedding": [1.0]}], 1)


def test_weights_and_transformer(spark, tmp_path):
    rng = np.random.default_rng(0)
    tensors = {n: rng.normal(size=s).astype(np.float32) * 0.1 for n, s in layout(2, 24, 10, 16)}
    path = str(tmp_path / "w.bin")
    write_weights(path, tensors, 2, 24, 10, 16)
    back, head = read_weights(path)
    assert head["layers"] == 2 and all(np.array_equal(back[k], tensors[k]) for k in tensors)
    t = Transformer(back, 2, {" a": 3, "b": 4}, max_tokens=16)
    out = t.embed("A, b a")
    assert t.tokens("A, b a") == [0, 3, 4, 3, 2] and abs(float(out @ out) - 1) < 1e-5
    assert not np.allclose(out, t.embed("b"))


def test_embedding_and_pooling(spark):
    e = HashedNgrams(32)
    d = spark.createDataFrame([("hello world",), ("",), (None,)], "t string").select(embed_column("t", e).alias("v")).collect()
    assert abs(sum(x * x for x in d[0].v) - 1) < 1e-5 and set(d[1].v) == set(d[2].v) == {0.0}
    texts = ["", "a", " A\t", "Word word", "é\u3000世界 x", "\n", "word " * 300]
    assert all(np.array_equal(x, e.embed(t)) for x, t in zip(e.embed_many(texts), texts, strict=True)) and e.embed_many([]) == []
    # The trigrams are those of each word between spaces, whatever parts the words.
    assert np.array_equal(e.embed("one two"), e.embed("TWO\n\n one ")) and np.allclose(e.embed("one one"), e.embed("one")) and not np.allclose(e.embed("onetwo"), e.embed("one two"))
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0])], "k int, embedding array<float>")
    assert mean_pool(rows, "k").first().embedding == [0.5, 0.5]


def test_analysis(spark):
    v = np.concatenate([vectors(20) + 8, vectors(20, seed=1) - 8])
    rows = frame(spark, v).withColumn("id", F.concat(F.lit("d/alpha beta"), F.col("id").cast("string"), F.lit(".md#0")))
    found = analysis.kmeans(rows, 2)
    assert found.groupBy("cluster").count().where("count = 20").count() == 2
    out = analysis.scatter_frame(rows.withColumn("deleted", F.lit(False)))
    assert out.columns == ["note", "path", "fragment", "x", "y", "z", "label"] and out.count() == 40
    assert analysis.cluster_labels(spark.createDataFrame([(0, "1 22")], "cluster int, t string"), "t").first().label == "Grupo 0: (Varios)"


def test_settings_imports_and_vocabulary(spark, tmp_path):
    s = parse_settings(["# x", "", "dim = 4", "nonsense", "other=1", "ef_search=7", "ef_search = 9x", "log_file= a b "])
    assert (s.dim, s.ef_search, s.log_file, s.max_text_length) == (4, 9, "a b", 4096)
    (tmp_path / "i.txt").write_text("doc1|one|two\n||doc2|x\nbad line\n|\n")
    assert {(r.id, r.text) for r in import_lines(spark, str(tmp_path / "i.txt")).collect()} == {("doc1", "one|two"), ("doc2", "x")}
    (tmp_path / "v.txt").write_text("a\nb\n\nc\n")
    assert vocabulary(spark, str(tmp_path / "v.txt")) == {"a": 0, "b": 1, "c": 3}


def test_parse():
    assert parse("vset k [1,2]", 3).vector == [1, 2, 0]
    assert parse('TSET "my id" "some text"', 2).id == "my id" and parse('TSET "my id" "some text"', 2).text == "some text"
    c = parse("HGETALL a* LIMIT 5", 2)
    assert (c.pattern, c.limit) == ("a*", 5) and parse("hgetall", 2).limit == 100
    assert parse("VSEARCH x [1]", 1).k == 0 and parse("tdel q", 1).name == "DELETE"
    assert split_stream("PING\r\nINFO\r\nVS") == (["PING", "INFO"], "VS")
    with pytest.raises(CommandError):
        parse("SELECT 1", 2)


def test_engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"), Settings(dim=2))
    replies = e.run(["PING", "VSET a [1,0]", "VSET a [2,0]", "VSET b [0,1]", "VSET", "DEL b", "DEL b", "nope", "TSET x hi", "VSEARCH 5"])
    assert replies == ["+PONG", "+OK", "+OK", "+OK", "-ERR missing data", "+OK", "-ERR not found", "-ERR unknown or unsupported command", "-ERR no embedding model", "-ERR missing search vector"]
    assert [r.id for r in e.execute("VSEARCH 5 [1,0.1]").collect()] == ["a"]
    assert [tuple(r) for r in e.execute("HGETALL").collect()] == [("a", "[1.000000,0.000000]"), ("b", "[0.000000,1.000000]")]
    assert e.execute("SAVE") == "+OK" and not e.dirty
    again = Engine(spark, str(tmp_path / "db"), Settings(dim=2))
    assert again.seq == e.seq and [r.id for r in again.execute("VSEARCH 5 [0,1]").collect()] == []  # the tombstone survives
    assert {r.key: r.value for r in again.execute("INFO").collect()}["total_keys"] == "2"
    assert again.restore().count() == 2
    # What comes after a save is folded on top of it.
    assert again.run(["VSET a [0,1]", "VSET c [1,1]", "VSET a [0,2]", "SAVE", "DEL c"]) == ["+OK"] * 5
    assert [(r.internal_id, r.id, r.deleted) for r in again.nodes().orderBy("internal_id").collect()] == [(r.internal_id, r.id, r.deleted) for r in store.nodes(again.log()).orderBy("internal_id").collect()]
    assert again.execute("FLUSHDB") == "+OK" and again.execute("HGETALL").count() == 0
    assert again.execute("QUIT") == "+OK bye" and again.closed


def test_autosave(spark, tmp_path, monkeypatch):
    from lodestar.plans import commands

    now = [100.0]
    monkeypatch.setattr(commands.time, "monotonic", lambda: now[0])
    e = Engine(spark, str(tmp_path / "db"), Settings(dim=2, save_interval=15), autosave=True, saved_at=now[0])
    assert e.run(["VSET a [1,0]", "PING"]) == ["+OK", "+PONG"] and e.dirty and e.restore() is None
    now[0] += 15
    assert e.execute("VSET b [0,1]") == "+OK" and not e.dirty and e.restore().count() == 2
    now[0] += 15
    version = e.saved
    assert e.execute("PING") == "+PONG" and e.saved == version  # nothing to save
    e.settings.save_interval = 0
    assert e.execute("DEL a") == "+OK" and e.dirty


def test_text_engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"), Settings(dim=64), HashedNgrams(64))
    texts = {"ai": "neural networks learn from data", "rome": "the roman empire and its legions", "plants": "plants get energy from sunlight"}
    (tmp_path / "in.txt").write_text("".join(f"{k}|{v}\n" for k, v in texts.items()) + "blank|   \n")
    assert e.import_file(str(tmp_path / "in.txt")) == 3
    assert e.run(["TSET a  ", 'TSET b "' + "x" * 5000 + '"']) == ["-ERR empty text rejected", "-ERR text too long"]
    assert [r.id for r in e.execute("TSEARCH 1 energy for plants from the sunlight").collect()] == ["plants"]
    for _ in range(3):
        e.execute("TSET again same text")
    assert {r.key: r.value for r in e.execute("INFO").collect()}["total_keys"] == "4"
    wire = resp(e.execute("TSEARCH 1 roman empire legions"))
    assert wire.startswith("*1\r\n$4\r\nrome\r\n") and read_resp(wire)[0] == "rome" and resp("+OK") == "+OK\r\n" and read_resp("+OK\r\n") == "+OK"
    with pytest.raises(ValueError):
        Engine(spark, str(tmp_path / "other"), Settings(dim=2), HashedNgrams(64))


def test_stream(spark, tmp_path):
    from lodestar.streaming.ingest import append_stream, upsert_stream

    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    log(spark, [(0, "set", "a", [1.0, 0.0]), (1, "set", "a", [2.0, 0.0])]).write.parquet(source)
    stream = lambda: spark.readStream.schema(store.LOG).parquet(source)
    append_stream(stream(), target, str(tmp_path / "c1"), once=True).awaitTermination()
    log(spark, [(2, "del", "a", None)]).write.mode("append").parquet(source)
    append_stream(stream(), target, str(tmp_path / "c1"), once=True).awaitTermination()
    assert [(r.internal_id, r.deleted) for r in store.nodes(spark.read.schema(store.LOG).parquet(target)).collect()] == [(0, True)]
    seen = []
    upsert_stream(stream(), lambda batch, n: seen.append(batch.count()), str(tmp_path / "c2"), once=True).awaitTermination()
    assert sum(seen) == 3


def test_stateful_stream(spark, tmp_path):
    from lodestar.streaming.ingest import fold_stream

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = str(tmp_path / "in")

    def run():
        q = fold_stream(spark.readStream.schema(store.LOG).parquet(source)).writeStream.outputMode("update").foreachBatch(lambda b, n: got.extend((r.internal_id, r.deleted) for r in b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()

    got = []
    log(spark, [(0, "set", "a", [1.0, 0.0]), (1, "set", "a", [2.0, 0.0])]).write.parquet(source)
    run()
    assert got == [(0, False)]
    got.clear()
    log(spark, [(2, "set", "a", [0.0, 1.0])]).write.mode("append").parquet(source)
    run()
    assert sorted(got) == [(0, True), (2, False)]


def test_wordpiece_query_runs_over_whole_texts(spark, tmp_path):
    from lodestar.plans.queries import wordpiece_tokens

    spark.createDataFrame([(1, "q" * 3000)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert len(wordpiece_tokens(spark, str(tmp_path)).first().tokens) == 3002
