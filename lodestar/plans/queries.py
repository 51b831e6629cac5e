"""One query for each operator over the driver's tables, and DuckDB SQL for those SQL can express.

Base vectors are the rows of ``embeddings``; the single query vector is that of vec_id 0, batched
queries are all rows whose vec_id is divisible by 100, against all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import text as tx
from lodestar.functions import vectors as vx
from lodestar.operators import analysis, ann, quantization, search, store
from lodestar.operators.embedding import HashedNgrams, embed_column, gelu_column, mean_pool
from lodestar.sources.imports import keyed_by, split_lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")


def asked(rows: DataFrame) -> DataFrame:
    return rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding")


def one_vector(rows: DataFrame, vec_id: int = 0) -> list[float]:
    return list(rows.where(F.col("id") == vec_id).select("embedding").first()[0])


_COS = "CASE WHEN sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(b.e, b.e)) < 1e-10 THEN 1.0 ELSE 1 - list_inner_product(q.e, b.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(b.e, b.e))) END"
_L2 = "power(list_distance(q.e, b.e), 2)"
_B = "b AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings)"


def _topk(d: str, where: str = "TRUE", k: int = 10, outer: str = "TRUE") -> str:
    return f"""WITH {_B}, d AS (SELECT b.id, {d} AS distance FROM b, b q WHERE q.id = 0 AND {where} ORDER BY distance, b.id LIMIT {k})
SELECT id, round(distance, 6) + 0.0 AS distance FROM d WHERE {outer}"""


def _batch(d: str, k: int = 10, where: str = "TRUE") -> str:
    return f"""WITH {_B}, d AS (SELECT q.id AS query_id, b.id, {d} AS distance FROM b, b q WHERE q.id % 100 = 0 AND {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d)
SELECT query_id, id, round(distance, 6) + 0.0 AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {k}"""


@query(_topk(_COS, outer="distance <= 0.85"))
def vsearch_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base(spark, sf_dir)
    return search.nearest(rows, one_vector(rows), 10).withColumn("distance", vx.shown("distance"))


@query(_topk(_L2))
def vsearch_l2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base(spark, sf_dir)
    return search.nearest(rows, one_vector(rows), 10, "l2", None).withColumn("distance", vx.shown("distance"))


@query(_topk(_COS, k=100, outer="distance <= 0.7"))
def vsearch_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base(spark, sf_dir)
    return search.nearest(rows, one_vector(rows), 100, threshold=0.7).withColumn("distance", vx.shown("distance"))


@query(_topk(_COS, where="b.label = q.label"))
def knn_same_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered search: the filter comes before the ranking."""
    rows = base(spark, sf_dir)
    label = rows.where("id = 0").select("label").first()[0]
    return search.nearest(rows.where(F.col("label") == label), one_vector(rows), 10, threshold=None).withColumn("distance", vx.shown("distance"))


@query(_batch(_COS))
def vsearch_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base(spark, sf_dir)
    return search.nearest_batch(rows, asked(rows), 10).withColumn("distance", vx.shown("distance"))


@query(_batch(_L2))
def vsearch_batch_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base(spark, sf_dir)
    return search.nearest_batch(rows, asked(rows), 10, "l2").withColumn("distance", vx.shown("distance"))


@query(f"WITH {_B} SELECT b.id, round({_L2}, 6) + 0.0 AS l2, round({_COS}, 6) + 0.0 AS cosine, round(list_inner_product(q.e, b.e), 6) + 0.0 AS dot FROM b, b q WHERE q.id = 0")
def vector_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base(spark, sf_dir)
    q = F.array(*[F.lit(float(x)) for x in one_vector(rows)])
    return rows.select("id", vx.shown(vx.squared_l2(q, "embedding")).alias("l2"), vx.shown(vx.cosine_distance(q, "embedding")).alias("cosine"), vx.shown(vx.dot(q, "embedding")).alias("dot"))


@query("SELECT vec_id AS id, '[' || array_to_string(list_transform(embedding, lambda x: printf('%.6f', x::DOUBLE)), ',') || ']' AS vector FROM embeddings")
def vector_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select("id", vx.format_vector("embedding").alias("vector"))


@query("SELECT vec_id AS id, CAST(len(embedding) AS INTEGER) AS dim, round(list_sum(list_transform(embedding, lambda x: CAST(printf('%.6f', x::DOUBLE) AS FLOAT)::DOUBLE)), 4) + 0.0 AS total FROM embeddings")
def vector_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals written and read back."""
    back = base(spark, sf_dir).select("id", vx.parse_vector(vx.format_vector("embedding"), 64).alias("v"))
    return back.select("id", F.size("v").alias("dim"), (F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")), 4) + 0.0).alias("total"))


_TRAIN = """e AS (SELECT vec_id AS id, unnest(range(0, 64)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
t AS (SELECT pos, min(x) AS min_val, max(x) AS max_val, CASE WHEN max(x) - min(x) < 1e-10 THEN 1.0 ELSE (max(x) - min(x)) / 255.0 END AS scale FROM e GROUP BY pos),
c AS (SELECT e.id, e.pos, e.x, CAST(trunc(least(greatest((x - min_val) / scale, 0.0), 255.0)) AS INTEGER) AS code, min_val, scale FROM e JOIN t USING (pos))"""


@query(f"WITH {_TRAIN} SELECT CAST(pos AS INTEGER) AS pos, min_val, max_val, scale FROM t")
def sq8_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantization.train(base(spark, sf_dir))


@query(f"WITH {_TRAIN} SELECT id, CAST(pos AS INTEGER) AS pos, code FROM c")
def sq8_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base(spark, sf_dir)
    return quantization.encode(rows, quantization.train(rows)).select("id", F.posexplode("codes").alias("pos", "code"))


@query(f"WITH {_TRAIN} SELECT id, round(sum(power(x - (min_val + code * scale), 2)), 6) + 0.0 AS error FROM c GROUP BY id")
def sq8_roundtrip_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantization.reconstruction_error(base(spark, sf_dir)).select("id", vx.shown("error").alias("error"))


@query(f"WITH {_TRAIN} SELECT a.id, round(sum(power((a.code - b.code) * a.scale, 2)), 6) + 0.0 AS distance FROM c a JOIN c b ON a.pos = b.pos AND b.id = 0 GROUP BY a.id")
def sq8_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base(spark, sf_dir)
    coded = quantization.encode(rows, quantization.train(rows))
    q = coded.where("id = 0").select(F.col("codes").alias("asked"))
    return coded.crossJoin(F.broadcast(q)).select("id", vx.shown(vx.quantized_l2("codes", "asked", "scale")).alias("distance"))


_EXACT = f"""exact AS (SELECT query_id, id FROM (SELECT q.id AS query_id, b.id, row_number() OVER (PARTITION BY q.id ORDER BY {_L2}, b.id) AS rank FROM b, b q WHERE q.id % 100 = 0) WHERE rank <= 10)"""


@query(
    f"""WITH {_TRAIN}, {_B}, {_EXACT},
s AS (SELECT q.id AS query_id, a.id, round(sum(power((a.code - q.code) * a.scale, 2)), 6) AS distance FROM c a JOIN c q ON a.pos = q.pos AND q.id % 100 = 0 GROUP BY q.id, a.id),
found AS (SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM s) WHERE rank <= 10)
SELECT (SELECT count(*) FROM exact JOIN found USING (query_id, id)) AS hits, (SELECT count(*) FROM exact) AS wanted,
  round((SELECT count(*) FROM exact JOIN found USING (query_id, id)) / (SELECT count(*) FROM exact), 6) AS recall"""
)
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall@10 of a search over 8-bit codes against the exact one."""
    rows = base(spark, sf_dir)
    exact = search.nearest_batch(rows, asked(rows), 10, "l2")
    coded = quantization.steps(quantization.encode(rows, quantization.train(rows)))
    return search.recall(exact, search.nearest_batch(coded, asked(coded), 10, "l2"))


@query()
def hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base(spark, sf_dir)
    return ann.search_index(ann.build_index(rows), asked(rows), 10)


@query()
def hnsw_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base(spark, sf_dir)
    return search.recall(search.nearest_batch(rows, asked(rows), 10), ann.search_index(ann.build_index(rows), asked(rows), 10))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a store's log: users are ids, purchases delete, the value and its square are the vector."""
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "purchase", store.DELETE).otherwise(store.SET)
    vector = F.array(F.col("value").cast("float"), F.lit(1.0).cast("float"))
    return e.select(F.col("event_id").alias("seq"), op.alias("op"), F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("id"), vector.alias("embedding"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.toxic = 1 AND l.doc_id = d.doc_id)")
def tombstone_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.without(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id").select("doc_id", "source")


@query()
def store_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered fold with no-op elimination: every node ever stored."""
    return store.nodes(event_log(spark, sf_dir))


@query("SELECT url AS id FROM pages WHERE url GLOB 'http*[0-4]' ORDER BY page_id LIMIT 20")
def hgetall_glob_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select(F.col("url").alias("id"), F.col("page_id").alias("internal_id"))
    return store.scan(p, "http*[0-4]", 20).select("id")


@query("SELECT p_partkey, p_name FROM part WHERE p_name GLOB '*e?[!a-m]*'")
def glob_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(tx.glob("p_name", "*e?[!a-m]*")).select("p_partkey", "p_name")


@query("SELECT unnest(['total_keys', 'live_keys', 'dim', 'last_id']) AS key, unnest([count(*)::VARCHAR, count(*)::VARCHAR, max(len(embedding))::VARCHAR, max(vec_id)::VARCHAR]) AS value FROM embeddings")
def info_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.info(base(spark, sf_dir).withColumn("internal_id", F.col("id")))


@query(
    """WITH s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS place, count(*) OVER () AS n FROM events WHERE value IS NOT NULL)
SELECT 0.95::DOUBLE AS share, value FROM s WHERE place = floor(n * 0.95) UNION ALL SELECT 0.99::DOUBLE, value FROM s WHERE place = floor(n * 0.99)"""
)
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    n = e.where("value IS NOT NULL").count()
    return search.nth_values(e, "value", {s: min(int(n * s), n - 1) for s in (0.95, 0.99)})


_PUNCT = "[!-/:-@\\[-`{-~]"
_NORMAL = "translate(regexp_replace(text, '[[:punct:]]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(f"SELECT doc_id, md5({_NORMAL}) AS normal FROM documents")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.normalize("text")).alias("normal"))


@query("SELECT doc_id, regexp_matches(text, '[^ \\t\\n\\x0B\\f\\r]') AND octet_length(encode(text)) <= 4096 AS valid FROM documents")
def text_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.is_valid("text").alias("valid"))


@query("SELECT doc_id, len(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> '')) AS words FROM documents")
def word_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tx.words("text")).cast("long").alias("words"))


@query(
    f"""WITH w AS (SELECT lang, unnest(list_filter(string_split_regex({_NORMAL}, '[ \\t\\n\\r]+'), lambda x: x <> '')) AS token FROM documents),
c AS (SELECT lang, token, count(*) AS n FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS rank FROM c)
SELECT lang, token, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3"""
)
def token_topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "documents").select("lang", F.explode(F.split(tx.normalize("text"), "[ \\t\\n\\r]+")).alias("token")).where("token <> ''")
    return analysis.top_tokens(tokens, "lang", "token")


@query("SELECT conv_id, turn, 'chats/' || conv_id AS path, conv_id::VARCHAR AS name, turn::VARCHAR AS chunk FROM conversations")
def chunk_id_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyed_by(table(spark, sf_dir, "conversations").withColumn("folder", F.concat(F.lit("chats/"), F.col("conv_id").cast("string"))), "folder", "turn")
    return rows.select("conv_id", "turn", tx.chunk_path("id").alias("path"), tx.chunk_name("id").alias("name"), tx.chunk_number("id").alias("chunk"))


@query("SELECT item_id, 'item ' || item_id AS id, octet_length(encode(text)) AS n_bytes FROM benchmark WHERE strpos(text, chr(10)) = 0")
def import_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id|text`` lines, one with a leading bar and one with bars in the text among them, split again."""
    b = table(spark, sf_dir, "benchmark").where(~F.col("text").contains("\n"))
    lines = b.select(F.concat(F.lit("||item "), F.col("item_id").cast("string"), F.lit("|"), "text").alias("value"))
    return split_lines(lines).select(F.split_part("id", F.lit(" "), F.lit(2)).cast("long").alias("item_id"), "id", F.octet_length("text").cast("long").alias("n_bytes"))


@query(
    """WITH e AS (SELECT label, unnest(range(0, 64)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT label, CAST(pos AS INTEGER) AS pos, round(avg(x), 6) + 0.0 AS mean FROM e GROUP BY label, pos"""
)
def mean_pool_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = mean_pool(base(spark, sf_dir), "label").select("label", F.posexplode("embedding").alias("pos", "x"))
    return pooled.select("label", "pos", vx.shown("x").alias("mean"))


@query(
    """WITH e AS (SELECT vec_id AS id, unnest(range(0, 64)) AS pos, unnest(embedding)::DOUBLE AS x, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)
SELECT id, CAST(pos AS INTEGER) AS pos, round(CASE WHEN n < 1e-12 THEN x ELSE x / n END, 6) + 0.0 AS x FROM e"""
)
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = base(spark, sf_dir).select("id", "embedding", vx.norm("embedding").alias("size"))
    return sized.select("id", F.posexplode(vx.normalised("embedding", "size")).alias("pos", "x")).select("id", "pos", vx.shown("x").alias("x"))


@query("SELECT event_id, round(0.5 * value * (1 + tanh(0.79788456 * (value + 0.044715 * value * value * value))), 6) + 0.0 AS gelu FROM events")
def gelu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", vx.shown(gelu_column(F.col("value"))).alias("gelu"))


@query("WITH s AS (SELECT event_type, avg(value) AS m, var_pop(value) AS v FROM events GROUP BY 1) SELECT event_id, round((value - m) / sqrt(v + 1e-12), 6) + 0.0 AS scaled FROM events JOIN s USING (event_type)")
def layer_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and variance by group, small enough to go back to every row."""
    e = table(spark, sf_dir, "events")
    s = e.groupBy("event_type").agg(F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    return e.join(s, "event_type").select("event_id", vx.shown((F.col("value") - F.col("m")) / F.sqrt(F.col("v") + 1e-12)).alias("scaled"))


@query("WITH e AS (SELECT event_type, value, max(value) OVER (PARTITION BY event_type) AS top FROM events), s AS (SELECT event_type, sum(exp(value - top)) AS total, max(top) AS top FROM e GROUP BY 1) SELECT event_type, round(top, 6) + 0.0 AS top, round(total, 6) + 0.0 AS total FROM s")
def softmax_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of a stable softmax by group: the maximum and the sum of exp(x - maximum)."""
    e = table(spark, sf_dir, "events")
    top = e.groupBy("event_type").agg(F.max("value").alias("top"))
    return e.join(top, "event_type").groupBy("event_type").agg(vx.shown(F.max("top")).alias("top"), vx.shown(F.sum(F.exp(F.col("value") - F.col("top")))).alias("total"))


@query(
    f"""WITH {_B}, n AS (SELECT q.id AS query_id, b.label, row_number() OVER (PARTITION BY q.id ORDER BY {_COS}, b.id) AS rank, q.label AS expected FROM b, b q WHERE q.id % 100 = 0 AND b.id <> q.id),
p AS (SELECT query_id, max(CASE WHEN label = expected AND rank = 1 THEN 1 ELSE 0 END) AS f, max(CASE WHEN label = expected THEN 1 ELSE 0 END) AS a FROM n WHERE rank <= 3 GROUP BY 1)
SELECT count(*) AS queries, round(avg(f), 6) AS top1, round(avg(a), 6) AS top3 FROM p"""
)
def retrieval_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a vector's nearest others carry its label."""
    rows = base(spark, sf_dir)
    found = search.nearest_batch(rows, asked(rows), 4).where("id <> query_id").join(rows.select("id", "label"), "id")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    found = found.select("query_id", F.col("label").alias("id"), F.row_number().over(order).alias("rank"))
    return search.retrieval_accuracy(found, rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("label").alias("expected_id")))


@query()
def embed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", embed_column("text", HashedNgrams(64)).alias("embedding"))


@query()
def tsearch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text search: benchmark items against the embedded documents."""
    embedder = HashedNgrams(64)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), embed_column("text", embedder).alias("embedding"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), embed_column("text", embedder).alias("embedding"))
    return search.nearest_batch(docs, items, 10, threshold=search.THRESHOLD)


@query()
def wordpiece_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of whole texts by a small vocabulary of letters and frequent pairs."""
    pieces = [" ", *"abcdefghijklmnopqrstuvwxyz", *(f" {c}" for c in "abcdefghijklmnopqrstuvwxyz"), "th", "er", "on", "an", "re", "en", "the", " the"]
    return table(spark, sf_dir, "documents").select("doc_id", tx.wordpieces("text", {p: k + 3 for k, p in enumerate(pieces)}, max_length=None).alias("tokens"))


@query()
def kmeans_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.kmeans(base(spark, sf_dir)).select("id", "cluster")


@query()
def pca_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.pca(base(spark, sf_dir)).select("id", "x", "y", "z")


@query(
    """WITH w AS (SELECT lang, unnest(list_filter(string_split_regex(regexp_replace(lower(text), '[^\\p{L}\\p{N}\\s]', ' ', 'g'), '\\s+'), lambda x: length(x) > 2 AND NOT regexp_full_match(x, '[0-9]+'))) AS token FROM documents),
c AS (SELECT lang, token, count(*) AS n FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS rank FROM c WHERE token NOT IN ('the', 'and', 'that'))
SELECT lang, 'Grupo ' || lang || ': ' || string_agg(upper(token[1]) || token[2:], ' | ' ORDER BY rank) AS label FROM r WHERE rank <= 3 GROUP BY lang"""
)
def cluster_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.cluster_labels(table(spark, sf_dir, "documents"), "text", "lang", ("the", "and", "that"))
