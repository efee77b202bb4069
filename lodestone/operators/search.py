"""Retrieval over tables of queries: dense and keyword top-k, fusion, reranking, assembly with citations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import token_count
from lodestone.operators.predicate import compile_filter
from lodestone.sources.tables import table

#: Bytes of query vectors that are sent to all executors at once; more are taken in blocks.
QUERY_BYTES = 32 << 20
#: Different query words, or phrases, that are looked for while texts are read.
QUERY_WORDS = 1000
# BM25, fusion and assembly.
K1, B = 1.2, 0.75
RRF_K, WEIGHTS = 60, {"dense": 1.0, "bm25": 1.0, "graph_low": 0.8, "graph_high": 0.6}
BUDGET, RERANK_WINDOW, RERANK_TOP, SNIPPET = 4096, 20, 8, 200

#: Queries of the reports: whole tables are searched for each.
PHRASES = [("q1", "retrieval gateway"), ("q2", "supplier note"), ("q3", "Schlüsselverwaltung"), ("q4", "向量仓库"), ("q5", "límites de sesión"), ("q6", "the default thresholds")]


def query_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PHRASES, "query_id string, query string")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of equal length; 0 if either is all zero.  The definition; bulk work is done as matrices."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int, dim: int) -> DataFrame:
    """query_id, item_id, score, rank: the ``k`` nearest items of each query, itself left out; ties by item_id.

    ``queries``: query_id, v; ``vectors``: item_id, v.  Vectors of another length or null are left
    out.  Queries are compared in blocks of QUERY_BYTES: each block goes to the executors, each
    partition of the vectors answers with its own top k as a matrix product, and only those are shuffled.
    """
    spark = queries.sparkSession
    ok = lambda d: d.where(F.col("v").isNotNull() & (F.size("v") == dim))
    q = ok(queries).select("query_id", F.col("v").cast("array<double>").alias("v"))
    per = max(1, QUERY_BYTES // (dim * 8))
    n_blocks = max(1, -(-q.count() // per))
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, item_id {vectors.schema['item_id'].dataType.simpleString()}, score double"
    out = None
    for block in range(n_blocks):
        rows = q.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == block).collect()  # at most about QUERY_BYTES
        if not rows:
            continue
        m = np.array([r[1] for r in rows], dtype=np.float64).reshape(-1, dim)
        sent = spark.sparkContext.broadcast(([r[0] for r in rows], m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)))
        out_block = ok(vectors).select("item_id", F.col("v").cast("array<double>").alias("v")).mapInArrow(_partition_topk(sent, k, dim), schema)
        out = out_block if out is None else out.unionByName(out_block)
    if out is None:
        return spark.createDataFrame([], schema + ", rank int")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "item_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "item_id", F.round("score", 6).alias("score"), "rank")


def _partition_topk(sent, k: int, dim: int):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, m = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            s = m @ np.where(norm > 0, x / np.where(norm > 0, norm, 1), 0).T
            item = b.column("item_id").to_pylist()
            # rows of rounded ties with the k-th stay, so that the order by id is exact
            r = np.round(s, 6)
            n = min(k + 1, r.shape[1])
            kth = -np.partition(-r, n - 1, axis=1)[:, n - 1]
            i, j = np.nonzero(r >= kth[:, None])
            keep = np.array([ids[a] != item[c] for a, c in zip(i, j, strict=True)], bool)
            i, j = i[keep], j[keep]
            yield pa.RecordBatch.from_arrays([pa.array([ids[a] for a in i]), pa.array([item[c] for c in j]), pa.array(s[i, j])], names=["query_id", "item_id", "score"])

    return run


def word_list(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def _corpus(d: DataFrame, length: Column) -> tuple[float, float]:
    """Number of texts and their mean length: two numbers that the scores take as constants."""
    r = d.agg(F.count("*"), F.avg(length)).first()
    return float(r[0]), float(r[1] or 1.0)


def token_bm25(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, score, rank by the words in common (any of the query's), scores squashed to s/(1+s).

    Up to QUERY_WORDS different words are filtered for while the texts are read, so that only their
    postings are shuffled; more are joined with all postings by word.
    """
    d = docs.where(F.col("text").isNotNull()).select("doc_id", word_list(F.col("text")).alias("w"))
    n_docs, avg_len = _corpus(d, F.size("w"))
    terms = queries.select("query_id", F.explode(F.array_distinct(word_list(F.col("query")))).alias("term"))
    words = [r[0] for r in terms.select("term").distinct().limit(QUERY_WORDS + 1).collect()]
    hit = d.select("doc_id", F.size("w").alias("len"), "w")
    if len(words) <= QUERY_WORDS:
        wanted = F.array(*map(F.lit, words)).cast("array<string>")
        hit = hit.withColumn("w", F.filter("w", lambda x: F.array_contains(wanted, x)))
    posts = hit.select("doc_id", "len", F.explode("w").alias("term")).groupBy("term", "doc_id", "len").agg(F.count("*").alias("tf"))
    df = posts.groupBy("term").agg(F.count("*").alias("df"))
    x = terms.join(posts, "term").join(df, "term")
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / avg_len))
    s = x.groupBy("query_id", "doc_id").agg(F.sum(part).alias("s")).select("query_id", "doc_id", F.round(F.col("s") / (1 + F.col("s")), 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def phrase_bm25(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, score, rank by the query as one phrase: substring without case, three characters at least.

    Frequencies are over all texts; a text's length is its number of trigrams.  Each text is tested
    against the queries as it is read, in blocks of QUERY_WORDS queries.
    """
    d = docs.where(F.col("text").isNotNull()).select("doc_id", F.lower("text").alias("t"), F.greatest(F.length("text") - 2, F.lit(0)).alias("len"))
    n_docs, avg_len = _corpus(d, F.col("len"))
    id_type = queries.schema["query_id"].dataType
    every = queries.where(F.length("query") >= 3).select("query_id", F.lower("query").alias("q")).collect()  # the stated queries
    hits = None
    for at in range(0, max(1, len(every)), QUERY_WORDS):
        block = every[at : at + QUERY_WORDS]
        known = F.array(*[F.struct(F.lit(r[0]).cast(id_type).alias("id"), F.lit(r[1]).alias("q")) for r in block]) if block else F.array().cast(f"array<struct<id:{id_type.simpleString()},q:string>>")
        x = d.withColumn("x", F.explode(F.filter(known, lambda r: F.contains(F.col("t"), r["q"]))))  # noqa: B023
        tf = ((F.length("t") - F.length(F.replace(F.col("t"), F.col("x.q"), F.lit("")))) / F.length("x.q")).cast("int")
        x = x.select(F.col("x.id").alias("query_id"), "doc_id", "len", tf.alias("tf"))
        hits = x if hits is None else hits.unionByName(x)
    df = hits.groupBy("query_id").agg(F.count("*").alias("df"))
    x = hits.join(df, "query_id")
    raw = F.log((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(raw <= 0, F.lit(1e-6)).otherwise(raw)
    s = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / avg_len))
    s = x.select("query_id", "doc_id", F.round(s, 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fuse_ranks(hits: DataFrame, order: str = "score") -> DataFrame:
    """query_id, chunk_id, rrf, score (0 to 1 within the query), sources, rank, from hits of several routes.

    ``hits``: query_id, chunk_id, route, rank.  Reciprocal ranks are weighted by route and summed;
    equal sums give score 0.  ``order='insertion'`` ranks by route and rank of the first mention instead.
    """
    weight = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    one = hits.groupBy("query_id", "chunk_id").agg(
        F.sum(weight[F.col("route")] / (RRF_K + F.col("rank"))).alias("rrf"), F.array_sort(F.collect_set("route")).alias("sources"),
        F.min(F.struct(F.array_position(F.array(*map(F.lit, WEIGHTS)), F.col("route")), F.col("rank"))).alias("first"),
    )
    q = Window.partitionBy("query_id")
    lo, hi = F.min("rrf").over(q), F.max("rrf").over(q)
    scored = one.withColumn("score", F.when(hi == lo, F.lit(0.0)).otherwise((F.col("rrf") - lo) / (hi - lo)))
    key = [F.col("first")] if order == "insertion" else [F.desc(F.round("score", 6))]
    return scored.withColumn("rank", F.row_number().over(q.orderBy(*key, "chunk_id"))).drop("first")


def fuse_weighted(hits: DataFrame) -> DataFrame:
    """query_id, chunk_id, score: scores scaled to 0..1 within each route, weighted and summed."""
    weight = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    r = Window.partitionBy("query_id", "route")
    lo, hi = F.min("score").over(r), F.max("score").over(r)
    scaled = hits.withColumn("scaled", F.when(hi == lo, F.lit(0.0)).otherwise((F.col("score") - lo) / (hi - lo)))
    return scaled.groupBy("query_id", "chunk_id").agg(F.sum(weight[F.col("route")] * F.col("scaled")).alias("score"))


def overlap_rerank(hits: DataFrame, queries: DataFrame, texts: DataFrame, window: int = RERANK_WINDOW, top: int = RERANK_TOP) -> DataFrame:
    """The first ``window`` hits of each query by the share of its words that the text holds; ties by rank."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "\\s+"), lambda w: w != ""))
    x = hits.where(F.col("rank") <= window).join(queries, "query_id").join(texts, "chunk_id")
    q = words(F.col("query"))
    x = x.withColumn("rerank", F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, words(F.col("text")))) / F.size(q)))
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank"), "rank")
    return x.withColumn("new_rank", F.row_number().over(w)).where(F.col("new_rank") <= top)


def assemble(hits: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The hits that fit the budget: text routes first, then those with a graph route, each pool up to its first overflow.

    ``hits``: query_id, chunk_id, rank, sources, token_count.  The second pool starts from what the first used.
    """
    graph = F.exists("sources", lambda s: F.startswith(s, F.lit("graph")))
    h = hits.withColumn("pool", F.when(graph, 1).otherwise(0))
    w = Window.partitionBy("query_id", "pool").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("run", F.sum("token_count").over(w))
    used = h.where((F.col("pool") == 0) & (F.col("run") <= budget)).groupBy("query_id").agg(F.max("run").alias("used"))
    h = h.join(used, "query_id", "left").withColumn("total", F.col("run") + F.when(F.col("pool") == 1, F.coalesce("used", F.lit(0))).otherwise(0))
    return h.where(F.col("total") <= budget).drop("used", "run")


def _chunk_texts(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "chunks").where("chunk_id IS NOT NULL AND text IS NOT NULL")
    return c.groupBy("chunk_id").agg(F.max_by(F.struct("text", "doc_id", "page"), F.struct("version", "text")).alias("x")).select("chunk_id", "x.*")


def _dense(spark: SparkSession, root: str, k: int = 10, expr: dict | None = None) -> DataFrame:
    e = table(spark, root, "embeddings")
    v = e.where(compile_filter(expr, e)) if expr else e
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    return dense_topk(q, v.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v")), k, 64)


def q_dense_topk(spark: SparkSession, root: str) -> DataFrame:
    """The 10 nearest vectors of every vector whose id is divisible by 20, among all."""
    return _dense(spark, root)


def q_dense_filtered(spark: SparkSession, root: str) -> DataFrame:
    """The same among the vectors that pass a filter."""
    return _dense(spark, root, 5, {"and": [{"field": "label", "op": "le", "value": 4}]})


def q_entity_match(spark: SparkSession, root: str) -> DataFrame:
    """Neighbours above a threshold with the same label: candidates to be merged."""
    e = table(spark, root, "embeddings").select("vec_id", "label")
    d = _dense(spark, root, 5).where("score >= 0.25")
    return d.join(e.toDF("query_id", "a"), "query_id").join(e.toDF("item_id", "b"), "item_id").where("a = b").select("query_id", "item_id", "score")


def q_token_bm25(spark: SparkSession, root: str) -> DataFrame:
    """The 20 best documents for each query, by words."""
    return token_bm25(query_table(spark), table(spark, root, "documents"), 20)


def q_phrase_bm25(spark: SparkSession, root: str) -> DataFrame:
    """The 20 best documents for each query, as a phrase."""
    return phrase_bm25(query_table(spark), table(spark, root, "documents"), 20)


def _routes(spark: SparkSession, root: str) -> DataFrame:
    docs = _chunk_texts(spark, root).select(F.col("chunk_id").alias("doc_id"), "text")
    q = query_table(spark)
    a = token_bm25(q, docs, 20).withColumn("route", F.lit("bm25"))
    b = phrase_bm25(q, docs, 20).withColumn("route", F.lit("dense"))
    return a.unionByName(b).withColumnRenamed("doc_id", "chunk_id")


def q_rrf(spark: SparkSession, root: str) -> DataFrame:
    """Chunks found by words and by phrase, fused by reciprocal ranks."""
    f = fuse_ranks(_routes(spark, root))
    return f.select("query_id", "chunk_id", F.round("rrf", 6).alias("rrf"), F.round("score", 6).alias("score"), F.concat_ws(",", "sources").alias("sources"), "rank")


def q_weighted(spark: SparkSession, root: str) -> DataFrame:
    """The same routes fused by scaled scores."""
    return fuse_weighted(_routes(spark, root)).withColumn("score", F.round("score", 5))


def q_rerank(spark: SparkSession, root: str) -> DataFrame:
    """Fused chunks reranked by word overlap."""
    texts = _chunk_texts(spark, root).select("chunk_id", "text")
    r = overlap_rerank(fuse_ranks(_routes(spark, root)).select("query_id", "chunk_id", "rank"), query_table(spark), texts)
    return r.select("query_id", "chunk_id", F.round("rerank", 6).alias("rerank"), "new_rank")


def _assembled(spark: SparkSession, root: str) -> DataFrame:
    texts = _chunk_texts(spark, root).withColumn("token_count", token_count(F.col("text")))
    f = fuse_ranks(_routes(spark, root)).where("rank <= 20")
    # hits of the phrase route stand in for the graph's
    f = f.withColumn("sources", F.when(F.array_contains("sources", "dense") & (F.size("sources") == 1), F.array(F.lit("graph_low"))).otherwise(F.col("sources")))
    return assemble(f.join(texts, "chunk_id"), 1024)


def q_assemble(spark: SparkSession, root: str) -> DataFrame:
    """Chunks that fit a budget of 1024 tokens for each query."""
    return _assembled(spark, root).select("query_id", "chunk_id", "pool", "rank", "total")


def q_citations(spark: SparkSession, root: str) -> DataFrame:
    """Citations of the assembled chunks: file name, page, snippet."""
    d = table(spark, root, "documents").select("doc_id", "filename")
    a = _assembled(spark, root).join(d, "doc_id", "left")
    return a.select("query_id", "chunk_id", "doc_id", F.coalesce("filename", F.lit("")).alias("filename"), "page", F.md5(F.substring("text", 1, SNIPPET)).alias("snippet"), F.round("score", 6).alias("score"))


QUERIES = {
    "dense_topk": q_dense_topk, "dense_topk_filtered": q_dense_filtered, "entity_match": q_entity_match, "keyword_token_bm25": q_token_bm25, "keyword_phrase_bm25": q_phrase_bm25,
    "rrf_fusion": q_rrf, "weighted_fusion": q_weighted, "overlap_rerank": q_rerank, "assemble_budget": q_assemble, "citations": q_citations,
}


def _dense_sql(k: int, where: str) -> str:
    return f"""SELECT query_id, item_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM (
SELECT q.vec_id AS query_id, v.vec_id AS item_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score
FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id {where})) WHERE rank <= {k}"""


_Q = "q(query_id, query) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in PHRASES) + ")"


def _token_sql(src: str) -> str:
    return f"""d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM {src} WHERE text IS NOT NULL), st AS (SELECT count(*) AS n, avg(len(w)) AS al FROM d),
t AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}]+')) AS term FROM q),
p AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM t) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
ts AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))) AS s FROM t JOIN p USING (term) JOIN f USING (term), st GROUP BY 1, 2),
tr AS (SELECT query_id, doc_id, round(s / (1 + s), 6) AS score FROM ts),
tk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM tr) WHERE rank <= 20)"""


def _phrase_sql(src: str) -> str:
    return f"""e AS (SELECT doc_id, lower(text) AS t, greatest(length(text) - 2, 0) AS len FROM {src} WHERE text IS NOT NULL), se AS (SELECT count(*) AS n, avg(len) AS al FROM e),
h AS (SELECT query_id, doc_id, len, (length(t) - length(replace(t, lower(query), ''))) // length(query) AS tf FROM e, q WHERE contains(t, lower(query))),
g AS (SELECT query_id, count(*) AS df FROM h GROUP BY 1),
ps AS (SELECT query_id, doc_id, round((CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al)), 6) AS score FROM h JOIN g USING (query_id), se),
pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ps) WHERE rank <= 20)"""


_C = "c AS (SELECT chunk_id, chunk_id AS doc_id, x.text AS text, x.doc_id AS of_doc, x.page AS page FROM (SELECT chunk_id, max_by({'text': text, 'doc_id': doc_id, 'page': page}, {'v': version, 't': text}) AS x FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL GROUP BY 1))"
_R = f"{_Q}, {_C}, {_token_sql('c')}, {_phrase_sql('c')}, r AS (SELECT query_id, doc_id AS chunk_id, 'bm25' AS route, score, rank FROM tk UNION ALL SELECT query_id, doc_id, 'dense', score, rank FROM pk)"
_F = _R + """, o AS (SELECT query_id, chunk_id, sum(1.0 / (60 + rank)) AS rrf, list_sort(list(DISTINCT route)) AS sources FROM r GROUP BY 1, 2),
n AS (SELECT *, min(rrf) OVER (PARTITION BY query_id) AS lo, max(rrf) OVER (PARTITION BY query_id) AS hi FROM o),
s AS (SELECT query_id, chunk_id, rrf, CASE WHEN hi = lo THEN 0.0 ELSE (rrf - lo) / (hi - lo) END AS score, sources FROM n),
fu AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM s)"""
_TOKENS = "(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, len(regexp_extract_all(text, '[A-Za-z0-9_`]+')) + (length(regexp_replace(text, '[A-Za-z0-9_`]+', '', 'g')) - w) // 4 + w) END)"
_WIDE = "(length(text) - length(regexp_replace(text, '[\\x{3040}-\\x{30ff}\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}\\x{ff00}-\\x{ffef}]', '', 'g')))"
_A = _F + f""", a0 AS (SELECT query_id, chunk_id, rank, score, of_doc, page, text, {_WIDE} AS w, CASE WHEN sources = ['dense'] THEN 1 ELSE 0 END AS pool FROM fu JOIN c USING (chunk_id) WHERE rank <= 20),
a1 AS (SELECT *, sum({_TOKENS}) OVER (PARTITION BY query_id, pool ORDER BY rank) AS run FROM a0),
a2 AS (SELECT query_id, max(run) AS used FROM a1 WHERE pool = 0 AND run <= 1024 GROUP BY 1),
a3 AS (SELECT a1.*, CAST(run + CASE WHEN pool = 1 THEN coalesce(used, 0) ELSE 0 END AS BIGINT) AS total FROM a1 LEFT JOIN a2 USING (query_id))"""
ORACLE = {
    "dense_topk": _dense_sql(10, ""),
    "dense_topk_filtered": _dense_sql(5, "AND v.label <= 4"),
    "entity_match": f"SELECT query_id, item_id, score FROM ({_dense_sql(5, '')}) x JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = item_id WHERE score >= 0.25 AND a.label = b.label",
    "keyword_token_bm25": f"WITH {_Q}, {_token_sql('documents')} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM tk",
    "keyword_phrase_bm25": f"WITH {_Q}, {_phrase_sql('documents')} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM pk",
    "rrf_fusion": f"WITH {_F} SELECT query_id, chunk_id, round(rrf, 6) AS rrf, round(score, 6) AS score, array_to_string(sources, ',') AS sources, CAST(rank AS INTEGER) AS rank FROM fu",
    "weighted_fusion": f"WITH {_R} SELECT query_id, chunk_id, round(sum(CASE WHEN hi = lo THEN 0.0 ELSE (score - lo) / (hi - lo) END), 5) AS score FROM (SELECT *, min(score) OVER (PARTITION BY query_id, route) AS lo, max(score) OVER (PARTITION BY query_id, route) AS hi FROM r) GROUP BY 1, 2",
    "overlap_rerank": f"""WITH {_F}, x AS (SELECT query_id, chunk_id, rank, list_distinct(list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda w: w <> '')) AS qw, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS tw FROM fu JOIN q USING (query_id) JOIN c USING (chunk_id) WHERE rank <= 20),
y AS (SELECT *, len(list_intersect(qw, tw)) / len(qw) AS rr FROM x)
SELECT query_id, chunk_id, round(rr, 6) AS rerank, CAST(new_rank AS INTEGER) AS new_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rr DESC, rank) AS new_rank FROM y) WHERE new_rank <= 8""",
    "assemble_budget": f"WITH {_A} SELECT query_id, chunk_id, CAST(pool AS INTEGER) AS pool, CAST(rank AS INTEGER) AS rank, total FROM a3 WHERE total <= 1024",
    "citations": f"WITH {_A} SELECT query_id, chunk_id, of_doc AS doc_id, coalesce(filename, '') AS filename, page, md5(substring(a3.text, 1, 200)) AS snippet, round(score, 6) AS score FROM a3 LEFT JOIN documents d ON d.doc_id = of_doc WHERE total <= 1024",
}
