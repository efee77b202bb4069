"""Answer caches as joins: exact with time to live and epoch, and by similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators.search import dense_topk
from lodestone.operators.texts import normalized_query
from lodestone.sources.tables import table

# Time to live, least similarity, neighbours looked at.
TTL_S, SIMILAR, NEIGHBOURS = 86_400, 0.97, 4


def exact_hits(probes: DataFrame, entries: DataFrame, ttl_s: int = TTL_S) -> DataFrame:
    """probe_id, hit: whether an entry of the same key and epoch was set at most ``ttl_s`` before.

    ``probes``: probe_id, key, epoch, ts; ``entries``: key, epoch, set_ts.  Both are merged into one
    ordered stream per key, and each probe looks at the last entry before it: an as-of join without
    a range join, whose cost does not grow with the entries of a key.
    """
    p = probes.select("key", "epoch", F.col("ts").alias("t"), "probe_id", F.lit(None).cast("timestamp").alias("set_ts"))
    e = entries.select("key", "epoch", F.col("set_ts").alias("t"), F.lit(None).cast(probes.schema["probe_id"].dataType).alias("probe_id"), "set_ts")
    w = Window.partitionBy("key", "epoch").orderBy("t", F.col("probe_id").isNull().cast("int")).rowsBetween(Window.unboundedPreceding, -1)
    x = p.unionByName(e).withColumn("last", F.last("set_ts", ignorenulls=True).over(w)).where("probe_id IS NOT NULL")
    fresh = F.unix_micros("t") - F.unix_micros("last") <= F.lit(ttl_s * 1_000_000)
    return x.select("probe_id", F.coalesce(fresh, F.lit(False)).alias("hit"))


def q_exact_cache(spark: SparkSession, root: str) -> DataFrame:
    """Events that repeat an earlier one's properties within the time to live, per kind of event."""
    e = table(spark, root, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "props")
    probes = e.select(F.col("event_id").alias("probe_id"), F.concat_ws("|", "event_type", "props").alias("key"), F.lit(1).alias("epoch"), "ts", "event_type")
    hits = exact_hits(probes, probes.select("key", "epoch", F.col("ts").alias("set_ts")))
    return hits.join(e.select(F.col("event_id").alias("probe_id"), "event_type"), "probe_id").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))


def q_semantic_cache(spark: SparkSession, root: str) -> DataFrame:
    """Vectors whose id is divisible by 20 that a vector set earlier answers: the first by similarity over the threshold."""
    e = table(spark, root, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    near = dense_topk(q, e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v")), NEIGHBOURS, 64)
    return near.where("score >= 0.3").groupBy("query_id").agg(F.min_by("item_id", "rank").alias("answer"), F.max("score").alias("score"))


def q_cache_keys(spark: SparkSession, root: str) -> DataFrame:
    """Cache keys of file names: hash of the raw text against hash of the normal form."""
    d = table(spark, root, "documents").where("filename IS NOT NULL")
    return d.groupBy("kb_id").agg(F.count_distinct(F.sha2("filename", 256)).alias("raw_keys"), F.count_distinct(F.sha2(normalized_query(F.col("filename")), 256)).alias("normal_keys"))


QUERIES = {"exact_cache_ttl": q_exact_cache, "semantic_cache_lookup": q_semantic_cache, "cache_keys": q_cache_keys}

from lodestone.operators.search import _dense_sql  # noqa: E402
from lodestone.operators.texts import STOPWORDS  # noqa: E402

_NQ = f"array_to_string(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(filename), '[-_/]', ' ', 'g'), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g'), '\\s+'), lambda w: length(w) > 1 AND w NOT IN ({', '.join(repr(w) for w in STOPWORDS)})), ' ')"
ORACLE = {
    "exact_cache_ttl": """SELECT event_type, count(*) AS n, count(*) FILTER (epoch_us(ts) - epoch_us(p) <= 86400000000) AS hits FROM (SELECT event_type, ts, lag(ts) OVER (PARTITION BY event_type, props ORDER BY ts) AS p FROM events) GROUP BY 1""",
    "semantic_cache_lookup": f"SELECT query_id, min_by(item_id, rank) AS answer, max(score) AS score FROM ({_dense_sql(4, '')}) WHERE score >= 0.3 GROUP BY 1",
    "cache_keys": f"SELECT kb_id, count(DISTINCT sha256(filename)) AS raw_keys, count(DISTINCT sha256({_NQ})) AS normal_keys FROM documents WHERE filename IS NOT NULL GROUP BY 1",
}
