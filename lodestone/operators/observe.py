"""Metrics, traces, spans, evaluation and regression gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators.ledger import calls
from lodestone.sources.tables import table

# Histogram bounds, tolerance.
BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0]
TOLERANCE = 0.05


def histogram(df: DataFrame, by: str, value: str) -> DataFrame:
    """Cumulative counts at the fixed bounds and infinity: one pass, one row a group, then one row a bound."""
    sums = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(BOUNDS)]
    wide = df.groupBy(by).agg(*sums, F.count(value).alias("all"))
    rows = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(BOUNDS)], F.struct(F.lit(float("inf")).alias("le"), F.col("all").alias("n")))
    return wide.select(by, F.explode(rows).alias("x")).select(by, "x.le", "x.n")


def quantile_of_histogram(h: DataFrame, by: str, q: float) -> DataFrame:
    """Linear interpolation within the bucket that the quantile falls into; the last finite bound beyond it."""
    w = Window.partitionBy(by).orderBy("le")
    x = h.withColumn("lo", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("below", F.coalesce(F.lag("n").over(w), F.lit(0))).withColumn("total", F.max("n").over(Window.partitionBy(by)))
    hit = x.where((F.col("n") >= q * F.col("total")) & (F.col("below") < q * F.col("total")))
    v = F.when(F.col("le") == float("inf"), F.col("lo")).otherwise(F.col("lo") + (F.col("le") - F.col("lo")) * (q * F.col("total") - F.col("below")) / (F.col("n") - F.col("below")))
    return hit.select(by, v.alias("value"))


def _latency(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").select("event_type", "user_id", "ts", (F.col("value") / 10).alias("seconds"))


def q_histogram(spark: SparkSession, root: str) -> DataFrame:
    """Latency histogram of each kind of event."""
    return histogram(_latency(spark, root), "event_type", "seconds").withColumn("le", F.format_string("%.3f", "le"))


def q_quantiles(spark: SparkSession, root: str) -> DataFrame:
    """Exact latency quantiles of each kind of event."""
    q = [F.round(F.expr(f"percentile_cont({p}) WITHIN GROUP (ORDER BY seconds)"), 6).alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)]
    return _latency(spark, root).groupBy("event_type").agg(*q)


def q_histogram_quantile(spark: SparkSession, root: str) -> DataFrame:
    """The 95th percentile read off the histogram."""
    return quantile_of_histogram(histogram(_latency(spark, root), "event_type", "seconds"), "event_type", 0.95).withColumn("value", F.round("value", 6))


def q_counters(spark: SparkSession, root: str) -> DataFrame:
    """Counters of calls and tokens by labels."""
    c = calls(spark, root)
    t = F.greatest(F.coalesce("prompt_tokens", F.lit(0)), F.lit(0)) + F.greatest(F.coalesce("completion_tokens", F.lit(0)), F.lit(0))
    return c.groupBy("role", "provider", F.when(F.col("ok"), "ok").otherwise("error").alias("outcome")).agg(F.count("*").alias("n"), F.sum(t).alias("tokens"))


def q_exposition(spark: SparkSession, root: str) -> DataFrame:
    """Counters as lines of the text format."""
    c = calls(spark, root).groupBy("model").agg(F.count("*").alias("n"))
    return c.select(F.format_string('llm_calls_total{model="%s"} %d', F.col("model"), F.col("n")).alias("line"))


def q_cache_ratio(spark: SparkSession, root: str) -> DataFrame:
    """Share of cached calls of each role."""
    return calls(spark, root).groupBy("role").agg(F.round(F.avg(F.col("cached").cast("int")), 6).alias("ratio"))


def q_rates(spark: SparkSession, root: str) -> DataFrame:
    """Events in windows of five minutes."""
    e = table(spark, root, "events")
    return e.groupBy(F.window("ts", "5 minutes").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.unix_timestamp("w.start").alias("start_s"), "event_type", "n")


def q_traces(spark: SparkSession, root: str) -> DataFrame:
    """Calls of each trace rolled up: tokens, cost, failures, roles in order of time."""
    c = calls(spark, root).where("trace_id IS NOT NULL")
    pos = lambda x: F.greatest(F.coalesce(x, F.lit(0)), F.lit(0))
    return c.groupBy("trace_id").agg(
        F.count("*").alias("n"), F.sum(pos("prompt_tokens") + pos("completion_tokens")).alias("tokens"), F.round(F.sum(F.coalesce("cost_usd", F.lit(0.0))), 6).alias("usd"),
        F.bool_or(~F.col("ok")).alias("failed"), F.concat_ws(">", F.array_sort(F.collect_set("role"))).alias("roles"),
    )


def q_trace_ttl(spark: SparkSession, root: str) -> DataFrame:
    """Calls of each day that are kept: those of the 7 days before the newest."""
    c = calls(spark, root)
    now = c.agg(F.max(F.unix_micros("ts"))).first()[0] or 0
    kept = c.where(F.unix_micros("ts") >= now - 7 * 86_400_000_000)
    return kept.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def q_spans(spark: SparkSession, root: str) -> DataFrame:
    """Stages of each task as spans: the time from each to the next, per stage."""
    c = table(spark, root, "checkpoints").select("task_id", "stage", "started_at").distinct()
    w = Window.partitionBy("task_id").orderBy("started_at", "stage")
    s = c.withColumn("ms", (F.unix_micros(F.lead("started_at").over(w)) - F.unix_micros("started_at")) / 1000).withColumn("depth", F.row_number().over(w))
    return s.groupBy("stage", "depth").agg(F.count("*").alias("n"), F.round(F.avg("ms"), 3).alias("mean_ms"))


def q_stage_progress(spark: SparkSession, root: str) -> DataFrame:
    """Tasks by status and number of stages checkpointed; a stage that produced nothing counts as done."""
    t = table(spark, root, "tasks").select("task_id", "status").distinct()
    c = table(spark, root, "checkpoints").select("task_id", "stage").distinct().groupBy("task_id").agg(F.count("*").alias("stages"))
    return t.join(c, "task_id", "left").groupBy("status", F.coalesce("stages", F.lit(0)).alias("stages")).agg(F.count("*").alias("n"))


def q_latest_task(spark: SparkSession, root: str) -> DataFrame:
    """The newest task of each document."""
    t = table(spark, root, "tasks").where("doc_id IS NOT NULL")
    return t.groupBy("doc_id").agg(F.max_by(F.struct("task_id", "status"), F.struct("created_at", "task_id")).alias("x")).select("doc_id", "x.task_id", "x.status")


def q_health(spark: SparkSession, root: str) -> DataFrame:
    """Whether every provider answered more often than not, and all together."""
    c = calls(spark, root).groupBy("provider").agg((F.avg(F.col("ok").cast("int")) > 0.5).alias("ok"))
    return c.agg(F.bool_and("ok").alias("healthy"), F.count("*").alias("checks"))


def q_row_counts(spark: SparkSession, root: str) -> DataFrame:
    """Rows and keys of the stores per knowledge base."""
    c = table(spark, root, "chunks").groupBy("kb_id").agg(F.count("*").alias("chunk_rows"), F.count_distinct("chunk_id").alias("chunks"))
    v = table(spark, root, "vector_sqlite").groupBy("kb_id").agg(F.count("*").alias("vector_rows"), F.count_distinct("chunk_id").alias("vectors"))
    return c.join(v, "kb_id", "full")


def citation_f1(got: Column, expected: Column) -> Column:
    """F1 of distinct ids; null where none is expected, 0 where none was given."""
    g, e = F.array_distinct(got), F.array_distinct(expected)
    both = F.size(F.array_intersect(g, e))
    return F.when(F.size(e) == 0, F.lit(None).cast("double")).when((F.size(g) == 0) | (both == 0), F.lit(0.0)).otherwise(2.0 * both / (F.size(g) + F.size(e)))


def q_citation_f1(spark: SparkSession, root: str) -> DataFrame:
    """Atoms that chunks cite against the atoms of their document."""
    c = table(spark, root, "chunks").where("doc_id IS NOT NULL AND atom_ids IS NOT NULL").groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("atom_ids")))).alias("got"))
    a = table(spark, root, "atoms").where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.array_sort(F.collect_set("atom_id")).alias("expected"))
    return c.join(a, "doc_id").select("doc_id", F.round(citation_f1(F.col("got"), F.col("expected")), 6).alias("f1"))


def regression(now: DataFrame, base: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """key, metric, drop, failed: metrics that fell by more than the tolerance (or rose, for hallucination)."""
    x = now.join(base.withColumnRenamed("value", "base"), ["key", "metric"])
    d = F.when(F.col("metric") == "hallucination", F.col("value") - F.col("base")).otherwise(F.col("base") - F.col("value"))
    return x.select("key", "metric", F.round(d, 4).alias("drop"), (d > tolerance).alias("failed"))


def _monthly_metrics(spark: SparkSession, root: str, months: str) -> DataFrame:
    c = calls(spark, root).where(f"month(ts) {months}")
    m = c.groupBy("model").agg(F.avg(F.col("ok").cast("int")).alias("answered"), F.avg((~F.col("ok")).cast("int")).alias("hallucination"), F.avg(F.col("cached").cast("int")).alias("cached"))
    rows = F.array(*[F.struct(F.lit(x).alias("metric"), F.col(x).alias("value")) for x in ("answered", "hallucination", "cached")])
    return m.select(F.col("model").alias("key"), F.explode(rows).alias("x")).select("key", "x.metric", "x.value")


def q_regression(spark: SparkSession, root: str) -> DataFrame:
    """Models whose figures of later months are worse than those of the first two."""
    return regression(_monthly_metrics(spark, root, "> 2"), _monthly_metrics(spark, root, "<= 2"), 0.01)


def q_eval_mean(spark: SparkSession, root: str) -> DataFrame:
    """Means of metrics that leave out NaN."""
    e = table(spark, root, "events").select("event_type", F.when(F.col("value") > 100, F.lit(float("nan"))).otherwise(F.col("value")).alias("x"))
    return e.groupBy("event_type").agg(F.round(F.avg(F.when(~F.isnan("x"), F.col("x"))), 6).alias("mean"))


QUERIES = {
    "latency_histogram": q_histogram, "latency_quantiles": q_quantiles, "histogram_quantile": q_histogram_quantile, "counters": q_counters, "exposition": q_exposition, "cache_ratio": q_cache_ratio,
    "rates": q_rates, "trace_rollup": q_traces, "trace_ttl": q_trace_ttl, "span_durations": q_spans, "stage_progress": q_stage_progress, "latest_task": q_latest_task, "health": q_health,
    "row_counts": q_row_counts, "citation_f1": q_citation_f1, "eval_regression": q_regression, "eval_mean": q_eval_mean,
}

from lodestone.operators.ledger import _CALLS  # noqa: E402

_HIST = "(SELECT event_type, le, (SELECT count(*) FROM events e WHERE e.event_type = t.event_type AND e.value / 10 <= le) AS n FROM (SELECT DISTINCT event_type FROM events) t, (SELECT unnest([" + ", ".join(map(str, BOUNDS)) + ", 'inf'::DOUBLE]) AS le) b)"
_M = "SELECT model AS key, metric, value FROM (UNPIVOT (SELECT model, avg(CAST(ok AS INT)) AS answered, avg(CAST(NOT ok AS INT)) AS hallucination, avg(CAST(cached AS INT)) AS cached FROM {c} WHERE month(ts) {m} GROUP BY 1) ON answered, hallucination, cached INTO NAME metric VALUE value)"
ORACLE = {
    "latency_histogram": f"SELECT event_type, CASE WHEN isinf(le) THEN 'Infinity' ELSE printf('%.3f', le) END AS le, n FROM {_HIST}",
    "latency_quantiles": "SELECT event_type, round(quantile_cont(value / 10, 0.5), 6) AS p50, round(quantile_cont(value / 10, 0.95), 6) AS p95, round(quantile_cont(value / 10, 0.99), 6) AS p99 FROM events GROUP BY 1",
    "histogram_quantile": f"""WITH h AS {_HIST}, x AS (SELECT *, coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag(n) OVER w, 0) AS below, max(n) OVER (PARTITION BY event_type) AS total FROM h WINDOW w AS (PARTITION BY event_type ORDER BY le))
SELECT event_type, round(CASE WHEN isinf(le) THEN lo ELSE lo + (le - lo) * (0.95 * total - below) / (n - below) END, 6) AS value FROM x WHERE n >= 0.95 * total AND below < 0.95 * total""",
    "counters": f"SELECT role, provider, CASE WHEN ok THEN 'ok' ELSE 'error' END AS outcome, count(*) AS n, sum(greatest(coalesce(prompt_tokens, 0), 0) + greatest(coalesce(completion_tokens, 0), 0)) AS tokens FROM {_CALLS} GROUP BY 1, 2, 3",
    "exposition": f"SELECT printf('llm_calls_total{{model=\"%s\"}} %d', model, count(*)) AS line FROM {_CALLS} GROUP BY model",
    "cache_ratio": f"SELECT role, round(avg(CAST(cached AS INT)), 6) AS ratio FROM {_CALLS} GROUP BY 1",
    "rates": "SELECT CAST(floor(epoch(ts) / 300) * 300 AS BIGINT) AS start_s, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "trace_rollup": f"SELECT trace_id, count(*) AS n, sum(greatest(coalesce(prompt_tokens, 0), 0) + greatest(coalesce(completion_tokens, 0), 0)) AS tokens, round(sum(coalesce(cost_usd, 0)), 6) AS usd, bool_or(NOT ok) AS failed, array_to_string(list_sort(list(DISTINCT role)), '>') AS roles FROM {_CALLS} WHERE trace_id IS NOT NULL GROUP BY 1",
    "trace_ttl": f"SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM {_CALLS} WHERE ts >= (SELECT max(ts) FROM cost_records) - INTERVAL 7 DAY GROUP BY 1",
    "span_durations": "SELECT stage, CAST(depth AS INTEGER) AS depth, count(*) AS n, round(avg(ms), 3) AS mean_ms FROM (SELECT stage, (epoch_us(lead(started_at) OVER w) - epoch_us(started_at)) / 1000 AS ms, row_number() OVER w AS depth FROM (SELECT DISTINCT task_id, stage, started_at FROM checkpoints) WINDOW w AS (PARTITION BY task_id ORDER BY started_at, stage)) GROUP BY 1, 2",
    "stage_progress": "SELECT status, coalesce(stages, 0) AS stages, count(*) AS n FROM (SELECT DISTINCT task_id, status FROM tasks) LEFT JOIN (SELECT task_id, count(DISTINCT stage) AS stages FROM checkpoints GROUP BY 1) USING (task_id) GROUP BY 1, 2",
    "latest_task": "SELECT doc_id, x.task_id AS task_id, x.status AS status FROM (SELECT doc_id, max_by({'task_id': task_id, 'status': status}, {'a': created_at, 'b': task_id}) AS x FROM tasks WHERE doc_id IS NOT NULL GROUP BY 1)",
    "health": f"SELECT bool_and(ok) AS healthy, count(*) AS checks FROM (SELECT avg(CAST(ok AS INT)) > 0.5 AS ok FROM {_CALLS} GROUP BY provider)",
    "row_counts": "SELECT * FROM (SELECT kb_id, count(*) AS chunk_rows, count(DISTINCT chunk_id) AS chunks FROM chunks GROUP BY 1) FULL JOIN (SELECT kb_id, count(*) AS vector_rows, count(DISTINCT chunk_id) AS vectors FROM vector_sqlite GROUP BY 1) USING (kb_id)",
    "citation_f1": """SELECT doc_id, round(CASE WHEN len(list_intersect(got, expected)) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(got, expected)) / (len(got) + len(expected)) END, 6) AS f1
FROM (SELECT doc_id, list_distinct(flatten(list(atom_ids))) AS got FROM chunks WHERE doc_id IS NOT NULL AND atom_ids IS NOT NULL GROUP BY 1) JOIN (SELECT doc_id, list_distinct(list(atom_id)) AS expected FROM atoms WHERE doc_id IS NOT NULL GROUP BY 1) USING (doc_id)""",
    "eval_regression": f"WITH a AS ({_M.format(c=_CALLS, m='> 2')}), b AS ({_M.format(c=_CALLS, m='<= 2')}), d AS (SELECT key, metric, CASE WHEN metric = 'hallucination' THEN a.value - b.value ELSE b.value - a.value END AS d FROM a JOIN b USING (key, metric)) SELECT key, metric, round(d, 4) AS drop, d > 0.01 AS failed FROM d",
    "eval_mean": "SELECT event_type, round(avg(value) FILTER (value <= 100), 6) AS mean FROM events GROUP BY 1",
}
