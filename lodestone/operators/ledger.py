"""Accounting of model calls: costs, budgets, quotas, routing, circuit breaking, rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import token_count
from lodestone.plans.session import parallelism
from lodestone.sources.tables import table

# Limits and windows.
DAILY_LIMIT_USD = 50.0
BREAKER_WINDOW_S, BREAKER_RATE, BREAKER_LEAST, BREAKER_OPEN_S = 60, 0.5, 10, 30
BUCKET_RATE, BUCKET_BURST = 10.0, 20.0
METHOD_ACTIONS = {"GET": "read", "POST": "write", "PUT": "write", "PATCH": "write", "DELETE": "delete"}
HTTP_STATUS = {
    1001: 400, 1002: 401, 1003: 403, 1004: 429, 2001: 422, 2002: 415, 2003: 404, 2004: 200, 3001: 404, 3002: 409, 4001: 404, 4002: 200, 4003: 400,
    5001: 503, 5002: 503, 5003: 422, 6001: 502, 6002: 503, 6003: 400, 6004: 503, 7001: 500, 7002: 502, 7003: 200, 9001: 503, 9002: 503, 9003: 500,
}


def calls(spark: SparkSession, root: str) -> DataFrame:
    """Calls, each once: those that arrived again are equal but for the arrival."""
    same = ["trace_id", "ts", "kb_id", "tenant_id", "role", "provider", "model", "prompt_tokens", "completion_tokens", "cost_usd", "ok", "cached"]
    c = table(spark, root, "cost_records")
    return c.groupBy(*same).agg(F.max(F.col("unit_price")["prompt_per_1k"]).alias("p"), F.max(F.col("unit_price")["completion_per_1k"]).alias("c"))


_CALLS = """(SELECT trace_id, ts, kb_id, tenant_id, role, provider, model, prompt_tokens, completion_tokens, cost_usd, ok, cached, max(unit_price['prompt_per_1k']) AS p, max(unit_price['completion_per_1k']) AS c FROM cost_records GROUP BY ALL)"""


def cost(prompt: Column, completion: Column, per_1k_prompt: Column, per_1k_completion: Column) -> Column:
    """Tokens by thousand at their price; missing prices and tokens count as 0."""
    z = lambda x: F.coalesce(x, F.lit(0))
    return z(prompt) / 1000 * z(per_1k_prompt) + z(completion) / 1000 * z(per_1k_completion)


def day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def q_cost_ledger(spark: SparkSession, root: str) -> DataFrame:
    """Cost of each model from tokens and prices."""
    c = calls(spark, root).where("prompt_tokens >= 0 AND completion_tokens >= 0")
    return c.groupBy("provider", "model").agg(F.count("*").alias("n"), F.sum("prompt_tokens").alias("prompt"), F.sum("completion_tokens").alias("completion"), F.round(F.sum(cost(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("p"), F.col("c"))), 3).alias("usd"))


def q_daily_cost(spark: SparkSession, root: str) -> DataFrame:
    """Cost of each knowledge base and UTC day."""
    return calls(spark, root).groupBy("kb_id", day(F.col("ts")).alias("day")).agg(F.sum(F.coalesce("cost_usd", F.lit(0.0)).cast("decimal(18,6)")).cast("double").alias("usd"), F.count("*").alias("n"))


def q_budget_gate(spark: SparkSession, root: str) -> DataFrame:
    """Calls over the running daily budget of their knowledge base (a small cap here), per day.

    The running sum is kept per knowledge base and day, so that no window holds more than a day.
    """
    c = calls(spark, root).select("kb_id", "ts", "trace_id", "role", "model", F.coalesce("cost_usd", F.lit(0.0)).cast("decimal(18,6)").alias("usd"), "prompt_tokens", "completion_tokens")
    w = Window.partitionBy("kb_id", "day").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    r = c.withColumn("day", day(F.col("ts"))).withColumn("spent", F.sum("usd").over(w))
    return r.groupBy("kb_id", "day").agg(F.count_if(F.col("spent") > F.lit(0.05)).alias("rejected"), F.count("*").alias("n")).where("rejected > 0")


def q_monthly_quota(spark: SparkSession, root: str) -> DataFrame:
    """Tokens of each tenant and month, and whether they pass a quota."""
    c = calls(spark, root).where("tenant_id IS NOT NULL")
    t = F.greatest(F.coalesce("prompt_tokens", F.lit(0)), F.lit(0)) + F.greatest(F.coalesce("completion_tokens", F.lit(0)), F.lit(0))
    s = c.groupBy("tenant_id", month(F.col("ts")).alias("month")).agg(F.sum(t).alias("tokens"))
    return s.withColumn("over", F.col("tokens") > 100_000)


def q_usage_estimate(spark: SparkSession, root: str) -> DataFrame:
    """Tokens of each knowledge base's texts: the stored count, or the counter's where it is missing."""
    c = table(spark, root, "chunks").where("text IS NOT NULL").dropDuplicates(["chunk_id", "version", "token_count", "text"])
    none = F.col("token_count").isNull() | (F.col("token_count") <= 0)
    n = F.when(none, token_count(F.col("text"))).otherwise(F.col("token_count"))
    return c.groupBy("kb_id").agg(F.sum(n).alias("tokens"), F.bool_or(none).alias("estimated"))


def q_least_cost(spark: SparkSession, root: str) -> DataFrame:
    """Models of each role from the cheapest, unpriced ones last."""
    c = calls(spark, root).groupBy("role", "provider", "model").agg(F.max(F.col("p") + F.col("c")).alias("price"))
    w = Window.partitionBy("role").orderBy(F.coalesce("price", F.lit(float("inf"))), "provider", "model")
    return c.select("role", "provider", "model", F.round("price", 6).alias("price"), F.row_number().over(w).alias("place"))


def q_weighted_route(spark: SparkSession, root: str) -> DataFrame:
    """Targets drawn for traces by weight: the hash of a trace is its uniform number."""
    t = calls(spark, root).where("trace_id IS NOT NULL").select("trace_id").distinct()
    u = F.conv(F.substring(F.md5("trace_id"), 1, 8), 16, 10).cast("bigint") / 4294967296.0
    pick = F.when(u < 0.5, "lumen").when(u < 0.8, "northgate").otherwise("selfhost")
    return t.groupBy(pick.alias("target")).agg(F.count("*").alias("n"))


def q_failure_rate(spark: SparkSession, root: str) -> DataFrame:
    """Calls at which a model's failure rate over the last 60 seconds is one half, of 2 calls at least."""
    c = calls(spark, root).groupBy("provider", "model", F.unix_timestamp("ts").alias("s")).agg(F.count("*").alias("n"), F.sum((~F.col("ok")).cast("int")).alias("bad"))
    w = Window.partitionBy("provider", "model").orderBy("s").rangeBetween(-BREAKER_WINDOW_S, 0)
    r = c.withColumn("calls", F.sum("n").over(w)).withColumn("fails", F.sum("bad").over(w))
    return r.where("calls >= 2 AND fails / calls >= 0.5").select("provider", "model", "s", "calls", "fails")


class Breaker:
    """The circuit breaker of one target, fed with calls in the order of time.

    Per-second counts over 60 seconds; it opens on a failure once 10 calls fail by half, lets the first
    call after 30 seconds through as half open, and closes on that call's success.  Counts are kept on closing.
    """

    def __init__(self, least: int = BREAKER_LEAST) -> None:
        self.least, self.state, self.opened = least, "closed", 0.0
        self.seconds: dict[int, list[int]] = {}

    def allow(self, now: float) -> bool:
        if self.state == "open" and now - self.opened >= BREAKER_OPEN_S:
            self.state = "half_open"
        return self.state != "open"

    def record(self, now: float, ok: bool) -> None:
        at = int(now)
        if at not in self.seconds:  # once a second: what has left the window goes
            self.seconds = {s: x for s, x in self.seconds.items() if s >= at - BREAKER_WINDOW_S}
        n = self.seconds.setdefault(at, [0, 0])
        n[0] += 1
        n[1] += not ok
        if ok:
            if self.state == "half_open":
                self.state = "closed"
            return
        total, bad = (sum(x[k] for x in self.seconds.values()) for k in (0, 1))
        if total >= self.least and bad / total >= BREAKER_RATE:
            self.state, self.opened = "open", now


class Bucket:
    """A token bucket: full at first, refilled by ``rate`` a second up to ``burst``."""

    def __init__(self, rate: float = BUCKET_RATE, burst: float = BUCKET_BURST) -> None:
        self.rate, self.burst, self.tokens, self.last = rate, burst, burst, None

    def take(self, now: float, need: float = 1.0) -> float:
        """0 if admitted, else the seconds to wait; a rejected request takes nothing."""
        if self.last is not None:
            self.tokens = min(self.burst, self.tokens + (now - self.last) * self.rate)
        self.last = now
        if self.tokens >= need:
            self.tokens -= need
            return 0.0
        return (need - self.tokens) / self.rate


def in_order(df: DataFrame, keys: list[str], order: list[str], make, step, columns: str) -> DataFrame:  # noqa: ANN001
    """Fold rows of each key in order, streamed: ``make()`` a state, ``step(state, row)`` to an output row.

    A key's rows are read once and never held, so a hot key costs time in proportion to its rows only.
    """
    names = [x.strip().split(" ")[0] for x in columns.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                now = tuple(getattr(row, k) for k in keys)
                if now != key:
                    key, state = now, make()
                out.append(step(state, row))
            yield pd.DataFrame(out, columns=names)

    return df.repartition(parallelism(df.sparkSession), *keys).sortWithinPartitions(*keys, *order).mapInPandas(run, columns)


def q_circuit_states(spark: SparkSession, root: str) -> DataFrame:
    """Calls let through and refused by each target's breaker (opening at 3 calls here)."""
    c = calls(spark, root).select("provider", "model", (F.unix_micros("ts") / 1e6).alias("t"), "ok", "trace_id")

    def step(b: Breaker, r) -> tuple:  # noqa: ANN001
        let = b.allow(r.t)
        if let:
            b.record(r.t, bool(r.ok))
        return (r.provider, r.model, let, b.state)

    f = in_order(c, ["provider", "model"], ["t", "trace_id"], lambda: Breaker(3), step, "provider string, model string, allowed boolean, state string")
    return f.groupBy("provider", "model", "state").agg(F.count("*").alias("n"), F.count_if("allowed").alias("allowed"))


def q_token_bucket(spark: SparkSession, root: str) -> DataFrame:
    """Requests admitted and rejected of each tenant, by a slow bucket."""
    c = calls(spark, root).where("tenant_id IS NOT NULL").select("tenant_id", (F.unix_micros("ts") / 1e6).alias("t"), "trace_id")

    def step(b: Bucket, r) -> tuple:  # noqa: ANN001
        return (r.tenant_id, b.take(r.t))

    f = in_order(c, ["tenant_id"], ["t", "trace_id"], lambda: Bucket(0.005, 5), step, "tenant_id string, wait double")
    return f.groupBy("tenant_id").agg(F.count("*").alias("n"), F.count_if(F.col("wait") == 0).alias("admitted"), F.round(F.max("wait"), 3).alias("longest_wait"))


def classify(method: Column, path: Column) -> tuple[Column, Column]:
    """(action, resource) of a request."""
    action = F.lit("admin")
    for m, a in METHOD_ACTIONS.items():
        action = F.when(F.upper(method) == m, a).otherwise(action)
    parts = F.split(path, "/")
    has = lambda *names: F.arrays_overlap(parts, F.array(*map(F.lit, names)))
    resource = (
        F.when(has("documents"), "document").when(has("chunks"), "chunk").when(has("search"), "query").when(has("chat"), "chat").when(has("tasks"), "task")
        .when(has("health", "metrics", "traces", "audit"), "ops").when(has("kb", "knowledge-base"), "kb").otherwise("settings")
    )
    return action, resource


#: The paths that events stand for.
_PATHS = {"view": "GET /v1/documents/x", "click": "POST /v1/search", "signup": "PUT /v1/knowledge-base", "purchase": "DELETE /v1/chunks/y", "error": "GET /v1/health"}


def _requests(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events")
    path = F.lit("PATCH /v1/settings")
    for k, v in _PATHS.items():
        path = F.when(F.col("event_type") == k, v).otherwise(path)
    return e.withColumn("line", path).withColumn("method", F.split("line", " ")[0]).withColumn("path", F.split("line", " ")[1])


def q_audit_classify(spark: SparkSession, root: str) -> DataFrame:
    """Requests per action and resource."""
    action, resource = classify(F.col("method"), F.col("path"))
    return _requests(spark, root).groupBy(action.alias("action"), resource.alias("resource")).agg(F.count("*").alias("n"))


def q_audit_latest(spark: SparkSession, root: str) -> DataFrame:
    """The newest 1000 events of the log, which a ring of that size holds."""
    return table(spark, root, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(1000).select("event_id", "user_id", "event_type")


def q_status_codes(spark: SparkSession, root: str) -> DataFrame:
    """HTTP status of error codes, 500 for others, over codes made of event properties."""
    codes = F.create_map(*[F.lit(x) for kv in HTTP_STATUS.items() for x in kv])
    k = F.get_json_object("props", "$.k").cast("int")
    code = (k % 9 + 1) * 1000 + k % 5
    return table(spark, root, "events").groupBy(code.alias("code"), F.coalesce(codes[code], F.lit(500)).alias("status")).agg(F.count("*").alias("n"))


def q_backoff(spark: SparkSession, root: str) -> DataFrame:
    """Seconds to wait before each task's next attempt, without jitter, and whether its error is worth one."""
    t = table(spark, root, "tasks").dropDuplicates()
    wait = F.least(F.pow(F.lit(2.0), F.col("attempts").cast("double")), F.lit(60.0))
    return t.groupBy("attempts", wait.alias("seconds"), F.col("error").isNotNull().alias("failed")).agg(F.count("*").alias("n"))


QUERIES = {
    "cost_ledger": q_cost_ledger, "daily_cost": q_daily_cost, "budget_gate": q_budget_gate, "monthly_quota": q_monthly_quota, "usage_estimate": q_usage_estimate, "least_cost_route": q_least_cost,
    "weighted_route": q_weighted_route, "circuit_failure_rate": q_failure_rate, "circuit_states": q_circuit_states, "token_bucket": q_token_bucket, "audit_classify": q_audit_classify,
    "audit_latest": q_audit_latest, "status_codes": q_status_codes, "retry_backoff": q_backoff,
}

_WIDE = "(length(text) - length(regexp_replace(text, '[\\x{3040}-\\x{30ff}\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}\\x{ff00}-\\x{ffef}]', '', 'g')))"
_TOKENS = f"(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, len(regexp_extract_all(text, '[A-Za-z0-9_`]+')) + (length(regexp_replace(text, '[A-Za-z0-9_`]+', '', 'g')) - {_WIDE}) // 4 + {_WIDE}) END)"
_LINE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _PATHS.items()) + " ELSE 'PATCH /v1/settings' END"
ORACLE = {
    "cost_ledger": f"SELECT provider, model, count(*) AS n, sum(prompt_tokens) AS prompt, sum(completion_tokens) AS completion, round(sum(prompt_tokens / 1000 * coalesce(p, 0) + completion_tokens / 1000 * coalesce(c, 0)), 3) AS usd FROM {_CALLS} WHERE prompt_tokens >= 0 AND completion_tokens >= 0 GROUP BY 1, 2",
    "daily_cost": f"SELECT kb_id, strftime(ts, '%Y-%m-%d') AS day, CAST(sum(CAST(coalesce(cost_usd, 0) AS DECIMAL(18,6))) AS DOUBLE) AS usd, count(*) AS n FROM {_CALLS} GROUP BY 1, 2",
    "budget_gate": f"""SELECT kb_id, day, count(*) FILTER (spent > 0.05) AS rejected, count(*) AS n FROM (SELECT kb_id, strftime(ts, '%Y-%m-%d') AS day, sum(CAST(coalesce(cost_usd, 0) AS DECIMAL(18,6))) OVER (PARTITION BY kb_id, strftime(ts, '%Y-%m-%d') ORDER BY ts RANGE UNBOUNDED PRECEDING) AS spent FROM {_CALLS})
GROUP BY 1, 2 HAVING count(*) FILTER (spent > 0.05) > 0""",
    "monthly_quota": f"SELECT tenant_id, strftime(ts, '%Y-%m') AS month, sum(greatest(coalesce(prompt_tokens, 0), 0) + greatest(coalesce(completion_tokens, 0), 0)) AS tokens, sum(greatest(coalesce(prompt_tokens, 0), 0) + greatest(coalesce(completion_tokens, 0), 0)) > 100000 AS over FROM {_CALLS} WHERE tenant_id IS NOT NULL GROUP BY 1, 2",
    "usage_estimate": f"SELECT kb_id, sum(CASE WHEN token_count IS NULL OR token_count <= 0 THEN {_TOKENS} ELSE token_count END) AS tokens, bool_or(token_count IS NULL OR token_count <= 0) AS estimated FROM (SELECT DISTINCT chunk_id, kb_id, version, token_count, text FROM chunks WHERE text IS NOT NULL) GROUP BY 1",
    "least_cost_route": f"SELECT role, provider, model, round(price, 6) AS price, CAST(row_number() OVER (PARTITION BY role ORDER BY coalesce(price, 'inf'::DOUBLE), provider, model) AS INTEGER) AS place FROM (SELECT role, provider, model, max(p + c) AS price FROM {_CALLS} GROUP BY 1, 2, 3)",
    "weighted_route": "SELECT CASE WHEN u < 0.5 THEN 'lumen' WHEN u < 0.8 THEN 'northgate' ELSE 'selfhost' END AS target, count(*) AS n FROM (SELECT DISTINCT trace_id, CAST('0x' || substring(md5(trace_id), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM cost_records WHERE trace_id IS NOT NULL) GROUP BY 1",
    "circuit_failure_rate": f"""SELECT provider, model, s, CAST(calls AS BIGINT) AS calls, CAST(fails AS BIGINT) AS fails FROM (SELECT provider, model, s, sum(n) OVER w AS calls, sum(bad) OVER w AS fails FROM
(SELECT provider, model, CAST(floor(epoch(ts)) AS BIGINT) AS s, count(*) AS n, count(*) FILTER (NOT ok) AS bad FROM {_CALLS} GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY provider, model ORDER BY s RANGE BETWEEN 60 PRECEDING AND CURRENT ROW)) WHERE calls >= 2 AND fails / calls >= 0.5""",
    "audit_classify": f"""SELECT CASE split_part(l, ' ', 1) WHEN 'GET' THEN 'read' WHEN 'DELETE' THEN 'delete' WHEN 'POST' THEN 'write' WHEN 'PUT' THEN 'write' WHEN 'PATCH' THEN 'write' ELSE 'admin' END AS action,
CASE WHEN l LIKE '%/documents%' THEN 'document' WHEN l LIKE '%/chunks%' THEN 'chunk' WHEN l LIKE '%/search%' THEN 'query' WHEN l LIKE '%/health%' THEN 'ops' WHEN l LIKE '%/knowledge-base%' THEN 'kb' ELSE 'settings' END AS resource, count(*) AS n FROM (SELECT {_LINE} AS l FROM events) GROUP BY 1, 2""",
    "audit_latest": "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000",
    "status_codes": "SELECT CAST(code AS INTEGER) AS code, CAST(CASE " + " ".join(f"WHEN code = {k} THEN {v}" for k, v in HTTP_STATUS.items()) + " ELSE 500 END AS INTEGER) AS status, count(*) AS n FROM (SELECT (k % 9 + 1) * 1000 + k % 5 AS code FROM (SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)) GROUP BY 1, 2",
    "retry_backoff": "SELECT attempts, least(pow(2.0, attempts), 60.0) AS seconds, error IS NOT NULL AS failed, count(*) AS n FROM (SELECT DISTINCT * FROM tasks) GROUP BY 1, 2, 3",
}
