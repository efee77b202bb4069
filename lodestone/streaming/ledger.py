"""Structured Streaming twins of the batch operators: ledger windows, quotas, deduplicated ingest, orphans."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from lodestone.operators.ledger import Breaker
from lodestone.operators.orphans import OrphanTracker
from lodestone.plans.session import shared_dir
from lodestone.sources.tables import table


def daily_cost(calls: DataFrame, late: str = "30 days") -> DataFrame:
    """Calls and cost per knowledge base and day; calls that arrive again within the watermark count once."""
    c = calls.withWatermark("ts", late).dropDuplicatesWithinWatermark(["trace_id", "ts", "role", "model", "prompt_tokens", "completion_tokens"])
    day = F.window("ts", "1 day")
    return c.groupBy(day.alias("w"), "kb_id").agg(F.count("*").alias("n"), F.sum(F.coalesce("cost_usd", F.lit(0.0)).cast("decimal(18,6)")).alias("usd"))


def monthly_tokens(calls: DataFrame) -> DataFrame:
    """Running tokens per tenant and month: quota counters that start anew each month."""
    t = F.greatest(F.coalesce("prompt_tokens", F.lit(0)), F.lit(0)) + F.greatest(F.coalesce("completion_tokens", F.lit(0)), F.lit(0))
    return calls.where("tenant_id IS NOT NULL").groupBy("tenant_id", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.sum(t).alias("tokens"))


def new_documents(docs: DataFrame) -> DataFrame:
    """The first document of each (kb_id, doc_hash) that the stream brings."""
    return docs.where("doc_hash IS NOT NULL").dropDuplicates(["kb_id", "doc_hash"])


def breaker_states(calls: DataFrame, least: int = 3) -> DataFrame:
    """provider, model, state, refused of each micro-batch's end, by a breaker kept as state.

    Calls of a micro-batch are taken in the order of time; the state is the breaker's counts of a minute.
    """
    import json

    def fold(key: tuple, parts, state):  # noqa: ANN001, ANN202
        b = Breaker(least)
        if state.exists:
            b.state, b.opened, seconds = json.loads(state.get[0])
            b.seconds = {int(k): v for k, v in seconds.items()}
        rows = pd.concat(list(parts)).sort_values(["t", "trace_id"])
        refused = 0
        for t, ok in zip(rows["t"], rows["ok"], strict=True):
            if b.allow(t):
                b.record(t, bool(ok))
            else:
                refused += 1
        state.update((json.dumps([b.state, b.opened, b.seconds]),))
        yield pd.DataFrame({"provider": [key[0]], "model": [key[1]], "state": [b.state], "refused": [refused]})

    c = calls.select("provider", "model", (F.unix_micros("ts") / 1e6).alias("t"), "ok", "trace_id")
    return c.groupBy("provider", "model").applyInPandasWithState(fold, "provider string, model string, state string, refused int", "breaker string", "append", GroupStateTimeout.NoTimeout)


def track_orphans(refs: DataFrame, tracker: OrphanTracker, parents: Callable[[], DataFrame], checkpoint: str):  # noqa: ANN201
    """Start a query that folds arriving references into the pending-orphan state, batch by batch."""
    return refs.writeStream.foreachBatch(lambda df, n: tracker.apply(n, df, parents())).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_stream(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table's files as a stream."""
    schema = table(spark, root, name).schema
    import os

    at = f"{root}/{name}.parquet"
    if os.path.isfile(at):  # a stream reads folders
        return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(root)
    return spark.readStream.schema(schema).parquet(at)


def drained(df: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there to a table in the shared folder, and read that."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/lodestone/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/{n:06d}")

    q = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/*")


def q_stream_daily_cost(spark: SparkSession, root: str) -> DataFrame:
    """The daily ledger from a stream, every update of a day reduced to its last."""
    out = drained(daily_cost(read_stream(spark, root, "cost_records")), "update")
    last = out.groupBy("kb_id", "w").agg(F.max_by(F.struct("n", "usd"), "n").alias("x"))
    return last.select("kb_id", F.date_format("w.start", "yyyy-MM-dd").alias("day"), "x.n", F.col("x.usd").cast("double").alias("usd"))


def q_stream_quota(spark: SparkSession, root: str) -> DataFrame:
    """Monthly tokens from a stream."""
    out = drained(monthly_tokens(read_stream(spark, root, "cost_records").dropDuplicates(["trace_id", "ts", "role", "model", "prompt_tokens", "completion_tokens"])), "complete")
    return out.groupBy("tenant_id", "month").agg(F.max("tokens").alias("tokens"))


def q_stream_dedup(spark: SparkSession, root: str) -> DataFrame:
    """Documents that a stream lets through, per knowledge base."""
    return drained(new_documents(read_stream(spark, root, "documents").select("doc_id", "kb_id", "doc_hash")), "append").groupBy("kb_id").agg(F.count("*").alias("n"))


def q_stream_breaker(spark: SparkSession, root: str) -> DataFrame:
    """Breakers of all targets after a stream of calls."""
    out = drained(breaker_states(read_stream(spark, root, "cost_records")), "append")
    return out.groupBy("provider", "model").agg(F.sum("refused").alias("refused"), F.count("*").alias("batches"))


QUERIES = {"stream_daily_cost": q_stream_daily_cost, "stream_quota": q_stream_quota, "stream_dedup": q_stream_dedup, "stream_breaker": q_stream_breaker}

_D = "(SELECT DISTINCT ON (trace_id, ts, role, model, prompt_tokens, completion_tokens) * FROM cost_records)"
ORACLE = {
    "stream_daily_cost": f"SELECT kb_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, CAST(sum(CAST(coalesce(cost_usd, 0) AS DECIMAL(18,6))) AS DOUBLE) AS usd FROM {_D} GROUP BY 1, 2",
    "stream_quota": f"SELECT tenant_id, strftime(ts, '%Y-%m') AS month, CAST(sum(greatest(coalesce(prompt_tokens, 0), 0) + greatest(coalesce(completion_tokens, 0), 0)) AS BIGINT) AS tokens FROM {_D} WHERE tenant_id IS NOT NULL GROUP BY 1, 2",
    "stream_dedup": "SELECT kb_id, count(DISTINCT doc_hash) AS n FROM documents WHERE doc_hash IS NOT NULL GROUP BY 1",
}
