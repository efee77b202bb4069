"""Small projections around the core: responses, frames, identifiers, credentials, local evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.tables import table

# The alphabet of identifiers, suffixes of sound files.
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
SUFFIXES = {"wav": ".wav", "mpeg": ".mp3", "mp4": ".m4a", "ogg": ".ogg"}


def base32_number(s: Column) -> Column:
    """The number that base-32 digits of that alphabet stand for; null if there is any other character."""
    digits = F.transform(F.filter(F.split(F.upper(s), ""), lambda c: c != ""), lambda c: F.call_function("instr", F.lit(CROCKFORD), c).cast("bigint") - 1)
    return F.when(s.rlike(f"^[{CROCKFORD}]+$"), F.aggregate(digits, F.lit(0).cast("bigint"), lambda h, d: h * 32 + d))


def markdown_table(rows: Column) -> Column:
    """A pipe table of an array of rows, the first as header; line breaks in cells become blanks."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" "))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(F.get(rows, F.lit(0)), lambda _: F.lit("---")), "|"), F.lit("|"))
    return F.concat_ws("\n", line(F.get(rows, F.lit(0))), rule, F.array_join(F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows), F.lit(1))), line), "\n"))


def q_kb_listing(spark: SparkSession, root: str) -> DataFrame:
    """Knowledge bases with their name, which is the id where none is set, and their documents."""
    d = table(spark, root, "documents").groupBy("kb_id").agg(F.count("*").alias("documents"))
    o = table(spark, root, "chunking_options").select("kb_id", F.when(F.col("overlap_ratio").isNull(), F.upper("kb_id")).alias("given"))
    return o.join(d, "kb_id", "left").select("kb_id", F.coalesce("given", "kb_id").alias("name"), F.coalesce("documents", F.lit(0)).alias("documents"))


def q_chat_envelope(spark: SparkSession, root: str) -> DataFrame:
    """Responses of the last call of each trace, as JSON with usage."""
    c = table(spark, root, "cost_records").where("trace_id IS NOT NULL AND prompt_tokens >= 0 AND completion_tokens >= 0")
    one = c.groupBy("trace_id").agg(F.max("prompt_tokens").alias("p"), F.max("completion_tokens").alias("c"))
    usage = F.struct(F.col("p").alias("prompt_tokens"), F.col("c").alias("completion_tokens"), (F.col("p") + F.col("c")).alias("total_tokens"))
    return one.select("trace_id", F.to_json(F.struct(F.col("trace_id").alias("id"), F.lit("chat.completion").alias("object"), usage.alias("usage"))).alias("body"))


def q_sse_frames(spark: SparkSession, root: str) -> DataFrame:
    """Stages of tasks as frames of an event stream."""
    c = table(spark, root, "checkpoints").select("task_id", "stage").distinct()
    return c.select("task_id", "stage", F.format_string('event: stage\ndata: {"task":"%s","stage":"%s"}\n\n', F.col("task_id"), F.col("stage")).alias("frame"))


def q_trace_hits(spark: SparkSession, root: str) -> DataFrame:
    """Scores of hits in traces: the rerank score, else the fused, else the raw one; 0 counts as none."""
    e = table(spark, root, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    score = F.coalesce(F.nullif(F.floor(k / 50), F.lit(0).cast("bigint")).cast("double"), F.nullif(F.round(k / 100, 2), F.lit(0.0)), F.col("value"))
    return e.select("event_id", F.round(score, 6).alias("score"))


def q_markdown_tables(spark: SparkSession, root: str) -> DataFrame:
    """Suppliers of each nation as a pipe table."""
    s = table(spark, root, "supplier")
    rows = s.groupBy("s_nationkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda x: F.array(x["s_suppkey"].cast("string"), x["s_name"])).alias("r"))
    return rows.select("s_nationkey", markdown_table(F.concat(F.array(F.array(F.lit("id"), F.lit("name"))), F.col("r"))).alias("table_md"))


def q_api_keys(spark: SparkSession, root: str) -> DataFrame:
    """Requests whose key resolves to an enabled tenant: keys are kept as hashes, and matched by hash."""
    t = table(spark, root, "cost_records").where("tenant_id IS NOT NULL").select("tenant_id").distinct()
    keys = t.select(F.sha2(F.concat(F.lit("key-"), "tenant_id"), 256).alias("key_hash"), "tenant_id", (F.length("tenant_id") % 2 == 0).alias("enabled"))
    c = table(spark, root, "cost_records").select(F.sha2(F.concat(F.lit("key-"), F.coalesce("tenant_id", F.lit("?"))), 256).alias("key_hash"))
    n = c.groupBy("key_hash").agg(F.count("*").alias("n"))
    return n.join(keys, "key_hash", "left").groupBy(F.when(F.col("tenant_id").isNull(), 1002).when(~F.col("enabled"), 1003).otherwise(0).alias("code")).agg(F.sum("n").alias("n"))


def q_id_numbers(spark: SparkSession, root: str) -> DataFrame:
    """Numbers in chunk ids, least and greatest per knowledge base."""
    c = table(spark, root, "chunks").where("chunk_id IS NOT NULL").select("kb_id", base32_number(F.substring_index("chunk_id", "_", -1)).alias("n"))
    return c.groupBy("kb_id").agg(F.min("n").alias("least"), F.max("n").alias("greatest"), F.count("n").alias("ids"))


def q_trace_ids(spark: SparkSession, root: str) -> DataFrame:
    """Trace ids passed through if of 26 characters, else derived from the request."""
    e = table(spark, root, "events")
    given = F.substring(F.md5("props"), 1, 1) == "a"
    x = F.when(given, F.substring(F.md5("props"), 1, 26)).otherwise(F.lit("short"))
    return e.select("event_id", F.when(F.length(x) == 26, x).otherwise(F.substring(F.md5(F.concat_ws("|", F.col("event_id").cast("string"), "event_type")), 1, 26)).alias("trace_id"))


def q_score_scales(spark: SparkSession, root: str) -> DataFrame:
    """Scores of another store brought to cosines, and keyword scores squashed both ways."""
    e = table(spark, root, "events")
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (F.col("value") / 400) - 1))
    return e.select("event_id", F.round(cos, 6).alias("cosine"), F.round(F.col("value") / (1 + F.col("value")), 6).alias("rising"), F.round(1 / (1 + F.col("value")), 6).alias("falling"))


def q_local_eval(spark: SparkSession, root: str) -> DataFrame:
    """Documents whose chunks hold their title's first word, without case: the local measure of an answer."""
    a = table(spark, root, "atoms").where("context IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("context").alias("truth"))
    c = table(spark, root, "chunks").where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "kb_id").distinct()
    hit = F.contains(F.lower("text"), F.lower(F.split("truth", " ")[0]))
    return c.join(a, "doc_id").groupBy("kb_id").agg(F.round(F.avg(hit.cast("int")), 6).alias("found"), F.count("*").alias("n"))


def q_error_envelopes(spark: SparkSession, root: str) -> DataFrame:
    """Failed tasks as error bodies; details stay inside."""
    t = table(spark, root, "tasks").where("error IS NOT NULL").select("task_id", "error").distinct()
    return t.select("task_id", F.md5(F.to_json(F.struct(F.lit(2001).alias("code"), F.lit("ingest failed").alias("message"), F.col("task_id").alias("trace_id")))).alias("body"))


QUERIES = {
    "kb_listing": q_kb_listing, "chat_envelope": q_chat_envelope, "sse_frames": q_sse_frames, "trace_hits": q_trace_hits, "markdown_tables": q_markdown_tables, "api_key_lookup": q_api_keys, "id_numbers": q_id_numbers,
    "trace_ids": q_trace_ids, "score_scales": q_score_scales, "local_eval": q_local_eval, "error_envelopes": q_error_envelopes,
}
ORACLE = {
    "kb_listing": "SELECT o.kb_id, coalesce(CASE WHEN overlap_ratio IS NULL THEN upper(o.kb_id) END, o.kb_id) AS name, coalesce(documents, 0) AS documents FROM chunking_options o LEFT JOIN (SELECT kb_id, count(*) AS documents FROM documents GROUP BY 1) d ON d.kb_id = o.kb_id",
    "chat_envelope": """SELECT trace_id, '{"id":"' || trace_id || '","object":"chat.completion","usage":{"prompt_tokens":' || p || ',"completion_tokens":' || c || ',"total_tokens":' || (p + c) || '}}' AS body FROM (SELECT trace_id, max(prompt_tokens) AS p, max(completion_tokens) AS c FROM cost_records WHERE trace_id IS NOT NULL AND prompt_tokens >= 0 AND completion_tokens >= 0 GROUP BY 1)""",
    "sse_frames": """SELECT DISTINCT task_id, stage, 'event: stage' || chr(10) || 'data: {"task":"' || task_id || '","stage":"' || stage || '"}' || chr(10) || chr(10) AS frame FROM checkpoints""",
    "trace_hits": "SELECT event_id, round(coalesce(nullif(floor(k / 50), 0), nullif(round(k / 100, 2), 0), value), 6) AS score FROM (SELECT *, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events)",
    "markdown_tables": "SELECT s_nationkey, '| id | name |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || s_suppkey || ' | ' || s_name || ' |', chr(10) ORDER BY s_suppkey) AS table_md FROM supplier GROUP BY 1",
    "api_key_lookup": "SELECT CASE WHEN tenant_id IS NULL THEN 1002 WHEN length(tenant_id) % 2 <> 0 THEN 1003 ELSE 0 END AS code, CAST(count(*) AS BIGINT) AS n FROM cost_records GROUP BY 1",
    "id_numbers": f"""SELECT kb_id, min(n) AS least, max(n) AS greatest, count(n) AS ids FROM (SELECT kb_id, CASE WHEN regexp_full_match(x, '[{CROCKFORD}]+') THEN list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(upper(x), ''), lambda c: CAST(strpos('{CROCKFORD}', c) - 1 AS BIGINT))), lambda a, b: a * 32 + b) END AS n
FROM (SELECT kb_id, list_extract(string_split(chunk_id, '_'), -1) AS x FROM chunks WHERE chunk_id IS NOT NULL)) GROUP BY 1""",
    "trace_ids": "SELECT event_id, CASE WHEN substring(md5(props), 1, 1) = 'a' THEN substring(md5(props), 1, 26) ELSE substring(md5(event_id || '|' || event_type), 1, 26) END AS trace_id FROM events",
    "score_scales": "SELECT event_id, round(greatest(-1.0, least(1.0, 2 * (value / 400) - 1)), 6) AS cosine, round(value / (1 + value), 6) AS rising, round(1 / (1 + value), 6) AS falling FROM events",
    "local_eval": "SELECT kb_id, round(avg(CAST(contains(lower(text), lower(split_part(truth, ' ', 1))) AS INT)), 6) AS found, count(*) AS n FROM (SELECT DISTINCT doc_id, text, kb_id FROM chunks WHERE doc_id IS NOT NULL AND text IS NOT NULL) JOIN (SELECT doc_id, min(context) AS truth FROM atoms WHERE context IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1) USING (doc_id) GROUP BY 1",
    "error_envelopes": """SELECT DISTINCT task_id, md5('{"code":2001,"message":"ingest failed","trace_id":"' || task_id || '"}') AS body FROM tasks WHERE error IS NOT NULL""",
}
