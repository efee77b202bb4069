"""Batches of questions: mode routing, planning, one retrieval job for all tasks, synthesis, degradation.

Models are a seam: ``Planner`` and ``Answerer`` are plain callables over columns; the defaults are deterministic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.search import token_bm25
from lodestone.sources.tables import table

# Heuristics of the router, cap of tasks, mark of an empty answer.
CONNECTORS = ("和", "与", "以及", "and", "比较", "对比", "关系")
MARKER, LONG, MOST_TASKS, NO_DATA = "的", 40, 8, "[NO DATA]"


def mode(query: Column, cached: Column, override: Column, agentic: Column) -> Column:
    """``fast`` on a cache hit, else the override, else ``agentic`` for long or many-sided questions, else ``standard``."""
    connected = F.lit(False)
    for c in CONNECTORS:
        connected = connected | F.contains(query, F.lit(c))
    markers = F.length(query) - F.length(F.replace(query, F.lit(MARKER), F.lit("")))
    many = (connected & (markers >= 2)) | (F.length(query) > LONG)
    asks = F.coalesce(override, F.lit(""))
    return (
        F.when(F.coalesce(cached, F.lit(False)) & (asks != "agentic"), "fast").when(asks == "agentic", F.when(agentic, "agentic").otherwise("standard")).when(asks == "standard", "standard")
        .when(agentic & many, "agentic").otherwise("standard")
    )


def plan(questions: DataFrame, split: Callable[[Column], Column] | None = None) -> DataFrame:
    """query_id, task_no, seed: at most eight seed queries of each question; an empty question has none."""
    split = split or (lambda q: F.split(q, "\\s+and\\s+|[,;，；]\\s*"))
    parts = F.slice(F.filter(F.transform(split(F.col("query")), lambda x: F.trim(x)), lambda x: x != ""), 1, MOST_TASKS)
    return questions.select("query_id", F.posexplode(parts).alias("task_no", "seed"))


def execute(tasks: DataFrame, docs: DataFrame, k: int = 3) -> DataFrame:
    """query_id, task_no, answer, no_data: every task retrieved in one job; those without a hit say so."""
    t = tasks.select(F.concat_ws("#", "query_id", "task_no").alias("query_id"), F.col("seed").alias("query"))
    hits = token_bm25(t, docs, k).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"].cast("string")), ",").alias("answer"))
    x = tasks.withColumn("id", F.concat_ws("#", "query_id", "task_no")).join(hits.withColumnRenamed("query_id", "id"), "id", "left")
    return x.select("query_id", "task_no", F.coalesce("answer", F.lit(NO_DATA)).alias("answer"), F.col("answer").isNull().alias("no_data"))


def synthesise(done: DataFrame) -> DataFrame:
    """query_id, answer, degraded: answers numbered and joined, empty ones left out; all empty means degraded."""
    rows = F.array_sort(F.collect_list(F.when(~F.col("no_data"), F.struct("task_no", "answer"))))
    text = F.array_join(F.transform(rows, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["answer"])), "\n")
    return done.groupBy("query_id").agg(text.alias("answer"), F.bool_and("no_data").alias("degraded"))


def _questions(spark: SparkSession, root: str) -> DataFrame:
    """One question for each section title, in two forms."""
    a = table(spark, root, "atoms").where("context IS NOT NULL AND context <> ''").select("context").distinct()
    return a.select("context", F.concat(F.lit("What about "), F.col("context"), F.lit(" and the shared glossary")).alias("query"))


def q_modes(spark: SparkSession, root: str) -> DataFrame:
    """Questions by the mode that answers them."""
    q = _questions(spark, root)
    cached = F.length("context") % 7 == 0
    override = F.when(F.length("context") % 5 == 0, F.lit("standard"))
    return q.groupBy(mode(F.col("query"), cached, override, F.lit(True)).alias("mode")).agg(F.count("*").alias("n"))


def q_agentic(spark: SparkSession, root: str) -> DataFrame:
    """A batch of questions planned, searched in one job and put together."""
    q = spark.createDataFrame([("a1", "retrieval gateway and supplier note; vector store"), ("a2", "zzzz qqqq"), ("a3", "Druckprüfung, Messgerät, 向量仓库"), ("a4", "")], "query_id string, query string")
    return synthesise(execute(plan(q), table(spark, root, "documents")))


QUERIES = {"query_mode_route": q_modes, "agentic_batch": q_agentic}
_CON = " OR ".join(f"contains(q, '{c}')" for c in CONNECTORS)
ORACLE = {
    "query_mode_route": f"""SELECT CASE WHEN length(context) % 7 = 0 THEN 'fast' WHEN length(context) % 5 = 0 THEN 'standard' WHEN (({_CON}) AND length(q) - length(replace(q, '的', '')) >= 2) OR length(q) > 40 THEN 'agentic' ELSE 'standard' END AS mode, count(*) AS n
FROM (SELECT DISTINCT context, 'What about ' || context || ' and the shared glossary' AS q FROM atoms WHERE context IS NOT NULL AND context <> '') GROUP BY 1""",
}
