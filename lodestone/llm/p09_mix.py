"""Problem 9: mix sources to target shares of all tokens, small sources repeated a capped number of times.

Method: iterative proportional fitting.  Token weights of the cells (source, language, topic) are raked
to the source targets and to the language and topic shares of the supply, within each source's cap of
repeats; documents are then drawn by the calibrated probabilities.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.tokens import counted
from lodestone.plans.session import materialize
from lodestone.sources.tables import table

#: Rounds of raking; languages told apart; documents of a stretch in which draws are
#: spread evenly; places tried to start from.
ROUNDS, STRETCH, STARTS = 30, 2000, 32
#: Cells that are raked; more are an error.
MOST_CELLS = 1_000_000
LANGUAGES = ("en", "zh", "de", "fr", "es", "pt", "ru")


def fill(weights: np.ndarray, caps: np.ndarray, total: float) -> np.ndarray:
    """``weights`` scaled to ``total`` with none over its cap; what is cut off goes to the others."""
    w, out = np.maximum(weights, 1e-12) * (caps > 0), np.zeros_like(caps)
    free = caps > 0
    for _ in range(len(caps) + 1):
        left = total - out[~free].sum()
        if not free.any() or w[free].sum() <= 0:
            break
        new = w * (left / w[free].sum())
        over = free & (new >= caps)
        if not over.any():
            out[free] = new[free]
            break
        out[over] = caps[over]
        free &= ~over
    return out


def rake(cells: pd.DataFrame, targets: pd.DataFrame, rounds: int = ROUNDS) -> pd.DataFrame:
    """``cells`` (source, lang, topic, tokens) with ``copies``: how often each token of a cell is taken on average.

    ``targets``: source, target_share, max_repeats.  The total is the largest under which every listed
    source that has any tokens can hold its share; sources without tokens are left out and the others'
    shares scaled up.  The source shares are met exactly, languages and topics as far as caps allow.
    """
    c = cells.merge(targets, on="source").reset_index(drop=True)
    c = c[(c["tokens"] > 0) & (c["target_share"] > 0) & (c["max_repeats"] > 0)].reset_index(drop=True)
    if not len(c):
        return c.assign(copies=[])
    supply = c.groupby("source")["tokens"].sum()
    t = targets.set_index("source").loc[supply.index]
    share = t["target_share"] / t["target_share"].sum()
    total = float((supply * t["max_repeats"] / share).min())
    caps = (c["tokens"] * c["max_repeats"]).to_numpy(float)
    w = c["tokens"].to_numpy(float) * total / c["tokens"].sum()
    natural = c["tokens"].to_numpy(float) / c["tokens"].sum()
    sources = c["source"].to_numpy()
    for _ in range(rounds):
        for by in ("lang", "topic"):
            goal = pd.Series(natural).groupby(c[by].to_numpy()).sum() * total
            now = pd.Series(w).groupby(c[by].to_numpy()).sum()
            w = w * (goal / now.where(now > 0, 1)).reindex(c[by]).to_numpy()
            w = np.minimum(w, caps)
        for s in supply.index:
            at = sources == s
            w[at] = fill(w[at], caps[at], float(share[s] * total))
    return c.assign(copies=w / c["tokens"])


def mixed(docs: DataFrame, targets: DataFrame, topics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``chosen`` (mix_id, doc_id, source, tokens, copies) and the ``cells`` that the draw followed.

    ``docs``: doc_id, source, lang, topic, tokens.  The cells are a listed source, one of LANGUAGES or
    other, and one of ``topics`` (topic; no repeats) or other.  They are aggregated before they reach the
    driver, and more than MOST_CELLS of them are an error.  Documents of a source are drawn systematically in stretches ordered by
    language and size: each is taken as often as its expected copies, rounded up or down, never over max_repeats.
    """
    spark = docs.sparkSession
    lang = F.lower(F.substring("lang", 1, 2))
    d = docs.where(F.col("tokens") > 0).join(topics.select("topic", F.lit(True).alias("_named")), "topic", "left").select(
        "doc_id", "source", "tokens", F.when(lang.isin(*LANGUAGES), lang).otherwise("other").alias("lang"), F.when(F.col("_named"), F.col("topic")).otherwise("other").alias("topic")
    )
    listed = targets.select("source").distinct()
    d = materialize(d.join(listed, "source", "left_semi"), "sized")
    cells = d.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).limit(MOST_CELLS + 1).toPandas()
    if len(cells) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells of source, language and topic")
    wanted = targets.toPandas()
    made = []
    for mix, t in wanted.groupby("mix_id"):
        r = rake(cells, t[["source", "target_share", "max_repeats"]])
        made.append(r.assign(mix_id=mix, cell_tokens=r["tokens"])[["mix_id", "source", "lang", "topic", "copies", "max_repeats", "n", "cell_tokens"]])
    for m in made:
        m["n"] = m.groupby("source")["n"].transform("sum")
    plan = pd.concat(made, ignore_index=True) if made else pd.DataFrame(columns=["mix_id", "source", "lang", "topic", "copies", "max_repeats", "n", "cell_tokens"])
    rates = spark.createDataFrame(plan, "mix_id string, source string, lang string, topic string, copies double, max_repeats int, n bigint, cell_tokens bigint")
    # a stretch has about STRETCH documents however large its source
    # the rates' size is known to the planner, which sends them to all executors only below its threshold
    x = d.join(rates, ["source", "lang", "topic"]).withColumn("stretch", F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.ceil(F.col("n") / STRETCH))))
    w = Window.partitionBy("mix_id", "source", "stretch").orderBy("lang", "tokens", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    start = F.pmod(F.xxhash64("mix_id", "source", "stretch"), F.lit(1_000_003)) / 1_000_003
    x = materialize(x.withColumn("upto", F.sum("copies").over(w) + start).select("mix_id", "doc_id", "source", "tokens", "copies", "max_repeats", "upto"), "upto")

    def times(shift: Column) -> Column:
        at = F.col("upto") + shift + 1e-9
        return F.least(F.floor(at) - F.floor(at - F.col("copies")), F.col("max_repeats"))

    # of STARTS places to start from, each source takes the one whose draw comes nearest to its tokens
    sums = x.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("goal"), *[F.sum(F.col("tokens") * times(F.lit(k / STARTS))).alias(f"s{k}") for k in range(STARTS)])
    gaps = F.array(*[F.struct(F.abs(F.col(f"s{k}") - F.col("goal")).alias("gap"), F.lit(k / STARTS).alias("shift")) for k in range(STARTS)])
    shifts = sums.select("mix_id", "source", F.array_min(gaps)["shift"].alias("shift"))
    chosen = x.join(shifts, ["mix_id", "source"]).withColumn("times", times(F.col("shift"))).where("times > 0")
    return chosen.select("mix_id", "doc_id", "source", "tokens", F.col("times").cast("int").alias("copies")), rates


def _mixed(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = table(spark, root, "documents")
    topics = table(spark, root, "chunking_options").where("kb_id IS NOT NULL").select(F.col("kb_id").alias("topic")).distinct()
    sized = counted(docs.where("source IS NOT NULL"), "text", ("doc_id", "source", "lang", "kb_id")).withColumnRenamed("kb_id", "topic")
    targets = table(spark, root, "mix_targets").dropDuplicates(["mix_id", "source"])
    chosen, rates = mixed(sized, targets, topics)
    return chosen, targets, rates


def p9_mix(spark: SparkSession, root: str) -> DataFrame:
    """The documents of each mix and how often each is taken."""
    return _mixed(spark, root)[0]


def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    """Target and reached share of all tokens of each source of each mix.

    ``supply`` is what the source holds under its cap of repeats; what the scarcest source of a mix makes
    the others leave out is the rest of it over ``tokens``.
    """
    chosen, targets, rates = _mixed(spark, root)
    held = rates.groupBy("mix_id", "source").agg(F.sum(F.col("cell_tokens") * F.col("max_repeats")).alias("supply"))
    got = chosen.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    whole = Window.partitionBy("mix_id")
    t = targets.join(got, ["mix_id", "source"], "left").join(held, ["mix_id", "source"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    return t.select("mix_id", "source", "target_share", F.round(F.col("tokens") / F.sum("tokens").over(whole), 6).alias("reached_share"), "tokens", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.coalesce("supply", F.lit(0)).alias("supply"))


QUERIES = {"p9_mix": p9_mix, "p9_shares": p9_shares}
ORACLE: dict[str, str] = {}
