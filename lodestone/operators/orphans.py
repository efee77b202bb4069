"""Problem 5: references to records that are missing, removed or came later.

Method: keyed pending-orphan state, kept incrementally.  New references probe the parent index,
arriving parents resolve the orphans that wait for them, deletions reopen settled references, and
counts are taken from the state per table and period.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.session import shared_dir
from lodestone.sources.tables import table

REFS = "tbl string, rec_id string, key string, ts timestamp"
PARENTS = "key string, created_at timestamp, deleted_at timestamp"


class OrphanState(NamedTuple):
    """``parents``: key, created_at, deleted_at; ``pending``: tbl, rec_id, key, ts, kind of the references that do not
    hold; ``settled``: tbl, rec_id, key, ts of those that held when they were last looked at (a log; ``pending`` decides)."""

    parents: DataFrame
    pending: DataFrame
    settled: DataFrame


def kind_of(created_at: Column, deleted_at: Column, found: Column, ts: Column) -> Column:
    """``missing``, else ``deleted``, else ``late``, else null (settled)."""
    return F.when(found.isNull(), F.lit("missing")).when(deleted_at.isNotNull(), F.lit("deleted")).when(created_at > ts, F.lit("late"))


def index(parents: DataFrame) -> DataFrame:
    """One row per parent key: first creation, last deletion.  Null keys are no parents."""
    return parents.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("created_at").alias("created_at"), F.max("deleted_at").alias("deleted_at"))


def probe(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """References with their kind.  The reference side is the one that can be skewed; being the
    preserved side of an outer join, its hot keys are split by adaptive execution."""
    p = parents.select("key", F.col("created_at").alias("_c"), F.col("deleted_at").alias("_d"), F.lit(1).alias("_f"))
    return refs.join(p, "key", "left").select("tbl", "rec_id", "key", "ts", kind_of(F.col("_c"), F.col("_d"), F.col("_f"), F.col("ts")).alias("kind"))


class Step(NamedTuple):
    """What a batch changes: its parents, all that is pending after it, and the references it settles."""

    parents: DataFrame
    pending: DataFrame
    settled: DataFrame


def step(state: OrphanState | None, refs: DataFrame, parents: DataFrame) -> Step:
    """The change that a batch of references and of parent rows (created, or deleted by ``deleted_at``) makes.

    New references probe the parents known so far and those of the batch; pending ones are looked at again where
    the batch has their parent; settled ones are reopened where it deletes their parent.  All others keep
    their kind and are not moved.  References with a null key or rec_id do not count; repeated ones count once.
    """
    refs = refs.select("tbl", "rec_id", "key", "ts").where(F.col("key").isNotNull() & F.col("rec_id").isNotNull())
    new = index(parents)
    if state is None:
        looked, kept = probe(refs, new), None
    else:
        known = index(state.parents.unionByName(new))
        waiting = state.pending.join(new.select("key"), "key", "left_semi").select("tbl", "rec_id", "key", "ts")
        reopened = state.settled.join(new.where("deleted_at IS NOT NULL").select("key"), "key", "left_semi").select("tbl", "rec_id", "key", "ts")
        looked = probe(refs.unionByName(waiting).unionByName(reopened), known)
        kept = state.pending.join(new.select("key"), "key", "left_anti").select("tbl", "rec_id", "key", "ts", "kind")
    open_ = looked.where(F.col("kind").isNotNull())
    return Step(new, (open_ if kept is None else kept.unionByName(open_)).distinct(), looked.where(F.col("kind").isNull()).drop("kind").distinct())


def advance(state: OrphanState | None, refs: DataFrame, parents: DataFrame) -> OrphanState:
    """The state after a batch (see :func:`step`).  Any split of the same rows into batches leads to the same orphans."""
    d = step(state, refs, parents)
    if state is None:
        return OrphanState(*d)
    return OrphanState(state.parents.unionByName(d.parents), d.pending, state.settled.unionByName(d.settled))


def orphans(state: OrphanState) -> DataFrame:
    """tbl, rec_id, kind of each record whose reference does not hold."""
    return state.pending.select("tbl", "rec_id", "kind").distinct()


def snapshot(state: OrphanState, period: str = "month") -> DataFrame:
    """Orphans per table, period of the record and kind."""
    one = state.pending.groupBy("tbl", "rec_id", "kind").agg(F.min("ts").alias("ts"))
    return one.groupBy("tbl", F.date_format(F.date_trunc(period, "ts"), "yyyy-MM-dd").alias("period"), "kind").agg(F.count("*").alias("n_orphans"))


class OrphanTracker:
    """The state as tables in a shared folder; made for ``foreachBatch``.

    Each batch (numbered from 0, without gaps) adds its parents and the references that it settled, and writes what is
    pending anew.  A batch that is applied again (after a restart) starts from the state before it and
    overwrites its own folders, so that it counts once.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _at(self, part: str, batch: int) -> str:
        return f"{self.folder}/{part}-{batch:09d}"

    def _path(self, at: str):  # noqa: ANN202
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def load(self, batch: int) -> OrphanState:
        """The state after a batch; an error if it was not applied or its pending rows are no longer kept."""
        path, fs = self._path(f"{self._at('pending', batch)}/_SUCCESS")
        if batch < 0 or not fs.exists(path):
            raise ValueError(f"there is no state of batch {batch}")
        every = lambda part: self.spark.read.parquet(*[self._at(part, k) for k in range(batch + 1)])
        return OrphanState(every("parents"), self.spark.read.parquet(self._at("pending", batch)), every("settled"))

    def apply(self, batch: int, refs: DataFrame, parents: DataFrame) -> OrphanState:
        new = step(self.load(batch - 1) if batch else None, refs, parents)
        for part, rows in (("parents", new.parents), ("settled", new.settled), ("pending", new.pending)):
            rows.write.mode("overwrite").parquet(self._at(part, batch))
        if batch > 1:  # a replay needs the state before the last batch only
            path, fs = self._path(self._at("pending", batch - 2))
            fs.delete(path, True)
        return self.load(batch)


#: Periods in which the tables are fed to the tracker, before the deletions.
PERIODS = 3


def _fed(spark: SparkSession, root: str) -> OrphanState:
    """The state after all references and parents came in by period, and the deletions last."""
    docs = table(spark, root, "documents").select(F.concat(F.lit("d"), "doc_id").alias("key"), "created_at", "deleted_at")
    tasks = table(spark, root, "tasks").select(F.concat(F.lit("t"), "task_id").alias("key"), "created_at", F.lit(None).cast("timestamp").alias("deleted_at"))
    parents = docs.unionByName(tasks)

    def refs_of(name: str, rec: str, mark: str, key: str, ts: str) -> DataFrame:
        return table(spark, root, name).select(F.lit(name).alias("tbl"), F.expr(rec).alias("rec_id"), F.concat(F.lit(mark), F.col(key)).alias("key"), F.col(ts).alias("ts"))

    refs = refs_of("atoms", "atom_id", "d", "doc_id", "created_at")
    for of in (("chunks", "chunk_id", "d", "doc_id", "created_at"), ("tasks", "task_id", "d", "doc_id", "created_at"), ("checkpoints", "task_id || ':' || stage", "t", "task_id", "started_at")):
        refs = refs.unionByName(refs_of(*of))
    # rows of before the first and after the last of these times are fed in the first and the last period
    lo, hi = parents.agg(F.min("created_at"), F.max("created_at")).first()
    times = [lo + (hi - lo) * k / PERIODS for k in range(1, PERIODS)] if lo else []

    def in_period(df: DataFrame, ts: str, k: int) -> DataFrame:
        from_ = F.lit(True) if k == 0 else F.col(ts) >= F.lit(times[k - 1])
        to = F.lit(True) if k == len(times) else F.col(ts) < F.lit(times[k])
        return df.where((from_ & to) | F.col(ts).isNull() if k == 0 else from_ & to)

    tracker = OrphanTracker(spark, f"{shared_dir(spark)}/lodestone/orphans-{uuid.uuid4().hex}")
    created = parents.withColumn("deleted_at", F.lit(None).cast("timestamp"))
    for k in range(len(times) + 1):
        tracker.apply(k, in_period(refs, "ts", k), in_period(created, "created_at", k))
    return tracker.apply(len(times) + 1, refs.limit(0), parents.where("deleted_at IS NOT NULL"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Records of atoms, chunks, tasks and checkpoints whose reference does not hold, as the tracker has them in the end."""
    return orphans(_fed(spark, root))


def p5_periods(spark: SparkSession, root: str) -> DataFrame:
    """Orphans per table, month and kind, as the tracker has them in the end."""
    return snapshot(_fed(spark, root))


QUERIES = {"p5_found": p5_found, "p5_periods": p5_periods}

_REFS = """
  SELECT 'atoms' AS tbl, atom_id AS rec_id, doc_id, created_at AS ts FROM atoms
  UNION SELECT 'chunks', chunk_id, doc_id, created_at FROM chunks
  UNION SELECT 'tasks', task_id, doc_id, created_at FROM tasks"""
_FOUND = f"""
  SELECT DISTINCT tbl, rec_id, ts, CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN d.deleted_at IS NOT NULL THEN 'deleted' WHEN d.created_at > ts THEN 'late' END AS kind
  FROM ({_REFS}) r LEFT JOIN documents d ON d.doc_id = r.doc_id WHERE r.doc_id IS NOT NULL
  UNION ALL
  SELECT DISTINCT 'checkpoints', c.task_id || ':' || stage, started_at, CASE WHEN t.task_id IS NULL THEN 'missing' WHEN t.created_at > started_at THEN 'late' END
  FROM checkpoints c LEFT JOIN (SELECT task_id, min(created_at) AS created_at FROM tasks GROUP BY 1) t ON t.task_id = c.task_id WHERE c.task_id IS NOT NULL"""
ORACLE = {
    "p5_found": f"SELECT DISTINCT tbl, rec_id, kind FROM ({_FOUND}) WHERE kind IS NOT NULL",
    "p5_periods": f"""SELECT tbl, strftime(date_trunc('month', ts), '%Y-%m-%d') AS period, kind, count(*) AS n_orphans
FROM (SELECT tbl, rec_id, kind, min(ts) AS ts FROM ({_FOUND}) WHERE kind IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2, 3""",
}
