"""Problem 2: percentiles of very large columns, from sketches that can be joined.

Method: relative-rank compactors.  Each level keeps its largest items whole and compacts the smaller
ones, every second of which moves up with twice the weight; so the rank error of an item is in
proportion to the number of items above it, and extreme high percentiles are nearly exact.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.session import materialize, parallelism
from lodestone.sources.tables import table

#: Items of a section; more make the sketch larger and the error smaller.
SECTION = 64
PERCENTS = (0.5, 0.75, 0.9, 0.95, 0.99, 0.999)
#: Sections compacted at first, and the constant of the method's standard error.
SECTIONS, ERROR = 3, 0.0512
#: Sketches of a group that one task merges; numbers that the sketches of a task hold together.
FAN, HELD = 64, 4_000_000


class RankSketch:
    """Quantile sketch of numbers with an error relative to the rank from the top.

    With 99.7 % confidence the rank of an answer is off by ``bound(q)`` of all items at most; sketches
    of disjoint items merge to a sketch of their union under the same bound.
    """

    def __init__(self, section: int = SECTION) -> None:
        self.section, self.n = section, 0
        self.low, self.high = np.inf, -np.inf
        self.levels: list[np.ndarray] = [np.zeros(0)]
        self.turns: list[int] = [0]

    def bound(self, q: float) -> float:
        """Rank error, as a share of all items, at three standard deviations."""
        return 0.0 if len(self.levels) == 1 else 3 * (ERROR / SECTIONS) ** 0.5 / self.section * (1 - q)

    def add(self, values: np.ndarray) -> RankSketch:
        """Take up items; NaN is left out."""
        v = np.asarray(values, dtype=np.float64)
        v = v[~np.isnan(v)]
        if len(v):
            self.n += len(v)
            self.low, self.high = min(self.low, v.min()), max(self.high, v.max())
            self.levels[0] = np.concatenate([self.levels[0], v])
            self._compress()
        return self

    def merge(self, other: RankSketch) -> RankSketch:
        """Take up another sketch's items."""
        while len(self.levels) < len(other.levels):
            self.levels.append(np.zeros(0))
            self.turns.append(0)
        for h, items in enumerate(other.levels):
            self.levels[h] = np.concatenate([self.levels[h], items])
            self.turns[h] |= other.turns[h]
        self.n += other.n
        self.low, self.high = min(self.low, other.low), max(self.high, other.high)
        self._compress()
        return self

    def _compress(self) -> None:
        sections = max(SECTIONS, int(np.ceil(np.log2(max(2, self.n / self.section)))))
        room = 2 * self.section * sections
        h = 0
        while h < len(self.levels):
            items = self.levels[h]
            if len(items) > room:
                items = np.sort(items)
                turn = self.turns[h]
                # the lowest section is compacted each time, the next every second time, and so on
                ones = (turn ^ (turn + 1)).bit_length()
                keep = room // 2 + (sections - min(ones, sections)) * self.section
                keep += (len(items) - keep) % 2
                moved, self.levels[h] = items[: len(items) - keep], items[len(items) - keep :]
                if h + 1 == len(self.levels):
                    self.levels.append(np.zeros(0))
                    self.turns.append(0)
                # the first of each two turns draws a side by hash, the second takes the other one
                side = (((turn // 2 + 1) * 0x9E3779B1 + h * 0x85EBCA6B + self.n) >> 7) & 1 if turn % 2 == 0 else self._side[h] ^ 1
                self._side[h] = side
                self.levels[h + 1] = np.concatenate([self.levels[h + 1], moved[side::2]])
                self.turns[h] = turn + 1
            h += 1

    def size(self) -> int:
        """Numbers held."""
        return sum(map(len, self.levels))

    @property
    def _side(self) -> dict[int, int]:
        if not hasattr(self, "_sides"):
            self._sides = dict.fromkeys(range(64), 0)
        return self._sides

    def quantiles(self, qs: tuple[float, ...]) -> list[float]:
        """Smallest item whose estimated rank reaches each share; NaN for an empty sketch."""
        if not self.n:
            return [float("nan")] * len(qs)
        items = np.concatenate(self.levels)
        weights = np.concatenate([np.full(len(x), 1 << h, dtype=np.float64) for h, x in enumerate(self.levels)])
        order = np.argsort(items, kind="stable")
        items, ranks = items[order], np.cumsum(weights[order])
        at = np.searchsorted(ranks, np.ceil(np.array(qs) * ranks[-1]).clip(1), "left").clip(0, len(items) - 1)
        return [float(min(max(x, self.low), self.high)) for x in items[at]]

    def to_bytes(self) -> bytes:
        head = struct.pack("<HHqdd", self.section, len(self.levels), self.n, self.low, self.high)
        return head + b"".join(struct.pack("<qi", t, len(x)) for t, x in zip(self.turns, self.levels, strict=True)) + b"".join(x.astype("<f8").tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, raw: bytes) -> RankSketch:
        section, levels, n, low, high = struct.unpack_from("<HHqdd", raw)
        s = cls(section)
        s.n, s.low, s.high, at = n, low, high, struct.calcsize("<HHqdd")
        heads = [struct.unpack_from("<qi", raw, at + 12 * h) for h in range(levels)]
        at += 12 * levels
        s.levels, s.turns = [], [t for t, _ in heads]
        for _, k in heads:
            s.levels.append(np.frombuffer(raw, "<f8", k, at).copy())
            at += 8 * k
        return s


def sketches(df: DataFrame, groups: list[str], values: list[str]) -> DataFrame:
    """A sketch per group and value column of each partition: ``groups``, field, sketch.

    Built where the rows are, so a hot group costs one sketch a partition.  Sketches that hold more than
    HELD numbers together are passed on and begun anew, so a task's memory is bounded however many groups
    it meets.  Null and negative numbers are left out; a group without any number gives no row.
    """
    kept = ", ".join(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in groups)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, RankSketch] = {}
        size = 0
        for pdf in batches:
            for key, rows in pdf.groupby(groups, dropna=False, sort=False):
                for v in values:
                    x = rows[v].to_numpy(dtype=np.float64, na_value=np.nan)
                    x = x[x >= 0]
                    if len(x):
                        k = (*(None if pd.isna(g) else g for g in key), v)
                        s = held.setdefault(k, RankSketch())
                        size -= s.size()
                        size += s.add(x).size()
            if size > HELD:
                yield _frame(list(held.items()), groups)
                held, size = {}, 0
        if held:
            yield _frame(list(held.items()), groups)

    return df.select(*groups, *values).mapInPandas(run, f"{kept}, field string, sketch binary")


def _frame(held: list[tuple[tuple, RankSketch]], groups: list[str]) -> pd.DataFrame:
    out = pd.DataFrame([k[: len(groups) + 1] for k, _ in held], columns=[*groups, "field"])
    out["sketch"] = [s.to_bytes() for _, s in held]
    return out


def _merge_sorted(groups: list[str], keys: list[str]):  # noqa: ANN202
    """Merges runs of rows with equal ``keys``, one sketch held at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: tuple | None = None
        s: RankSketch | None = None
        for pdf in batches:
            done: list[tuple[tuple, RankSketch]] = []
            for *key, raw in pdf[[*keys, "sketch"]].itertuples(index=False, name=None):
                k = tuple(None if pd.isna(g) else g for g in key)
                if k == now:
                    s.merge(RankSketch.from_bytes(raw))
                else:
                    if s is not None:
                        done.append((now, s))
                    now, s = k, RankSketch.from_bytes(raw)
            if done:
                yield _frame(done, groups)
        if s is not None:
            yield _frame([(now, s)], groups)

    return run


def merged(sk: DataFrame, groups: list[str], fan: int = FAN) -> DataFrame:
    """One sketch per group and field, merged in a tree: no task takes up more than about ``fan`` sketches of a group.

    The sketches are written once and counted.  As long as a group has more than ``fan`` of them, its sketches are
    dealt at random into parts of that size, each of which is merged.  Rows are sorted by group, so that a task
    holds one sketch at a time.
    """
    spark = sk.sparkSession
    kept = ", ".join(f"`{g}` {sk.schema[g].dataType.simpleString()}" for g in groups)
    schema = f"{kept}, field string, sketch binary"
    keys = [*groups, "field"]
    n = parallelism(spark)
    sk = materialize(sk.select(*keys, "sketch"), "sketches")
    while True:
        counts = sk.groupBy(*keys).agg(F.count("*").alias("_n"))
        most = counts.agg(F.max("_n")).first()[0] or 0
        if most <= fan:
            break
        parts = sk.join(counts.select(*[F.col(k).alias(f"_{k}") for k in keys], "_n"), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
        parts = parts.select(*keys, "sketch", F.pmod(F.xxhash64("sketch"), F.ceil(F.col("_n") / fan)).alias("_part"))
        sorted_ = parts.repartition(n, *keys, "_part").sortWithinPartitions(*keys, "_part")
        sk = materialize(sorted_.mapInPandas(_merge_sorted(groups, [*keys, "_part"]), schema), "sketches")
    return sk.repartition(n, *keys).sortWithinPartitions(*keys).mapInPandas(_merge_sorted(groups, keys), schema)


def percentiles(sk: DataFrame, groups: list[str], qs: tuple[float, ...] = PERCENTS) -> DataFrame:
    """``groups``, field, n, q, value and rank_error (share of n, at 99.7 % confidence) of merged sketches."""
    kept = ", ".join(f"`{g}` {sk.schema[g].dataType.simpleString()}" for g in groups)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False, name=None):
                s = RankSketch.from_bytes(row[-1])
                out += [(*(None if pd.isna(g) else g for g in row[:-1]), s.n, q, v, s.bound(q)) for q, v in zip(qs, s.quantiles(qs), strict=True)]
            yield pd.DataFrame(out, columns=[*groups, "field", "n", "q", "value", "rank_error"])

    return sk.select(*groups, "field", "sketch").mapInPandas(run, f"{kept}, field string, n bigint, q double, value double, rank_error double")


def _calls(spark: SparkSession, root: str) -> DataFrame:
    """Calls, those that arrived again once (all but the arrival equal), with their day.

    Equal calls meet by a 128-bit digest of their columns, so that only it and the columns needed are shuffled.
    """
    same = ["trace_id", "ts", "kb_id", "tenant_id", "role", "provider", "model", "prompt_tokens", "completion_tokens", "cost_usd", "ok", "cached"]
    marked = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in same]  # null differs from what no column holds
    c = table(spark, root, "cost_records").select("model", "kb_id", F.to_date("ts").alias("day"), "prompt_tokens", "completion_tokens", F.unhex(F.md5(F.concat_ws("\x1f", *marked))).alias("_d"))
    return c.dropDuplicates(["_d"]).drop("_d")


FIELDS = ["prompt_tokens", "completion_tokens"]


def p2_daily(spark: SparkSession, root: str) -> DataFrame:
    """Percentiles of each model, knowledge base and day."""
    keys = ["model", "kb_id", "day"]
    return percentiles(merged(sketches(_calls(spark, root), keys, FIELDS), keys), keys)


def p2_rollup(spark: SparkSession, root: str) -> DataFrame:
    """Percentiles of each model and knowledge base, joined from the sketches of single days."""
    days, keys = ["model", "kb_id", "day"], ["model", "kb_id"]
    return percentiles(merged(merged(sketches(_calls(spark, root), days, FIELDS), days), keys), keys)


def p2_percentiles(spark: SparkSession, root: str) -> DataFrame:
    """Percentiles of each model and knowledge base, from the sketches of single partitions."""
    keys = ["model", "kb_id"]
    return percentiles(merged(sketches(_calls(spark, root), keys, FIELDS), keys), keys)


QUERIES = {"p2_percentiles": p2_percentiles, "p2_daily": p2_daily, "p2_rollup": p2_rollup}
ORACLE: dict[str, str] = {}
