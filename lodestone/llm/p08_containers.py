"""Problem 8: fill containers of fixed capacity with documents, leaving little room unused.

Method: bin completion by branch and bound.  Around the largest document left, the undominated
fillings are enumerated, branches are pruned by the bound of the room wasted, and best fit gives the
incumbent.  Documents are dealt by hash into lots that are packed on their own.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.tokens import counted
from lodestone.plans.session import parallelism
from lodestone.sources.tables import table

#: Documents of a lot (about), fillings looked at around one document, branches looked at in a lot.
LOT, FILLINGS, BRANCHES = 2000, 24, 400
#: Specifications that are packed at once; a longer table is an error.
MOST_SPECS = 1000


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best fit decreasing: each item, largest first, into the fullest container it fits; lists of indices.

    A number's bits mark the room left over of the open containers, so that the search is one shift.
    """
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    bins: list[list[int]] = []
    open_: dict[int, list[int]] = {}
    mask = 0
    for i in order:
        s = sizes[i]
        fits = mask >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            k = open_[room].pop()
            if not open_[room]:
                mask &= ~(1 << room)
        else:
            room, k = capacity, len(bins)
            bins.append([])
        bins[k].append(i)
        room -= s
        open_.setdefault(room, []).append(k)
        mask |= 1 << room
    return bins


def fillings(room: int, sizes: list[int], counts: dict[int, int], most: int = FILLINGS) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room`` from ``counts`` (size to number left), the fullest first.

    Up to three sizes are enumerated with the rest taken greedily.  A filling is dominated, and left
    out, if one of its items can be swapped for a larger unused one that still fits.
    """
    out: set[tuple[int, ...]] = set()
    left = [s for s in sizes if s <= room and counts[s] > 0]  # largest first

    def greedy(room: int, start: int, used: tuple[int, ...]) -> tuple[int, ...]:
        got = []
        for s in left[start:]:
            if s > room:
                continue
            n = min(room // s, counts[s] - used.count(s)) if s else 0
            got += [s] * n
            room -= n * s
            if not room:
                break
        return tuple(got)

    for a in range(min(len(left), most)):
        f = (left[a],)
        rest = room - left[a]
        out.add(f + greedy(rest, a, f))
        tried = 0
        for b in range(a, len(left)):
            if left[b] > rest or (b == a and counts[left[a]] < 2):
                continue
            g = (*f, left[b])
            out.add(g + greedy(rest - left[b], b, g))
            tried += 1
            if tried >= 3 or len(out) >= 4 * most:
                break
    out.add(())
    if left:
        out.discard(())
    ranked = sorted(out, key=lambda f: (room - sum(f), -max(f, default=0)))

    rising = left[::-1]

    def dominated(f: tuple[int, ...]) -> bool:
        waste = room - sum(f)
        return any(counts[y] > f.count(y) for x in set(f) for y in rising[bisect_right(rising, x) : bisect_right(rising, x + waste)])

    kept = [f for f in ranked if not dominated(f)]
    return (kept or ranked)[:most]


def pack(sizes: list[int], capacity: int, branches: int = BRANCHES) -> list[list[int]]:
    """Containers as lists of indices, none over ``capacity``; sizes are 0 to ``capacity``.

    Best fit is returned where it meets the bound (total size over capacity, rounded up), else the
    best that at most ``branches`` branches of bin completion yield.
    """
    incumbent = best_fit(sizes, capacity)
    total = sum(sizes)
    bound = max(1, math.ceil(total / capacity)) if sizes else 0
    if len(incumbent) <= bound:
        return incumbent
    counts: dict[int, int] = {}
    for s in sizes:
        counts[s] = counts.get(s, 0) + 1
    distinct = sorted(counts, reverse=True)
    best: list[tuple[int, ...]] | None = None
    best_n, seen = len(incumbent), 0
    stack: list[tuple[int, tuple[int, ...]]] = []
    chosen: list[tuple[int, ...]] = []
    wasted = [0]

    def largest() -> int | None:
        return next((s for s in distinct if counts[s] > 0), None)

    def expand(depth: int) -> None:
        top = largest()
        counts[top] -= 1
        # the best filling is taken last from the stack, that is first
        for f in fillings(capacity - top, distinct, counts, 6)[::-1]:
            stack.append((depth, (top, *f)))
        counts[top] += 1

    if sizes:
        expand(0)
    while stack and seen < branches * 4 + len(incumbent):
        depth, f = stack.pop()
        while len(chosen) > depth:
            for s in chosen.pop():
                counts[s] += 1
            wasted.pop()
        seen += 1
        waste = wasted[-1] + capacity - sum(f)
        if waste > (best_n - 1) * capacity - total:
            continue  # no better than the incumbent, however the rest is packed
        for s in f:
            counts[s] -= 1
        chosen.append(f)
        wasted.append(waste)
        if largest() is None:
            if len(chosen) < best_n:
                best, best_n = list(chosen), len(chosen)
                if best_n <= bound:
                    break
        elif len(chosen) + 1 < best_n:
            expand(len(chosen))
    if best is None:
        return incumbent
    at: dict[int, list[int]] = {}
    for i, s in enumerate(sizes):
        at.setdefault(s, []).append(i)
    return [[at[s].pop() for s in f] for f in best]


def packed(df: DataFrame, key: str, tokens: str, specs: list[tuple[str, int]], rows: int, lot: int = LOT) -> DataFrame:
    """spec_id, container_id, ``key``, part_no, tokens: every item in one container of each spec.

    Only an item over the capacity is divided, into parts of the capacity and a rest.  Items without
    tokens go into a container as well.  Rows with null key or tokens are left out.  Lots have a
    bounded number of items however keys are skewed, as they are drawn by the key's hash.
    """
    lots = max(1, round(rows / lot))
    kind = df.schema[key].dataType.simpleString()

    def one_lot(lot_no: int, pdf: pd.DataFrame) -> pd.DataFrame:
        keys, sizes = pdf[key].to_numpy(), pdf[tokens].to_numpy().astype(int)
        out = []
        for spec, capacity in specs:
            full = sizes // capacity
            rest = sizes - full * capacity
            whole = (full > 0) & (rest == 0)
            n = 0
            many = np.repeat(np.arange(len(sizes)), full)
            part = np.arange(len(many)) - np.repeat(np.cumsum(full) - full, full)
            out.append((spec, np.arange(len(many)), many, part, np.full(len(many), capacity)))
            n = len(many)
            at = np.flatnonzero(~whole)
            bins = pack([int(x) for x in rest[at]], capacity)
            which = np.concatenate([np.array(b, int) for b in bins]) if bins else np.zeros(0, int)
            no = np.repeat(np.arange(len(bins)), [len(b) for b in bins]) + n
            out.append((spec, no, at[which], full[at[which]], rest[at[which]]))
        return pd.DataFrame(
            {
                "spec_id": np.concatenate([[o[0]] * len(o[1]) for o in out]),
                "container_id": np.concatenate([[f"{lot_no}-{x}" for x in o[1]] for o in out]),
                key: keys[np.concatenate([o[2] for o in out]).astype(int)],
                "part_no": np.concatenate([o[3] for o in out]).astype("int32"),
                "tokens": np.concatenate([o[4] for o in out]).astype("int32"),
            }
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            last = int(np.searchsorted(held["_lot"].to_numpy(), held["_lot"].iloc[-1], "left")) if len(held) else 0
            for n, g in held.iloc[:last].groupby("_lot", sort=False):
                yield one_lot(int(n), g)
            held = held.iloc[last:]
        if held is not None and len(held):
            yield one_lot(int(held["_lot"].iloc[0]), held)

    dealt = df.select(key, tokens).where(F.col(key).isNotNull() & F.col(tokens).isNotNull()).withColumn("_lot", F.pmod(F.xxhash64(key), F.lit(lots)))
    # a number of partitions that is given stays as it is, so small lots are not joined into one task
    parts = min(lots, max(parallelism(df.sparkSession), lots // 64))
    return dealt.repartition(parts, "_lot").sortWithinPartitions("_lot", key).mapInPandas(run, f"spec_id string, container_id string, `{key}` {kind}, part_no int, tokens int")


def _packed(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    rows = table(spark, root, "container_specs").where("capacity_tokens > 0").orderBy("spec_id").limit(MOST_SPECS + 1).collect()
    if len(rows) > MOST_SPECS:
        raise ValueError(f"more than {MOST_SPECS} container specifications")
    specs = [(r[0], int(r[1])) for r in rows]
    return packed(counted(docs, "text", ("doc_id",)).dropDuplicates(["doc_id"]), "doc_id", "tokens", specs, docs.count())


def p8_containers(spark: SparkSession, root: str) -> DataFrame:
    """The container of each document, for each specification."""
    return _packed(spark, root)


def p8_room(spark: SparkSession, root: str) -> DataFrame:
    """Containers used, least number possible, and share of room left, for each specification."""
    p = _packed(spark, root)
    one = p.groupBy("spec_id", "container_id").agg(F.sum("tokens").alias("t")).groupBy("spec_id").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"))
    specs = table(spark, root, "container_specs")
    least = F.ceil(F.col("tokens") / F.col("capacity_tokens"))
    return one.join(specs, "spec_id").select("spec_id", "containers", least.alias("least"), "tokens", F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("unused"))


QUERIES = {"p8_containers": p8_containers, "p8_room": p8_room}
ORACLE: dict[str, str] = {}
