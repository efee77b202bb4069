"""Problem 6: groups of records that differ by small edits.

Method: segment-popcount embedding.  A record's fingerprint has a segment of eight bits for each of 64
minimum hashes; it is embedded as the 64 bit counts of its segments.  Where a minimum hash agrees, the
counts do, and each hash that differs adds 1.6 on average, so the Manhattan distance of two embeddings is a lower bound of
the bits that differ and tells their share.  Pairs beyond RADIUS are dropped before any text is fetched (see :func:`sieve_loss` for what
that can cost), and the others are verified exactly on the runs of characters.

One step departs from the method: which pairs are compared.  A grid over bit counts cannot find them.  At a share of
0.60 the expected distance is 40 of 100 for unrelated texts, so by pigeonhole a group of segments whose counts are
nearly equal must be so small that unrelated texts fall together in it as well.  Pairs meet instead in
one of BLOCKS cells, each the digest of five minimum hashes (probability in :func:`recall`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.classes import linked_pairs
from lodestone.operators.graph import components
from lodestone.plans.session import materialize, parallelism
from lodestone.sources.tables import table

#: Characters of a run, least share of common runs, least characters of a text.
RUN, SHARE, LEAST_CHARS = 12, 0.60, 120
#: Minimum hashes, subsets of them (blocks), hashes in a subset.
HASHES, BLOCKS, ROWS = 64, 40, 5
#: A cell of at most this many records gives all its pairs at once; a larger one is cut into
#: parts of about PART records, all of which are compared with one another.
CELL, PART = 100, 2048
#: Largest Manhattan distance of the bit counts of two records that are verified.
RADIUS = 74
SEED = 20


def normalised(text: str) -> str:
    """Lower case without blanks, tabs and line breaks."""
    return text.lower().replace(" ", "").replace("\n", "").replace("\t", "").replace("\r", "")


@lru_cache(1)
def _numbers() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    r = np.random.default_rng(SEED)
    powers = np.array([pow(0x9E3779B97F4A7C15, j, 1 << 64) for j in range(RUN)], dtype=np.uint64)
    mult = r.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    add = r.integers(0, 1 << 32, HASHES, dtype=np.uint32)
    # every hash is in about as many blocks
    rows = np.stack([np.sort(r.permutation(HASHES)[:ROWS]) for _ in range(BLOCKS)])
    return powers, mult, add, rows


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def hashed(norm: str) -> np.ndarray:
    """64-bit hashes of all runs of a normalised text; those of twice the length are made from two halves."""
    h = np.frombuffer(norm.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    n = len(h) - RUN + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    powers, two = _numbers()[0], None
    for k in (1, 2, 4):  # h holds the runs of k characters
        if k == 4:
            two = h
        h = h[:-k] * powers[k] + h[k:]
    h = h[:n] * powers[4] + two[8 : 8 + n]
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)


def runs(norm: str) -> np.ndarray:
    """The set of the hashes of all runs, sorted."""
    h = np.sort(hashed(norm))
    first = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=first[1:])
    return h[first]


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of each of the hash functions."""
    _, mult, add, _ = _numbers()
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 4096):  # stays in the cache
        x = h[at : at + 4096][None, :] * mult[:, None]
        x += add[:, None]
        np.minimum(best, x.min(axis=1), out=best)
    return best


def cells(minima_: np.ndarray) -> np.ndarray:
    """The digest of each block's minimum hashes; blocks never share a cell but by chance."""
    rows = _numbers()[3]
    h = np.zeros(minima_.shape[:-1] + (BLOCKS,), np.uint64)
    for j in range(ROWS):
        h = _mix(h * np.uint64(31) + minima_[..., rows[:, j]].astype(np.uint64) + np.uint64(j + 1))
    return _mix(h + np.arange(1, BLOCKS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


def fingerprint(minima_: np.ndarray) -> np.ndarray:
    """The segment of eight bits of each minimum hash."""
    h = minima_ * np.uint32(0x85EBCA6B)
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> np.uint32(24)).astype(np.uint8)


def embedded(minima_: np.ndarray) -> np.ndarray:
    """The bit counts (0 to 8) of the segments of the fingerprint."""
    return _ONES[fingerprint(minima_)]


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of bit counts, row by row: never more than the number of bits in which the fingerprints differ."""
    return (np.maximum(a, b) - np.minimum(a, b)).sum(axis=-1, dtype=np.int64)


def share(a: np.ndarray, b: np.ndarray) -> float:
    """Size of the common set over size of the united set."""
    c = np.sort(np.concatenate([a, b]))
    both = int(np.count_nonzero(c[1:] == c[:-1]))
    return both / max(1, len(a) + len(b) - both)


def recall(at: float, trials: int = 20000) -> float:
    """Probability that two records which share ``at`` of their content meet in a cell."""
    r = np.random.default_rng(1)
    same = r.random((trials, HASHES)) < at
    return float(same[:, _numbers()[3]].all(axis=2).any(axis=1).mean())


def sieve_loss(at: float) -> float:
    """Probability that the embeddings of two records which share ``at`` of their content are beyond RADIUS.

    The distance is a sum over independent segments: nothing where the hash agrees, else the difference of the
    bit counts of two random bytes.
    """
    n = np.bincount(_ONES, minlength=9) / 256
    one = np.array([sum(n[i] * n[j] for i in range(9) for j in range(9) if abs(i - j) == d) for d in range(9)]) * (1 - at)
    one[0] += at
    total = np.ones(1)
    for _ in range(HASHES):
        total = np.convolve(total, one)
    return float(total[RADIUS + 1 :].sum())


def within(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b`` (rows of bit counts) of all pairs within RADIUS."""
    left, right, columns = [], [], np.ascontiguousarray(b.T)
    for at in range(0, len(a), 64):  # stays in the cache
        x = a[at : at + 64]
        n = np.zeros((len(x), len(b)), np.uint16)
        for k in range(HASHES):
            n += np.maximum(x[:, k, None], columns[k]) - np.minimum(x[:, k, None], columns[k])
        i, j = np.nonzero(n <= RADIUS)
        left.append(i + at)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def _counts(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, HASHES)


def fingerprints(df: DataFrame, key: str, text: str, tbl: str, least_chars: int = LEAST_CHARS) -> DataFrame:
    """tbl, key, cls (64-bit digest of table and normalised text), cells and sig (the embedding, a byte for
    each bit count) of every text that is long enough.

    Null keys and null or shorter texts give no rows.
    """
    rows = df.select(F.col(tbl).alias("tbl"), F.col(key).cast("string").alias("key"), F.col(text).alias("_t"))
    rows = rows.where((F.length("_t") >= least_chars) & F.col("key").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            cls, low = [], np.zeros((b.num_rows, HASHES), np.uint32)
            names = b.column("tbl").to_pylist()
            for i, t in enumerate(b.column("_t").to_pylist()):
                n = normalised(t)
                cls.append(_class(names[i], n))
                low[i] = minima(hashed(n))
            own = np.array([_class(x, "") for x in names], np.int64).view(np.uint64)  # tables share no cell
            c = _mix(cells(low) ^ own[:, None]).view(np.int64)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, c.size + 1, BLOCKS, dtype=np.int32)), pa.array(c.ravel()))
            sig = pa.array([x.tobytes() for x in embedded(low)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("tbl"), b.column("key"), pa.array(cls, pa.int64()), flat, sig], names=["tbl", "key", "cls", "cells", "sig"])

    return rows.mapInArrow(run, "tbl string, key string, cls bigint, cells array<bigint>, sig binary")


def _class(tbl: str, norm: str) -> int:
    return int.from_bytes(hashlib.blake2b((tbl + "\0" + norm).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def candidates(prints: DataFrame) -> DataFrame:
    """Distinct pairs (cls_a < cls_b) of classes that meet in a cell and are within RADIUS.

    Rows are dealt by cell and read in order.  Equal classes count once.  The members of a cell of more
    than ``CELL`` classes stream through as they are, and :func:`hot_pairs` compares them all.
    """
    spark = prints.sparkSession
    dealt = (
        prints.select("cls", F.explode("cells").alias("cell"))
        .repartition(2 * parallelism(spark), "cell")
        .sortWithinPartitions("cell", "cls")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_cell, held, hot = None, np.zeros(0, np.int64), False

        def pairs(p: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1]), pa.nulls(len(p), pa.int64())], names=["cls_a", "cls_b", "cell"])

        def members(cell: np.ndarray, cls: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(cls), pa.nulls(len(cls), pa.int64()), pa.array(cell)], names=["cls_a", "cls_b", "cell"])

        for b in batches:
            if not b.num_rows:
                continue
            cell = b.column("cell").to_numpy()
            cls = b.column("cls").to_numpy()
            if held_cell is not None:
                cell, cls = np.concatenate([np.full(len(held), held_cell), cell]), np.concatenate([held, cls])
            first = np.ones(len(cell), bool)
            first[1:] = (cell[1:] != cell[:-1]) | (cls[1:] != cls[:-1])
            cell, cls = cell[first], cls[first]
            start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            held_cell, held = cell[start[-1]], cls[start[-1] :]  # goes on in the next batch
            size = np.diff(start)
            large = size > CELL
            if len(size):
                large[0] |= hot
                hot = False
            found = []
            for k in np.unique(size[(size > 1) & ~large]):  # all cells of a size at once
                i, j = np.triu_indices(k, 1)
                at = start[:-1][(size == k) & ~large][:, None]
                found.append(np.stack([cls[at + i].ravel(), cls[at + j].ravel()], 1))
            if found:
                yield pairs(np.concatenate(found))
            if large.any():
                in_ = np.repeat(large, size)
                yield members(cell[: start[-1]][in_], cls[: start[-1]][in_])
            if hot or len(held) > CELL:  # all but the last, which the next batch may repeat
                hot = True
                yield members(np.full(len(held) - 1, held_cell), held[:-1])
                held = held[-1:]
        if hot:
            yield members(np.full(len(held), held_cell), held)
        elif len(held) > 1:
            i, j = np.triu_indices(len(held), 1)
            yield pairs(np.stack([held[i], held[j]], 1))

    met = materialize(dealt.mapInArrow(run, "cls_a bigint, cls_b bigint, cell bigint"), "met")
    sigs = prints.select("cls", "sig").dropDuplicates(["cls"])
    hot = hot_pairs(met.where("cell IS NOT NULL").select("cell", F.col("cls_a").alias("cls")), sigs)
    ordered = lambda d: d.select(F.least("cls_a", "cls_b").alias("cls_a"), F.greatest("cls_a", "cls_b").alias("cls_b")).where("cls_a <> cls_b").distinct()
    return near(ordered(met.where("cell IS NULL").select("cls_a", "cls_b")), sigs).unionByName(ordered(hot)).distinct()


def near(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The pairs (cls_a, cls_b) whose embeddings are within RADIUS; ``sigs``: cls, sig, one row a class."""
    x = pairs.join(sigs.select(F.col("cls").alias("cls_a"), F.col("sig").alias("sa")), "cls_a").join(sigs.select(F.col("cls").alias("cls_b"), F.col("sig").alias("sb")), "cls_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ok = pa.array(manhattan(_counts(b.column("sa")), _counts(b.column("sb"))) <= RADIUS)
                yield b.select(["cls_a", "cls_b"]).filter(ok)

    return x.select("cls_a", "cls_b", "sa", "sb").mapInArrow(run, "cls_a bigint, cls_b bigint")


def hot_pairs(members: DataFrame, sigs: DataFrame, part: int = PART) -> DataFrame:
    """Pairs (cls_a, cls_b) of the members (cell, cls; no repeats) of a cell that are within RADIUS.

    A cell is cut into parts by hash and each part meets each other one, and itself, in a group of its
    own.  So all pairs of a cell are compared, however many they are, and no task holds more than two parts.
    """
    parts = members.groupBy("cell").agg(F.ceil(F.count("*") / part).alias("parts"))
    own = members.join(parts, "cell").join(sigs, "cls").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("parts")))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    met = other.select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cls", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def compare(i: np.ndarray, j: np.ndarray, own: np.ndarray, cls: np.ndarray, sig: np.ndarray) -> pa.RecordBatch:
            if i[0] == j[0]:
                a, b = within(sig, sig)
                a, b = cls[a[a < b]], cls[b[a < b]]
            else:
                left = own == i[0]
                if left.all() or not left.any():
                    a = b = cls[:0]
                else:
                    a, b = within(sig[left], sig[~left])
                    a, b = cls[left][a], cls[~left][b]
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["cls_a", "cls_b"])

        for b in batches:
            if not b.num_rows:
                continue
            now = [b.column(c).to_numpy() for c in ("cell", "i", "j", "own", "cls")]
            now.append(_counts(b.column("sig")))
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            new = np.any([x[1:] != x[:-1] for x in now[:3]], axis=0)
            start = np.flatnonzero(np.concatenate([[True], new]))
            for s, e in zip(start[:-1], start[1:], strict=True):
                yield compare(*(x[s:e] for x in now[1:]))
            held = [x[start[-1] :] for x in now]  # goes on in the next batch
        if held is not None:
            yield compare(*held[1:])

    dealt = met.repartition(2 * parallelism(members.sparkSession), "cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    return dealt.mapInArrow(run, "cls_a bigint, cls_b bigint")


def verified(pairs: DataFrame, texts: DataFrame, least: float = SHARE) -> DataFrame:
    """The pairs whose texts share at least ``least`` of their runs, with that share; ``texts``: cls, text."""
    a = pairs.join(texts.select(F.col("cls").alias("cls_a"), F.col("text").alias("ta")), "cls_a")
    both = a.join(texts.select(F.col("cls").alias("cls_b"), F.col("text").alias("tb")), "cls_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            last, of_last, s = None, None, []
            for k, x, y in zip(b.column("cls_a").to_pylist(), b.column("ta").to_pylist(), b.column("tb").to_pylist(), strict=True):
                if k != last:
                    last, of_last = k, runs(normalised(x))
                s.append(share(of_last, runs(normalised(y))))
            yield pa.RecordBatch.from_arrays([b.column("cls_a"), b.column("cls_b"), pa.array(s, pa.float64())], names=["cls_a", "cls_b", "share"])

    return both.select("cls_a", "cls_b", "ta", "tb").mapInArrow(run, "cls_a bigint, cls_b bigint, share double").where(F.col("share") >= least)


def near_links(df: DataFrame, key: str, text: str, tbl: str) -> tuple[DataFrame, DataFrame]:
    """``links`` (cls_a, cls_b, share) between classes of equal texts, and their ``members`` (tbl, key, cls)."""
    prints = materialize(fingerprints(df, key, text, tbl), "prints")
    members = prints.select("tbl", "key", "cls").distinct()
    found = materialize(candidates(prints), "candidates")
    need = found.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).distinct()
    reps = prints.join(need, "cls", "left_semi").groupBy("tbl", "cls").agg(F.min("key").alias("key"))
    source = df.select(F.col(tbl).alias("tbl"), F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    texts = reps.join(source, ["tbl", "key"]).select("cls", "text").dropDuplicates(["cls"])
    return verified(found, texts), members


def _records(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select(F.lit("documents").alias("tbl"), F.col("doc_id").cast("string").alias("key"), "text")
    chunks = table(spark, root, "chunks").select(F.lit("chunks").alias("tbl"), F.col("chunk_id").alias("key"), "text")
    return docs.unionByName(chunks)


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of documents, and of chunks, that share at least 0.60 of their content."""
    links, members = near_links(_records(spark, root), "key", "text", "tbl")
    return linked_pairs(links.select("cls_a", "cls_b"), members)


def p6_groups(spark: SparkSession, root: str) -> DataFrame:
    """One row for each record that has a near or equal copy: its group (the smallest class joined to it by any chain of
    links), the representative of its class of equal texts, the copies in that class and the other classes it is linked to."""
    links, members = near_links(_records(spark, root), "key", "text", "tbl")
    links = materialize(links.select("cls_a", "cls_b"), "links")
    of = components(links.select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b"))).select(F.col("node").alias("cls"), F.col("component").alias("grp"))
    degree = links.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("n_links"))
    stats = members.groupBy("tbl", "cls").agg(F.count("*").alias("copies"), F.min("key").alias("rep"))
    known = stats.join(of, "cls", "left").join(degree, "cls", "left").where("copies > 1 OR grp IS NOT NULL")
    return members.join(known, ["tbl", "cls"]).select("tbl", "key", F.coalesce("grp", "cls").alias("group_id"), "rep", "copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))


QUERIES = {"p6_found": p6_found, "p6_groups": p6_groups}
ORACLE: dict[str, str] = {}
