"""Problem 4: the k most similar vectors of every vector.

Method: NN-descent.  A neighbour graph starts from the leaves of random projection trees, and grows better
by rounds of joins: every node brings its neighbours together, and each pair of them that is closer than
what either knows becomes an edge.  Links back are drawn anew in each round, so its pairs are others, and rounds
end when few edges change.  Queries are answered by greedy search in the graph.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.plans.session import drop_materialized, materialize, parallelism
from lodestone.sources.tables import table

DIM, K = 64, 10
#: Neighbours kept while building; trees; rows of a leaf; links that a node brings together in a round
#: (its own first, then links back to it, drawn anew in each round).
KEEP, TREES, LEAF, MEET = 20, 8, 512, 64
#: Rounds end after ROUNDS, or when less than this share of the edges is new.
ROUNDS, STILL = 4, 0.03
#: Rows that are split by trees in one task at once; rows of a part of the node table.
STRETCH, PART = 8192, 4096
LEAST = 0.85
#: Pool of a query, nodes of it walked from in a step, steps of the search in the graph.
WIDTH, AHEAD, STEPS = 48, 10, 2
SEED = 11


def nodes(df: DataFrame, key: str, vector: str, version: str, dim: int = DIM) -> DataFrame:
    """id, key, q (the unit vector in 16-bit floats) and u (in 32-bit floats), one row per key.

    The vector of the highest version counts (null versions lowest; of equal ones any, as repeated
    rows are equal).  Keys whose vector is null, of another length, holds a null or NaN or is all zero
    are left out, as are null keys.  Ids follow an order by random projections, so that the nodes of a part
    (:func:`part_of`) lie near each other; equal vectors are told apart by their key, so parts stay even.
    """
    v = df.select(F.col(key).alias("key"), F.col(vector).alias("v"), F.coalesce(F.col(version), F.lit(-(2**31))).alias("n")).where("key IS NOT NULL")
    best_ = v.groupBy("key").agg(F.max_by(F.struct("v"), "n").alias("s")).select("key", F.col("s.v").alias("v"))
    good = best_.where((F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)) & F.exists("v", lambda x: x != 0))
    planes = np.random.default_rng(SEED).standard_normal((dim, 25)).astype(np.float32)
    bits = (1 << np.arange(23, -1, -1)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
            x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            u = x.astype(np.float32)
            p = u @ planes
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), pa.array([r.tobytes() for r in u.astype("<f2")], pa.binary()), pa.array([r.tobytes() for r in u], pa.binary()), pa.array((p[:, :24] > 0) @ bits), pa.array(p[:, 24])],
                names=["key", "q", "u", "code", "at"],
            )

    made = materialize(good.mapInArrow(run, "key string, q binary, u binary, code bigint, at float"), "vectors")
    parts = max(parallelism(df.sparkSession), -(-made.count() // PART))
    dealt = made.repartitionByRange(parts, "code", "at", F.xxhash64("key"))
    # ids are fixed by being written once
    out = materialize(dealt.select(F.monotonically_increasing_id().alias("id"), "key", "q", "u"), "nodes")
    drop_materialized(df.sparkSession, made)
    return out


def part_of(node: Column) -> Column:
    """The part of the node table that an id belongs to: its partition when it was written."""
    return F.shiftright(node, 33).cast("int")


def _matrix(column: pa.Array, dim: int = DIM) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f2").reshape(-1, dim).astype(np.float32)


EDGES = "src bigint, dst array<bigint>, sim array<float>, fresh array<boolean>"


def _ragged(src: np.ndarray, size: np.ndarray, dst: np.ndarray, sim: np.ndarray, fresh: np.ndarray) -> pa.RecordBatch:
    """Rows src, dst, sim, fresh of lists of these sizes."""
    at = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (dst, sim.astype(np.float32), fresh)]
    return pa.RecordBatch.from_arrays([pa.array(src), *lists], names=["src", "dst", "sim", "fresh"])


def _nearest_first(src: np.ndarray, dst: np.ndarray, sim: np.ndarray, fresh: np.ndarray, keep: int) -> pa.RecordBatch:
    """Lists of the ``keep`` nearest distinct neighbours; of equal edges the one that is not new, ties by id."""
    o = np.lexsort((fresh, dst, src))
    src, dst, sim, fresh = src[o], dst[o], sim[o], fresh[o]
    first = np.ones(len(src), bool)
    first[1:] = (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])
    src, dst, sim, fresh = src[first], dst[first], sim[first], fresh[first]
    o = np.lexsort((dst, -sim, src))
    src, dst, sim, fresh = src[o], dst[o], sim[o], fresh[o]
    start = np.flatnonzero(np.concatenate([[True], src[1:] != src[:-1]])) if len(src) else np.zeros(0, int)
    size = np.diff(np.concatenate([start, [len(src)]]))
    in_ = np.arange(len(src)) - np.repeat(start, size) < keep
    return _ragged(src[start], np.minimum(size, keep), dst[in_], sim[in_], fresh[in_])


def _halved(x: np.ndarray, leaf: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Places of the rows by leaf: each set is halved at the median of its projection on the line through two of its rows."""
    done, todo = [], [np.arange(len(x))]
    while todo:
        at = todo.pop()
        if len(at) <= leaf:
            done.append(at)
            continue
        i, j = rng.choice(len(at), 2, replace=False)
        p = x[at] @ (x[at[i]] - x[at[j]])
        half = np.argpartition(p, len(at) // 2)
        todo += [at[half[: len(at) // 2]], at[half[len(at) // 2 :]]]
    return done


def forest(n: DataFrame, rows: int, trees: int, leaf: int, keep: int, dim: int = DIM) -> DataFrame:
    """First neighbours of each node: the nearest among those in its leaf of each tree.

    A tree orders the nodes by the signs of random projections, and nodes of equal signs by one more
    projection, so that a crowd which no sign parts is cut along another line in each tree.  Stretches of that
    order are dealt to tasks and halved at medians down to ``leaf`` nodes, which are compared as a matrix.
    """
    depth = max(1, int(np.ceil(np.log2(max(2, rows / STRETCH)))) + 2)
    rng = np.random.default_rng(SEED)
    planes = rng.standard_normal((dim, trees * depth)).astype(np.float32)
    lines = rng.standard_normal((dim, trees)).astype(np.float32)
    bits = (1 << np.arange(depth - 1, -1, -1)).astype(np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("q"), dim)
            code = ((x @ planes) > 0).reshape(-1, trees, depth) @ bits
            code += np.arange(trees) << depth
            along = x @ lines
            for t in range(trees):
                yield pa.RecordBatch.from_arrays([pa.array(code[:, t]), pa.array(along[:, t]), b.column("id"), b.column("q")], names=["code", "along", "id", "q"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, ids, xs, held = None, [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held > 1:
                i, x = np.concatenate(ids), np.concatenate(xs)
                for at in _halved(x, leaf, np.random.default_rng([SEED, int(tree)])):
                    if len(at) > 1:
                        yield _block(i[at], x[at], keep)

        for b in batches:
            if not b.num_rows:
                continue
            of = b.column("code").to_numpy() >> depth
            i, x = b.column("id").to_numpy(), _matrix(b.column("q"), dim)
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1), len(of)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if tree != of[s]:
                    yield from flush()
                    tree, ids, xs, held = of[s], [], [], 0
                while s < e:
                    take = min(STRETCH - held, e - s)
                    ids.append(i[s : s + take])
                    xs.append(x[s : s + take])
                    held += take
                    s += take
                    if held == STRETCH:
                        yield from flush()
                        ids, xs, held = [], [], 0
        yield from flush()

    dealt = n.select("id", "q").mapInArrow(deal, "code bigint, along float, id bigint, q binary")
    parts = max(parallelism(n.sparkSession), -(-rows * trees // (32 * STRETCH)))
    return dealt.repartitionByRange(parts, "code", "along", "id").sortWithinPartitions("code", "along", "id").mapInArrow(near, EDGES)


def _block(ids: np.ndarray, x: np.ndarray, keep: int) -> pa.RecordBatch:
    s = x @ x.T
    np.fill_diagonal(s, -2)
    k = min(keep, len(ids) - 1)
    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return _ragged(ids, np.full(len(ids), k), ids[top].ravel(), np.take_along_axis(s, top, 1).ravel(), np.ones(top.size, bool))


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """src, dst, sim, fresh of each edge of a batch of lists."""
    size = np.diff(b.column("dst").offsets.to_numpy())
    return np.repeat(b.column("src").to_numpy(), size), b.column("dst").flatten().to_numpy(), b.column("sim").flatten().to_numpy(), b.column("fresh").flatten().to_numpy(zero_copy_only=False)


def best(edges: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` nearest distinct neighbours of each node, nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            now = _flat(b)
            if held is not None:
                now = tuple(np.concatenate([x, y]) for x, y in zip(held, now, strict=True))
            last = int(np.searchsorted(now[0], now[0][-1], "left")) if len(now[0]) else 0
            held = tuple(x[last:] for x in now)
            if last:
                yield _nearest_first(*(x[:last] for x in now), keep)
        if held is not None and len(held[0]):
            yield _nearest_first(*held, keep)

    n = parallelism(edges.sparkSession)
    return edges.repartition(n, "src").sortWithinPartitions("src").mapInArrow(run, EDGES)


def meetings(graph: DataFrame, meet: int, turn: int) -> DataFrame:
    """at, of (list): the links that each node brings together, at most ``meet`` of them.

    Its own links come first, then links back to it by a hash that changes with ``turn``.  Links back are cut to
    ``meet`` for each target while a batch of the graph is read, so a node that very many lead to is no hot key;
    only ids are moved.
    """

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            src, dst, *_ = _flat(b)
            draw = _mixed(src ^ (dst << 1) ^ (turn * 0x9E3779B9)) >> np.int64(33)
            o = np.lexsort((draw, dst))
            start = np.flatnonzero(np.concatenate([[True], dst[o][1:] != dst[o][:-1]])) if len(o) else np.zeros(0, int)
            rank = np.arange(len(o)) - np.repeat(start, np.diff(np.concatenate([start, [len(o)]])))
            o = o[rank < meet]
            at, of, turn_of = (np.concatenate(x) for x in ((src, dst[o]), (dst, src[o]), (np.full(len(src), -1), draw[o])))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(of), pa.array(turn_of.astype(np.int32))], names=["at", "of", "draw"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def lists(at: np.ndarray, of: np.ndarray) -> pa.RecordBatch:
            order = np.arange(len(at))
            o = np.lexsort((order, of, at))  # the first mention of each neighbour
            first = np.ones(len(o), bool)
            first[1:] = (at[o][1:] != at[o][:-1]) | (of[o][1:] != of[o][:-1])
            o = np.sort(o[first])
            at, of = at[o], of[o]
            start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            size = np.diff(np.concatenate([start, [len(at)]]))
            in_ = np.arange(len(at)) - np.repeat(start, size) < meet
            size = np.minimum(size, meet)
            nodes_, of = at[start], of[in_]
            offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array(nodes_), pa.ListArray.from_arrays(offsets, pa.array(of))], names=["at", "of"])

        for b in batches:
            if not b.num_rows:
                continue
            now = [b.column("at").to_numpy(), b.column("of").to_numpy()]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            last = int(np.searchsorted(now[0], now[0][-1], "left"))
            if last:
                yield lists(*(x[:last] for x in now))
            held = [x[last : last + 8 * meet] for x in now]  # rows are in the order of their draw
        if held is not None:
            yield lists(*held)

    n = parallelism(graph.sparkSession)
    moved = graph.mapInArrow(both, "at bigint, of bigint, draw int").repartition(n, "at").sortWithinPartitions("at", "draw", "of")
    return moved.mapInArrow(cut, "at bigint, of array<bigint>")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return ((x ^ (x >> np.uint64(33))) >> np.uint64(1)).astype(np.int64)


def descend(graph: DataFrame, n: DataFrame, keep: int, meet: int, turn: int = 0, dim: int = DIM) -> DataFrame:
    """One round: edges between neighbours of a common node that beat the worst edge of their source.

    The links of a part's nodes are compared in one group, to which each vector is sent once however many of them
    name it.  A part has a bounded number of nodes and they of links.
    """
    adj = materialize(meetings(graph, meet, turn).withColumn("part", part_of(F.col("at"))), "meetings")
    worst = graph.select(F.col("src").alias("id"), F.when(F.size("dst") < keep, F.lit(-2.0)).otherwise(F.element_at("sim", -1)).cast("float").alias("worst"))
    wanted = adj.select((F.col("part") + 0).alias("to"), F.explode("of").alias("id")).distinct()
    sender = n.select("id", "q").join(worst, "id", "left").withColumn("worst", F.coalesce("worst", F.lit(-2.0).cast("float")))
    sent = wanted.join(sender, "id")

    def compare(links: pa.Table, vectors: pa.Table) -> pa.Table:
        schema = pa.schema([("src", pa.int64()), ("dst", pa.list_(pa.int64())), ("sim", pa.list_(pa.float32())), ("fresh", pa.list_(pa.bool_()))])
        if not links.num_rows or not vectors.num_rows:
            return schema.empty_table()
        v = vectors.combine_chunks()
        ids = v.column("id").to_numpy()
        o = np.argsort(ids)
        ids, x, w = ids[o], _matrix(v.column("q").combine_chunks(), dim)[o], v.column("worst").to_numpy()[o]
        of = links.column("of").combine_chunks()
        of = of.chunk(0) if isinstance(of, pa.ChunkedArray) else of
        size = np.diff(of.offsets.to_numpy())
        start = np.cumsum(size) - size
        at = np.searchsorted(ids, of.flatten().to_numpy())
        found: list[tuple[np.ndarray, ...]] = []
        for c in range(0, len(size), 512):
            s0, n0 = start[c : c + 512], size[c : c + 512]
            wide = int(n0.max())
            place = np.minimum(s0[:, None] + np.arange(wide), len(at) - 1)
            real = np.arange(wide) < n0[:, None]
            i = at[place]
            y = x[i]
            sim = y @ y.transpose(0, 2, 1)
            ok = (sim > w[i][:, :, None]) & real[:, :, None] & real[:, None, :] & (i[:, :, None] != i[:, None, :])
            g, a, b = np.nonzero(ok)
            found.append((ids[i[g, a]], ids[i[g, b]], sim[g, a, b]))
        src, dst, sim = (np.concatenate(z) for z in zip(*found, strict=True))
        out = _nearest_first(src, dst, sim, np.ones(len(src), bool), keep)
        return pa.Table.from_batches([out]).cast(schema)

    return adj.groupBy("part").cogroup(sent.groupBy("to")).applyInArrow(compare, EDGES)


def neighbour_graph(n: DataFrame, keep: int = KEEP, trees: int = TREES, leaf: int = LEAF, rounds: int = ROUNDS, meet: int = MEET, still: float = STILL, least: float = -1.0) -> DataFrame:
    """src, dst, sim and fresh (lists, nearest first) of every node: the graph of ``keep`` near neighbours.

    Rounds end when less than ``still`` of the edges of a cosine of ``least`` or more are new.
    """
    rows = n.count()
    graph = materialize(best(forest(n, rows, trees, leaf, min(keep, 10)), keep), "graph")
    for turn in range(rounds):
        known = graph.withColumn("fresh", F.transform("fresh", lambda _: F.lit(False)))
        better = materialize(best(known.unionByName(descend(graph, n, keep, meet, turn)), keep), "graph")
        drop_materialized(n.sparkSession, graph)
        graph = better
        near = F.filter(F.arrays_zip("sim", "fresh"), lambda e: e["sim"] >= least)
        new, every = graph.agg(F.sum(F.size(F.filter(near, lambda e: e["fresh"]))), F.sum(F.size(near))).first()
        if (new or 0) <= still * (every or 0):
            break
    return graph


def nearest(n: DataFrame, graph: DataFrame, k: int = K, least: float = -1.0) -> DataFrame:
    """key_a, key_b, cosine and rank (1 to k) of the nearest of each node, by exact cosines.

    Ranks are taken among the graph's neighbours; only those whose rounded cosine can reach ``least``
    have their vectors fetched.  Ties go to the smaller key.
    """
    e = graph.select("src", F.explode(F.arrays_zip("dst", "sim")).alias("x")).select("src", F.col("x.dst").alias("dst"), F.col("x.sim").alias("s"))
    e = e.where(F.col("s") >= least - 0.002)  # more than rounding to 16-bit floats can move a cosine
    a = e.join(n.select(F.col("id").alias("src"), F.col("key").alias("key_a"), F.col("u").alias("ua")), "src")
    both = a.join(n.select(F.col("id").alias("dst"), F.col("key").alias("key_b"), F.col("u").alias("ub")), "dst").select("key_a", "key_b", "ua", "ub")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.float32).reshape(b.num_rows, -1).astype(np.float64) for c in ("ua", "ub"))
            cos = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))
            yield pa.RecordBatch.from_arrays([b.column("key_a"), b.column("key_b"), pa.array(cos)], names=["key_a", "key_b", "cosine"])

    exact = both.mapInArrow(run, "key_a string, key_b string, cosine double")
    w = Window.partitionBy("key_a").orderBy(F.desc("cosine"), "key_b")
    return exact.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= k) & (F.col("cosine") >= least))


def search_graph(queries: DataFrame, n: DataFrame, graph: DataFrame, width: int, ahead: int, steps: int, dim: int = DIM) -> DataFrame:
    """src, dst, sim, fresh: the ``width`` nearest nodes of each query node (id, q) after greedy steps over the graph.

    A step walks from the ``ahead`` nearest nodes of each query's pool that were not walked from before (they are
    marked fresh) to their neighbours, compares these with the query and keeps the best; it is
    :func:`greedy_search` for a table of queries.
    """
    pool = graph.join(queries.select(F.col("id").alias("src")), "src", "left_semi").withColumn("fresh", F.transform("dst", lambda _: F.lit(True)))
    # links are walked both ways: what is in nobody's list is reached from those in its own
    links = materialize(meetings(graph, MEET, 0), "links").select(F.col("at").alias("mid"), F.col("of").alias("next"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sim = (_matrix(b.column("qc"), dim) * _matrix(b.column("qs"), dim)).sum(1)
                yield _ragged(b.column("src").to_numpy(), np.ones(b.num_rows, int), b.column("cand").to_numpy(), sim, np.ones(b.num_rows, bool))

    for _ in range(steps):
        places = F.filter(F.transform("fresh", lambda x, i: F.when(x, i)), lambda x: x.isNotNull())
        next_ = pool.withColumn("walk", F.slice(places, 1, ahead))
        cand = next_.select("src", F.explode(F.transform("walk", lambda i: F.get("dst", i))).alias("mid")).join(links, "mid").select("src", F.explode("next").alias("cand")).where("src <> cand").distinct()
        cand = cand.join(pool.select("src", F.explode("dst").alias("cand")), ["src", "cand"], "left_anti")
        x = cand.join(n.select(F.col("id").alias("cand"), F.col("q").alias("qc")), "cand").join(queries.select(F.col("id").alias("src"), F.col("q").alias("qs")), "src")
        new = x.select("src", "cand", "qc", "qs").mapInArrow(compare, EDGES)
        walked = next_.select("src", "dst", "sim", F.transform("fresh", lambda x, i: x & ~F.array_contains("walk", i)).alias("fresh"))
        pool = materialize(best(walked.unionByName(new), width), "pool")
    return pool


def greedy_search(query: np.ndarray, vectors: dict[int, np.ndarray], edges: dict[int, list[int]], starts: list[int], k: int, width: int = 32) -> list[int]:
    """Best-first walk over the graph: the ``k`` nearest nodes found to a unit vector."""
    seen = set(starts)
    pool = sorted(((float(vectors[s] @ query), s) for s in seen), reverse=True)[:width]
    done: set[int] = set()
    while True:
        ahead = next((s for _, s in pool if s not in done), None)
        if ahead is None:
            return [s for _, s in pool[:k]]
        done.add(ahead)
        fresh = [d for d in edges.get(ahead, []) if d not in seen]
        seen.update(fresh)
        pool = sorted(pool + [(float(vectors[d] @ query), d) for d in fresh], reverse=True)[:width]


def _vectors(spark: SparkSession, root: str) -> DataFrame:
    return nodes(table(spark, root, "vector_sqlite"), "chunk_id", "vector", "version")


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of chunks of a cosine of at least 0.85, one among the 10 most similar to the other."""
    n = _vectors(spark, root)
    near = nearest(n, neighbour_graph(n, least=LEAST), K, LEAST)
    return near.select(F.least("key_a", "key_b").alias("chunk_a"), F.greatest("key_a", "key_b").alias("chunk_b")).distinct()


def p4_neighbours(spark: SparkSession, root: str) -> DataFrame:
    """The 10 most similar chunks of every chunk whose id, a number after its prefix, is divisible by 20."""
    n = _vectors(spark, root)
    q = n.where(F.pmod(F.coalesce(F.regexp_extract("key", "(\\d+)$", 1).try_cast("bigint"), F.xxhash64("key")), F.lit(20)) == 0)
    graph = neighbour_graph(n, keep=32, trees=12, rounds=5, meet=96, still=0.02)
    return nearest(n, search_graph(q, n, graph, WIDTH, AHEAD, STEPS), K).select("key_a", "key_b", F.round("cosine", 6).alias("cosine"), "rank")


QUERIES = {"p4_found": p4_found, "p4_neighbours": p4_neighbours}
ORACLE: dict[str, str] = {}
