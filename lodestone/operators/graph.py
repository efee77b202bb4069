"""Knowledge graph: rule extraction, merging, deletion by document, neighbourhoods, communities, topics.

Entities and relations are two DataFrames; the bridge of chunks to entities is a third.
"""

from __future__ import annotations

from functools import reduce
from math import ceil
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.operators import held as task
from lodestone.plans.session import drop_materialized, materialize, materialize_by, parallelism
from lodestone.sources.tables import table

# Patterns and thresholds of the rule extraction.
QUOTED = '["「]([^"」]{2,30})["」]'
PROPER = "(?<![A-Za-z])[A-Z][A-Za-z]{2,}(?:\\s+[A-Z][A-Za-z]{2,})*(?![\\p{L}\\p{N}_])"
PHRASE = "[\\u4e00-\\u9fff]{2,6}(?:[\\u4e00-\\u9fff、， ]+[\\u4e00-\\u9fff]{1,6})?"
IS_A = "([\\u4e00-\\u9fffA-Za-z]{2,20})\\s*是\\s*([\\u4e00-\\u9fffA-Za-z]{2,20})"
OF_IS = "([\\u4e00-\\u9fff]{2,10})\\s*的\\s*([\\u4e00-\\u9fff]{2,10})\\s*是\\s*([\\u4e00-\\u9fff]{2,20})"
CONFIDENCE, CONFIDENCE_MIN, SAME_AS = 0.55, 0.5, 0.92
#: Rounds of moves on a level and levels of contraction end when less than this share of the nodes moves, at these numbers at the latest.
STILL, ROUNDS, LEVELS = 0.01, 8, 4
#: Edges of a bucket, on average.
BUCKET = 1_000_000
#: Edges that a task of the queries may hold, repeats counted, and those of a partition of components, on average.
HELD, DEALT = 4_000_000, 250_000


def entity_names(text: Column) -> Column:
    """Distinct names in the order of the patterns: quoted, capitalised, Chinese phrases."""
    every = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (QUOTED, PROPER, PHRASE)])
    trimmed = F.transform(every, lambda x: F.regexp_replace(x, '^[ "“”「」]+|[ "“”「」]+$', ""))
    return F.array_distinct(F.filter(trimmed, lambda x: x != ""))


def relation_pairs(text: Column, names: Column) -> Column:
    """(head, tail, type) of the sentence patterns whose ends are both extracted names."""

    def of(pattern: str, kind: str) -> Column:
        z = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("b"))
        return F.transform(z, lambda x: F.struct(x["a"].alias("head"), x["b"].alias("tail"), F.lit(kind).alias("type")))

    both = F.concat(of(IS_A, "is_a"), of(OF_IS, "related_to"))
    return F.filter(both, lambda r: F.array_contains(names, r["head"]) & F.array_contains(names, r["tail"]) & (r["head"] != r["tail"]))


def _texts(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "chunks").where("chunk_id IS NOT NULL AND text IS NOT NULL")
    return c.select("chunk_id", "doc_id", "kb_id", "text").dropDuplicates(["chunk_id", "text"])


def mentions(spark: SparkSession, root: str) -> DataFrame:
    """The bridge: chunk_id, doc_id, kb_id, name."""
    return _texts(spark, root).select("chunk_id", "doc_id", "kb_id", F.explode(entity_names(F.col("text"))).alias("name"))


def merge_entities(e: DataFrame) -> DataFrame:
    """One row per (kb_id, name_norm): documents united and sorted, highest confidence, longest description.

    ``e``: kb_id, name_norm, description, confidence, doc_id.  Aggregated map-side, so hot names merge where they are.
    """
    return e.groupBy("kb_id", "name_norm").agg(
        F.array_sort(F.collect_set("doc_id")).alias("docs"), F.max("confidence").alias("confidence"), F.max_by("description", F.struct(F.length("description"), F.col("description"))).alias("description")
    )


def merge_relations(r: DataFrame) -> DataFrame:
    """One row per (head, tail, type): documents united and sorted, highest weight, longest description."""
    return r.groupBy("head", "tail", "type").agg(
        F.array_sort(F.collect_set("doc_id")).alias("docs"), F.max("weight").alias("weight"), F.max_by("description", F.struct(F.length("description"), F.col("description"))).alias("description")
    )


def delete_documents(entities: DataFrame, relations: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both without the documents of ``gone`` (doc_id): rows that no document supports go, and with
    entities the relations at either end.  Entities: name, docs; relations: head, tail, type, docs."""

    def without(df: DataFrame, keys: list[str]) -> DataFrame:
        one = df.select(*keys, F.explode("docs").alias("doc_id")).join(gone, "doc_id", "left_anti")
        return one.groupBy(*keys).agg(F.array_sort(F.collect_set("doc_id")).alias("docs"))

    left = without(entities, ["name"])
    names = left.select("name")
    rel = without(relations, ["head", "tail", "type"])
    return left, rel.join(names.toDF("head"), "head", "left_semi").join(names.toDF("tail"), "tail", "left_semi")


def neighbours(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """seed, node, depth: nodes within ``hops`` undirected steps of each seed, the seed at depth 0.

    The frontier is joined with the edges hop by hop, distinct before each join; what was seen drops out.
    """
    both = _ways(edges)
    seen = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth")).distinct()
    front = seen
    for d in range(1, hops + 1):
        step = front.join(both, "node").select("seed", F.col("to").alias("node")).distinct()
        known = seen.select(F.col("seed").alias("s"), F.col("node").alias("n"))
        front = step.join(known, (F.col("seed") == F.col("s")) & F.col("node").eqNullSafe(F.col("n")), "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(front)
    return seen


def _ways(edges: DataFrame) -> DataFrame:
    """node, to: the edges (a, b) walked both ways, each once."""
    return edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("to"))).distinct()


def neighbour_totals(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """seed, depth, n, ids: number and sum of the nodes at each depth of :func:`neighbours`, for nodes that are numbers.

    Seeds with the same neighbours (twins, as the leaves of a hub) reach the same nodes at the same depths, but for themselves:
    each is one of the nodes around the other, at depth 1 if they have loops and else at 2.  So one seed of each class is walked
    from, and the others put it in their own place.  Classes come from fingerprints of the neighbours, compared exactly.
    """
    seeds = seeds.select("seed").distinct()
    near = seeds.join(_ways(edges).withColumnRenamed("node", "seed"), "seed")
    loop = F.coalesce(F.bool_or(F.col("to") == F.col("seed")), F.lit(False))
    prints = near.groupBy("seed").agg(F.count("*").alias("degree"), F.bit_xor(F.xxhash64("to")).alias("x"), F.bit_xor(F.xxhash64("to", F.lit(1))).alias("y"), loop.alias("loop"))
    alike = prints.join(prints.groupBy("degree", "x", "y").agg(F.min("seed").alias("first")), ["degree", "x", "y"]).select("seed", "degree", "first")
    of_first = near.join(alike.select("first").distinct(), F.col("seed") == F.col("first"), "left_semi").select(F.col("seed").alias("f"), F.col("to").alias("t"))
    shared = near.join(alike, "seed").join(of_first, (F.col("first") == F.col("f")) & F.col("to").eqNullSafe(F.col("t")))
    twins = shared.groupBy("seed", "degree", "first").agg(F.count("*").alias("both")).where("both = degree").select("seed", "first")
    # of equal fingerprints and unequal neighbours: on its own
    of = prints.join(twins, "seed", "left").select("seed", "loop", F.coalesce("first", "seed").alias("first"))
    walked = neighbours(edges, of.select(F.col("first").alias("seed")).distinct(), hops).where("depth > 0")
    totals = walked.groupBy(F.col("seed").alias("first"), "depth").agg(F.count("*").alias("n"), F.sum("node").alias("ids"))
    met = F.col("depth") == F.when(F.col("loop"), 1).otherwise(2)
    far = of.join(totals, "first").select("seed", "depth", "n", F.when(met & (F.col("seed") != F.col("first")), F.col("ids") + F.col("first") - F.col("seed")).otherwise(F.col("ids")).alias("ids"))
    return seeds.select("seed", F.lit(0).alias("depth"), F.lit(1).cast("bigint").alias("n"), F.col("seed").cast("bigint").alias("ids")).unionByName(far)


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node): labels are handed on over edges and over labels, so a round
    at least doubles the distance that they cover; lineage is cut in each round, and rounds end when no label changes."""
    both = materialize(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).where("u <> v").distinct(), "edges")
    label = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("c")), "labels")
    while True:
        near = both.join(label.select(F.col("u").alias("v"), "c"), "v").groupBy("u").agg(F.min("c").alias("m"))
        own = label.join(near, "u").select("u", F.least("c", "m").alias("c"))
        # from a label to that node's own label
        jumped = own.alias("x").join(own.select(F.col("u").alias("c"), F.col("c").alias("cc")), "c", "left").select("u", F.least(F.col("c"), F.coalesce("cc", "c")).alias("c"))
        new = materialize(jumped, "labels")
        changed = new.join(label.withColumnRenamed("c", "old"), "u").where("c <> old").limit(1).count()
        drop_materialized(edges.sparkSession, label)
        label = new
        if not changed:
            break
    return label.select(F.col("u").alias("node"), F.col("c").alias("component"))


def communities(edges: DataFrame, held: int = 0) -> DataFrame:
    """node, community (its smallest node): greedy modularity by local moves and contraction, the same at any size.

    Every node starts on its own.  In a round a node moves to the neighbouring community that raises modularity most;
    nodes move in turns drawn by hash, so that two do not change places, and each level ends when hardly any
    moves.  Then communities become the nodes of the next level, with the summed weights as edges.  ``edges``: a, b;
    direction, repeats and loops do not count.  Without edges there is no row.

    ``held``: edges that a task may hold, repeats counted.  If the graph, or each of its components, has no more, tasks go
    through all rounds and levels in memory; the result is the same.
    """
    spark = edges.sparkSession
    if held and (done := _held(edges, held)) is not None:
        return done
    one = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    one = materialize(one, "pairs")
    m2 = 2.0 * one.count()
    if not m2:
        return one.select(F.col("a").alias("node"), F.col("a").alias("community"))
    parts = max(parallelism(spark), ceil(m2 / BUCKET))
    both = materialize_by(one.union(one.select("b", "a")).toDF("u", "v").withColumn("w", F.lit(1.0)), "weighted", parts, "v")
    drop_materialized(spark, one)
    of = None
    for level in range(LEVELS):
        moved = _moves(both, m2, parts)
        nodes, left = moved.agg(F.count("*"), F.count_distinct("c")).first()
        if of is None:
            of = moved.select(F.col("u").alias("node"), "c")
        else:
            of = materialize(of.join(moved.select(F.col("u").alias("c"), F.col("c").alias("to")), "c").select("node", F.col("to").alias("c")), "communities")
        if left > (1 - STILL) * nodes or level == LEVELS - 1:
            break
        fine, both = both, materialize_by(_contracted(both, moved, parts), "weighted", parts, "v", dealt=True)
        drop_materialized(spark, fine)
    drop_materialized(spark, both)
    first = of.groupBy("c").agg(F.min("node").alias("community"))
    return of.join(first, "c").select("node", "community")


def _held(edges: DataFrame, most: int) -> DataFrame | None:
    """As :func:`communities`, in tasks that hold the graph or whole components; None where one has over ``most`` edges."""
    spark = edges.sparkSession
    one = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    n = one.count()
    if n <= most:
        return _settled(one.repartition(1).withColumn("component", F.lit(0)), None, [ROUNDS] * LEVELS).where("level IS NULL").select("node", "community")
    kind = one.schema["a"].dataType
    rooted = materialize(one.mapInArrow(task.rooted(to_arrow_type(kind)), ", ".join(f"{k} {kind.simpleString()}" for k in ("a", "b", "root"))), "rooted")
    # stretches that share a node are of one component
    ends = rooted.where("b IS NULL").groupBy("a").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    links = rooted.where("b IS NULL").join(ends, "a").where("root <> low").select(F.col("root").alias("a"), F.col("low").alias("b")).distinct()
    of = components(links).select(F.col("node").alias("root"), "component")
    pairs = rooted.where("b IS NOT NULL").join(of, "root", "left").select(F.coalesce("component", "root").alias("component"), "a", "b")
    if pairs.groupBy("component").count().agg(F.max("count")).first()[0] > most:
        drop_materialized(spark, rooted)
        return None
    pairs = materialize(pairs, "pairs")
    drop_materialized(spark, rooted)
    m2 = 2.0 * pairs.select("a", "b").distinct().count()
    parts = max(4 * parallelism(spark), ceil(n / DEALT))
    turns = [ROUNDS] * LEVELS
    while True:
        made = _settled(pairs.repartition(parts, "component").sortWithinPartitions("component"), m2, turns)
        # rounds and levels end by the counts of all tasks
        ended = _ended({(r.level, r.turn): r.n for r in made.where("level IS NOT NULL").groupBy("level", "turn").agg(F.sum("n").alias("n")).collect()}, turns)
        if ended == turns:
            drop_materialized(spark, pairs)
            return made.where("level IS NULL").select("node", "community")
        drop_materialized(spark, made)
        turns = ended


def _settled(pairs: DataFrame, m2: float | None, turns: list[int]) -> DataFrame:
    """node, community, level, turn, n by :func:`held.settled`; ``pairs``: component, a, b, partitions of whole components in order."""
    kind = pairs.schema["a"].dataType
    bits = [reduce(add, [_on(F.col(x), t).cast("int") * 2**t for t in range(ROUNDS)]).alias(f"on_{x}") for x in ("a", "b")]
    schema = f"node {kind.simpleString()}, community {kind.simpleString()}, level int, turn int, n bigint"
    return materialize(pairs.select("component", "a", "b", *bits).mapInArrow(task.settled(to_arrow_type(kind), m2, turns, STILL), schema), "moves")


def _ended(counts: dict[tuple[int, int], int], turns: list[int]) -> list[int]:
    """The rounds of each level by the counts of a run with ``turns`` rounds; after a level that ended earlier, as many as there may be."""
    for level, rounds in enumerate(turns):
        nodes, idle = counts[level, task.NODES], 0
        for turn in range(rounds):
            idle = idle + 1 if counts[level, turn] <= STILL * nodes else 0
            if idle == 2 and turn + 1 < rounds:
                return [*turns[:level], turn + 1, *[ROUNDS] * (LEVELS - 1 - level)]
        if counts[level, task.LEFT] > (1 - STILL) * nodes:
            return turns[: level + 1]
    return turns


def _on(u: Column, turn: int) -> Column:
    """Whether it is the turn of a node."""
    return F.pmod(F.xxhash64(u, F.lit(turn)), F.lit(2)) == 0


def _contracted(both: DataFrame, moved: DataFrame, parts: int) -> DataFrame:
    """u, v, w between communities, dealt by v: each pair of nodes is moved once and told both ways; ``moved``: u, c."""
    half = both.where("u <= v").join(moved.select(F.col("u").alias("v"), F.col("c").alias("cv")).hint("shuffle_hash"), "v").select("u", "v", "cv", "w")
    ends = half.repartition(parts, "u").join(moved.select("u", F.col("c").alias("cu")).hint("shuffle_hash"), "u")
    within = F.col("cu") == F.col("cv")
    # within a community both ways are one loop; a loop was one way before
    w = F.col("w") * F.when(within & (F.col("u") != F.col("v")), 2.0).otherwise(1.0)
    ways = F.array(F.struct(F.col("cu").alias("u"), F.col("cv").alias("v"), w.alias("w")), F.struct(F.col("cv").alias("u"), F.col("cu").alias("v"), w.alias("w")))
    told = ends.select(F.explode(F.when(within, F.slice(ways, 1, 1)).otherwise(ways)).alias("x")).select("x.u", "x.v", "x.w")
    return told.repartition(parts, "v").groupBy("u", "v").agg(F.sum("w").alias("w"))


def _moves(both: DataFrame, m2: float, parts: int) -> DataFrame:
    """u, c: the community of each node after the moves of one level; ``both``: u, v, w in both directions, loops once, in buckets of v.

    Labels lie in the same buckets, with the weight of their community, so edges meet them where they are.  Only what
    nodes are told whose turn it is goes through a shuffle, once a round, to the bucket of the node.
    """
    spark = both.sparkSession
    k = both.groupBy(F.col("v").alias("u")).agg(F.sum("w").alias("k"))
    label = materialize_by(k.select("u", "k", F.col("u").alias("c"), F.col("k").alias("kc")), "labels", parts, "u")
    nodes = label.count()
    idle, new = 0, None
    for turn in range(ROUNDS):
        if new is not None:
            size = new.groupBy("c").agg(F.sum("k").alias("kc"))
            label = materialize_by(new.join(size, "c").select("u", "k", "c", "kc"), "labels", parts, "u")
        on = _on(F.col("u"), turn)
        near = both.where("u <> v").where(on).join(label.select(F.col("u").alias("v"), "c", "kc").hint("shuffle_hash"), "v").select("u", "c", "kc", "w")
        stay = label.where(on).select("u", "c", "kc", F.lit(0.0).alias("w"))  # its own community may hold no neighbour
        told = near.unionByName(stay).repartition(parts, "u").groupBy("u", "c").agg(F.sum("w").alias("w"), F.max("kc").alias("kc"))
        options = told.join(label.select("u", "k", F.col("c").alias("own")).hint("shuffle_hash"), "u")
        here = F.col("c") == F.col("own")
        gain = F.col("w") - F.col("k") * (F.col("kc") - F.when(here, F.col("k")).otherwise(0.0)) / m2
        best = options.groupBy("u").agg(F.max("k").alias("k"), F.max("own").alias("own"), F.max_by("c", F.struct(gain, here, -F.col("c"))).alias("c"))
        rest = label.where(~on).select("u", "k", "c", F.lit(False).alias("moved"))
        last, new = new, materialize(best.select("u", "k", "c", (F.col("c") != F.col("own")).alias("moved")).unionByName(rest), "moves")
        n = new.where("moved").count()
        drop_materialized(spark, label)
        if last is not None:
            drop_materialized(spark, last)
        idle = idle + 1 if n <= STILL * nodes else 0
        if idle == 2:  # both halves had their turn
            break
    return new.select("u", "c")


def modularity(edges: DataFrame, of: DataFrame) -> float:
    """The modularity of communities (node, community) of a graph (a, b; direction, repeats and loops do not count)."""
    one = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    x = one.join(of.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(of.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    m, inside = x.agg(F.count("*"), F.count_if(F.col("ca") == F.col("cb"))).first()
    if not m:
        return 0.0
    ends = x.select(F.explode(F.array("ca", "cb")).alias("c")).groupBy("c").count()
    return inside / m - ends.agg(F.sum(F.col("count") * F.col("count"))).first()[0] / (4.0 * m * m)


def q_entities(spark: SparkSession, root: str) -> DataFrame:
    """Entities of each knowledge base by name, with the chunks that mention them."""
    return mentions(spark, root).groupBy("kb_id", "name").agg(F.count("*").alias("chunks"))


def q_relations(spark: SparkSession, root: str) -> DataFrame:
    """Relations stated by the sentence patterns."""
    t = _texts(spark, root).where(F.contains("text", F.lit("是"))).withColumn("names", entity_names(F.col("text")))
    r = t.select("chunk_id", F.explode(relation_pairs(F.col("text"), F.col("names"))).alias("r"))
    return r.groupBy("r.head", "r.tail", "r.type").agg(F.count("*").alias("n"))


def _supplies(spark: SparkSession, root: str) -> DataFrame:
    """Relations between suppliers and parts: line items are the documents that state them."""
    x = table(spark, root, "lineitem")
    return x.select(F.concat(F.lit("s"), "l_suppkey").alias("head"), F.concat(F.lit("p"), "l_partkey").alias("tail"), F.lit("supplies").alias("type"), F.col("l_quantity").alias("weight"), F.col("l_orderkey").alias("doc_id"), F.concat(F.col("l_returnflag"), F.lit("/"), F.col("l_linestatus")).alias("description"))


def q_entity_merge(spark: SparkSession, root: str) -> DataFrame:
    """Entities merged over the orders that mention them; those of too low confidence are dropped."""
    s = _supplies(spark, root)
    e = s.select(F.lit("kb").alias("kb_id"), F.col("head").alias("name_norm"), "description", (F.col("weight") / 50).alias("confidence"), "doc_id").where(F.col("confidence") >= CONFIDENCE_MIN)
    return merge_entities(e).select("name_norm", F.size("docs").alias("docs"), F.round("confidence", 6).alias("confidence"), "description")


def q_relation_merge(spark: SparkSession, root: str) -> DataFrame:
    """Relations merged over the orders that state them."""
    return merge_relations(_supplies(spark, root)).select("head", "tail", F.size("docs").alias("docs"), "weight", "description")


def q_delete_by_doc(spark: SparkSession, root: str) -> DataFrame:
    """Relations left when the cancelled orders are deleted, with their counts of support."""
    s = _supplies(spark, root)
    e = s.select(F.col("head").alias("name"), "doc_id").union(s.select("tail", "doc_id")).groupBy("name").agg(F.collect_set("doc_id").alias("docs"))
    r = merge_relations(s).select("head", "tail", "type", "docs")
    gone = table(spark, root, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("doc_id"))
    _, left = delete_documents(e, r, gone)
    return left.select("head", "tail", F.size("docs").alias("docs"))


def _edges(spark: SparkSession, root: str) -> DataFrame:
    """Regions (from 0), nations (from 1000), suppliers (from 10 000) and customers (from 10 million)."""
    n = table(spark, root, "nation").select((F.col("n_nationkey") + 1000).cast("bigint").alias("a"), F.col("n_regionkey").cast("bigint").alias("b"))
    s = table(spark, root, "supplier").select((F.col("s_suppkey") + 10_000).cast("bigint").alias("a"), (F.col("s_nationkey") + 1000).cast("bigint").alias("b"))
    c = table(spark, root, "customer").select((F.col("c_custkey") + 10_000_000).cast("bigint").alias("a"), (F.col("c_nationkey") + 1000).cast("bigint").alias("b"))
    return n.unionByName(s).unionByName(c)


def q_neighbours(hops: int):  # noqa: ANN201
    def run(spark: SparkSession, root: str) -> DataFrame:
        e = _edges(spark, root)
        seeds = table(spark, root, "supplier").select((F.col("s_suppkey") + 10_000).cast("bigint").alias("seed"))
        return neighbour_totals(e, seeds, hops)

    run.__doc__ = f"Nodes within {hops} steps of every supplier."
    return run


def _citations(spark: SparkSession, root: str) -> DataFrame:
    """Edges between orders and the parts they name, as numbers: all line items."""
    t = table(spark, root, "lineitem")
    return t.select(F.col("l_orderkey").alias("a"), (F.col("l_partkey") + 1_000_000_000).alias("b"))


def q_components(spark: SparkSession, root: str) -> DataFrame:
    """Connected components of orders and parts, by size."""
    c = components(_citations(spark, root))
    return c.groupBy("component").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("components"), F.sum("component").alias("ids"))


def q_communities(spark: SparkSession, root: str) -> DataFrame:
    """Communities of orders and parts, of three members at least."""
    return communities(_citations(spark, root), HELD).groupBy("community").agg(F.count("*").alias("members")).where("members >= 3")


def q_topics_by_type(spark: SparkSession, root: str) -> DataFrame:
    """Parts as entities, one topic per type: members, the three dearest as title."""
    p = table(spark, root, "part")
    w = Window.partitionBy("p_type").orderBy(F.desc("p_retailprice"), "p_partkey")
    top = p.withColumn("r", F.row_number().over(w)).where("r <= 3").groupBy("p_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "p_name"))), lambda x: x["p_name"]), ", ").alias("title"))
    return p.groupBy("p_type").agg(F.count("*").alias("members")).join(top, "p_type")


def centroids(v: DataFrame, by: str, vector: str) -> DataFrame:
    """``by``, pos, mean: element-wise means."""
    return v.select(by, F.posexplode(vector).alias("pos", "x")).groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def q_centroids(spark: SparkSession, root: str) -> DataFrame:
    """Centroids of the labels."""
    return centroids(table(spark, root, "embeddings"), "label", "embedding").withColumn("mean", F.round("mean", 6))


def q_topic_rank(spark: SparkSession, root: str) -> DataFrame:
    """The three topics nearest to each vector whose id is divisible by 20: cosine to the centroid, then size."""
    e = table(spark, root, "embeddings")
    size = e.groupBy("label").agg(F.count("*").alias("members"))
    c = centroids(e, "label", "embedding")
    norm = c.groupBy("label").agg(F.sqrt(F.sum(F.col("mean") * F.col("mean"))).alias("cn"))
    q = e.where("vec_id % 20 = 0").select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    qn = q.groupBy("vec_id").agg(F.sqrt(F.sum(F.col("x").cast("double") * F.col("x").cast("double"))).alias("qn"))
    s = q.join(c, "pos").groupBy("vec_id", "label").agg(F.sum(F.col("x").cast("double") * F.col("mean")).alias("dot")).join(norm, "label").join(qn, "vec_id").join(size, "label")
    s = s.withColumn("score", F.round(F.col("dot") / (F.col("cn") * F.col("qn")), 6))
    w = Window.partitionBy("vec_id").orderBy(F.desc("score"), F.desc("members"), "label")
    return s.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("vec_id", "label", "score", "rank")


def q_dual_level(spark: SparkSession, root: str) -> DataFrame:
    """Chunks reached from entities and from their documents' other chunks, the better score kept."""
    m = mentions(spark, root).where("doc_id IS NOT NULL")
    low = m.groupBy("chunk_id").agg(F.count("*").alias("n")).select("chunk_id", F.least(F.lit(1.0), F.col("n") / 10).alias("score"), F.lit("graph_low").alias("route"))
    per_doc = m.groupBy("doc_id").agg(F.count("*").alias("n"))
    c = table(spark, root, "chunks").where("doc_id IS NOT NULL AND chunk_id IS NOT NULL").select("doc_id", "chunk_id").distinct()
    high = c.join(per_doc, "doc_id").groupBy("chunk_id").agg(F.max(F.least(F.lit(1.0), F.col("n") / 40)).alias("score")).withColumn("route", F.lit("graph_high"))
    both = low.unionByName(high)
    return both.groupBy("chunk_id").agg(F.max_by(F.struct("score", "route"), F.struct("score", "route")).alias("x")).select("chunk_id", F.round("x.score", 6).alias("score"), "x.route")


QUERIES = {
    "entity_extract": q_entities, "relation_extract": q_relations, "entity_merge": q_entity_merge, "relation_merge": q_relation_merge, "delete_by_doc": q_delete_by_doc, "neighbors_1hop": q_neighbours(1), "neighbors_2hop": q_neighbours(2),
    "connected_components": q_components, "communities": q_communities, "topics_by_type": q_topics_by_type, "topic_centroids": q_centroids, "topic_rank": q_topic_rank, "dual_level_dedup": q_dual_level,
}

_SUP = "(SELECT 's' || l_suppkey AS head, 'p' || l_partkey AS tail, l_quantity AS weight, l_orderkey AS doc_id, l_returnflag || '/' || l_linestatus AS description FROM lineitem)"
_EDGE = "(SELECT CAST(n_nationkey + 1000 AS BIGINT) AS a, CAST(n_regionkey AS BIGINT) AS b FROM nation UNION ALL SELECT s_suppkey + 10000, s_nationkey + 1000 FROM supplier UNION ALL SELECT c_custkey + 10000000, c_nationkey + 1000 FROM customer)"
_TWICE = "regexp_replace(text, '([^A-Za-z])', '\\1\\1', 'g')"
_NAMES = f"""list_filter(list_transform(
  list_concat(regexp_extract_all(text, '["「][^"」]{{2,30}}["」]'),
  list_concat(list_transform(regexp_extract_all({_TWICE}, '(?:^|[^A-Za-z])([A-Z][A-Za-z]{{2,}}(?:\\s+[A-Z][A-Za-z]{{2,}})*)(?:[^\\p{{L}}\\p{{N}}_]|$)', 1), lambda x: regexp_replace(x, '(\\s)\\s', '\\1', 'g')),
  regexp_extract_all(text, '[\\x{{4e00}}-\\x{{9fff}}]{{2,6}}(?:[\\x{{4e00}}-\\x{{9fff}}、， ]+[\\x{{4e00}}-\\x{{9fff}}]{{1,6}})?'))),
  lambda x: regexp_replace(x, '^[ "“”「」]+|[ "“”「」]+$', '', 'g')), lambda x: x <> '')"""


def _hops(n: int) -> str:
    return f"""WITH RECURSIVE e AS (SELECT a, b FROM {_EDGE} UNION SELECT b, a FROM {_EDGE}), x AS (SELECT s_suppkey + 10000 AS seed, s_suppkey + 10000 AS node, 0 AS depth FROM supplier
UNION SELECT seed, e.b, depth + 1 FROM x JOIN e ON e.a = node WHERE depth < {n}), m AS (SELECT seed, node, min(depth) AS depth FROM x GROUP BY 1, 2) SELECT seed, CAST(depth AS INTEGER) AS depth, count(*) AS n, CAST(sum(node) AS BIGINT) AS ids FROM m GROUP BY 1, 2"""


ORACLE = {
    "entity_extract": f"SELECT kb_id, name, count(*) AS chunks FROM (SELECT chunk_id, kb_id, unnest(list_distinct({_NAMES})) AS name FROM (SELECT DISTINCT chunk_id, kb_id, text FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL)) GROUP BY 1, 2",
    "entity_merge": f"SELECT name_norm, len(docs) AS docs, confidence, description FROM (SELECT head AS name_norm, list(DISTINCT doc_id) AS docs, round(max(weight / 50), 6) AS confidence, max_by(description, {{'l': length(description), 'd': description}}) AS description FROM {_SUP} WHERE weight / 50 >= 0.5 GROUP BY 1)",
    "relation_merge": f"SELECT head, tail, count(DISTINCT doc_id) AS docs, max(weight) AS weight, max_by(description, {{'l': length(description), 'd': description}}) AS description FROM {_SUP} GROUP BY 1, 2",
    "delete_by_doc": f"SELECT head, tail, count(DISTINCT doc_id) AS docs FROM {_SUP} WHERE doc_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') GROUP BY 1, 2",
    "neighbors_1hop": _hops(1),
    "neighbors_2hop": _hops(2),
    "topics_by_type": """SELECT p_type, count(*) AS members, string_agg(p_name, ', ' ORDER BY r) FILTER (r <= 3) AS title FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) GROUP BY 1""",
    "topic_centroids": "SELECT label, CAST(pos - 1 AS INTEGER) AS pos, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2",
    "topic_rank": """WITH c AS (SELECT label, list(m ORDER BY pos) AS v FROM (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2) GROUP BY 1), s AS (SELECT label, count(*) AS members FROM embeddings GROUP BY 1),
x AS (SELECT vec_id, c.label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 6) AS score, members FROM embeddings e, c JOIN s ON s.label = c.label WHERE vec_id % 20 = 0)
SELECT vec_id, label, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, members DESC, label) AS rank FROM x) WHERE rank <= 3""",
    "dual_level_dedup": f"""WITH m AS (SELECT chunk_id, doc_id, unnest(list_distinct({_NAMES})) AS name FROM (SELECT chunk_id, text, any_value(doc_id) AS doc_id FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL GROUP BY 1, 2) WHERE doc_id IS NOT NULL),
l AS (SELECT chunk_id, least(1.0, count(*) / 10) AS score, 'graph_low' AS route FROM m GROUP BY 1), p AS (SELECT doc_id, count(*) AS n FROM m GROUP BY 1),
h AS (SELECT chunk_id, max(least(1.0, n / 40)) AS score, 'graph_high' AS route FROM (SELECT DISTINCT doc_id, chunk_id FROM chunks WHERE doc_id IS NOT NULL AND chunk_id IS NOT NULL) JOIN p USING (doc_id) GROUP BY 1),
b AS (SELECT * FROM l UNION ALL SELECT * FROM h) SELECT chunk_id, round(max(score), 6) AS score, max_by(route, {{'s': score, 'r': route}}) AS route FROM b GROUP BY 1""",
}
