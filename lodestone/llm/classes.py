"""Pairs within classes of like records, without ever emitting all pairs of many equal ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Classes of at most this many members come out as all their pairs.  In larger ones equal records come
#: out as pairs with representatives, from which every other pair follows; no member is left out.
ALL_PAIRS_UP_TO = 100
#: Variants of a class that are compared at once.
BLOCK = 1000


def variant_pairs(members: DataFrame, up_to: int = ALL_PAIRS_UP_TO, block: int = BLOCK) -> DataFrame:
    """Pairs (tbl, key_a, key_b), the smaller key first, of members of a class whose variants differ.

    ``members``: tbl, key, cls, variant; repeated rows count once.  Classes with one variant give
    nothing.  In a class of more than ``up_to`` members only equal strings are told by one of them:
    each two variants give the pair of their representatives (smallest keys), and every other member
    the pair with the smallest member of another variant.  Variants are dealt in blocks of about
    ``block``, each two of which meet in a group of their own.  Counting comes before any join, with
    map-side aggregation, so copies cost rows in proportion to their number.
    """
    one = members.groupBy("tbl", "cls", "variant", "key").agg(F.lit(1).alias("n"))
    stats = one.groupBy("tbl", "cls").agg(F.count("*").alias("n"), F.min("variant").alias("v0"), F.max("variant").alias("v1")).where("v0 <> v1")
    inside = one.drop("n").join(stats.select("tbl", "cls", "n"), ["tbl", "cls"])
    small = inside.where(F.col("n") <= up_to).drop("n")
    a = small.select("tbl", "cls", F.col("variant").alias("va"), F.col("key").alias("key_a"))
    b = small.select("tbl", "cls", F.col("variant").alias("vb"), F.col("key").alias("key_b"))
    pairs = a.join(b, ["tbl", "cls"]).where("va <> vb AND key_a < key_b").select("tbl", "key_a", "key_b")
    large = inside.where(F.col("n") > up_to).drop("n")
    firsts = large.groupBy("tbl", "cls", "variant").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    best = firsts.groupBy("tbl", "cls").agg(F.min_by("variant", F.struct("first", "variant")).alias("v0"), F.min("first").alias("rep"), F.ceil(F.count("*") / block).alias("blocks"))
    other = firsts.join(best, ["tbl", "cls"]).where("variant <> v0").groupBy("tbl", "cls").agg(F.min("first").alias("second"))
    star = (
        large.join(best, ["tbl", "cls"])
        .join(other, ["tbl", "cls"])
        .withColumn("to", F.when(F.col("variant") == F.col("v0"), F.col("second")).otherwise(F.col("rep")))
        .select("tbl", F.col("key").alias("x"), F.col("to").alias("y"))
    )
    dealt = firsts.join(best.select("tbl", "cls", "blocks"), ["tbl", "cls"]).withColumn("own", F.pmod(F.xxhash64("variant"), F.col("blocks")))
    every = F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)
    left = dealt.withColumn("j", F.explode(F.filter(every, lambda x: x >= F.col("own")))).select("tbl", "cls", F.col("own").alias("i"), "j", F.col("variant").alias("va"), F.col("first").alias("fa"), F.col("last").alias("la"))
    right = dealt.withColumn("i", F.explode(F.filter(every, lambda x: x <= F.col("own")))).select("tbl", "cls", "i", F.col("own").alias("j"), F.col("variant").alias("vb"), F.col("first").alias("fb"), F.col("last").alias("lb"))
    met = left.join(right, ["tbl", "cls", "i", "j"]).where("i < j OR va < vb")
    # one key with two strings cannot stand for both
    ends = F.when(F.col("fa") != F.col("fb"), F.array(F.struct(F.col("fa").alias("x"), F.col("fb").alias("y")))).otherwise(
        F.array(F.struct(F.col("fa").alias("x"), F.col("lb").alias("y")), F.struct(F.col("la").alias("x"), F.col("fb").alias("y")))
    )
    across = met.select("tbl", F.explode(ends).alias("p")).select("tbl", "p.x", "p.y")
    told = star.unionByName(across).where("x <> y").select("tbl", F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()
    return pairs.unionByName(told)


def linked_pairs(links: DataFrame, members: DataFrame, up_to: int = ALL_PAIRS_UP_TO) -> DataFrame:
    """Pairs (tbl, key_a, key_b) of the members of equal or linked classes.

    ``links``: cls_a, cls_b; ``members``: tbl, key, cls, without repeats.  Where both classes have at
    most ``up_to`` members all pairs come out, else pairs of representatives (smallest key) and, for
    each member of a large class, the pair with its representative.
    """
    stats = members.groupBy("tbl", "cls").agg(F.count("*").alias("n"), F.min("key").alias("rep"))
    copies = members.join(stats.where("n > 1"), ["tbl", "cls"])
    star = copies.where((F.col("n") > up_to) & (F.col("key") != F.col("rep"))).select("tbl", F.col("rep").alias("key_a"), F.col("key").alias("key_b"))
    few = copies.where(F.col("n") <= up_to).select("tbl", "cls", "key")
    equal = few.withColumnRenamed("key", "key_a").join(few.withColumnRenamed("key", "key_b"), ["tbl", "cls"]).where("key_a < key_b").select("tbl", "key_a", "key_b")
    # one row per member, or per class where it is large
    shown = members.join(stats, ["tbl", "cls"]).where((F.col("n") <= up_to) | (F.col("key") == F.col("rep"))).select("tbl", "cls", "key")
    a = shown.select("tbl", F.col("cls").alias("cls_a"), F.col("key").alias("ka"))
    b = shown.select("tbl", F.col("cls").alias("cls_b"), F.col("key").alias("kb"))
    near = links.join(a, "cls_a").join(b, ["tbl", "cls_b"]).select("tbl", F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b"))
    return star.unionByName(equal).unionByName(near)
