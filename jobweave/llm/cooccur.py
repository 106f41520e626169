"""Pairs of items that stand together in one record, and how far beyond chance.

Ordinary baskets give their pairs where they are read, inside the JVM, and partial aggregation shrinks them before the
only shuffle. A basket of more than `chunk` items is split into chunks; each pair of chunks is a row of its own, so
that the products of one huge basket spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.llm.common import cut


def _within(a: Column) -> Column:
    """All (x, y) of the sorted array a with x <= y; (x, x) counts the item itself."""
    return F.flatten(F.transform(a, lambda x, i: F.transform(F.slice(a, i + 1, F.size(a)), lambda y: F.struct(x.alias("a"), y.alias("b")))))


def _across(a: Column, b: Column) -> Column:
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")))))


def pair_counts(baskets: DataFrame, items: str, chunk: int = 64) -> DataFrame:
    """Rows (a, b, joint), a <= b, of the baskets' items; a = b counts the baskets that hold a.

    An item repeated in a basket counts once, null entries not at all; a null basket is none; every row of baskets
    is a basket of its own, repeated or not. An empty table gives an empty result.
    """
    one = baskets.select(F.array_sort(F.array_distinct(F.filter(F.col(items), lambda x: x.isNotNull()))).alias("s")).filter(F.size("s") > 0)
    small = one.filter(F.size("s") <= chunk).select(F.explode(_within(F.col("s"))).alias("p"))
    big = one.filter(F.size("s") > chunk).withColumn("n", F.ceil(F.size("s") / F.lit(chunk)).cast("int"))
    # One row for a chunk, then one for each pair of chunks, dealt out before any product is made.
    big = big.select("s", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    big = big.select(F.slice("s", F.col("i") * chunk + 1, chunk).alias("x"), "i", F.explode(F.transform(F.sequence("i", F.col("n") - 1), lambda j: F.struct(j.alias("j"), F.slice("s", j * chunk + 1, chunk).alias("y")))).alias("o"))
    n = int(baskets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    big = big.select("x", "i", "o.j", "o.y").repartition(n)
    big = big.select(F.explode(F.when(F.col("i") == F.col("j"), _within(F.col("x"))).otherwise(_across(F.col("x"), F.col("y")))).alias("p"))
    return small.unionByName(big).groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("joint"))


def associations(baskets: DataFrame, items: str, least: int = 1, chunk: int = 64) -> DataFrame:
    """Rows (a, b, joint, n_a, n_b, n, lift, npmi, jaccard), a < b, of the pairs in at least `least` baskets.

    n counts the baskets that aren't null, the empty ones included; npmi is 1 where a pair stands in every basket.
    """
    counts = cut(pair_counts(baskets, items, chunk))
    n = baskets.filter(F.col(items).isNotNull()).count()
    single = counts.filter("a = b")
    of_a = single.select("a", F.col("joint").alias("n_a"))
    of_b = single.select("b", F.col("joint").alias("n_b"))
    pairs = counts.filter((F.col("a") < F.col("b")) & (F.col("joint") >= least)).join(of_a, "a").join(of_b, "b").withColumn("n", F.lit(n).cast("long"))
    lift = F.col("joint") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b"))
    return pairs.select(
        "a", "b", "joint", "n_a", "n_b", "n",
        lift.alias("lift"),
        F.when(F.col("joint") == F.col("n"), 1.0).otherwise(F.log(lift) / -F.log(F.col("joint") / F.col("n"))).alias("npmi"),
        (F.col("joint") / (F.col("n_a") + F.col("n_b") - F.col("joint"))).alias("jaccard"),
    )
