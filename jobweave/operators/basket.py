"""Skills of postings in long form (posting, skill): frequencies, pairs, association, communities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Postings from which a pair counts; from which a lack of pairs does; rows of a ranking.
PAIR_LEAST, EXPECTED_LEAST, TOP = 5, 5.0, 30
VOCABULARY = 20_000  # skills that are paired with each other for lack of pairs


def basket(df: DataFrame, key: str = "job_id", skills: str = "extracted_skills") -> DataFrame:
    """(key, skill), each once; nulls in the array and null arrays give nothing."""
    return df.select(key, F.explode(F.array_distinct(F.array_compact(skills))).alias("skill"))


def at_least(long: DataFrame, n: int) -> DataFrame:
    """The rows of skills in at least n postings."""
    return long.join(long.groupBy("skill").count().filter(F.col("count") >= n).select("skill"), "skill", "left_semi").select(*long.columns)


def frequency(long: DataFrame, n: int) -> DataFrame:
    """(skill, n_postings, share) over n postings."""
    return long.groupBy("skill").agg(F.count("*").alias("n_postings")).withColumn("share", F.round(F.col("n_postings") / F.lit(n), 4))


def sizes(df: DataFrame, skills: str = "extracted_skills", low: int = 2) -> DataFrame:
    """One row: mean, median, p10, p90 of skills per posting and the postings under `low`."""
    k = F.size(F.array_distinct(F.array_compact(skills)))
    one = df.filter(F.col(skills).isNotNull()).select(k.alias("k"))
    return one.agg(F.round(F.avg("k"), 2).alias("mean"), F.percentile("k", 0.5).alias("median"), F.percentile("k", 0.1).alias("p10"), F.percentile("k", 0.9).alias("p90"), F.count_if(F.col("k") < low).alias("postings_below_min"))


def _pairs(a: Column) -> Column:
    return F.flatten(F.transform(a, lambda x, i: F.transform(F.slice(a, i + 2, F.size(a)), lambda y: F.struct(x.alias("skill_a"), y.alias("skill_b")))))


def pairs(df: DataFrame, skills: str = "extracted_skills", least: int = PAIR_LEAST) -> DataFrame:
    """(skill_a, skill_b, joint), a < b: made within each row, summed with partial aggregation."""
    arr = F.array_sort(F.array_distinct(F.array_compact(skills)))
    both = df.filter(F.size(skills) > 1).select(F.explode(F.element_at(F.transform(F.array(arr), _pairs), 1)).alias("p")).select("p.*")
    return both.groupBy("skill_a", "skill_b").agg(F.count("*").alias("joint")).filter(F.col("joint") >= least)


def association(df: DataFrame, skills: str = "extracted_skills", least: int = PAIR_LEAST) -> DataFrame:
    """(skill_a, skill_b, joint, lift, npmi, jaccard), measures to 3 places; npmi is 1 for a pair in every posting."""
    some = df.filter(F.col(skills).isNotNull())
    n = some.agg(F.count("*").cast("double").alias("n"))
    single = some.select(F.explode(F.array_distinct(F.array_compact(skills))).alias("s")).groupBy("s").agg(F.count("*").alias("c"))
    p = pairs(some, skills, least).join(single.select(F.col("s").alias("skill_a"), F.col("c").alias("c_a")), "skill_a").join(single.select(F.col("s").alias("skill_b"), F.col("c").alias("c_b")), "skill_b").crossJoin(F.broadcast(n))
    lift = F.col("joint") * F.col("n") / (F.col("c_a") * F.col("c_b"))
    npmi = F.when(F.col("joint") == F.col("n"), 1.0).otherwise(F.log(lift) / -F.log(F.col("joint") / F.col("n")))
    return p.select("skill_a", "skill_b", "joint", F.round(lift, 3).alias("lift"), F.round(npmi, 3).alias("npmi"), F.round(F.col("joint") / (F.col("c_a") + F.col("c_b") - F.col("joint")), 3).alias("jaccard"))


def top_by_metric(pairs_: DataFrame, n: int = TOP) -> DataFrame:
    """(metric, rank, skill_a, skill_b, joint, value): for each measure the n pairs with the largest rounded value."""
    out = None
    for m in ("lift", "npmi", "jaccard"):
        order = [F.desc(m), F.desc("joint"), "skill_a", "skill_b"]
        top = pairs_.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order))).select(F.lit(m).alias("metric"), "rank", "skill_a", "skill_b", "joint", F.col(m).alias("value"))
        out = top if out is None else out.unionByName(top)
    return out


def negative(df: DataFrame, skills: str = "extracted_skills", expected_least: float = EXPECTED_LEAST, n_top: int = TOP) -> DataFrame:
    """(skill_a, skill_b, joint, expected, lift) of the pairs that stand together less than chance gives, which is at least expected_least.

    Pairs that never meet count. A pair can only qualify if both skills are in enough postings, so few skills are paired.
    """
    some = df.filter(F.col(skills).isNotNull())
    n = some.count()
    single = some.select(F.explode(F.array_distinct(F.array_compact(skills))).alias("s")).groupBy("s").agg(F.count("*").alias("c"))
    top = single.agg(F.max("c")).first()[0] or 0
    # The partner of the rarest skill that can qualify is at best as frequent as the most frequent one.
    often = single.filter(F.col("c") * F.lit(top) >= expected_least * n)
    if often.count() > VOCABULARY:
        raise ValueError(f"more than {VOCABULARY} skills are frequent enough: raise expected_least")
    a, b = often.select(F.col("s").alias("skill_a"), F.col("c").alias("c_a")), often.select(F.col("s").alias("skill_b"), F.col("c").alias("c_b"))
    both = a.join(F.broadcast(b), (F.col("skill_a") < F.col("skill_b")) & (F.col("c_a") * F.col("c_b") >= expected_least * n))
    met = both.join(pairs(some, skills, 1), ["skill_a", "skill_b"], "left").withColumn("joint", F.coalesce("joint", F.lit(0).cast("long")))
    expected = F.col("c_a").cast("double") * F.col("c_b") / F.lit(n)
    rows = met.select("skill_a", "skill_b", "joint", F.round(expected, 2).alias("expected"), F.round(F.col("joint") / expected, 3).alias("lift")).filter("lift < 1")
    return rows.orderBy("lift", F.desc("expected"), "skill_a", "skill_b").limit(n_top)
