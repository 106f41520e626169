"""How titles are spread over postings: counts, shares, concentration, entropy, rare titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobweave.functions.text import title_key

# A title is rare up to so many postings; a sample is a test of the pipeline below so many.
RARE, SMALL = 2, 1000


def eligible(df: DataFrame) -> DataFrame:
    return df.filter(F.col("relevance_flag") & ~F.col("duplicate_flag"))


def counts(df: DataFrame, key: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))


def spread_of(df: DataFrame, key: str) -> DataFrame:
    """One row (n, k, hhi, entropy, entropy_ratio, top1, top5, top10) for the values of key: n rows, k values; entropy in bits.

    The sums over ranks are taken from the ten largest values alone, so no task sorts all values.
    """
    c = counts(df, key)
    total = c.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    share = F.col("n") / F.col("total")
    body = c.crossJoin(F.broadcast(total)).agg(F.max("total").alias("n"), F.max("k").alias("k"), F.sum(share * share).alias("hhi"), (-F.sum(share * F.log2(share))).alias("entropy"))
    top = c.orderBy(F.desc("n"), key).limit(10).select(F.row_number().over(Window.orderBy(F.desc("n"), key)).alias("r"), F.col("n").alias("c"))
    tops = top.agg(*[F.sum(F.when(F.col("r") <= i, F.col("c"))).alias(f"t{i}") for i in (1, 5, 10)])
    ratio = F.when(F.col("k") > 1, F.col("entropy") / F.log2("k")).otherwise(0.0)
    return body.crossJoin(F.broadcast(tops)).select("n", "k", "hhi", "entropy", ratio.alias("entropy_ratio"), *[(F.col(f"t{i}") / F.col("n")).alias(f"top{i}") for i in (1, 5, 10)])


def rare(df: DataFrame, key: str, most: int = RARE) -> DataFrame:
    return counts(df, key).filter(F.col("n") <= most)


def title_summary(df: DataFrame, raw: str = "raw_job_title", normal: str = "normalized_job_title", company: str = "company") -> DataFrame:
    """Rows (metric, value, description) of the titles of df."""
    keyed = df.withColumn("_raw", title_key(F.col(raw)))
    r, n = spread_of(keyed, "_raw"), spread_of(keyed, normal)
    few = rare(keyed, normal)
    behind = keyed.join(few.select(normal), normal, "left_semi").groupBy(company).agg(F.count("*").alias("c"))
    rare_one = few.agg(F.count("*").alias("rare_titles"), F.coalesce(F.sum("n"), F.lit(0)).alias("rare_postings"))
    first = behind.orderBy(F.desc("c"), F.asc_nulls_last(company)).limit(3).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("top3"))
    firms = behind.agg(F.count(company).alias("rare_companies"))
    one = r.select(*[F.col(c).alias(f"r_{c}") for c in r.columns]).crossJoin(F.broadcast(n)).crossJoin(F.broadcast(rare_one)).crossJoin(F.broadcast(first)).crossJoin(F.broadcast(firms)).crossJoin(F.broadcast(df.agg(F.count("*").alias("all"))))
    table = [
        ("n_postings", F.col("all"), "postings"),
        ("distinct_raw_titles", F.col("r_k"), "titles as written, blanks and case aside"),
        ("distinct_normalized_titles", F.col("k"), "normalised titles"),
        ("compression_ratio", F.round(F.col("k") / F.col("r_k"), 4), "normalised over raw"),
        ("top1_share", F.round("top1", 4), "share of the most frequent title"),
        ("top5_share", F.round("top5", 4), "share of the five most frequent"),
        ("top10_share", F.round("top10", 4), "share of the ten most frequent"),
        ("hhi", F.round("hhi", 4), "sum of squared shares"),
        ("entropy_raw_bits", F.round("r_entropy", 4), "entropy of raw titles"),
        ("entropy_normalized_bits", F.round("entropy", 4), "entropy of normalised titles"),
        ("entropy_ratio_raw", F.round("r_entropy_ratio", 4), "over its maximum"),
        ("entropy_ratio_normalized", F.round("entropy_ratio", 4), "over its maximum"),
        ("rare_titles", F.col("rare_titles"), f"titles of up to {RARE} postings"),
        ("rare_posting_share", F.round(F.col("rare_postings") / F.col("n"), 4), "postings with a rare title"),
        ("rare_companies", F.col("rare_companies"), "companies with a rare title"),
        ("rare_top3_company_share", F.when(F.col("rare_postings") > 0, F.round(F.col("top3") / F.col("rare_postings"), 4)).otherwise(0.0), "rare postings of the three companies with most"),
        ("is_pipeline_test", F.when(F.col("all") < SMALL, 1).otherwise(0), f"under {SMALL} postings"),
    ]
    cells = [F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value"), F.lit(d).alias("description")) for m, v, d in table]
    return one.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def top_titles(df: DataFrame, key: str = "normalized_job_title", n: int = 20) -> DataFrame:
    """(rank, title, n_postings, share) of the n most frequent; of equal ones the first by name."""
    total = df.filter(F.col(key).isNotNull()).agg(F.count("*").alias("total"))
    top = counts(df, key).orderBy(F.desc("n"), key).limit(n)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), key)))
    return ranked.crossJoin(F.broadcast(total)).select("rank", key, F.col("n").alias("n_postings"), F.round(F.col("n") / F.col("total"), 4).alias("share"))


def rare_table(df: DataFrame, key: str = "normalized_job_title", company: str = "company", url: str = "source_url", order: str = "job_id") -> DataFrame:
    """(title, n_postings, companies, source_urls) of rare titles: companies sorted and distinct, addresses in the order of `order`."""
    few = df.join(rare(df, key).select(key), key, "left_semi")
    urls = F.transform(F.array_sort(F.collect_list(F.struct(order, url))), lambda x: x[url])
    return few.groupBy(key).agg(F.count("*").alias("n_postings"), F.array_join(F.array_sort(F.collect_set(company)), "; ").alias("companies"), F.array_join(urls, "; ").alias("source_urls"))
