"""Tables that describe a collection: groups, weeks, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.functions.text import language_of, seniority_of, title_group_of


def status() -> Column:
    """out_of_scope before duplicate before valid."""
    return F.when(~F.coalesce("relevance_flag", F.lit(False)), "out_of_scope").when(F.coalesce("duplicate_flag", F.lit(False)), "duplicate").otherwise("valid")


def frame(df: DataFrame) -> DataFrame:
    """df with text, its length and language, seniority, title group, status and posting date."""
    text = F.concat_ws("\n", F.coalesce("job_description", F.lit("")), F.coalesce("job_requirements", F.lit("")))
    return df.withColumns({"text": text, "n_chars": F.length(text), "language": language_of(text), "seniority": seniority_of(F.col("raw_job_title")), "title_group": title_group_of(F.col("raw_job_title")), "status": status(), "posted": F.col("posted_date").try_cast("date")})


def summary(f: DataFrame) -> DataFrame:
    return f.agg(F.count("*").alias("n"), F.count_distinct("company").alias("companies"), F.count_distinct("source").alias("sources"), F.percentile("n_chars", 0.5).alias("median_chars"), F.count_if(F.col("language") == "vi").alias("vi"), F.count_if(F.col("language") == "en").alias("en"), F.count_if(F.col("status") == "valid").alias("valid"), F.min("posted").cast("string").alias("first_posted"), F.max("posted").cast("string").alias("last_posted"), F.round(F.avg("skill_count"), 4).alias("mean_skills"))


def by_status_language(f: DataFrame) -> DataFrame:
    return f.groupBy("status", F.coalesce("language", F.lit("none")).alias("language")).agg(F.count("*").alias("n"))


def by_group(f: DataFrame) -> DataFrame:
    return f.groupBy("status", "title_group").agg(F.count("*").alias("n"), F.percentile("n_chars", 0.5).alias("median_chars"), F.percentile("skill_count", 0.5).alias("median_skills"), F.round(F.avg("skill_count"), 3).alias("mean_skills"))


def by_seniority(f: DataFrame) -> DataFrame:
    return f.groupBy("seniority").agg(F.count("*").alias("n"))


def top_companies(f: DataFrame, n: int = 30) -> DataFrame:
    return f.filter(F.col("company").isNotNull()).groupBy("company").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "company").limit(n)


def weekly(f: DataFrame, column: str, values: list) -> DataFrame:
    """(week, one column for each value): postings by the Monday of their week."""
    return f.filter(F.col("posted").isNotNull()).groupBy(F.date_trunc("week", "posted").cast("date").cast("string").alias("week")).pivot(column, values).count().fillna(0)


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))


def coverage(basket: DataFrame, taxonomy: DataFrame, n: int) -> DataFrame:
    """(skill_group, n_postings, share): postings with a skill of the group."""
    t = F.broadcast(taxonomy.select(F.col("canonical_name").alias("skill"), "skill_group"))
    return basket.join(t, "skill").select("job_id", "skill_group").distinct().groupBy("skill_group").agg(F.count("*").alias("n_postings")).withColumn("share", F.round(F.col("n_postings") / F.lit(n), 4))
