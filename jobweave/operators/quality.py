"""Contracts and quality checks: one row for each violation or check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.functions.text import is_missing, strip
from jobweave.operators.duplicates import residual
from jobweave.plans.staging import small
from jobweave.sources.schema import IMMUTABLE

# Thresholds of the checks.
NO_TEXT_REASONS = ("INSUFFICIENT_TEXT", "SCRAPE_ERROR")  # why a posting without any text may stand in a cleaned table
MEAN_SKILLS, NO_SKILL, TOP_SKILL, RESIDUAL, MEDIAN_TEXT = 3.0, 0.10, 0.90, 0.02, 300


def repeated_ids(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of ids that are blank, missing or given to several rows."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | is_missing(F.col(key)))


def violations(df: DataFrame, key: str = "job_id") -> DataFrame:
    """(key, violation) of each rule of the record that a row breaks."""
    no_text = is_missing(F.col("job_description")) & is_missing(F.col("job_requirements"))
    date = F.col("posted_date").isNotNull() & F.col("posted_date").try_cast("date").isNull()
    relevant, repeated = F.coalesce("relevance_flag", F.lit(False)), F.coalesce("duplicate_flag", F.lit(False))
    rules = [
        ("blank_id", is_missing(F.col(key))),
        ("missing_source", is_missing(F.col("source"))),
        ("missing_url", is_missing(F.col("source_url"))),
        ("missing_time", is_missing(F.col("crawl_timestamp"))),
        ("missing_version", is_missing(F.col("parser_version"))),
        ("missing_title", is_missing(F.col("raw_job_title"))),
        ("undecided", F.col("relevance_flag").isNull() | F.col("duplicate_flag").isNull()),
        ("blank_skill", F.exists("extracted_skills", lambda x: is_missing(x))),
        ("eligible_without_title", relevant & ~repeated & is_missing(F.col("normalized_job_title"))),
        ("eligible_without_job_text", relevant & ~repeated & is_missing(F.col("job_text"))),
        ("no_text_without_reason", no_text & ~(F.coalesce(~F.col("relevance_flag"), F.lit(False)) & F.coalesce(F.col("exclusion_reason").isin(*NO_TEXT_REASONS), F.lit(False)))),
        ("bad_date", date | (F.col("posted_date").isNotNull() & ~F.col("posted_date").rlike(r"^\d{4}-\d{2}-\d{2}$"))),
        ("bad_time", F.col("crawl_timestamp").isNotNull() & ~F.col("crawl_timestamp").rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}")),
        ("negative_count", F.col("skill_count") < 0),
        ("count_differs", F.col("extracted_skills").isNotNull() & (F.size("extracted_skills") != F.col("skill_count"))),
        ("reason_without_exclusion", F.coalesce(F.col("relevance_flag"), F.lit(False)) & F.col("exclusion_reason").isNotNull()),
        ("exclusion_without_reason", ~F.col("relevance_flag") & F.col("exclusion_reason").isNull()),
        ("relevant_without_text", F.coalesce(F.col("relevance_flag"), F.lit(False)) & no_text),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules]))
    return df.select(key, F.explode(found).alias("violation"))


def changed_fields(raw: DataFrame, clean: DataFrame, key: str = "job_id") -> DataFrame:
    """(key, field) of the immutable fields that differ between two tables with unique ids; 'missing' or 'extra' for rows of one only."""
    a = raw.select(key, F.struct(*IMMUTABLE).alias("x"))
    b = clean.select(key, F.struct(*IMMUTABLE).alias("y"))
    both = a.join(b, key, "full")
    differ = F.array_compact(F.array(*[F.when(~F.col(f"x.{f}").eqNullSafe(F.col(f"y.{f}")), F.lit(f)) for f in IMMUTABLE]))
    found = F.when(F.col("y").isNull(), F.array(F.lit("missing"))).when(F.col("x").isNull(), F.array(F.lit("extra"))).otherwise(differ)
    return both.select(key, F.explode(found).alias("field"))


def feature_faults(features: DataFrame, eligible: DataFrame, vocabulary: DataFrame, key: str = "job_id") -> DataFrame:
    """(key, fault): ids that only one side has, skills given twice or outside the vocabulary, counts that differ."""
    missing = eligible.select(key).join(features.select(key), key, "left_anti").select(key, F.lit("missing").alias("fault"))
    extra = features.select(key).join(eligible.select(key), key, "left_anti").select(key, F.lit("extra").alias("fault"))
    own = features.select(key, F.explode(F.array_compact(F.array(F.when(F.size(F.array_distinct("extracted_skills")) != F.size("extracted_skills"), "repeated_skill"), F.when(F.size("extracted_skills") != F.col("skill_count"), "count_differs")))).alias("fault"))
    alien = features.select(key, F.explode("extracted_skills").alias("skill")).join(vocabulary.select("skill"), "skill", "left_anti").select(key, F.lit("unknown_skill").alias("fault")).distinct()
    return missing.unionByName(extra).unionByName(own).unionByName(alien)


def checks(clean: DataFrame, skills: DataFrame, key: str = "job_id") -> DataFrame:
    """(check, name, value, threshold, passed): the eight checks of a cleaned table and its skills (key, extracted_skills)."""
    ok = clean.filter(F.col("relevance_flag") & ~F.col("duplicate_flag"))
    n = skills.agg(F.count("*").alias("n"), F.count_if(F.col("extracted_skills").isNull()).alias("nulls"), F.avg(F.when(F.col("extracted_skills").isNotNull(), F.size("extracted_skills"))).alias("mean"), F.avg((F.coalesce(F.size("extracted_skills"), F.lit(0)) < 1).cast("double")).alias("zero"))
    unmatched = ok.select(key).join(skills.select(key), key, "left_anti").agg(F.count("*").alias("lack")).crossJoin(skills.select(key).join(ok.select(key), key, "left_anti").agg(F.count("*").alias("over")))
    top = skills.select(F.explode(F.array_distinct("extracted_skills")).alias("s")).groupBy("s").count().agg(F.max("count").alias("top"))
    text = F.length(strip(F.concat_ws(" ", "job_description", "job_requirements")))
    rest = ok.agg(F.percentile(text, 0.5).alias("median"), F.count_if(is_missing(F.col("normalized_job_title"))).alias("untitled"))
    one = n.crossJoin(F.broadcast(unmatched)).crossJoin(F.broadcast(top)).crossJoin(F.broadcast(rest)).crossJoin(F.broadcast(residual(ok).select("residual_share")))
    table = [
        ("QC1", "ids match", F.col("lack") + F.col("over"), 0.0, "<="),
        ("QC2", "no null list", F.col("nulls"), 0.0, "<="),
        ("QC3", "mean skills", F.col("mean"), MEAN_SKILLS, ">="),
        ("QC4", "share without skill", F.col("zero"), NO_SKILL, "<="),
        ("QC5", "share of the top skill", F.coalesce(F.col("top"), F.lit(0)) / F.col("n"), TOP_SKILL, "<="),
        ("QC6", "residual duplicates", F.col("residual_share"), RESIDUAL, "<="),
        ("QC7", "median text length", F.col("median"), MEDIAN_TEXT, ">="),
        ("QC8", "missing titles", F.col("untitled"), 0.0, "<="),
    ]
    cells = [F.struct(F.lit(c).alias("check"), F.lit(name).alias("name"), F.round(v.cast("double"), 4).alias("value"), F.lit(float(t)).alias("threshold"), (v <= t if way == "<=" else v >= t).alias("passed")) for c, name, v, t, way in table]
    return one.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def matrix_faults(matrix: DataFrame, features: DataFrame, names: DataFrame, key: str = "job_id") -> DataFrame:
    """(key, fault) of a 0/1 matrix with a column for each skill id, against lists of skills; names: (skill_id, canonical_name).

    'cell' where a cell is neither 0 nor 1, 'differs' where the row's skills aren't those of its list, 'missing' and 'extra' rows. Columns that are no skill id are an error.
    """
    ids = [c for c in matrix.columns if c != key]
    known = {r[0]: r[1] for r in small(names.select("skill_id", "canonical_name"))}
    if alien := [c for c in ids if c not in known]:
        raise ValueError(f"columns that are no skill: {alien[:5]}")
    empty = F.array().cast("array<string>")
    cell = F.array(*[~F.coalesce(F.col(f"`{c}`").cast("double").isin(0.0, 1.0), F.lit(False)) for c in ids]) if ids else F.array(F.lit(False))
    held = F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"`{c}`") == 1, F.lit(known[c])) for c in ids]))) if ids else empty
    rows = matrix.select(key, F.exists(cell, lambda x: x).alias("_bad"), held.alias("_held"))
    both = rows.join(features.select(key, F.array_sort(F.array_distinct(F.array_compact(F.coalesce("extracted_skills", empty)))).alias("_said"), F.lit(True).alias("_in")), key, "full")
    fault = F.when(F.col("_bad").isNull(), "missing").when(F.col("_in").isNull(), "extra").when(F.col("_bad"), "cell").when(F.col("_held") != F.col("_said"), "differs")
    return both.select(key, fault.alias("fault")).filter("fault IS NOT NULL")


def title_check(df: DataFrame, title: str = "normalized_job_title", least: int = 5) -> DataFrame:
    """One row (ok, qualifying, untitled, largest): whether some title has enough postings to be compared."""
    n = df.groupBy(title).agg(F.count("*").alias("c"))
    named = F.col(title).isNotNull()
    one = n.agg(F.count_if(named & (F.col("c") >= least)).alias("qualifying"), F.coalesce(F.sum(F.when(~named, F.col("c"))), F.lit(0)).alias("untitled"), F.coalesce(F.max(F.when(named, F.col("c"))), F.lit(0)).alias("largest"))
    return one.select((F.col("qualifying") > 0).alias("ok"), "qualifying", "untitled", "largest")


def matrix_warnings(basket: DataFrame, n: int) -> list[str]:
    """What makes a basket of n postings a poor matrix."""
    k = basket.groupBy("job_id").count()
    s = basket.groupBy("skill").count().agg(F.count("*").alias("skills"), F.max("count").alias("top"), F.count_if(F.col("count") < 3).alias("few")).first()
    one = k.agg(F.count("*").alias("rows"), F.count_if(F.col("count") < 2).alias("thin")).first()
    out = []
    if n - one["rows"] > 0:
        out.append(f"{n - one['rows']} postings without skills")
    if one["thin"]:
        out.append(f"{one['thin']} postings of one skill")
    if s["few"]:
        out.append(f"{s['few']} skills in fewer than 3 postings")
    if n and s["top"] and s["top"] > 0.9 * n:
        out.append("a skill in over 90 % of the postings")
    return out
