"""Flags instead of deletion: missing and unusable values, places, experience, dataset gates and the counts of a cleaned table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.functions.text import flags, is_missing, job_text, merge_flags, squeeze, strip
from jobweave.sources.schema import ContractError

# Lengths and shares from which the checks speak.
SHORT_TEXT = 30
NO_TEXT_HALT, NO_REQUIREMENTS_WARN, NO_LOCATION_WARN, DUPLICATES_WARN = 0.10, 0.20, 0.30, 0.15
SEVERAL = "Nhiều địa điểm"
NOT_GIVEN = r"(?iu)^[\s\p{Z}]*(not available|n/?a|tbd|none|null|unknown|-+|\?+|đang cập nhật|thoả thuận.*)?[\s\p{Z}]*$"
NA_TOKEN = r"(?iu)\bnot available\b"
ERROR_TITLE = r"(?iu)<[^>]+>|404|page\s+not\s+found"
WORK_MODE = r"(?iu)\b(remote|hybrid|onsite|on-site|at office|full[- ]?time|part[- ]?time)\b"


def fatal(title: Column, source: Column, url: Column) -> Column:
    """The first of the faults that make a record unusable, or null."""
    return F.when(is_missing(title), "MISSING_TITLE").when(is_missing(source), "MISSING_SOURCE").when(is_missing(url), "MISSING_URL").when(~strip(url).rlike("(?i)^https?"), "INVALID_URL")


def missing_flags() -> Column:
    """Flags of a record that isn't unusable, in fixed order."""
    d, r = F.col("job_description"), F.col("job_requirements")
    short = lambda c: F.length(strip(c)) < SHORT_TEXT
    fields = ["crawl_timestamp", "company", ("raw_location", "LOCATION"), ("raw_experience", "EXPERIENCE"), "parser_version", "job_description", "job_requirements"]
    named = [(f, f.upper()) if isinstance(f, str) else f for f in fields]
    return flags(
        *[(f"MISSING_{n}", is_missing(F.col(f))) for f, n in named],
        ("SCRAPE_FAILED", ~is_missing(d) & ~is_missing(r) & short(d) & short(r)),
        ("SCRAPE_ERROR_CONTENT", F.coalesce(F.col("raw_job_title").rlike(ERROR_TITLE), F.lit(False))),
    )


def record_flags() -> Column:
    """The fatal fault alone, or all other flags."""
    f = fatal(F.col("raw_job_title"), F.col("source"), F.col("source_url"))
    return F.when(f.isNotNull(), F.array(f)).otherwise(missing_flags())


def experience_flags(c: Column) -> Column:
    """A work mode in the experience field means that the scraper took the wrong one."""
    return F.when(F.coalesce(c.rlike(WORK_MODE), F.lit(False)), F.array(F.lit("MISSING_EXPERIENCE"), F.lit("SCRAPER_FIELD_MISMATCH"))).otherwise(F.array().cast("array<string>"))


def location_of(raw: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(value, flags): the place by the first rule that fits each part; several places as one common value."""
    text = F.coalesce(raw, F.lit(""))
    absent = text.rlike(NOT_GIVEN)
    part_na = text.rlike(NA_TOKEN)
    parts = F.filter(F.transform(F.split(F.regexp_replace(text, NA_TOKEN, ""), "[,/]"), strip), lambda p: p != "")

    def one(p: Column) -> Column:
        out = None
        for pattern, label in rules:
            out = F.when(p.rlike(f"(?iu){pattern}"), label) if out is None else out.when(p.rlike(f"(?iu){pattern}"), label)
        return out if out is not None else F.lit(None).cast("string")

    found = F.array_distinct(F.array_compact(F.transform(parts, one)))
    n = F.size(found)
    value = F.when(absent | (n == 0), None).when(n == 1, F.element_at(found, 1)).otherwise(SEVERAL)
    none = F.array().cast("array<string>")
    more = F.when(part_na, F.array(F.lit("MISSING_LOCATION"))).otherwise(none)
    flag = F.when(absent, F.array(F.lit("MISSING_LOCATION"))).when(n == 0, F.when(part_na, F.array(F.lit("MISSING_LOCATION"))).otherwise(F.array(F.lit("LOCATION_UNRECOGNIZED")))).when(n == 1, more).otherwise(F.concat(F.array(F.lit("MULTI_LOCATION")), more))
    return F.struct(value.alias("value"), flag.alias("flags"))


def flagged(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """df with normalized_location, job_text and quality_flags by the rules above, in their order; no row is dropped."""
    place = df.withColumn("_place", location_of(F.col("raw_location"), rules))
    return place.withColumn("quality_flags", merge_flags(record_flags(), F.col("_place.flags"), experience_flags(F.col("raw_experience")))).withColumn("normalized_location", F.col("_place.value")).withColumn("job_text", job_text(F.col("job_description"), F.col("job_requirements"))).drop("_place")


def gates(df: DataFrame) -> dict[str, float]:
    """Shares of the table that lack texts or places; raises where too many rows have no text at all."""
    no = lambda c: is_missing(F.col(c))
    avg = lambda c: F.avg(c.cast("double"))
    row = df.agg(avg(no("job_description") & no("job_requirements")).alias("no_text"), avg(~no("job_description") & no("job_requirements")).alias("no_requirements"), avg(no("raw_location")).alias("no_location"), avg(F.coalesce(F.col("duplicate_flag"), F.lit(False))).alias("duplicates")).first()
    got = {k: float(v or 0.0) for k, v in row.asDict().items()}
    if got["no_text"] > NO_TEXT_HALT:
        raise ContractError(f"{got['no_text']:.1%} of the rows have no text")
    return got


def gate_table(df: DataFrame) -> DataFrame:
    """(gate, share, threshold, exceeded) of each gate, without raising."""
    no = lambda c: is_missing(F.col(c))
    cases = [("no_text", no("job_description") & no("job_requirements"), NO_TEXT_HALT), ("no_requirements", ~no("job_description") & no("job_requirements"), NO_REQUIREMENTS_WARN), ("no_location", no("raw_location"), NO_LOCATION_WARN), ("duplicates", F.coalesce(F.col("duplicate_flag"), F.lit(False)), DUPLICATES_WARN)]
    one = df.agg(*[F.avg(c.cast("double")).alias(n) for n, c, _ in cases])
    cells = [F.struct(F.lit(n).alias("gate"), F.round(n, 4).alias("share"), F.lit(t).alias("threshold"), (F.col(n) > t).alias("exceeded")) for n, _, t in cases]
    return one.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def clean_counts(df: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """One row of a cleaned table's figures; n_output = n_valid + n_duplicates + n_out_of_scope - n_out_of_scope_and_duplicate. raw: the table it came from, if not of the same rows."""
    rel, dup = F.coalesce("relevance_flag", F.lit(False)), F.coalesce("duplicate_flag", F.lit(False))
    one = df.agg(
        F.count("*").alias("n_output"),
        F.count_if(fatal(F.col("raw_job_title"), F.col("source"), F.col("source_url")).isNotNull()).alias("n_scrape_error"),
        F.count_if(dup).alias("n_duplicates"),
        F.count_if(~rel).alias("n_out_of_scope"),
        F.count_if(dup & ~rel).alias("n_out_of_scope_and_duplicate"),
        F.count_if(rel & ~dup).alias("n_valid"),
        F.count_distinct(F.lower(squeeze(F.col("raw_job_title")))).alias("unique_raw_titles"),
        F.count_distinct("normalized_job_title").alias("unique_normalized_titles"),
        F.count_distinct("normalized_location").alias("unique_normalized_locations"),
    )
    return (raw if raw is not None else df).agg(F.count("*").alias("n_input")).crossJoin(F.broadcast(one))  # one row each


def fatal_ids(df: DataFrame, key: str = "job_id") -> DataFrame:
    """(key, fault) of the unusable records."""
    return df.select(key, fatal(F.col("raw_job_title"), F.col("source"), F.col("source_url")).alias("fault")).filter("fault IS NOT NULL")


def missing_by_field(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, missing, share): null, blank, 'None', 'nan' and 'Not Available', alone or repeated, are missing."""
    gone = lambda c: is_missing(F.col(c)) | strip(F.col(c)).rlike(r"(?i)^(none|nan|not available([\s,]+not available)*)$")
    one = df.agg(F.count("*").alias("n"), *[F.count_if(gone(c)).alias(f"m_{c}") for c in fields])
    cells = [F.struct(F.lit(c).alias("field"), F.col(f"m_{c}").alias("missing"), F.round(F.col(f"m_{c}") / F.col("n"), 4).alias("share")) for c in fields]
    return one.select(F.explode(F.array(*cells)).alias("x")).select("x.*")
