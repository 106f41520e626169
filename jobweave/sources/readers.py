"""Readers of tables; schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobweave.functions.text import strip
from jobweave.sources.schema import POSTING, TAXONOMY, ContractError, require_columns


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = POSTING) -> DataFrame:
    """One object a line; blank lines and a byte-order mark are passed over, anything else is an error with its text."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^\\x{FEFF}", "").alias("value")).filter(strip(F.col("value")) != "")
    object_ = F.col("value").rlike(r"^\s*\{")
    checked = F.when(object_, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not an object: "), F.substring("value", 1, 80))))
    return lines.select(F.from_json(checked, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_postings(spark: SparkSession, path: str, schema: T.StructType = POSTING) -> DataFrame:
    """Parquet by its suffix, or line-wise JSON."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    if path.rstrip("/").endswith((".jsonl", ".json")):
        return read_jsonl(spark, path, schema)
    raise ContractError(f"neither .parquet nor .jsonl: {path}")


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Postings with unique, non-blank ids and at least one row."""
    df = read_postings(spark, path)
    require_columns(df, ["job_id"])
    bad = df.groupBy("job_id").count().filter((F.col("count") > 1) | F.col("job_id").isNull() | (strip(F.col("job_id")) == ""))
    if not bad.isEmpty():
        raise ContractError("job_id must be unique and not blank")
    return df


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """The skills' CSV, whose header must be exactly the taxonomy's fields; ids and names unique and not blank."""
    head = spark.read.text(path).limit(1).collect()
    names = head[0][0].lstrip("﻿").strip().split(",") if head else []
    if names != TAXONOMY.names:
        raise ContractError(f"taxonomy header must be {TAXONOMY.names}, not {names}")
    df = spark.read.csv(path, header=True, schema=TAXONOMY, enforceSchema=True, multiLine=True, escape='"')
    for c in ("skill_id", "canonical_name"):
        if not df.groupBy(c).count().filter((F.col("count") > 1) | F.col(c).isNull() | (strip(F.col(c)) == "")).isEmpty():
            raise ContractError(f"{c} must be unique and not blank")
    return df


def code_names(spark: SparkSession, path: str) -> DataFrame:
    """(code, name) from a taxonomy whose header may vary."""
    df = spark.read.csv(path, header=True)
    pick = lambda *names: F.coalesce(*[F.col(n) for n in names if n in df.columns], F.lit(None))
    return df.select(strip(pick("skill_id", "id", "code")).alias("code"), strip(pick("canonical_name", "name", "skill")).alias("name")).dropna()


def tech_terms(taxonomy: DataFrame, extra: tuple[str, ...] = (), without_groups: tuple[str, ...] = (), without_names: tuple[str, ...] = ()) -> DataFrame:
    """(term) in lower case: names, abbreviations and aliases of the taxonomy outside some groups and but for some names, and extra terms."""
    t = taxonomy.filter(~F.coalesce(F.col("skill_group"), F.lit("")).isin(*without_groups, "\0") & ~F.col("canonical_name").isin(*without_names, "\0"))
    parts = F.array_union(F.array("canonical_name", "abbreviation"), F.split(F.coalesce("aliases", F.lit("")), ";"))
    found = t.select(F.explode(parts).alias("term"))
    if extra:
        found = found.unionByName(taxonomy.sparkSession.createDataFrame([(x,) for x in extra], "term string"))
    return found.select(F.lower(strip(F.col("term"))).alias("term")).filter("term <> ''").distinct()


def location_rules(spark: SparkSession, path: str) -> DataFrame:
    """(rule_idx, pattern, label): the file's order is the rules' priority."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("raw_pattern", "normalized_location", "notes")])
    rows = spark.read.csv(path, header=True, schema=schema).collect()  # a file of rules, read whole to keep its order
    return spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(rows)], "rule_idx int, pattern string, label string")


ID_NAMES = ("job_id", "id", "posting_id", "jobid", "jd_id", "index")
NOT_SKILLS = ("normalized_job_title", "raw_job_title", "title", "skill_count", "extracted_skills", "company", "source")


def matrix_basket(df: DataFrame, names: DataFrame | None = None, least: int = 0) -> DataFrame:
    """(job_id, skill) of a wide 0/1 matrix: cells may be boolean, integer, float or text, and must mean 0 or 1.

    Columns that look like codes are renamed by `names` (code, name). Postings without any skill are left out of the long form.
    """
    key = next((c for n in ID_NAMES for c in df.columns if c.lower() == n), None)
    if key is None:
        raise ContractError("no id column")
    skills = [c for c in df.columns if c != key and c.lower() not in NOT_SKILLS]
    cell = lambda c: F.when(F.lower(df[c].cast("string")).isin("true", "false"), F.lower(df[c].cast("string")) == "true").otherwise(df[c].cast("string").try_cast("double") == 1)
    fit = lambda c: F.lower(df[c].cast("string")).isin("true", "false") | F.coalesce(df[c].cast("string").try_cast("double").isin(0.0, 1.0), F.lit(False))
    bad = df.agg(*[F.sum((~F.coalesce(fit(c), F.lit(False))).cast("int")).alias(c) for c in skills]).first()
    if wrong := [c for c in skills if bad[c]]:
        raise ContractError(f"cells that are neither 0 nor 1: {', '.join(wrong)}")
    long = df.select(df[key].cast("string").alias("job_id"), F.explode(F.array_compact(F.array(*[F.when(cell(c), F.lit(c)) for c in skills]))).alias("skill"))
    if names is not None:
        long = long.join(F.broadcast(names.select(F.col("code").alias("skill"), "name")), "skill", "left").select("job_id", F.coalesce("name", "skill").alias("skill"))
    if least:
        long = long.join(long.groupBy("skill").count().filter(F.col("count") >= least).select("skill"), "skill", "left_semi").select("job_id", "skill")
    return long
