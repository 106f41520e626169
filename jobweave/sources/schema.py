"""The posting record: its fields, in order, and how a table is made to conform to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobweave.functions.text import is_missing

# The fields of a posting, in order; those that later stages must not change; those a text must have.
FIELDS = (
    "job_id source source_job_id source_url crawl_timestamp parser_version raw_job_title normalized_job_title company raw_location "
    "normalized_location posted_date raw_experience job_description job_requirements job_text relevance_flag exclusion_reason "
    "duplicate_flag duplicate_group_id extracted_skills skill_count"
).split()
_KINDS = {"relevance_flag": T.BooleanType(), "duplicate_flag": T.BooleanType(), "extracted_skills": T.ArrayType(T.StringType()), "skill_count": T.IntegerType()}
POSTING = T.StructType([T.StructField(f, _KINDS.get(f, T.StringType())) for f in FIELDS])
IMMUTABLE = "source source_job_id source_url crawl_timestamp parser_version raw_job_title company raw_location posted_date raw_experience job_description job_requirements".split()
TAXONOMY = T.StructType([T.StructField(f, T.StringType()) for f in ("skill_id", "canonical_name", "abbreviation", "aliases", "skill_group", "observed_count")])


class ContractError(ValueError):
    """A table that doesn't keep its contract."""


def conform(df: DataFrame, legacy: tuple[str, ...] = ()) -> DataFrame:
    """df with exactly the posting fields: missing ones as nulls, legacy ones dropped if wholly empty; others are refused."""
    extra = [c for c in df.columns if c not in FIELDS]
    if bad := [c for c in extra if c not in legacy]:
        raise ContractError(f"unexpected columns: {', '.join(sorted(bad))}")
    if extra:
        full = df.agg(*[F.max((~is_missing(df[c].cast("string"))).cast("int")).alias(c) for c in extra]).first()
        if bad := [c for c in extra if full[c]]:
            raise ContractError(f"legacy columns hold values: {', '.join(sorted(bad))}")
    return df.select(*[(df[f] if f in df.columns else F.lit(None)).cast(POSTING[f].dataType).alias(f) for f in FIELDS])


def require_columns(df: DataFrame, needed: list[str], exact: bool = False) -> None:
    if lack := [c for c in needed if c not in df.columns]:
        raise ContractError(f"missing columns: {', '.join(lack)}")
    if exact and list(df.columns) != list(needed):
        raise ContractError(f"columns must be {needed}")
    if df.isEmpty():
        raise ContractError("the table is empty")
