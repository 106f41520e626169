"""The queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.llm.canon import map_to_canon
from jobweave.llm.common import shared_dir, table
from jobweave.llm.consensus import Consensus
from jobweave.llm.cooccur import associations
from jobweave.llm.encode import decoded, encode_corpus
from jobweave.llm.history import repeats
from jobweave.llm.langid import fitted, languages, mislabelled
from jobweave.llm.leaks import find_leaks, removed
from jobweave.llm.lookalikes import unify
from jobweave.llm.pieces import split_oversized
from jobweave.llm.stable_sample import Registry, evenness
from jobweave.plans.staging import new_path

TEXTS = ["raw_job_title", "company", "job_description"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unify(table(spark, sf_dir, "jobs_clean"), "job_id", TEXTS, only_changed=True).select("job_id", "field").distinct()


def p1_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unify(table(spark, sf_dir, "jobs_clean"), "job_id", TEXTS)


def _consensus(spark: SparkSession, sf_dir: str) -> Consensus:
    gold = table(spark, sf_dir, "gold_jobs")
    return Consensus(gold, "job_id", "annotated_by", F.col("annotations.skill_id"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir).items().filter("probability > 0.5").select(F.col("item").alias("job_id"), F.col("label").alias("skill_id"))


def p2_annotators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir).annotators()


def p2_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir).agreement().withColumnRenamed("item", "job_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "jobs_raw")).select(F.col("a").alias("raw_id_a"), F.col("b").alias("raw_id_b"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = associations(table(spark, sf_dir, "jobs_clean"), "extracted_skills", least=5)
    return found.filter("joint < n AND npmi >= 0.3").select(F.col("a").alias("skill_a"), F.col("b").alias("skill_b"))


def p4_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = associations(table(spark, sf_dir, "jobs_clean"), "extracted_skills")
    return found.select(F.col("a").alias("skill_a"), F.col("b").alias("skill_b"), "joint", *[F.round(c, 6).alias(c) for c in ("lift", "npmi", "jaccard")])


def p5_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "jobs_clean").select("job_id", "job_text"), table(spark, sf_dir, "posting_lang")
    return languages(docs, "job_id", "job_text", fitted(docs, labels, "job_id", "job_text", "lang"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mislabelled(p5_languages(spark, sf_dir), table(spark, sf_dir, "posting_lang"), "job_id", "lang")
    return found.select("job_id", F.explode("runs").alias("r")).select("job_id", "r.line_from", "r.lang").distinct()


def _registry(spark: SparkSession, name: str) -> Registry:
    """The numbers given so far, beside the folders of single runs, so that later runs find them."""
    return Registry(spark, f"{shared_dir(spark).rsplit('/', 1)[0]}/jobweave-registry/{name}", "job_id")


def p6_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _registry(spark, "gold").sample(table(spark, sf_dir, "gold_jobs"), "job_id", 0.2, order="crawl_timestamp").select("job_id")


def p6_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _registry(spark, "roles").sample(table(spark, sf_dir, "role_sample"), "job_id", 0.25, stratum="stratum", order="batch")


def p6_evenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the first n numbered postings are selected, at every power of two: never more than a few off the share."""
    jobs = table(spark, sf_dir, "jobs_clean").select("job_id", "crawl_timestamp")
    numbers = Registry(spark, new_path(spark), "job_id").numbered(jobs, "job_id", order="crawl_timestamp")
    even = evenness(numbers, 0.2, [2**k for k in range(5, 31)])
    return even.agg(F.count("*").alias("sizes"), F.count_if(F.abs(F.col("selected") - F.col("expected")) > 4).alias("uneven"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "jobs_clean")
    places = map_to_canon(jobs.filter("normalized_location IS NULL"), "job_id", "raw_location", table(spark, sf_dir, "canon_locations"), "ref_id", "normalized_location", several=True)
    titles = map_to_canon(jobs.filter("normalized_job_title IS NULL"), "job_id", "raw_job_title", table(spark, sf_dir, "canon_titles"), "ref_id", "normalized_job_title", title=True, blanks=True)
    return places.select("job_id", F.lit("raw_location").alias("field"), "ref_id").unionByName(titles.select("job_id", F.lit("raw_job_title").alias("field"), "ref_id"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_passages(spark, sf_dir).select("doc_id", "item_id").distinct()


def p9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_pieces(spark, sf_dir).select("doc_id").distinct()


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "documents"), "doc_id", "text")


# ---- what must hold of every result; the SQL says how many cases there are, and no fault


def p7_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values asked for, and those that have no answer or both entries and 'none'."""
    a = p7_found(spark, sf_dir).groupBy("job_id", "field").agg(F.min("ref_id").alias("low"), F.max("ref_id").alias("high"))
    return a.groupBy("field").agg(F.count("*").alias("n"), F.count_if((F.col("low") == 0) & (F.col("high") > 0)).alias("faults"))


def p8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, and those whose ids don't decode to their text."""
    docs, ids = table(spark, sf_dir, "documents").select("doc_id", "text"), p8_ids(spark, sf_dir)
    back = decoded(ids, "doc_id", "ids")
    return docs.join(back, "doc_id", "left").agg(F.count("*").alias("n"), F.count_if(~F.coalesce("text", F.lit("")).eqNullSafe(F.col("decoded"))).alias("faults"))


def p10_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces over the limit or without overlap, and documents whose pieces don't make up their text: none."""
    pieces = p10_pieces(spark, sf_dir)
    bad = F.count_if((F.col("n_tokens") > 2048) | ((F.col("piece") > 0) & (F.col("shared") <= 0)))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "shared", "body"))), lambda p: F.substring(p["body"], p["shared"] + 1, F.length(p["body"]))), "")
    per = pieces.groupBy("doc_id").agg(bad.alias("bad"), whole.alias("whole"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return per.join(docs, "doc_id").agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad_pieces"), F.count_if(F.col("whole") != F.col("text")).alias("bad_texts"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    from jobweave.llm import lookalikes

    pairs = """
    WITH t AS (SELECT row_number() OVER () AS r, extracted_skills AS s FROM jobs_clean WHERE extracted_skills IS NOT NULL),
    x AS (SELECT DISTINCT r, unnest(s) AS k FROM t), i AS (SELECT r, k FROM x WHERE k IS NOT NULL),
    n AS (SELECT count(*) AS n FROM t), one AS (SELECT k, count(*) AS c FROM i GROUP BY k),
    j AS (SELECT a.k AS skill_a, b.k AS skill_b, count(*) AS joint FROM i a JOIN i b ON a.r = b.r AND a.k < b.k GROUP BY 1, 2),
    p AS (SELECT skill_a, skill_b, joint, n, joint * n / (u.c::DOUBLE * v.c) AS lift, joint::DOUBLE / (u.c + v.c - joint) AS jaccard,
        CASE WHEN joint = n THEN 1.0 ELSE ln(joint * n / (u.c::DOUBLE * v.c)) / -ln(joint / n::DOUBLE) END AS npmi
        FROM j, n, one u, one v WHERE u.k = skill_a AND v.k = skill_b)"""
    value = " UNION ALL ".join(f"SELECT job_id, '{c}' AS field, {c} AS value FROM jobs_clean" for c in TEXTS)
    unified = lookalikes.sql(f"({value})", ["job_id", "field"], "value")
    return {
        "p1_found": f"SELECT DISTINCT job_id, field FROM ({unified}) WHERE unified <> value",
        "p1_unified": f"SELECT job_id, field, unified FROM ({unified})",
        "p6_evenness": "WITH n AS (SELECT count(DISTINCT job_id) AS n FROM jobs_clean), s AS (SELECT unnest(range(5, 31)) AS k) SELECT count(*) FILTER (pow(2, k) <= n) AS sizes, 0 AS uneven FROM n, s",
        "p7_answers": r"SELECT field, count(*) AS n, 0 AS faults FROM (SELECT job_id, 'raw_job_title' AS field FROM jobs_clean WHERE normalized_job_title IS NULL UNION ALL SELECT job_id, 'raw_location' AS field FROM jobs_clean WHERE normalized_location IS NULL AND regexp_matches(raw_location, '[^\s\p{Z}]')) GROUP BY 1",
        "p8_round_trip": "SELECT count(*) AS n, 0 AS faults FROM documents",
        "p10_faults": "SELECT 0 AS bad_pieces, 0 AS bad_texts",
        "p4_found": pairs + " SELECT skill_a, skill_b FROM p WHERE joint >= 5 AND joint < n AND npmi >= 0.3",
        "p4_associations": pairs + " SELECT skill_a, skill_b, joint, round(lift, 6) AS lift, round(npmi, 6) AS npmi, round(jaccard, 6) AS jaccard FROM p",
    }
