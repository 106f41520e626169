"""All queries of the general part, by name, and SQL that gives the same on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.functions import text as T
from jobweave.operators import agreement, basket, cleaning, cluster, concentration, duplicates, explore, graph, matcher, pages, profile, quality, titles
from jobweave.plans.staging import settle, small
from jobweave.sources import readers

TITLE, SKILLS = "normalized_job_title", "extracted_skills"
S = r"[\s\p{Z}]"
_STRIP = lambda c: f"regexp_replace({c}, '^{S}+|{S}+$', '', 'g')"
_SQUEEZE = lambda c: _STRIP(f"regexp_replace({c}, '{S}+', ' ', 'g')")
_MISS = lambda c: f"({c} IS NULL OR {_STRIP(c)} = '')"
_OK = "e AS (SELECT * FROM jobs_clean WHERE relevance_flag AND NOT duplicate_flag)"
_SQL: dict[str, str] = {}
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _q(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


# Raw titles, the title each must become, and the flags.
TITLE_PLACES = [("hà nội|ha noi", "Hà Nội"), ("hồ chí minh|hcm", "Hồ Chí Minh"), ("đà nẵng", "Đà Nẵng")]
TITLE_TOOLS = ["python", "spark", "pyspark", "snowflake", "sql", "power bi", "bi", "etl", "data warehouse", "kafka", "airflow", "r", "tableau"]
TITLE_CASES = [
    ("DATA STEWARD", "Data Steward", ""),
    ("bi developer", "BI Developer", ""),
    ("Data Engineer Python/Spark", "Data Engineer", "TECH_SUFFIX_REMOVED"),
    ("Data Engineer PySpark, Snowflake", "Data Engineer", "TECH_SUFFIX_REMOVED"),
    ("Data Analyst [Azure, SQL & Power BI]", "Data Analyst", "TECH_SUFFIX_REMOVED"),
    ("Analytics Engineer | Airflow; Kafka", "Analytics Engineer", "TECH_SUFFIX_REMOVED"),
    ("Data Analyst (Python, Pricing)", "Data Analyst (Python, Pricing)", ""),
    ("Python (SQL)", "Python (SQL)", ""),
    ("Senior Data Analyst (CRM & Loyalty)", "Data Analyst (CRM & Loyalty)", "SENIORITY_REMOVED"),
    ("Machine Learning Engineer - Computer Vision", "Machine Learning Engineer - Computer Vision", ""),
    ("Sr. data mgr", "Data Manager", "SENIORITY_REMOVED"),
    ("Junior/Middle QA Engineer", "QA Engineer", "SENIORITY_REMOVED"),
    ("Senior/Lead Data Engineer", "Lead Data Engineer", "SENIORITY_REMOVED"),
    ("Data Engineer (Junior - Middle)", "Data Engineer", "SENIORITY_REMOVED"),
    ("Data Engineer Fresher", "Data Engineer", "SENIORITY_REMOVED"),
    ("Data Engineer (Senior/Leader)", "Data Engineer (Senior/Leader)", ""),
    ("AI Engineer - Thu Nhập Upto 40M - Tại Hà Nội", "AI Engineer", "RECRUITMENT_NOISE_REMOVED"),
    ("Data Lead (Lương 35 Triệu)", "Data Lead", "RECRUITMENT_NOISE_REMOVED"),
    ("Chuyên viên dữ liệu [Đà Nẵng/HCM]", "Chuyên Viên Dữ Liệu", "RECRUITMENT_NOISE_REMOVED"),
    ("Senior Tester (ONSITE BANK)", "Tester", "RECRUITMENT_NOISE_REMOVED,SENIORITY_REMOVED"),
    ("Data Analyst (Fraud, Risk), Retail", "Data Analyst (Fraud, Risk), Retail", ""),
    ("Risk Specialist (A (b), c), Hà Nội", "Risk Specialist (A (B), C)", "RECRUITMENT_NOISE_REMOVED"),
    ("Data Analyst Up to 75M", "Data Analyst", ""),
    ("Data Analyst $2000", "Data Analyst", ""),
    ("Data Engineer (Japanese N2)", "Data Engineer", ""),
    ("1. Data   Analyst /", "Data Analyst", ""),
    ("Data Engineer / Data Analyst", "Data Engineer / Data Analyst", "AMBIGUOUS_TITLE"),
    ("C++ dev", "C++ Developer", ""),
    ("Head of DATA and insight", "Head of DATA and Insight", ""),
    ("QC Engineer AI-Powered Testing", "QC Engineer AI-Powered Testing", ""),
    ("AI", "AI", "TITLE_TOO_SHORT"),
    ("Data Analyst " + "Customer Growth Team " * 5, "Data Analyst " + " ".join(["Customer Growth Team"] * 5), "TITLE_TOO_LONG"),
    ("  ", None, "MISSING_JOB_TITLE"),
    (None, None, "MISSING_JOB_TITLE"),
]


def query(sql: str | None = None):
    def keep(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def _ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concentration.eligible(_t(spark, sf_dir, "jobs_clean"))


def _n(df: DataFrame) -> int:
    return df.filter(F.col(SKILLS).isNotNull()).count()


# ---- titles ---------------------------------------------------------------------------------------------------------


def _concentration_sql() -> str:
    def part(x: str, c: str) -> str:
        return f"""c{x} AS (SELECT {c} AS k, count(*) AS n FROM x WHERE {c} IS NOT NULL GROUP BY 1),
        s{x} AS (SELECT sum(n)::DOUBLE AS n, count(*)::DOUBLE AS k, sum((n / t) * (n / t)) AS hhi, -sum(n / t * log2(n / t)) AS h FROM c{x}, (SELECT sum(n)::DOUBLE AS t FROM c{x}))"""

    rows = [
        ("n_postings", "(SELECT count(*) FROM x)", "postings"),
        ("distinct_raw_titles", "r.k", "titles as written, blanks and case aside"),
        ("distinct_normalized_titles", "m.k", "normalised titles"),
        ("compression_ratio", "round(m.k / r.k, 4)", "normalised over raw"),
        *[(f"top{i}_share", f"round((SELECT sum(n) FROM top WHERE r <= {i}) / m.n, 4)", d) for i, d in ((1, "share of the most frequent title"), (5, "share of the five most frequent"), (10, "share of the ten most frequent"))],
        ("hhi", "round(m.hhi, 4)", "sum of squared shares"),
        ("entropy_raw_bits", "round(r.h, 4)", "entropy of raw titles"),
        ("entropy_normalized_bits", "round(m.h, 4)", "entropy of normalised titles"),
        ("entropy_ratio_raw", "round(CASE WHEN r.k > 1 THEN r.h / log2(r.k) ELSE 0 END, 4)", "over its maximum"),
        ("entropy_ratio_normalized", "round(CASE WHEN m.k > 1 THEN m.h / log2(m.k) ELSE 0 END, 4)", "over its maximum"),
        ("rare_titles", "(SELECT count(*) FROM cm WHERE n <= 2)", "titles of up to 2 postings"),
        ("rare_posting_share", "round(coalesce((SELECT sum(n) FROM cm WHERE n <= 2), 0) / m.n, 4)", "postings with a rare title"),
        ("rare_companies", "(SELECT count(company) FROM f)", "companies with a rare title"),
        ("rare_top3_company_share", "CASE WHEN (SELECT sum(c) FROM f) > 0 THEN round((SELECT sum(c) FROM (SELECT c FROM f ORDER BY c DESC, company NULLS LAST LIMIT 3)) / (SELECT sum(c) FROM f), 4) ELSE 0 END", "rare postings of the three companies with most"),
        ("is_pipeline_test", "CASE WHEN (SELECT count(*) FROM x) < 1000 THEN 1 ELSE 0 END", "under 1000 postings"),
    ]
    body = " UNION ALL ".join(f"SELECT '{m}' AS metric, ({v})::DOUBLE AS value, '{d}' AS description FROM sr r, sm m" for m, v, d in rows)
    return f"""WITH {_OK}, x AS (SELECT nullif(lower({_SQUEEZE('raw_job_title')}), '') AS raw, {TITLE} AS norm, company FROM e), {part('r', 'raw')}, {part('m', 'norm')},
    top AS (SELECT n, row_number() OVER (ORDER BY n DESC, k) AS r FROM cm), f AS (SELECT company, count(*) AS c FROM x WHERE norm IN (SELECT k FROM cm WHERE n <= 2) GROUP BY 1) {body}"""


@query(_concentration_sql())
def rq1_summary(spark, sf_dir):
    return concentration.title_summary(_ok(spark, sf_dir))


@query(f"WITH {_OK}, c AS (SELECT {TITLE}, count(*) AS n FROM e WHERE {TITLE} IS NOT NULL GROUP BY 1) SELECT (row_number() OVER (ORDER BY n DESC, {TITLE}))::INT AS rank, {TITLE}, n AS n_postings, round(n / (SELECT sum(n)::DOUBLE FROM c), 4) AS share FROM c QUALIFY rank <= 20")
def rq1_top20_titles(spark, sf_dir):
    return concentration.top_titles(_ok(spark, sf_dir))


_RAWKEY = f"x AS (SELECT *, lower({_SQUEEZE('raw_job_title')}) AS raw_title FROM e)"


@query(f"WITH {_OK}, {_RAWKEY} SELECT raw_title, count(*) AS n_postings, coalesce(string_agg(DISTINCT company, '; ' ORDER BY company), '') AS companies, coalesce(string_agg(source_url, '; ' ORDER BY job_id), '') AS source_urls FROM x WHERE raw_title <> '' GROUP BY 1 HAVING count(*) <= 2")
def rq1_rare_titles(spark, sf_dir):
    return concentration.rare_table(_ok(spark, sf_dir).withColumn("raw_title", T.title_key(F.col("raw_job_title"))), "raw_title")


@query(f"WITH {_OK}, {_RAWKEY}, c AS (SELECT raw_title, count(*) AS n FROM x WHERE raw_title <> '' GROUP BY 1) SELECT n AS n_postings, count(*) AS n_titles FROM c GROUP BY 1")
def rq1_rank_frequency(spark, sf_dir):
    c = concentration.counts(_ok(spark, sf_dir).withColumn("raw_title", T.title_key(F.col("raw_job_title"))), "raw_title")
    return c.groupBy(F.col("n").alias("n_postings")).agg(F.count("*").alias("n_titles"))


# ---- skills ---------------------------------------------------------------------------------------------------------

_B = f"{_OK}, p AS (SELECT job_id, {SKILLS} AS s FROM e WHERE {SKILLS} IS NOT NULL), b AS (SELECT DISTINCT job_id, k AS skill FROM (SELECT job_id, unnest(s) AS k FROM p) WHERE k IS NOT NULL), n AS (SELECT count(*) AS n FROM p), f AS (SELECT skill, count(*) AS c FROM b GROUP BY 1)"
_J = _B + ", j AS (SELECT x.skill AS skill_a, y.skill AS skill_b, count(*) AS joint FROM b x JOIN b y ON x.job_id = y.job_id AND x.skill < y.skill GROUP BY 1, 2)"
_A = _J + ", a AS (SELECT skill_a, skill_b, joint, round(joint * n / (u.c::DOUBLE * v.c), 3) AS lift, round(CASE WHEN joint = n THEN 1.0 ELSE ln(joint * n / (u.c::DOUBLE * v.c)) / -ln(joint / n::DOUBLE) END, 3) AS npmi, round(joint / (u.c + v.c - joint)::DOUBLE, 3) AS jaccard FROM j, n, f u, f v WHERE u.skill = skill_a AND v.skill = skill_b AND joint >= 5)"


@query(f"WITH {_B} SELECT skill, c AS n_postings, round(c / n::DOUBLE, 4) AS share FROM f, n")
def rq2_skill_frequency(spark, sf_dir):
    e = _ok(spark, sf_dir)
    return basket.frequency(basket.basket(e), _n(e))


@query(f"WITH {_B}, k AS (SELECT p.job_id, count(b.skill) AS k FROM p LEFT JOIN b USING (job_id) GROUP BY 1) SELECT round(avg(k), 2) AS mean, quantile_cont(k, 0.5)::DOUBLE AS median, quantile_cont(k, 0.1)::DOUBLE AS p10, quantile_cont(k, 0.9)::DOUBLE AS p90, count(*) FILTER (k < 2) AS postings_below_min FROM k")
def rq2_skills_per_posting(spark, sf_dir):
    return basket.sizes(_ok(spark, sf_dir))


@query(f"WITH {_A} SELECT * FROM a")
def rq2_skill_pairs(spark, sf_dir):
    return basket.association(_ok(spark, sf_dir))


@query(f"WITH {_A} " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{m}' AS metric, (row_number() OVER (ORDER BY {m} DESC, joint DESC, skill_a, skill_b))::INT AS rank, skill_a, skill_b, joint, {m} AS value FROM a QUALIFY rank <= 30)" for m in ("lift", "npmi", "jaccard")))
def rq2_top_pairs_by_metric(spark, sf_dir):
    return basket.top_by_metric(basket.association(_ok(spark, sf_dir)))


@query(f"WITH {_J}, q AS (SELECT u.skill AS skill_a, v.skill AS skill_b, u.c::DOUBLE * v.c / n AS x FROM f u, f v, n WHERE u.skill < v.skill AND u.c * v.c >= 5.0 * n), r AS (SELECT skill_a, skill_b, coalesce(joint, 0)::BIGINT AS joint, round(x, 2) AS expected, round(coalesce(joint, 0) / x, 3) AS lift FROM q LEFT JOIN j USING (skill_a, skill_b)) SELECT * FROM r WHERE lift < 1 ORDER BY lift, expected DESC, skill_a, skill_b LIMIT 30")
def rq2_negative_pairs(spark, sf_dir):
    return basket.negative(_ok(spark, sf_dir))


@query()
def rq2_skill_communities(spark, sf_dir):
    e = _ok(spark, sf_dir)
    return graph.communities(basket.association(e), basket.basket(e).select("skill").distinct())


@query(f"WITH {_A}, t AS (SELECT skill FROM f ORDER BY c DESC, skill LIMIT 40) SELECT skill_a, skill_b, npmi FROM a WHERE npmi > 0.1 AND skill_a IN (FROM t) AND skill_b IN (FROM t)")
def rq2_network(spark, sf_dir):
    e = _ok(spark, sf_dir)
    return graph.network(basket.association(e), basket.frequency(basket.basket(e), 1))


@query(f"WITH {_B} SELECT job_id, skill FROM b WHERE skill IN (SELECT skill FROM f WHERE c >= 3)")
def rq2_basket(spark, sf_dir):
    return basket.at_least(basket.basket(_ok(spark, sf_dir)), 3)


# ---- titles against skills ------------------------------------------------------------------------------------------

_T = f"{_OK}, p AS (SELECT job_id, {TITLE} AS title, list_distinct(list_filter({SKILLS}, lambda x: x IS NOT NULL)) AS s FROM e WHERE {TITLE} IS NOT NULL AND {SKILLS} IS NOT NULL), g AS (SELECT title, count(*) AS n_postings FROM p GROUP BY 1)"
_P = _T + ", q AS (SELECT title, skill, count(*) / any_value(n_postings)::DOUBLE AS share, any_value(n_postings) AS n_postings FROM (SELECT title, unnest(s) AS skill FROM p) JOIN g USING (title) WHERE n_postings >= 5 GROUP BY 1, 2)"
_L = _P + ", w AS (SELECT title, sqrt(sum(share * share)) AS w FROM q GROUP BY 1), l AS (SELECT a.title AS title_a, b.title AS title_b, round(sum(a.share * b.share) / (any_value(u.w) * any_value(v.w)), 4) AS cosine FROM q a JOIN q b ON a.skill = b.skill AND a.title < b.title JOIN w u ON u.title = a.title JOIN w v ON v.title = b.title GROUP BY 1, 2)"


@query(f"WITH {_T}, d AS (SELECT x.title, avg(CASE WHEN len(x.s) + len(y.s) = 0 THEN 0 ELSE len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)))::DOUBLE END) AS j FROM p x JOIN p y ON x.title = y.title AND x.job_id < y.job_id GROUP BY 1) SELECT title, n_postings, round(1 - j, 4) AS dispersion FROM d JOIN g USING (title) WHERE n_postings >= 5")
def rq3_title_dispersion(spark, sf_dir):
    return profile.dispersion(_ok(spark, sf_dir), TITLE, "job_id", SKILLS)


@query(f"WITH {_OK}, g AS (SELECT lower({_SQUEEZE('raw_job_title')}) AS title, count(*) AS n_postings FROM e WHERE {SKILLS} IS NOT NULL GROUP BY 1) SELECT * FROM g WHERE n_postings < 5 AND title <> ''")
def rq3_skipped_titles(spark, sf_dir):
    """Of the titles as they were written, as many of those are rare."""
    return profile.skipped(_ok(spark, sf_dir).withColumn("raw_title", T.title_key(F.col("raw_job_title"))), "raw_title", SKILLS)


@query()
def rq3_baseline(spark, sf_dir):
    e = _ok(spark, sf_dir)
    found = profile.dispersion(e, TITLE, "job_id", SKILLS)
    return profile.with_baseline(found, profile.baseline(e, "job_id", SKILLS, found))


@query(f"WITH {_L} SELECT * FROM l")
def rq3_title_similarity(spark, sf_dir):
    return profile.likeness(profile.profiles(_ok(spark, sf_dir), TITLE, SKILLS))


@query(f"WITH {_L} SELECT *, CASE WHEN cosine >= 0.9 THEN 0.9 WHEN cosine >= 0.8 THEN 0.8 ELSE 0.7 END::DOUBLE AS level FROM l WHERE cosine >= 0.7")
def rq3_flagged_pairs(spark, sf_dir):
    return profile.flagged(rq3_title_similarity(spark, sf_dir))


@query(f"WITH {_L}, o AS (SELECT title, list(skill) AS s FROM q WHERE share >= 0.5 GROUP BY 1), t AS (SELECT * FROM l ORDER BY cosine DESC, title_a, title_b LIMIT 5), z AS (SELECT t.*, coalesce(a.s, []) AS x, coalesce(b.s, []) AS y FROM t LEFT JOIN o a ON a.title = title_a LEFT JOIN o b ON b.title = title_b) SELECT title_a, title_b, cosine, array_to_string(list_sort(list_intersect(x, y)), ', ') AS shared, array_to_string(list_sort(list_filter(x, lambda k: NOT list_contains(y, k))), ', ') AS only_a, array_to_string(list_sort(list_filter(y, lambda k: NOT list_contains(x, k))), ', ') AS only_b FROM z")
def rq3_notable_pairs(spark, sf_dir):
    p = profile.profiles(_ok(spark, sf_dir), TITLE, SKILLS)
    return profile.notable(p, profile.likeness(p))


@query(f"WITH {_P} SELECT title, n_postings, (row_number() OVER (PARTITION BY title ORDER BY share DESC, skill))::INT AS rank, skill, round(share, 4) AS share FROM q QUALIFY rank <= 10")
def rq3_title_profiles(spark, sf_dir):
    return profile.top_skills(profile.profiles(_ok(spark, sf_dir), TITLE, SKILLS))


@query(f"WITH {_P}, {_B.split(', ', 1)[1]}, top AS (SELECT skill FROM f ORDER BY c DESC, skill LIMIT 15) SELECT t.title, top.skill, coalesce(round(q.share, 4), 0) AS share FROM (SELECT DISTINCT title FROM q) t CROSS JOIN top LEFT JOIN q ON q.title = t.title AND q.skill = top.skill".replace(", p AS (SELECT job_id, extracted_skills AS s", ", p2 AS (SELECT job_id, extracted_skills AS s").replace("unnest(s) AS k FROM p)", "unnest(s) AS k FROM p2)").replace("count(*) AS n FROM p)", "count(*) AS n FROM p2)"))
def rq3_profile_matrix(spark, sf_dir):
    """The heat map's cells: each title's share of the 15 most frequent skills."""
    top = rq2_skill_frequency(spark, sf_dir).orderBy(F.desc("n_postings"), "skill").limit(15).select("skill")
    shape = profile.profiles(_ok(spark, sf_dir), TITLE, SKILLS)
    cells = shape.select("title").distinct().crossJoin(F.broadcast(top))
    return cells.join(shape.select("title", "skill", F.round("share", 4).alias("share")), ["title", "skill"], "left").fillna(0.0, "share")


# ---- cleaning -------------------------------------------------------------------------------------------------------


def _rules(spark, sf_dir) -> list[tuple[str, str]]:
    """Rules from the table of places: each name and alias as a pattern for its entry, in the table's order."""
    rows = small(_t(spark, sf_dir, "canon_locations").orderBy("ref_id"))
    plain = lambda s: "".join("\\" + c if c in r"\.[]{}()*+?^$|" else c for c in s.strip())
    return [("|".join(plain(x) for x in [r["normalized_location"], *(r["aliases"] or "").split(";")] if x.strip()), r["normalized_location"]) for r in rows]


_NA = r"(?i)^[\s\p{Z}]*(not available|n/?a|tbd|none|null|unknown|-+|\?+|đang cập nhật|thoả thuận.*)?[\s\p{Z}]*$"


def _location_sql() -> str:
    return rf"""WITH r AS (SELECT ref_id, normalized_location AS label, '(?i)' || array_to_string(list_transform(list_filter(string_split(normalized_location || ';' || coalesce(aliases, ''), ';'), lambda x: trim(x) <> ''), lambda x: regexp_replace(trim(x), '([\\.\[\]{{}}()*+?^$|])', '\\\1', 'g')), '|') AS p FROM canon_locations),
    x AS (SELECT job_id, coalesce(raw_location, '') AS t FROM jobs_clean),
    y AS (SELECT job_id, t, regexp_matches(t, '{_NA}') AS absent, regexp_matches(t, '(?i)\bnot available\b') AS na, list_filter(list_transform(regexp_split_to_array(regexp_replace(t, '(?i)\bnot available\b', '', 'g'), '[,/]'), lambda z: {_STRIP('z')}), lambda z: z <> '') AS parts FROM x),
    v AS (SELECT job_id, unnest(parts) AS part FROM y),
    w AS (SELECT DISTINCT job_id, arg_min(label, ref_id) AS label FROM v JOIN r ON regexp_matches(part, p) GROUP BY job_id, part),
    k AS (SELECT job_id, count(*) AS n, any_value(label) AS label FROM w GROUP BY 1)
    SELECT job_id, CASE WHEN absent OR n IS NULL THEN NULL WHEN n = 1 THEN label ELSE 'Nhiều địa điểm' END AS location,
    CASE WHEN absent THEN 'MISSING_LOCATION' WHEN n IS NULL THEN CASE WHEN na THEN 'MISSING_LOCATION' ELSE 'LOCATION_UNRECOGNIZED' END ELSE concat_ws(',', CASE WHEN n > 1 THEN 'MULTI_LOCATION' END, CASE WHEN na THEN 'MISSING_LOCATION' END) END AS flags
    FROM y LEFT JOIN k USING (job_id)"""


@query(_location_sql())
def clean_locations(spark, sf_dir):
    place = cleaning.location_of(F.col("raw_location"), _rules(spark, sf_dir))
    return _t(spark, sf_dir, "jobs_clean").select("job_id", place.alias("p")).select("job_id", F.col("p.value").alias("location"), F.array_join("p.flags", ",").alias("flags"))


def _flags_sql(table: str, key: str) -> str:
    cases = [(f"MISSING_{n}", _MISS(f)) for f, n in (("crawl_timestamp", "CRAWL_TIMESTAMP"), ("company", "COMPANY"), ("raw_location", "LOCATION"), ("raw_experience", "EXPERIENCE"), ("parser_version", "PARSER_VERSION"), ("job_description", "JOB_DESCRIPTION"), ("job_requirements", "JOB_REQUIREMENTS"))]
    short = " AND ".join(f"NOT {_MISS(c)} AND length({_STRIP(c)}) < 30" for c in ("job_description", "job_requirements"))
    cases += [("SCRAPE_FAILED", short), ("SCRAPE_ERROR_CONTENT", r"coalesce(regexp_matches(raw_job_title, '(?i)<[^>]+>|404|page\s+not\s+found'), false)")]
    rest = "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in cases) + ")"
    return f"SELECT {key}, CASE WHEN {_MISS('raw_job_title')} THEN 'MISSING_TITLE' WHEN {_MISS('source')} THEN 'MISSING_SOURCE' WHEN {_MISS('source_url')} THEN 'MISSING_URL' WHEN NOT regexp_matches({_STRIP('source_url')}, '(?i)^https?') THEN 'INVALID_URL' ELSE {rest} END AS flags FROM {table}"


@query(_flags_sql("jobs_raw", "raw_id"))
def clean_record_flags(spark, sf_dir):
    return _t(spark, sf_dir, "jobs_raw").select("raw_id", F.array_join(cleaning.record_flags(), ",").alias("flags"))


@query("WITH x AS (SELECT " + f"{_MISS('job_description')} AS d, {_MISS('job_requirements')} AS r, {_MISS('raw_location')} AS l, coalesce(duplicate_flag, false) AS u FROM jobs_clean), y AS (SELECT avg((d AND r)::INT) AS a, avg((NOT d AND r)::INT) AS b, avg(l::INT) AS c, avg(u::INT) AS e FROM x) " + " UNION ALL ".join(f"SELECT '{g}' AS gate, round({c}, 4) AS share, {t}::DOUBLE AS threshold, {c} > {t} AS exceeded FROM y" for g, c, t in (("no_text", "a", 0.1), ("no_requirements", "b", 0.2), ("no_location", "c", 0.3), ("duplicates", "e", 0.15))))
def clean_gates(spark, sf_dir):
    return cleaning.gate_table(_t(spark, sf_dir, "jobs_clean"))


@query(f"WITH x AS (SELECT *, coalesce(relevance_flag, false) AS r, coalesce(duplicate_flag, false) AS d, {_MISS('raw_job_title')} OR {_MISS('source')} OR {_MISS('source_url')} OR NOT regexp_matches({_STRIP('source_url')}, '(?i)^https?') AS bad FROM jobs_clean) SELECT (SELECT count(*) FROM jobs_raw) AS n_input, count(*) AS n_output, count(*) FILTER (bad) AS n_scrape_error, count(*) FILTER (d) AS n_duplicates, count(*) FILTER (NOT r) AS n_out_of_scope, count(*) FILTER (NOT r AND d) AS n_out_of_scope_and_duplicate, count(*) FILTER (r AND NOT d) AS n_valid, count(DISTINCT lower({_SQUEEZE('raw_job_title')})) AS unique_raw_titles, count(DISTINCT {TITLE}) AS unique_normalized_titles, count(DISTINCT normalized_location) AS unique_normalized_locations FROM x")
def clean_counts(spark, sf_dir):
    return cleaning.clean_counts(_t(spark, sf_dir, "jobs_clean"), _t(spark, sf_dir, "jobs_raw"))


_FIELDS = ["raw_job_title", "company", "raw_location", "posted_date", "raw_experience", "job_description", "job_requirements", "source_job_id"]


@query(" UNION ALL ".join(rf"SELECT '{c}' AS field, count(*) FILTER (x) AS missing, round(avg(x::INT), 4) AS share FROM (SELECT {_MISS(c)} OR regexp_matches({_STRIP(c)}, '(?i)^(none|nan|not available([\s,]+not available)*)$') AS x FROM jobs_raw)" for c in _FIELDS))
def eda_missing_by_field(spark, sf_dir):
    return cleaning.missing_by_field(_t(spark, sf_dir, "jobs_raw"), _FIELDS)


@query(f"WITH x AS (SELECT raw_id, CASE WHEN {_MISS('job_description')} THEN NULL ELSE {_STRIP('job_description')} END AS d, CASE WHEN {_MISS('job_requirements')} THEN NULL ELSE {_STRIP('job_requirements')} END AS r FROM jobs_raw) SELECT raw_id, CASE WHEN d IS NOT NULL AND r IS NOT NULL THEN d || chr(10) || chr(10) || r ELSE coalesce(d, r) END AS job_text FROM x")
def clean_job_text(spark, sf_dir):
    return _t(spark, sf_dir, "jobs_raw").select("raw_id", T.job_text(F.col("job_description"), F.col("job_requirements")).alias("job_text"))


def _tools(spark, sf_dir) -> list[str]:
    return [r[0] for r in small(readers.tech_terms(_t(spark, sf_dir, "skills_taxonomy"), titles.MORE_TOOLS, titles.DOMAIN_GROUPS, titles.DOMAIN_SKILLS).orderBy("term"))]


@query()
def clean_titles(spark, sf_dir):
    distinct = _t(spark, sf_dir, "jobs_raw").select("raw_job_title").distinct()
    title = titles.normal_title(F.col("raw_job_title"), [p for p, _ in _rules(spark, sf_dir)], _tools(spark, sf_dir))
    return distinct.select("raw_job_title", title.alias("t")).select("raw_job_title", F.col("t.title").alias("title"), F.array_join("t.flags", ",").alias("flags"))


@query(" UNION ALL ".join(f"SELECT {i} AS n, {_q(r)} AS raw_job_title, {_q(t)}::VARCHAR AS title, {_q(f)} AS flags" for i, (r, t, f) in enumerate(TITLE_CASES)))
def clean_title_cases(spark, sf_dir):
    """Known titles and what they must come out as."""
    df = spark.createDataFrame([(i, r) for i, (r, _, _) in enumerate(TITLE_CASES)], "n int, raw_job_title string")
    title = titles.normal_title(F.col("raw_job_title"), [p for p, _ in TITLE_PLACES], [*TITLE_TOOLS])
    return df.select("n", "raw_job_title", title.alias("t")).select("n", "raw_job_title", F.col("t.title").alias("title"), F.array_join("t.flags", ",").alias("flags"))


# ---- duplicates -----------------------------------------------------------------------------------------------------


@query(f"WITH x AS (SELECT raw_id, {_STRIP('source_url')} AS u, CASE WHEN {_MISS('crawl_timestamp')} THEN NULL ELSE crawl_timestamp END AS t FROM jobs_raw) SELECT raw_id, first_value(raw_id) OVER (PARTITION BY u ORDER BY t NULLS LAST, raw_id) AS canonical FROM x WHERE u <> '' QUALIFY raw_id <> canonical")
def dup_exact(spark, sf_dir):
    return duplicates.exact(_t(spark, sf_dir, "jobs_raw"), key="raw_id")


@query("WITH x AS (SELECT raw_id, source_url, try_cast(crawl_timestamp AS TIMESTAMPTZ) AS t FROM jobs_raw), y AS (SELECT raw_id, source_url, t FROM x WHERE ((t AT TIME ZONE 'UTC') + INTERVAL 7 HOUR)::DATE BETWEEN DATE '2025-03-01' AND DATE '2025-04-30') SELECT source_url, raw_id FROM y QUALIFY row_number() OVER (PARTITION BY source_url ORDER BY t, raw_id) = 1")
def dup_combined_rounds(spark, sf_dir):
    return duplicates.combine(_t(spark, sf_dir, "jobs_raw").select("raw_id", "source_url", "crawl_timestamp"), "2025-03-01", "2025-04-30").select("source_url", "raw_id")


def _near_sql(alone: bool) -> str:
    """o (a, b, cosine, alone): by the rule as it is said, over all pairs of a company; r (job_id, k): the first of the rows that are the same in all respects."""
    common = "len(list_intersect(x.tt, y.tt))"
    standard = f"x.ti <> '' AND y.ti <> '' AND x.pl IS NOT DISTINCT FROM y.pl AND (len(x.tt) + len(y.tt) = 0 OR {common} >= 0.6 * (len(x.tt) + len(y.tt) - {common}))"
    return f"""c AS (SELECT job_id, lower({_STRIP('company')}) AS co, normalized_location AS pl, lower({_STRIP(f"coalesce({TITLE}, '')")}) AS ti, job_description AS te, regexp_matches(lower(coalesce(job_description, '')), '[a-z0-9]') AS has FROM jobs_clean),
    r AS (SELECT job_id, min(job_id) OVER (PARTITION BY co, pl, ti, te) AS k FROM c WHERE co <> '' AND has {"" if alone else "AND ti <> ''"}),
    e AS (SELECT job_id, co, pl, ti, list_distinct(regexp_extract_all(ti, '[a-z0-9]+')) AS tt FROM c WHERE job_id IN (SELECT k FROM r)),
    m AS (SELECT x.job_id AS a, y.job_id AS b, {standard} AS standard, list_sort(list_filter(x.tt, lambda w: list_contains({list(duplicates.LEVELS)}, w))) <> list_sort(list_filter(y.tt, lambda w: list_contains({list(duplicates.LEVELS)}, w))) AS differs FROM e x JOIN e y ON x.co = y.co AND x.job_id < y.job_id {"" if alone else f"WHERE {standard}"}),
    k AS (SELECT job_id, token, count(*) AS c FROM (SELECT job_id, unnest(regexp_extract_all(lower(coalesce(job_description, '')), '[a-z0-9]+')) AS token FROM jobs_clean) GROUP BY 1, 2),
    i AS (SELECT token, ln(((SELECT count(*) FROM jobs_clean) + 1) / (count(*) + 1)::DOUBLE) + 1 AS idf FROM k GROUP BY 1), w AS (SELECT job_id, token, c * idf AS w FROM k JOIN i USING (token)), z AS (SELECT job_id, sqrt(sum(w * w)) AS z FROM w GROUP BY 1),
    d AS (SELECT a, b, any_value(standard) AS standard, any_value(differs) AS differs, sum(p.w * q.w) / (any_value(u.z) * any_value(v.z)) AS cosine FROM m JOIN w p ON p.job_id = a JOIN w q ON q.job_id = b AND q.token = p.token JOIN z u ON u.job_id = a JOIN z v ON v.job_id = b GROUP BY 1, 2),
    o AS (SELECT a, b, cosine, differs, NOT (standard AND cosine >= 0.8) AS alone FROM d WHERE standard AND cosine >= 0.8 OR cosine >= 0.95)"""


@query(f"WITH {_near_sql(False)} SELECT a, b, round(cosine, 6) AS cosine FROM o")
def dup_near(spark, sf_dir):
    return duplicates.near(_t(spark, sf_dir, "jobs_clean")).select("a", "b", F.round("cosine", 6).alias("cosine"))


@query(f"WITH {_near_sql(False)} SELECT job_id, k AS representative FROM r")
def dup_near_classes(spark, sf_dir):
    return duplicates.near_classes(_t(spark, sf_dir, "jobs_clean"))


# Row after row: one that is like an earlier row that is not gone is gone, and belongs to the first such.
@query(
    f"""WITH {_near_sql(False)}, g AS (SELECT y.job_id AS b, x.job_id AS a, coalesce(o.differs, false) AS differs FROM r x JOIN r y ON x.job_id < y.job_id LEFT JOIN o ON o.a = least(x.k, y.k) AND o.b = greatest(x.k, y.k) WHERE x.k = y.k OR o.a IS NOT NULL),
    n AS (SELECT b, list(a) AS n FROM g GROUP BY 1), f AS (SELECT list_reduce(list(struct_pack(k := b, n := n, gone := []::VARCHAR[]) ORDER BY b), lambda x, y: struct_pack(k := y.k, n := y.n, gone := CASE WHEN len(list_filter(y.n, lambda z: NOT list_contains(x.gone, z))) > 0 THEN list_append(x.gone, y.k) ELSE x.gone END), struct_pack(k := '', n := []::VARCHAR[], gone := []::VARCHAR[])) AS s FROM n),
    h AS (SELECT unnest(s.gone) AS b FROM f), t AS (SELECT g.b, min(a) AS a FROM g JOIN h USING (b) WHERE a NOT IN (SELECT b FROM h) GROUP BY 1)
    SELECT t.b AS job_id, t.a AS duplicate_group_id, CASE WHEN differs THEN 'DUPLICATE_NEAR,SENIORITY_VARIANT' ELSE 'DUPLICATE_NEAR' END AS flags FROM t JOIN g ON g.a = t.a AND g.b = t.b"""
)
def dup_near_greedy(spark, sf_dir):
    found = duplicates.repeats(_t(spark, sf_dir, "jobs_clean"))
    return found.select("job_id", F.col("near_of").alias("duplicate_group_id"), F.array_join("near_flags", ",").alias("flags"))


@query(rf"WITH {_OK}, x AS (SELECT lower({_STRIP("coalesce(company, '')")}) AS a, lower({_STRIP(f"coalesce({TITLE}, '')")}) AS b, lower(regexp_replace({_STRIP("concat_ws(' ', job_description, job_requirements)")}, '\s+', ' ', 'g')) AS c FROM e) SELECT count(*) AS n, count(DISTINCT (a, b, c)) AS distinct_postings, round(1 - count(DISTINCT (a, b, c)) / count(*)::DOUBLE, 4) AS residual_share FROM x")
def dup_residual(spark, sf_dir):
    return duplicates.residual(_ok(spark, sf_dir))


@query(r"WITH w AS (SELECT job_id, list_filter(regexp_split_to_array(lower(regexp_replace(coalesce(job_requirements, ''), '[^\p{L}\p{N}_]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM jobs_clean) SELECT job_id, len(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1)::BIGINT + 1), lambda i: array_to_string(w[i:i+4], ' '))))::INT AS n_shingles FROM w")
def dup_shingles(spark, sf_dir):
    return _t(spark, sf_dir, "jobs_clean").select("job_id", F.size(duplicates.shingles(F.col("job_requirements"))).alias("n_shingles"))


# ---- skills in texts ------------------------------------------------------------------------------------------------


def _matches(spark, sf_dir) -> DataFrame:
    jobs = _t(spark, sf_dir, "jobs_clean").select("job_id", F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in ("raw_job_title", "job_description", "job_requirements")]).alias("t"))
    return matcher.extract(jobs, "job_id", "t", _t(spark, sf_dir, "skills_taxonomy"))


@query()
def skills_extracted(spark, sf_dir):
    return matcher.skill_lists(_matches(spark, sf_dir)).select("job_id", F.array_join(SKILLS, "|").alias("skills"), "skill_count")


@query()
def skills_spans(spark, sf_dir):
    return _matches(spark, sf_dir).select("job_id", F.explode("matches").alias("m")).select("job_id", "m.*")


@query()
def skills_recount(spark, sf_dir):
    return matcher.recount(_matches(spark, sf_dir))


@query()
def skills_matrix(spark, sf_dir):
    ids = [r[0] for r in small(_t(spark, sf_dir, "skills_taxonomy").select("skill_id").orderBy("skill_id"))]
    return matcher.skill_matrix(_matches(spark, sf_dir), "job_id", ids)


@query()
def skills_evidence(spark, sf_dir):
    return matcher.evidence(_matches(spark, sf_dir), "job_id")


@query()
def skills_recount_differs(spark, sf_dir):
    return matcher.recount_differs(matcher.recount(_matches(spark, sf_dir)), _t(spark, sf_dir, "skills_taxonomy"))


@query(f"WITH {_B}, g AS (SELECT unnest({list(matcher.CORE_GROUPS)}) AS skill_group) SELECT job_id, count(*) AS n_skills, round(avg((coalesce(skill_group, '') IN (FROM g))::INT), 4) AS core_share FROM b LEFT JOIN skills_taxonomy ON canonical_name = skill GROUP BY 1")
def skills_core_share(spark, sf_dir):
    return matcher.group_shares(basket.basket(_ok(spark, sf_dir)), _t(spark, sf_dir, "skills_taxonomy"), list(matcher.CORE_GROUPS))


@query(f"WITH {_B} SELECT skill_group, count(DISTINCT job_id) AS n_postings, round(count(DISTINCT job_id) / any_value(n)::DOUBLE, 4) AS share FROM b JOIN skills_taxonomy ON canonical_name = skill, n GROUP BY 1")
def skills_group_coverage(spark, sf_dir):
    e = _ok(spark, sf_dir)
    return explore.coverage(basket.basket(e), _t(spark, sf_dir, "skills_taxonomy"), _n(e))


# ---- labels ---------------------------------------------------------------------------------------------------------

# w: who was asked about an item, those who gave no label included.
_G = f"w AS (SELECT DISTINCT job_id AS item, lower({_STRIP('annotated_by')}) AS person FROM gold_jobs), g AS (SELECT DISTINCT job_id AS item, lower({_STRIP('annotated_by')}) AS person, u.t.skill_id AS label FROM gold_jobs, unnest(annotations) AS u(t) WHERE u.t.skill_id IS NOT NULL)"


def _long(spark, sf_dir) -> DataFrame:
    """(item, person, label); a submission without labels has one row, its label null."""
    gold = _t(spark, sf_dir, "gold_jobs")
    return gold.select(F.col("job_id").alias("item"), F.lower(T.strip(F.col("annotated_by"))).alias("person"), F.explode_outer("annotations.skill_id").alias("label")).distinct()


@query(f"WITH {_G}, n AS (SELECT item, count(DISTINCT person) AS n FROM w GROUP BY 1), m AS (SELECT item, label FROM g JOIN n USING (item) GROUP BY 1, 2 HAVING count(*) * 2 > any_value(n)), p AS (SELECT item, label, person FROM g), o AS (SELECT coalesce(p.label, m.label) AS label, p.person IS NOT NULL AS y, m.item IS NOT NULL AS x FROM (SELECT item, label, min(person) AS person FROM p GROUP BY 1, 2) p FULL JOIN m ON m.item = p.item AND m.label = p.label) SELECT label, count(*) FILTER (x AND y) AS tp, count(*) FILTER (y AND NOT x) AS fp, count(*) FILTER (x AND NOT y) AS fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, 4) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END, 4) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END, 4) AS f1 FROM o GROUP BY 1")
def gold_scores_by_skill(spark, sf_dir):
    long = _long(spark, sf_dir)
    n = long.groupBy("item").agg(F.count_distinct("person").alias("n"))
    long = long.filter("label IS NOT NULL")
    gold = long.groupBy("item", "label").agg(F.count("*").alias("c")).join(n, "item").filter("c * 2 > n")
    return agreement.per_label(agreement.compare_labels(gold.select(F.col("item").alias("id"), "label"), long.select(F.col("item").alias("id"), "label")))


@query(
    f"""WITH {_G}, p AS (FROM w), c AS (SELECT l.item, l.label, p.person, (g.label IS NOT NULL)::INT AS y FROM (SELECT DISTINCT item, label FROM g) l JOIN p ON p.item = l.item LEFT JOIN g ON g.item = l.item AND g.label = l.label AND g.person = p.person),
    q AS (SELECT x.person AS a, y.person AS b, count(*)::DOUBLE AS n, sum(x.y * y.y) AS tp, sum(x.y) AS pa, sum(y.y) AS pb, count(*) FILTER (x.y = y.y) AS same FROM c x JOIN c y ON x.item = y.item AND x.label = y.label AND x.person < y.person GROUP BY 1, 2), r AS (SELECT *, (pa * pb + (n - pa) * (n - pb)) / (n * n) AS pe FROM q)
    SELECT a, b, n::BIGINT AS n, round(CASE WHEN pe >= 1 THEN 1 ELSE (same / n - pe) / (1 - pe) END, 4) AS kappa, round(CASE WHEN pa + pb > 0 THEN 2 * tp / (pa + pb)::DOUBLE ELSE 0 END, 4) AS positive_agreement FROM r"""
)
def gold_kappa(spark, sf_dir):
    return agreement.pairwise_kappa(_long(spark, sf_dir))


@query(f"WITH {_G}, n AS (SELECT item, count(DISTINCT person) AS n_people FROM w GROUP BY 1), c AS (SELECT item, label, count(DISTINCT person) AS c FROM g GROUP BY 1, 2) SELECT item, n_people, coalesce(string_agg(label, '|' ORDER BY label) FILTER (c = n_people), '') AS agreed, coalesce(string_agg(label, '|' ORDER BY label) FILTER (c < n_people), '') AS disputed FROM n LEFT JOIN c USING (item) GROUP BY 1, 2")
def gold_merged(spark, sf_dir):
    return agreement.merge_labels(_long(spark, sf_dir))


# v (item, label): labels that more than half of the item's people gave; o: everybody's labels against them.
_MAJORITY = _G + ", n AS (SELECT item, count(DISTINCT person) AS n FROM w GROUP BY 1), v AS (SELECT item, label FROM g JOIN n USING (item) GROUP BY 1, 2 HAVING count(*) * 2 > any_value(n)), s AS (SELECT DISTINCT item, label FROM g), o AS (SELECT coalesce(s.item, v.item) AS item, coalesce(s.label, v.label) AS label, CASE WHEN v.item IS NULL THEN 'fp' WHEN s.item IS NULL THEN 'fn' ELSE 'tp' END AS outcome FROM s FULL JOIN v ON v.item = s.item AND v.label = s.label)"
_SPLIT = "CASE WHEN ('0x' || substr(sha256('gold-split-v1:' || item), 1, 8))::BIGINT % 2 = 0 THEN 'holdout' ELSE 'tune' END"


def _evaluation(spark, sf_dir) -> dict[str, DataFrame]:
    """The labels that anybody gave, against those of the majority."""
    long = _long(spark, sf_dir)
    n = long.groupBy("item").agg(F.count_distinct("person").alias("n"))
    given = long.filter("label IS NOT NULL")
    gold = given.groupBy("item", "label").agg(F.count("*").alias("c")).join(n, "item").filter("c * 2 > n")
    return agreement.evaluation(gold.select(F.col("item").alias("id"), "label"), given.select(F.col("item").alias("id"), "label"), long.select(F.col("item").alias("id")))


@query(
    f"WITH {_MAJORITY}, p AS (SELECT item, 'all' AS subset FROM n UNION ALL SELECT item, {_SPLIT} AS subset FROM n), c AS (SELECT subset, count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'fp') AS fp, count(*) FILTER (outcome = 'fn') AS fn, count(DISTINCT item) FILTER (outcome <> 'tp') AS n_errors FROM p LEFT JOIN o USING (item) GROUP BY 1), k AS (SELECT subset, count(*) AS n_items FROM p GROUP BY 1)"
    " SELECT subset, n_items, n_errors, tp, fp, fn, round(tp / (tp + fp)::DOUBLE, 4) AS precision, round(tp / (tp + fn)::DOUBLE, 4) AS recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 4) AS f1 FROM c JOIN k USING (subset)"
)
def gold_metrics(spark, sf_dir):
    return _evaluation(spark, sf_dir)["metrics"]


@query(f"WITH {_MAJORITY} SELECT item AS id, coalesce(string_agg(label, '|' ORDER BY label) FILTER (outcome = 'fp'), '') AS false_positives, coalesce(string_agg(label, '|' ORDER BY label) FILTER (outcome = 'fn'), '') AS false_negatives FROM o WHERE outcome <> 'tp' GROUP BY 1")
def gold_errors(spark, sf_dir):
    return _evaluation(spark, sf_dir)["errors"]


def _choices(spark, sf_dir) -> DataFrame:
    """(item, person, label): the group of skills that each person named most often in a posting."""
    gold = _t(spark, sf_dir, "gold_jobs").select(F.col("job_id").alias("item"), F.lower(T.strip(F.col("annotated_by"))).alias("person"), F.explode("annotations.skill_id").alias("skill_id"))
    groups = _t(spark, sf_dir, "skills_taxonomy").select("skill_id", "skill_group")
    n = gold.distinct().join(groups, "skill_id").groupBy("item", "person", "skill_group").agg(F.count("*").alias("c"))
    return n.groupBy("item", "person").agg(F.min(F.struct(-F.col("c"), "skill_group")).alias("x")).select("item", "person", F.col("x.skill_group").alias("label"))


_CHOICE = f"{_G}, q AS (SELECT item, person, skill_group, count(*) AS c FROM g JOIN skills_taxonomy t ON t.skill_id = g.label WHERE person IS NOT NULL GROUP BY 1, 2, 3), c AS (SELECT item, person, skill_group AS label FROM q QUALIFY row_number() OVER (PARTITION BY item, person ORDER BY c DESC, skill_group) = 1)"


@query(f"WITH {_CHOICE} SELECT item, CASE WHEN count(DISTINCT label) = 1 THEN min(label) END AS label, CASE WHEN count(DISTINCT label) > 1 THEN 'conflict' WHEN count(*) = 1 THEN 'single' ELSE 'agreed' END AS status, count(*) AS n_people, string_agg(person, ';' ORDER BY person) AS people, CASE WHEN count(DISTINCT label) > 1 THEN string_agg(person || ': ' || label, ' | ' ORDER BY person) END AS choices FROM c GROUP BY 1")
def role_merged(spark, sf_dir):
    return agreement.merge_choices(_choices(spark, sf_dir))


@query(f"WITH {_CHOICE}, b AS (SELECT x.person AS a, y.person AS b, x.label AS la, y.label AS lb FROM c x JOIN c y ON x.item = y.item AND x.person < y.person), n AS (SELECT a, b, count(*) AS shared, avg((la = lb)::INT) AS po FROM b GROUP BY 1, 2), l AS (SELECT a, b, la AS l, count(*) AS p FROM b GROUP BY 1, 2, 3), r AS (SELECT a, b, lb AS l, count(*) AS q FROM b GROUP BY 1, 2, 3), e AS (SELECT a, b, sum(p * q) AS s FROM l JOIN r USING (a, b, l) GROUP BY 1, 2), z AS (SELECT a, b, shared, po, coalesce(s, 0) / (shared * shared)::DOUBLE AS pe FROM n LEFT JOIN e USING (a, b)) SELECT a, b, shared, round(po, 4) AS agreement, round(CASE WHEN pe >= 1 THEN 1 ELSE (po - pe) / (1 - pe) END, 4) AS kappa FROM z")
def role_kappa(spark, sf_dir):
    return agreement.choice_kappa(_choices(spark, sf_dir))


@query(f"WITH {_CHOICE} SELECT least(x.label, y.label) AS label_a, greatest(x.label, y.label) AS label_b, count(*) AS n FROM c x JOIN c y ON x.item = y.item AND x.person < y.person AND x.label <> y.label GROUP BY 1, 2 ORDER BY n DESC, label_a, label_b LIMIT 10")
def role_confused(spark, sf_dir):
    return agreement.confused(_choices(spark, sf_dir))


@query("WITH a AS (SELECT job_id, text AS t, u.x AS x FROM gold_jobs, unnest(annotations) AS u(x)), b AS (SELECT job_id, x.skill_id AS skill_id, CASE WHEN x.start < 0 OR x.end > length(t) OR x.end <= x.start THEN 'outside' WHEN array_to_string(list_slice(string_split(t, ''), x.start + 1, x.end), '') <> x.evidence THEN 'differs' END AS fault FROM a) SELECT * FROM b WHERE fault IS NOT NULL")
def gold_span_faults(spark, sf_dir):
    return agreement.span_faults(_t(spark, sf_dir, "gold_jobs"), "job_id", "text", "annotations")


@query("SELECT DISTINCT job_id, CASE WHEN ('0x' || substr(sha256('gold-split-v1:' || job_id), 1, 8))::BIGINT % 2 = 0 THEN 'holdout' ELSE 'tune' END AS split FROM gold_jobs")
def gold_split(spark, sf_dir):
    return _t(spark, sf_dir, "gold_jobs").select("job_id").distinct().select("job_id", agreement.split_by_hash(F.col("job_id")).alias("split"))


@query("SELECT job_id, (row_number() OVER (ORDER BY sha256('sample-v1:' || job_id), job_id))::INT AS rank FROM jobs_clean QUALIFY rank <= 300")
def role_hash_sample(spark, sf_dir):
    return agreement.hash_sample(_t(spark, sf_dir, "jobs_clean").select("job_id"), "job_id", 300, "sample-v1:")


@query("WITH g AS (SELECT count(*) AS bad FROM gold_jobs WHERE sha256(text) <> text_sha256), h AS (SELECT count(*) AS n FROM gold_jobs) SELECT n, bad FROM g, h")
def gold_text_hashes(spark, sf_dir):
    return _t(spark, sf_dir, "gold_jobs").agg(F.count("*").alias("n"), F.count_if(F.sha2("text", 256) != F.col("text_sha256")).alias("bad"))


def _partition_sql(a: str, b: str) -> str:
    p = lambda x: f"{x} * ({x} - 1) / 2"
    return f"""WITH c AS (SELECT {a} AS a, {b} AS b, count(*)::DOUBLE AS c FROM jobs_clean WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2), r AS (SELECT sum(c) AS c FROM c GROUP BY a), k AS (SELECT sum(c) AS c FROM c GROUP BY b),
    o AS (SELECT sum(c) AS n, sum({p('c')}) AS s, sum(c * ln(c)) AS h FROM c), x AS (SELECT sum({p('c')}) AS s, sum(c * ln(c)) AS h FROM r), y AS (SELECT sum({p('c')}) AS s, sum(c * ln(c)) AS h FROM k),
    z AS (SELECT n, o.s AS s, x.s * y.s / ({p('n')}) AS e, (x.s + y.s) / 2 AS t, ln(n) - x.h / n AS hr, ln(n) - y.h / n AS hk, ln(n) - o.h / n AS hc FROM o, x, y)
    SELECT n::BIGINT AS n_compared, round(CASE WHEN t = e THEN 1 ELSE (s - e) / (t - e) END, 6) AS ari, round(CASE WHEN hr + hk <= 1e-12 THEN 1 ELSE 2 * (hr + hk - hc) / (hr + hk) END, 6) AS nmi FROM z"""


@query(_partition_sql(TITLE, "source"))
def rq4_agreement(spark, sf_dir):
    return agreement.partition_agreement(_t(spark, sf_dir, "jobs_clean"), TITLE, "source")


# ---- quality --------------------------------------------------------------------------------------------------------


@query(f"SELECT job_id, count(*) AS n FROM jobs_raw GROUP BY 1 HAVING count(*) > 1 OR {_MISS('job_id')}")
def quality_repeated_ids(spark, sf_dir):
    return quality.repeated_ids(_t(spark, sf_dir, "jobs_raw"), "job_id")


def _violations_sql() -> str:
    rules = [
        ("blank_id", _MISS("job_id")),
        ("missing_source", _MISS("source")),
        ("missing_url", _MISS("source_url")),
        ("missing_time", _MISS("crawl_timestamp")),
        ("missing_version", _MISS("parser_version")),
        ("missing_title", _MISS("raw_job_title")),
        ("undecided", "relevance_flag IS NULL OR duplicate_flag IS NULL"),
        ("blank_skill", f"len(list_filter({SKILLS}, lambda x: {_MISS('x')})) > 0"),
        ("eligible_without_title", f"relevance_flag AND NOT coalesce(duplicate_flag, false) AND {_MISS(TITLE)}"),
        ("eligible_without_job_text", f"relevance_flag AND NOT coalesce(duplicate_flag, false) AND {_MISS('job_text')}"),
        ("no_text_without_reason", f"{_MISS('job_description')} AND {_MISS('job_requirements')} AND NOT (coalesce(NOT relevance_flag, false) AND coalesce(exclusion_reason IN ('INSUFFICIENT_TEXT', 'SCRAPE_ERROR'), false))"),
        ("bad_date", r"posted_date IS NOT NULL AND (try_cast(posted_date AS DATE) IS NULL OR NOT regexp_matches(posted_date, '^\d{4}-\d{2}-\d{2}$'))"),
        ("bad_time", r"crawl_timestamp IS NOT NULL AND NOT regexp_matches(crawl_timestamp, '^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}')"),
        ("negative_count", "skill_count < 0"),
        ("count_differs", f"{SKILLS} IS NOT NULL AND len({SKILLS}) <> skill_count"),
        ("reason_without_exclusion", "coalesce(relevance_flag, false) AND exclusion_reason IS NOT NULL"),
        ("exclusion_without_reason", "NOT relevance_flag AND exclusion_reason IS NULL"),
        ("relevant_without_text", f"coalesce(relevance_flag, false) AND {_MISS('job_description')} AND {_MISS('job_requirements')}"),
    ]
    return " UNION ALL ".join(f"SELECT job_id, '{n}' AS violation FROM jobs_clean WHERE {c}" for n, c in rules)


@query(_violations_sql())
def quality_violations(spark, sf_dir):
    return quality.violations(_t(spark, sf_dir, "jobs_clean"))


_IMM = quality.IMMUTABLE


@query("WITH r AS (SELECT * FROM jobs_raw QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY raw_id DESC) = 1) " + " UNION ALL ".join(f"SELECT job_id, '{f}' AS field FROM r JOIN jobs_clean c USING (job_id) WHERE r.{f} IS DISTINCT FROM c.{f}" for f in _IMM) + " UNION ALL SELECT job_id, 'missing' AS field FROM r WHERE job_id NOT IN (SELECT job_id FROM jobs_clean) UNION ALL SELECT job_id, 'extra' AS field FROM jobs_clean WHERE job_id NOT IN (SELECT job_id FROM r)")
def quality_changed_fields(spark, sf_dir):
    raw = _t(spark, sf_dir, "jobs_raw")
    last = raw.groupBy("job_id").agg(F.max_by(F.struct(*_IMM), "raw_id").alias("x")).select("job_id", "x.*")
    return quality.changed_fields(last, _t(spark, sf_dir, "jobs_clean"))


def _checks_sql() -> str:
    length = f"length({_STRIP("concat_ws(' ', job_description, job_requirements)")})"
    rows = [
        ("QC1", "ids match", "(SELECT count(*) FROM k WHERE job_id NOT IN (SELECT job_id FROM e)) + (SELECT count(*) FROM e WHERE job_id NOT IN (SELECT job_id FROM k))", 0.0, "<="),
        ("QC2", "no null list", f"(SELECT count(*) FROM k WHERE {SKILLS} IS NULL)", 0.0, "<="),
        ("QC3", "mean skills", f"(SELECT avg(len({SKILLS})) FROM k)", 3.0, ">="),
        ("QC4", "share without skill", f"(SELECT avg((coalesce(len({SKILLS}), 0) < 1)::INT) FROM k)", 0.1, "<="),
        ("QC5", "share of the top skill", f"(SELECT max(c) FROM (SELECT count(*) AS c FROM (SELECT unnest(list_distinct({SKILLS})) AS s FROM k) WHERE s IS NOT NULL GROUP BY s)) / (SELECT count(*) FROM k)::DOUBLE", 0.9, "<="),
        ("QC6", "residual duplicates", "(SELECT residual_share FROM d)", 0.02, "<="),
        ("QC7", "median text length", f"(SELECT quantile_cont({length}, 0.5) FROM e)", 300, ">="),
        ("QC8", "missing titles", f"(SELECT count(*) FROM e WHERE {_MISS(TITLE)})", 0.0, "<="),
    ]
    return f"WITH {_OK}, k AS (SELECT job_id, {SKILLS} FROM jobs_clean WHERE relevance_flag), d AS ({_SQL['dup_residual']}), v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"check\", '{n}' AS name, ({v})::DOUBLE AS value, {float(t)}::DOUBLE AS threshold, {v} {way} {t} AS passed" for c, n, v, t, way in rows) + ") SELECT \"check\", name, round(value, 4) AS value, threshold, passed FROM v"


@query(_checks_sql())
def quality_checks(spark, sf_dir):
    """The skills are those of an earlier stage, which had not yet left out duplicates; QC1 counts them."""
    jobs = _t(spark, sf_dir, "jobs_clean")
    return quality.checks(jobs, jobs.filter("relevance_flag").select("job_id", SKILLS))


@query(f"WITH {_OK} SELECT job_id, 'missing' AS fault FROM jobs_clean WHERE relevance_flag AND job_id NOT IN (SELECT job_id FROM e) UNION ALL SELECT job_id, 'repeated_skill' AS fault FROM e WHERE len(list_distinct({SKILLS})) + (len({SKILLS}) > len(list_filter({SKILLS}, lambda x: x IS NOT NULL)))::INT <> len({SKILLS}) UNION ALL SELECT job_id, 'count_differs' AS fault FROM e WHERE len({SKILLS}) <> skill_count UNION ALL SELECT DISTINCT job_id, 'unknown_skill' AS fault FROM (SELECT job_id, unnest({SKILLS}) AS k FROM e) WHERE k IS NULL OR k NOT IN (SELECT canonical_name FROM skills_taxonomy)")
def quality_feature_faults(spark, sf_dir):
    e, relevant = _ok(spark, sf_dir), _t(spark, sf_dir, "jobs_clean").filter("relevance_flag")
    return quality.feature_faults(e, relevant, _t(spark, sf_dir, "skills_taxonomy").select(F.col("canonical_name").alias("skill")))


@query(f"WITH {_OK}, g AS (SELECT {TITLE} AS t, count(*) AS c FROM e GROUP BY 1) SELECT count(*) FILTER (t IS NOT NULL AND c >= 5) > 0 AS ok, count(*) FILTER (t IS NOT NULL AND c >= 5) AS qualifying, coalesce(sum(c) FILTER (t IS NULL), 0)::BIGINT AS untitled, coalesce(max(c) FILTER (t IS NOT NULL), 0)::BIGINT AS largest FROM g")
def quality_titles(spark, sf_dir):
    return quality.title_check(_ok(spark, sf_dir))


# ---- description ----------------------------------------------------------------------------------------------------

_TEXT = "coalesce(job_description, '') || chr(10) || coalesce(job_requirements, '')"
_FRAME = f"""f AS (SELECT *, length(t) AS n_chars, length(regexp_replace(lower(t), '[^\\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(lower(t), '[^{T.VIETNAMESE}]', '', 'g')) AS vn, CASE WHEN NOT coalesce(relevance_flag, false) THEN 'out_of_scope' WHEN coalesce(duplicate_flag, false) THEN 'duplicate' ELSE 'valid' END AS status, try_cast(posted_date AS DATE) AS posted FROM (SELECT *, {_TEXT} AS t FROM jobs_clean)),
    h AS (SELECT *, CASE WHEN letters > 0 THEN CASE WHEN vn / letters::DOUBLE >= 0.05 THEN 'vi' WHEN vn / letters::DOUBLE >= 0.005 THEN 'mixed' ELSE 'en' END END AS language FROM f)"""


def _frame(spark, sf_dir) -> DataFrame:
    return explore.frame(_t(spark, sf_dir, "jobs_clean"))


@query(f"WITH {_FRAME} SELECT count(*) AS n, count(DISTINCT company) AS companies, count(DISTINCT source) AS sources, quantile_cont(n_chars, 0.5)::DOUBLE AS median_chars, count(*) FILTER (language = 'vi') AS vi, count(*) FILTER (language = 'en') AS en, count(*) FILTER (status = 'valid') AS valid, min(posted)::VARCHAR AS first_posted, max(posted)::VARCHAR AS last_posted, round(avg(skill_count), 4) AS mean_skills FROM h")
def eda_summary(spark, sf_dir):
    return explore.summary(_frame(spark, sf_dir))


@query(f"WITH {_FRAME} SELECT status, coalesce(language, 'none') AS language, count(*) AS n FROM h GROUP BY 1, 2")
def eda_status_language(spark, sf_dir):
    return explore.by_status_language(_frame(spark, sf_dir))


def _ladder_sql(c: str, steps: list[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(coalesce({c}, ''), '(?i){p}') THEN '{n}'" for n, p in steps) + f" ELSE '{otherwise}' END"


@query(f"WITH {_FRAME} SELECT status, {_ladder_sql('raw_job_title', T.TITLE_GROUPS, T.NO_GROUP)} AS title_group, count(*) AS n, quantile_cont(n_chars, 0.5)::DOUBLE AS median_chars, quantile_cont(skill_count, 0.5)::DOUBLE AS median_skills, round(avg(skill_count), 3) AS mean_skills FROM h GROUP BY 1, 2")
def eda_title_groups(spark, sf_dir):
    return explore.by_group(_frame(spark, sf_dir))


@query(f"SELECT {_ladder_sql('raw_job_title', T.SENIORITY, T.NO_LEVEL)} AS seniority, count(*) AS n FROM jobs_clean GROUP BY 1")
def eda_seniority(spark, sf_dir):
    return explore.by_seniority(_frame(spark, sf_dir))


@query("SELECT company, count(*) AS n FROM jobs_clean WHERE company IS NOT NULL GROUP BY 1 ORDER BY n DESC, company LIMIT 30")
def eda_top_companies(spark, sf_dir):
    return explore.top_companies(_t(spark, sf_dir, "jobs_clean"))


@query("SELECT date_trunc('week', try_cast(posted_date AS DATE))::DATE::VARCHAR AS week, " + ", ".join(f"count(*) FILTER (parser_version = '{v}') AS \"{v}\"" for v in ("v0.1", "v0.2", "v0.3")) + " FROM jobs_clean WHERE try_cast(posted_date AS DATE) IS NOT NULL GROUP BY 1")
def eda_weekly(spark, sf_dir):
    return explore.weekly(_frame(spark, sf_dir), "parser_version", ["v0.1", "v0.2", "v0.3"])


@query(f"SELECT source, {TITLE}, count(*) AS n FROM jobs_clean WHERE source IS NOT NULL AND {TITLE} IS NOT NULL GROUP BY 1, 2")
def eda_crosstab(spark, sf_dir):
    return explore.crosstab(_t(spark, sf_dir, "jobs_clean"), "source", TITLE)


@query()
def pages_rendered(spark, sf_dir):
    return _t(spark, sf_dir, "jobs_raw").select("raw_id", pages.rendered(F.col("job_description")).alias("text"))


def _pages(spark, sf_dir) -> DataFrame:
    """Pages made of the postings, as they might have been fetched: some refused, some broken off, some without a title."""
    raw, esc = _t(spark, sf_dir, "jobs_raw"), lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    ld = F.to_json(F.struct(F.lit("JobPosting").alias("@type"), F.struct("company").withField("name", F.col("company")).dropFields("company").alias("hiringOrganization")))
    ld = F.replace(ld, F.lit("<"), F.lit("\\u003c"))
    html = F.concat(F.lit('<html><head><script type="application/ld+json">'), ld, F.lit("</script></head><body><h1>"), esc(F.col("raw_job_title")), F.lit("</h1></body></html>"))
    code = F.when(F.col("raw_id") % 11 == 0, 404).when(F.col("raw_id") % 13 == 0, 403).otherwise(200)
    return raw.select("raw_id", F.concat(F.lit("https://pages.example/"), F.col("raw_id")).alias("url"), html.alias("html"), code.alias("code"))


@query("WITH x AS (SELECT raw_id, trim(regexp_replace(coalesce(raw_job_title, ''), '[\\s\\p{Z}\\x1c-\\x1f\\x0b\\x{85}]+', ' ', 'g')) AS t FROM jobs_raw) SELECT 'https://pages.example/' || raw_id AS source_url, CASE WHEN raw_id % 11 = 0 THEN 'HTTP_ERROR' WHEN raw_id % 13 = 0 THEN 'ACCESS_BLOCKED' WHEN t = '' THEN 'VALIDATION_ERROR' ELSE 'SUCCESS' END AS status, CASE WHEN raw_id % 11 = 0 THEN 404 WHEN raw_id % 13 = 0 THEN 403 ELSE 200 END AS http_status FROM x")
def pages_log(spark, sf_dir):
    """The crawl log of such pages."""
    return pages.crawl_log(pages.details(_pages(spark, sf_dir), code="code")).select("source_url", "status", "http_status")


@query("SELECT 'https://pages.example/' || raw_id AS source_url, company FROM jobs_raw WHERE raw_id % 11 <> 0 AND raw_id % 13 <> 0")
def pages_details(spark, sf_dir):
    """What is read from their JSON-LD."""
    return pages.details(_pages(spark, sf_dir), code="code").filter("status IN ('SUCCESS', 'VALIDATION_ERROR')").select("source_url", "company")


# ---- clustering -----------------------------------------------------------------------------------------------------


def _vectors(spark, sf_dir) -> DataFrame:
    """The 0/1 vectors of the eligible postings over the skills that stand in three of them at least."""
    e = _ok(spark, sf_dir).filter(F.col(SKILLS).isNotNull()).select("job_id", SKILLS)
    words = [r[0] for r in small(basket.at_least(basket.basket(e), 3).select("skill").distinct().orderBy("skill"))]
    return settle(cluster.skill_vectors(e, "job_id", SKILLS, words))


@query()
def rq4_assignment(spark, sf_dir):
    data = _vectors(spark, sf_dir)
    return cluster.fit(data, 8).transform(data).select(F.col("id").alias("job_id"), F.col("prediction").alias("cluster"))


@query()
def rq4_title_crosstab(spark, sf_dir):
    """Titles against clusters, which were made without them."""
    rows = rq4_assignment(spark, sf_dir).join(_ok(spark, sf_dir).select("job_id", TITLE), "job_id")
    return explore.crosstab(rows, "cluster", TITLE)


@query()
def rq4_k_sweep(spark, sf_dir):
    table, _ = cluster.sweep(_vectors(spark, sf_dir), list(cluster.KS))
    return spark.createDataFrame(table)


@query()
def rq4_exemplars(spark, sf_dir):
    data = _vectors(spark, sf_dir)
    return cluster.exemplars(cluster.fit(data, 8).transform(data))


@query()
def rq4_coordinates(spark, sf_dir):
    return cluster.coordinates(_vectors(spark, sf_dir))


@query("WITH e AS (SELECT vec_id, label AS c, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT c, i, avg(x) AS m FROM e GROUP BY 1, 2), d AS (SELECT e.c, vec_id, sqrt(sum((x - m) * (x - m))) AS d FROM e JOIN m ON m.c = e.c AND m.i = e.i GROUP BY 1, 2), s AS (SELECT c, avg(d) AS s FROM d GROUP BY 1), g AS (SELECT a.c AS a, b.c AS b, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS g FROM m a JOIN m b ON a.i = b.i AND a.c <> b.c GROUP BY 1, 2), w AS (SELECT a, max((x.s + y.s) / greatest(g, 1e-12)) AS w FROM g JOIN s x ON x.c = a JOIN s y ON y.c = b GROUP BY 1) SELECT round(avg(w), 6) AS davies_bouldin FROM w")
def rq4_davies_bouldin(spark, sf_dir):
    value = cluster.davies_bouldin(_t(spark, sf_dir, "embeddings").select("label", "embedding"), "label", "embedding")
    return spark.createDataFrame([(round(value, 6),)], "davies_bouldin double")


@query(f"WITH {_OK}, p AS (SELECT source AS cluster, {SKILLS} AS s FROM e WHERE {SKILLS} IS NOT NULL AND source IS NOT NULL), n AS (SELECT cluster, count(*) AS n_jobs FROM p GROUP BY 1), k AS (SELECT cluster, skill, count(*) AS c FROM (SELECT cluster, unnest(list_distinct(s)) AS skill FROM p) WHERE skill IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY c DESC, skill) AS r FROM k QUALIFY r <= 5) SELECT cluster, any_value(n_jobs) AS n_jobs, string_agg(skill, ', ' ORDER BY r) AS top_skills FROM n LEFT JOIN r USING (cluster) GROUP BY 1")
def rq4_cluster_profiles(spark, sf_dir):
    return cluster.profiles(_ok(spark, sf_dir).filter(F.col(SKILLS).isNotNull() & F.col("source").isNotNull()), "source", SKILLS)


@query(f"WITH k AS (SELECT source AS cluster, {TITLE} AS t, count(*) AS c FROM jobs_clean WHERE source IS NOT NULL AND {TITLE} IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY c DESC, t) AS r FROM k QUALIFY r <= 3) SELECT cluster, string_agg(t, ', ' ORDER BY r) AS titles FROM r GROUP BY 1")
def rq4_clusters_with_titles(spark, sf_dir):
    return cluster.top_titles(_t(spark, sf_dir, "jobs_clean").filter(F.col("source").isNotNull()), "source", TITLE)


@query()
def rq4_methods(spark, sf_dir):
    e = _ok(spark, sf_dir).filter(F.col(SKILLS).isNotNull())
    words = [r[0] for r in small(_t(spark, sf_dir, "skills_taxonomy").select("canonical_name").orderBy("canonical_name"))]
    return cluster.compare_methods(e, "job_id", SKILLS, 6, TITLE, words)


@query()
def rq3_title_order(spark, sf_dir):
    return cluster.title_order(rq3_title_similarity(spark, sf_dir))


_SH = r"""x AS (SELECT job_id AS k, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1)::BIGINT + 1), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM (SELECT job_id, list_filter(regexp_split_to_array(lower(regexp_replace(coalesce(job_description, ''), '[^\p{L}\p{N}_]+', ' ', 'g')), ' '), lambda z: z <> '') AS w FROM jobs_clean) WHERE len(w) > 0),
    r AS (SELECT s, min(k) AS k FROM (SELECT k, list_sort(s) AS s FROM x) GROUP BY 1)"""


@query(f"WITH {_SH}, e AS (SELECT k, len(s) AS n, unnest(s) AS h FROM r), p AS (SELECT a.k AS a, b.k AS b, count(*) AS c, any_value(a.n) AS m, any_value(b.n) AS n FROM e a JOIN e b ON a.h = b.h AND a.k < b.k GROUP BY 1, 2) SELECT a, b, round(c / (m + n - c)::DOUBLE, 6) AS jaccard FROM p WHERE c / (m + n - c)::DOUBLE >= 0.8")
def dup_shingle_pairs(spark, sf_dir):
    return duplicates.shingle_pairs(_t(spark, sf_dir, "jobs_clean"), "job_id", "job_description").select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query(f"WITH {_SH} SELECT x.k AS job_id, r.k AS representative, len(x.s)::INT AS n_shingles FROM x JOIN r ON r.s = list_sort(x.s)")
def dup_shingle_classes(spark, sf_dir):
    return duplicates.shingle_classes(_t(spark, sf_dir, "jobs_clean"), "job_id", "job_description")


@query(f"WITH {_near_sql(True)} SELECT a, b, round(cosine, 6) AS cosine, alone FROM o")
def dup_near_text_alone(spark, sf_dir):
    return duplicates.near(_t(spark, sf_dir, "jobs_clean"), text_alone=True).select("a", "b", F.round("cosine", 6).alias("cosine"), "alone")


_RUNS = r"list_distinct(list_transform(range(1, greatest(len(w) - 4, 1)::BIGINT + 1), lambda i: array_to_string(w[i:i+4], ' ')))"
_WORDS = r"list_filter(regexp_split_to_array(lower(regexp_replace(coalesce(t, ''), '[^\p{L}\p{N}_]+', ' ', 'g')), ' '), lambda z: z <> '')"


def _like_sql(texts: str, least: float) -> str:
    """j (a, b): texts of the table texts (k, t), a < b, whose runs of five words are `least` alike."""
    return f"""x AS (SELECT k, {_RUNS} AS s FROM (SELECT k, {_WORDS} AS w FROM {texts}) WHERE len(w) > 0), h AS (SELECT k, len(s) AS n, unnest(s) AS h FROM x),
    j AS (SELECT a.k AS a, b.k AS b FROM h a JOIN h b ON a.h = b.h AND a.k < b.k GROUP BY 1, 2, a.n, b.n HAVING count(*) >= {least} * (a.n + b.n - count(*)))"""


_KNOWN = "known AS (SELECT job_id, source_url, source_job_id, job_description FROM gold_jobs QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY crawl_timestamp, annotated_by) = 1)"


@query(
    f"""WITH {_KNOWN}, y AS (SELECT '0:' || job_id AS k, job_description AS t FROM known UNION ALL SELECT '1:' || job_id AS k, job_description AS t FROM jobs_clean), {_like_sql("y", 0.5)}
    SELECT job_id, 'id' AS reason FROM jobs_clean WHERE NOT {_MISS("job_id")} AND job_id IN (SELECT job_id FROM known)
    UNION ALL SELECT job_id, 'address' AS reason FROM jobs_clean WHERE NOT {_MISS("source_url")} AND source_url IN (SELECT source_url FROM known)
    UNION ALL SELECT job_id, 'source id' AS reason FROM jobs_clean WHERE NOT {_MISS("source_job_id")} AND source_job_id IN (SELECT source_job_id FROM known)
    UNION ALL SELECT DISTINCT substr(b, 3) AS job_id, 'text' AS reason FROM j WHERE b LIKE '1:%'"""
)
def gold_independence(spark, sf_dir):
    gold = _t(spark, sf_dir, "gold_jobs").dropDuplicates(["job_id"])
    return duplicates.not_independent(_t(spark, sf_dir, "jobs_clean"), gold, "job_id", "source_url", "source_job_id", "job_description")


@query(
    f"""WITH {_KNOWN}, fit AS (SELECT *, '1:' || lpad(length(job_description)::VARCHAR, 9, '0') || ':' || job_id AS k FROM jobs_clean WHERE regexp_matches(raw_job_title, '(?i)(^|[^\\p{{L}}\\p{{N}}_])(data|analyst|analytics)($|[^\\p{{L}}\\p{{N}}_])') AND length(job_description) >= 150 AND job_id NOT IN (SELECT job_id FROM known) AND (source_url IS NULL OR source_url NOT IN (SELECT source_url FROM known WHERE source_url IS NOT NULL))),
    y AS (SELECT '0:' || job_id AS k, job_description AS t FROM known UNION ALL SELECT k, job_description AS t FROM fit), {_like_sql("y", 0.5)},
    n AS (SELECT b, list(a) AS n FROM j GROUP BY 1), f AS (SELECT list_reduce(list(struct_pack(k := b, n := n, gone := []::VARCHAR[]) ORDER BY b), lambda x, y: struct_pack(k := y.k, n := y.n, gone := CASE WHEN len(list_filter(y.n, lambda z: NOT list_contains(x.gone, z))) > 0 THEN list_append(x.gone, y.k) ELSE x.gone END), struct_pack(k := '', n := []::VARCHAR[], gone := []::VARCHAR[])) AS s FROM n)
    SELECT job_id, raw_job_title FROM fit WHERE k NOT IN (SELECT unnest(s.gone) FROM f) ORDER BY k LIMIT 50"""
)
def gold_candidates(spark, sf_dir):
    known = _t(spark, sf_dir, "gold_jobs").select("job_id", "source_url", "job_description").dropDuplicates(["job_id"])
    return agreement.gold_candidates(_t(spark, sf_dir, "jobs_clean"), known, r"(?iuU)\b(data|analyst|analytics)\b").select("job_id", "raw_job_title")


@query("WITH s AS (SELECT job_id FROM jobs_clean ORDER BY sha256('sample-v1:' || job_id), job_id LIMIT 300), r AS (SELECT job_id, row_number() OVER (ORDER BY sha256('order-sample-v1:' || job_id), job_id) AS r FROM s) SELECT job_id, CASE WHEN r <= 60 THEN 'K' ELSE 'B' || ceil((r - 60) / 48.0)::INT END AS batch FROM r")
def role_batches(spark, sf_dir):
    return agreement.batched_sample(_t(spark, sf_dir, "jobs_clean").select("job_id"), "job_id", 300, 60, 5, "sample-v1:")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
