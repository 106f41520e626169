"""The general operators against hand-made examples and brute force."""

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobweave import catalog
from jobweave.functions import text as T
from jobweave.operators import agreement, basket, cleaning, cluster, concentration, duplicates, graph, matcher, pages, profile, quality, titles
from jobweave.plans import runner
from jobweave.sources import readers
from jobweave.sources.schema import FIELDS, POSTING, ContractError, conform, require_columns
from jobweave.sources.synthetic import generate


def posting(**values):
    row = dict.fromkeys(FIELDS) | {"job_id": "a", "source": "s", "source_url": "https://x/1", "crawl_timestamp": "2025-01-01T00:00:00+00:00", "parser_version": "v1", "raw_job_title": "Data Engineer", "company": "C", "raw_location": "P", "raw_experience": "1 year", "job_description": "d" * 40, "job_requirements": "r" * 40}
    return tuple((row | values)[f] for f in FIELDS)


def one(df, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()]


def test_text(spark):
    df = spark.createDataFrame([("  A　 B ",), ("",), (None,)], "s string")
    assert one(df.select(T.squeeze(F.col("s")).alias("x")), "x") == ["A B", "", None]
    assert one(df.select(T.title_key(F.col("s")).alias("x")), "x") == ["a b", None, None]
    assert one(df.select(T.nfkc(F.col("s")).alias("x")), "x") == ["  A  B ", "", None]
    assert one(spark.createDataFrame([("Kỹ sư Dữ liệu",)], "s string").select(T.slug(F.col("s")).alias("x")), "x") == ["ky-su-du-lieu"]
    langs = spark.createDataFrame([("Kỹ sư dữ liệu",), ("data engineer",), ("123",)], "s string")
    assert one(langs.select(T.language_of(F.col("s")).alias("x")), "x") == ["vi", "en", None]


def test_conform(spark):
    df = spark.createDataFrame([("a", "")], "job_id string, old string")
    assert conform(df, ("old",)).columns == FIELDS
    with pytest.raises(ContractError):
        conform(df)
    with pytest.raises(ContractError):
        conform(spark.createDataFrame([("a", "x")], "job_id string, old string"), ("old",))
    with pytest.raises(ContractError):
        require_columns(df, ["nope"])


def test_readers(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('﻿{"job_id": "1", "extracted_skills": ["A", null]}\n\n{"job_id": "2"}\n', encoding="utf-8")
    assert one(readers.read_jobs(spark, str(p)).orderBy("job_id"), "job_id") == ["1", "2"]
    p.write_text('{"job_id": "1"}\n{"job_id": "1"}\n')
    with pytest.raises(ContractError):
        readers.read_jobs(spark, str(p))
    p.write_text("[1]\n")
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(p)).collect()
    t = tmp_path / "t.csv"
    t.write_text("﻿skill_id,canonical_name,abbreviation,aliases,skill_group,observed_count\nS1,Python,,py; python3,L,1\n", encoding="utf-8")
    tax = readers.read_taxonomy(spark, str(t))
    assert sorted(one(readers.tech_terms(tax, ("x",)), "term")) == ["py", "python", "python3", "x"]
    t.write_text("a,b\n")
    with pytest.raises(ContractError):
        readers.read_taxonomy(spark, str(t))


def test_matrix(spark):
    df = spark.createDataFrame([("1", True, "1", 0.0), ("2", False, "0", 1.0)], "jd_id string, s_001 boolean, s_002 string, s_003 double")
    names = spark.createDataFrame([("s_001", "A")], "code string, name string")
    assert sorted(one(readers.matrix_basket(df, names), "job_id", "skill")) == [("1", "A"), ("1", "s_002"), ("2", "s_003")]
    with pytest.raises(ContractError):
        readers.matrix_basket(spark.createDataFrame([("1", 1.9)], "job_id string, x double"))


@pytest.mark.parametrize(
    ("change", "flags"),
    [
        ({}, []),
        ({"raw_job_title": "　 "}, ["MISSING_TITLE"]),
        ({"source_url": "ftp://x", "company": None}, ["INVALID_URL"]),
        ({"company": " ", "job_requirements": ""}, ["MISSING_COMPANY", "MISSING_JOB_REQUIREMENTS"]),
        ({"job_description": "x", "job_requirements": "y"}, ["SCRAPE_FAILED"]),
        ({"raw_job_title": "404 Page not found"}, ["SCRAPE_ERROR_CONTENT"]),
    ],
)
def test_record_flags(spark, change, flags):
    df = spark.createDataFrame([posting(**change)], POSTING)
    assert one(df.select(cleaning.record_flags().alias("f")), "f") == [flags]


def test_locations_and_gates(spark):
    rules = [("hải lâm|hai lam", "Hải Lâm"), ("remote", "Remote")]
    df = spark.createDataFrame([("HẢI LÂM, remote",), ("hai lam/Hải Lâm",), ("Not Available",), ("nowhere",), (None,), ("remote, not available",)], "raw_location string")
    got = one(df.select(cleaning.location_of(F.col("raw_location"), rules).alias("p")).select("p.*"), "value", "flags")
    assert got == [("Nhiều địa điểm", ["MULTI_LOCATION"]), ("Hải Lâm", []), (None, ["MISSING_LOCATION"]), (None, ["LOCATION_UNRECOGNIZED"]), (None, ["MISSING_LOCATION"]), ("Remote", ["MISSING_LOCATION"])]
    rows = [posting(job_id=str(i)) for i in range(10)]
    full = spark.createDataFrame(rows, POSTING)
    assert cleaning.gates(full)["no_text"] == 0
    assert cleaning.flagged(full, rules).count() == 10
    with pytest.raises(ContractError):
        cleaning.gates(spark.createDataFrame([posting(), posting(job_description=None, job_requirements=" ")], POSTING))
    assert cleaning.clean_counts(full).first()["n_out_of_scope"] == 10


def test_titles(spark):
    cases = catalog.TITLE_CASES
    df = spark.createDataFrame([(i, r) for i, (r, _, _) in enumerate(cases)], "n int, t string")
    got = {r["n"]: r["x"] for r in df.select("n", titles.normal_title(F.col("t"), [p for p, _ in catalog.TITLE_PLACES], catalog.TITLE_TOOLS).alias("x")).collect()}
    assert [(got[i]["title"], ",".join(got[i]["flags"])) for i in range(len(cases))] == [(t, f) for _, t, f in cases]


def test_titles_without_lists(spark):
    df = spark.createDataFrame([("Data Engineer - Spark, Hà Nội",)], "t string")
    assert one(df.select(titles.normal_title(F.col("t")).alias("x")), "x") == [("Data Engineer - Spark, Hà Nội", [])]
    assert df.limit(0).select(titles.normal_title(F.col("t"))).count() == 0


def test_segments(spark):
    texts = ["a - b, c", "a (b, c), d", "a (b (c), d) | e", "a) - b", "(a - b", "", "x,y-z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [[x["text"] for x in r["s"]] for r in df.select("i", titles.segments(F.col("t")).alias("s")).orderBy("i").collect()]
    assert got == [["a", "b", "c"], ["a (b, c)", "d"], ["a (b (c), d)", "e"], ["a) - b"], ["(a - b"], [""], ["x,y-z"]]


def test_exact_and_combined(spark):
    rows = [("1", " https://x ", "2025-01-02T00:00:00+00:00"), ("2", "https://x", "2025-01-01T20:00:00+00:00"), ("3", "", "2025-01-01"), ("4", None, None), ("5", "https://x", None)]
    df = spark.createDataFrame(rows, "job_id string, source_url string, crawl_timestamp string")
    assert sorted(one(duplicates.exact(df), "job_id", "canonical")) == [("1", "2"), ("5", "2")]
    got = duplicates.combine(df.withColumn("source_url", F.trim("source_url")), "2025-01-02", "2025-01-02")
    assert one(got, "job_id") == ["2"]  # 3 a.m. of the next day there
    assert duplicates.exact(df.limit(0)).count() == 0


def test_near_and_greedy(spark):
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [("1", "C", "Data Engineer", None, long), ("2", " c ", "Data Engineer", None, long + " extra"), ("3", "C", "Data Engineer", "X", long), ("4", "D", "Data Engineer", None, long), ("5", "C", "Cook", None, long), ("6", "C", None, None, long), ("7", "C", "Data Engineer", None, "wholly other words here")]
    df = spark.createDataFrame(rows, "job_id string, company string, normalized_job_title string, normalized_location string, job_description string")
    assert one(duplicates.near(df), "a", "b") == [("1", "2")]
    assert duplicates.near(df.limit(0)).count() == duplicates.repeats(df.limit(0)).count() == 0
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long")
    assert sorted(one(duplicates.greedy(e), "b", "a")) == [(2, 1), (4, 3)]


def test_near_flags(spark):
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    rows = [
        ("1", "C", "Data Engineer", None, long), ("2", "C", "Senior Data Engineer", None, long), ("3", "C", "Cook", "X", long), ("4", "C", None, None, long), ("5", "C", "Data Engineer", None, long),
        ("6", "E", "Data Engineer", None, None), ("7", "E", "Data Engineer", None, None), ("8", "E", "Data Engineer", None, "!"), ("9", "E", "Data Engineer", None, "!"),
        ("a", "F", "データ", "P", long), ("b", "F", "分析", "P", long), ("c", None, "Data Engineer", None, long), ("d", " ", "Data Engineer", None, long),
    ]
    df = spark.createDataFrame(rows, "job_id string, company string, normalized_job_title string, normalized_location string, job_description string").withColumn("k", F.lit("clash")).withColumn("a", F.lit("clash"))
    got = {r[0]: (r[1], list(r[2])) for r in duplicates.repeats(df).collect()}
    # Texts without tokens are like none; titles without tokens are like each other; a blank company is none.
    assert got == {"2": ("1", ["DUPLICATE_NEAR", "SENIORITY_VARIANT"]), "5": ("1", ["DUPLICATE_NEAR"]), "b": ("a", ["DUPLICATE_NEAR"])}
    alone = {r[0]: (r[1], list(r[2])) for r in duplicates.repeats(df, text_alone=True).collect()}
    assert alone == got | {"3": ("1", ["DUPLICATE_NEAR", "HIGH_CONF_JD_ONLY"]), "4": ("1", ["DUPLICATE_NEAR", "HIGH_CONF_JD_ONLY"])}
    # Rows that are out already take no part, but count for the tokens' weights.
    assert {r[0]: r[1] for r in duplicates.repeats(df, without=df.filter("job_id = '1'").select("job_id")).collect()} == {"5": "2", "b": "a"}


def test_association(spark):
    df = spark.createDataFrame([(str(i), ["A", "B", "A", None]) for i in range(6)], "job_id string, extracted_skills array<string>")
    assert one(basket.association(df), "joint", "npmi", "lift", "jaccard") == [(6, 1.0, 1.0, 1.0)]
    r = np.random.default_rng(1)
    rows = [(str(i), [s for s in "ABCDEF" if r.random() < 0.4]) for i in range(80)]
    df = spark.createDataFrame(rows, "job_id string, extracted_skills array<string>")
    got = {(a, b): (j, n) for a, b, j, n in one(basket.association(df), "skill_a", "skill_b", "joint", "npmi")}
    for a, b in itertools.combinations("ABCDEF", 2):
        j = sum(a in s and b in s for _, s in rows)
        if j >= 5:
            pa, pb = (sum(x in s for _, s in rows) / 80 for x in (a, b))
            assert got[a, b] == (j, pytest.approx(math.log(j / 80 / pa / pb) / -math.log(j / 80), abs=6e-4))


def test_communities(spark):
    assert graph.greedy_modularity(list("abcdz"), [("a", "b", 1.0), ("c", "d", 1.0), ("b", "c", 0.05)]) == [{"a", "b"}, {"c", "d"}, {"z"}]


def test_dispersion(spark):
    r = np.random.default_rng(2)
    rows = [(str(i), "t" if i < 30 else "u", [s for s in "ABCDEFG" if r.random() < 0.4]) for i in range(40)] + [("x", None, ["A"]), ("y", "v", ["A"])]
    df = spark.createDataFrame(rows, "k string, g string, s array<string>")
    got = dict(one(profile.dispersion(df, "g", "k", "s"), "title", "dispersion"))
    assert set(got) == {"t", "u"}
    for g in got:
        sets = [set(s) for _, t, s in rows if t == g]
        like = [len(a & b) / len(a | b) if a | b else 0 for a, b in itertools.combinations(sets, 2)]
        assert got[g] == pytest.approx(1 - np.mean(like), abs=1e-4)
    base = profile.baseline(df, "k", "s", profile.dispersion(df, "g", "k", "s"), rounds=50).collect()
    assert {b["n_postings"] for b in base} == {10, 30} and all(b["baseline_p5"] <= b["baseline_mean"] <= b["baseline_p95"] for b in base)


def test_baseline_draws_whole_groups(spark):
    r = np.random.default_rng(3)
    rows = [(str(i), [s for s in "ABCDEFG" if r.random() < 0.4]) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, s array<string>")
    sets = [set(s) for _, s in rows]
    exact = 1 - np.mean([len(a & b) / len(a | b) if a | b else 0 for a, b in itertools.combinations(sets, 2)])
    sizes = spark.createDataFrame([(300,), (290,), (20,)], "n_postings long")
    got = {b["n_postings"]: b for b in profile.baseline(df, "k", "s", sizes, rounds=60).collect()}
    # A group of all postings is always the same; one of nearly all hardly varies.
    assert got[300]["baseline_p5"] == got[300]["baseline_p95"] == got[300]["baseline_mean"] == pytest.approx(exact, abs=1e-4)
    assert got[290]["baseline_p95"] - got[290]["baseline_p5"] < 0.01 < got[20]["baseline_p95"] - got[20]["baseline_p5"]


def test_titles_summary(spark):
    rows = [("Data Eng ", "DE", "X"), ("data eng", "DE", "Y"), ("BA", "BA", "X"), ("Cook", "DE", "Z"), ("DE", "Chef", "X")]
    df = spark.createDataFrame(rows, "raw_job_title string, normalized_job_title string, company string")
    got = dict(one(concentration.title_summary(df), "metric", "value"))
    assert (got["n_postings"], got["distinct_raw_titles"], got["distinct_normalized_titles"], got["compression_ratio"], got["top1_share"], got["rare_titles"]) == (5, 4, 3, 0.75, 0.6, 2)


TAXONOMY = [{"skill_id": f"S{i}", "canonical_name": n, "abbreviation": a, "aliases": x} for i, (n, a, x) in enumerate([("SQL", None, None), ("SQL Server", None, "MSSQL"), ("C", None, None), ("R", None, None), ("Go", None, "Golang"), ("Computer Vision", "CV", None), ("Machine Learning", "ML", "máy học")])]


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("SQL server and sql", ["SQL", "SQL Server"]),
        ("only SQL  Server", ["SQL Server"]),
        ("C++ and C# and R&D", []),
        ("C, R", ["C", "R"]),
        ("go to golang", ["Go"]),
        ("send your CV", []),
        ("CV with OpenCV", ["Computer Vision"]),
        ("ml and ＭＬ", ["Machine Learning"]),
        ("ăsql sqlă MYSQL", []),
        ("Máy  học", ["Machine Learning"]),
        ("", []),
    ],
)
def test_matcher(text, names):
    assert [m[1] for m in matcher.Matcher(TAXONOMY).matches(text)] == names


def test_extract(spark):
    tax = spark.createDataFrame([(t["skill_id"], t["canonical_name"], t["abbreviation"], t["aliases"]) for t in TAXONOMY], "skill_id string, canonical_name string, abbreviation string, aliases string")
    df = spark.createDataFrame([("1", "SQL and Golang"), ("2", None)], "job_id string, t string")
    m = matcher.extract(df, "job_id", "t", tax)
    assert one(matcher.skill_lists(m).orderBy("job_id"), "extracted_skills", "skill_count") == [(["SQL", "Go"], 2), ([], 0)]
    assert one(matcher.skill_matrix(m, "job_id", ["S0", "S1"]).orderBy("job_id"), "S0", "S1") == [(1, 0), (0, 0)]
    assert m.filter("job_id = '1'").select(F.explode("matches").alias("m")).select("m.start", "m.end").collect()[0] == (0, 3)


def test_agreement(spark):
    g = spark.createDataFrame([("a", "Python"), ("a", "SQL")], "id string, label string")
    p = spark.createDataFrame([("a", "Python"), ("a", "Docker")], "id string, label string")
    assert one(agreement.micro(agreement.compare_labels(g, p)), "tp", "fp", "fn", "f1") == [(1, 1, 1, 0.5)]
    k = lambda rows: agreement.kappa(spark.createDataFrame(rows, "x string, y string"), "x", "y").first()["kappa"]
    assert (k([("a", "a")]), k([("a", "a"), ("a", "b"), ("b", "a"), ("b", "b")]), k([("a", "a"), ("a", "a"), ("b", "b"), ("b", "a")])) == (1.0, 0.0, 0.5)
    df = spark.createDataFrame([(1, 1), (1, 1), (2, 2), (2, 2), (None, 2)], "x int, y int")
    assert one(agreement.partition_agreement(df, "x", "y"), "n_compared", "ari", "nmi") == [(4, 1.0, 1.0)]
    long = spark.createDataFrame([("j", "p", "A"), ("j", "q", "A"), ("j", "q", "B")], "item string, person string, label string")
    assert one(agreement.merge_labels(long), "agreed", "disputed") == [("A", "B")]
    ids = spark.createDataFrame([("6d8a728e0459f4b4",)], "i string")
    assert one(ids.select(agreement.split_by_hash(F.col("i")).alias("s")), "s") == ["holdout"]


def test_submissions_without_labels(spark, tmp_path):
    from jobweave import catalog

    a = lambda *x: [(s,) for s in x]
    rows = [("j", "p", a("A")), ("j", "q", a("A")), ("j", "r", []), ("j", "s", None), ("k", "p", a("A", "B")), ("k", "q", a("A", "B")), ("m", "p", [])]
    spark.createDataFrame(rows, "job_id string, annotated_by string, annotations array<struct<skill_id: string>>").write.parquet(f"file://{tmp_path}/gold_jobs.parquet")
    q = {n: catalog.queries()[n](spark, f"file://{tmp_path}") for n in ("gold_merged", "gold_kappa", "gold_scores_by_skill")}
    assert sorted(one(q["gold_merged"], "item", "n_people", "agreed", "disputed")) == [("j", 4, "", "A"), ("k", 2, "A|B", ""), ("m", 1, "", "")]
    assert {(a, b): n for a, b, n in one(q["gold_kappa"], "a", "b", "n")} == {("p", "q"): 3, ("p", "r"): 1, ("p", "s"): 1, ("q", "r"): 1, ("q", "s"): 1, ("r", "s"): 1}
    assert sorted(one(q["gold_scores_by_skill"], "label", "tp", "fp")) == [("A", 1, 1), ("B", 1, 0)]
    said = spark.createDataFrame([("j", "p", "A")], "item string, person string, label string")
    people = spark.createDataFrame([("j", "p"), ("j", "q")], "item string, person string")
    assert one(agreement.pairwise_kappa(said, people), "a", "b", "n") == [("p", "q", 1)]


def test_clusters(spark):
    df = generate(spark, 400)
    words = sorted({s for r in df.collect() for s in r["extracted_skills"]})
    data = cluster.skill_vectors(df, "job_id", "extracted_skills", words)
    table, models = cluster.sweep(data, [3, 4, 5], starts=2, rounds=4)
    assert cluster.choose_k(table) == 4
    lab = models[4].transform(data).select(F.col("id").alias("job_id"), "prediction", "features").join(df, "job_id")
    assert agreement.partition_agreement(lab, "prediction", "true_family").first()["ari"] > 0.9
    assert cluster.exemplars(models[4].transform(data)).count() == 12
    h = cluster.hierarchical(df.limit(60), "job_id", "extracted_skills", 4).join(df, "job_id")
    assert agreement.partition_agreement(h, "cluster", "true_family").first()["ari"] > 0.7
    assert list(cluster.upgma(np.array([[0, 1, 9], [1, 0, 8], [9, 8, 0.0]]), 2)) == [0, 0, 1]
    assert cluster.coordinates(data).count() == 400


HTML = """<html><head><script type="application/ld+json">{"@graph": [{"@type": "JobPosting", "title": "Data Engineer", "datePosted": "2025-01-02T00:00", "identifier": {"value": 7}, "hiringOrganization": {"name": "ACME"}, "jobLocation": [{"address": {"addressRegion": "A"}}, {"address": {"addressRegion": "A"}}, {"address": {"addressRegion": "B"}}]}]}</script></head>
<body><h1>Other</h1><h2>Job description</h2><p>First  line<br>second</p><h2>Requirements</h2><ul><li>3+ years of experience</li></ul></body></html>"""


def test_pages(spark):
    row = pages.detail("https://x/1", HTML, "s", None, "v")
    assert (row["raw_job_title"], row["company"], row["raw_location"], row["posted_date"], row["source_job_id"]) == ("Data Engineer", "ACME", "A, B", "2025-01-02", "7")
    assert row["job_description"] == "First line\nsecond" and row["job_requirements"].startswith("3+ years") and row["raw_experience"] == "3+ years of experience"
    found, following = pages.listing('<div data-job-id="1"><a href="/a#x">One</a></div><div data-job-id="2"><a href="/a">One</a></div><a rel="next" href="?p=2">n</a>', "https://x/l")
    assert found == [("https://x/a", "One")] and following == "https://x/l?p=2"
    df = spark.createDataFrame([("https://x/1", HTML), ("https://x/2", ""), ("https://x/3", None)], "url string, html string")
    assert one(pages.details(df).orderBy("source_url"), "status") == ["SUCCESS", "VALIDATION_ERROR", "VALIDATION_ERROR"]
    assert pages.links(df).count() == 0
    b = spark.createDataFrame([(200, "fine"), (403, ""), (200, "Just a moment...")], "s int, h string")
    assert one(b.select(pages.blocked(F.col("s"), F.col("h")).alias("x")), "x") == [False, True, True]


def test_quality(spark):
    rows = [posting(job_id=f"j{i}", relevance_flag=True, duplicate_flag=False, normalized_job_title="DE", extracted_skills=["A", "B", "C"], skill_count=3, job_description=f"{i} " * 100, job_text=f"{i} " * 100) for i in range(40)]
    df = spark.createDataFrame(rows, POSTING)
    got = dict(one(quality.checks(df, df.select("job_id", "extracted_skills")), "check", "passed"))
    assert got == {"QC1": True, "QC2": True, "QC3": True, "QC4": True, "QC5": False, "QC6": True, "QC7": True, "QC8": True}
    assert quality.violations(df).count() == 0
    bad = spark.createDataFrame([posting(job_id=" ", posted_date="01/02/2025", skill_count=-1, relevance_flag=False)], POSTING)
    assert sorted(one(quality.violations(bad), "violation")) == ["bad_date", "blank_id", "exclusion_without_reason", "negative_count", "undecided"]
    other = df.withColumn("company", F.when(F.col("job_id") == "j1", "X").otherwise(F.col("company"))).filter("job_id <> 'j2'")
    assert sorted(one(quality.changed_fields(df, other), "job_id", "field")) == [("j1", "company"), ("j2", "missing")]


def stage_ok(ctx):
    (ctx.target / "a.json").write_text("{}")
    return {"status": "completed", "reason": None, "artifacts": ["a.json"]}


def stage_bad(ctx):
    next(iter(ctx.inputs.values())).write_text("changed")
    return stage_ok(ctx)


def test_runner(spark, tmp_path):
    (tmp_path / "in.txt").write_text("x")
    config = {"version": 1, "inputs": {"raw": "in.txt"}, "outputs": {"clean": "out/clean"}, "modules": {"clean": f"{__name__}:stage_ok"}}
    (tmp_path / "c.json").write_text(json.dumps(config))
    got = runner.run(spark, runner.Config.load(tmp_path / "c.json"), report=tmp_path / "r.json")
    assert got["status"] == "completed" and (tmp_path / "out/clean/a.json").exists()
    config["modules"]["clean"] = f"{__name__}:stage_bad"
    (tmp_path / "c.json").write_text(json.dumps(config))
    with pytest.raises(ContractError):
        runner.run(spark, runner.Config.load(tmp_path / "c.json"), report=tmp_path / "r.json")
    assert json.loads((tmp_path / "r.json").read_text())["status"] == "failed" and (tmp_path / "out/clean/a.json").exists()
    config["outputs"]["analysis"] = "out/clean/inner"
    (tmp_path / "c.json").write_text(json.dumps(config))
    with pytest.raises(ContractError):
        runner.Config.load(tmp_path / "c.json")
    runner.write_together({"t": spark.range(3).toDF("i")}, tmp_path / "pair")
    assert spark.read.parquet(f"file://{tmp_path}/pair/t").count() == 3


def test_stream(spark, tmp_path):
    from jobweave.streaming import rounds

    (tmp_path / "in").mkdir()
    lines = [dict.fromkeys(FIELDS) | {"job_id": str(i), "source": "s", "source_url": u, "crawl_timestamp": f"2025-01-0{i + 1}T00:00:00+00:00"} for i, u in enumerate(["https://a", "https://a", "https://b", ""])]
    (tmp_path / "in/1.json").write_text("\n".join(map(json.dumps, lines)))
    rounds.write(rounds.first_seen(rounds.read(spark, f"file://{tmp_path}/in")), f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()
    assert sorted(one(spark.read.parquet(f"file://{tmp_path}/out"), "source_url")) == ["https://a", "https://b"]


def test_shingle_pairs(spark):
    r = np.random.default_rng(4)
    words = [f"w{i}" for i in range(30)]
    base = [list(r.choice(words, 40)) for _ in range(12)]
    texts = [" ".join(b) for b in base]
    for b in base[:8]:
        c = list(b)
        c[int(r.integers(40))] = "zzz"
        texts += [" ".join(c), " ".join(b[:30])]
    data = [(f"k{i:02d}", t) for i, t in enumerate(texts)] + [("x1", texts[0].upper()), ("x2", ""), ("x3", None), ("x4", "two words"), ("x5", "Two  words!")]
    df = spark.createDataFrame(data, "k string, t string")
    for least in (0.5, 0.8):
        sets = {k: {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, t in data if t for w in [t.lower().replace("!", "").split()]}
        reps = {min(j for j in sets if sets[j] == s) for s in sets.values()}
        want = {(a, b) for a, b in itertools.combinations(sorted(reps), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least}
        assert set(one(duplicates.shingle_pairs(df, "k", "t", least), "a", "b")) == want and want
    got = dict(one(duplicates.shingle_classes(df, "k", "t"), "k", "representative"))
    assert got["x1"] == "k00" and got["x5"] == "x4" and "x2" not in got and "x3" not in got
    assert duplicates.shingle_pairs(df.limit(0), "k", "t").count() == 0


def test_independence_and_candidates(spark):
    long = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"else{i}" for i in range(60))
    schema = "job_id string, source_url string, source_job_id string, raw_job_title string, job_description string"
    known = spark.createDataFrame([("g1", "u1", "s1", "t", long)], schema)
    rows = [("a", "u1", "", "Data", other), ("b", "u2", None, "Data", long + " tail"), ("c", "u3", "s1", "Data", other + " more words"), ("d", "u4", None, "Data", " ".join(f"third{i}" for i in range(60))), ("e", "u5", None, "Cook", other)]
    new = spark.createDataFrame(rows, schema)
    got = set(one(duplicates.not_independent(new, known, "job_id", "source_url", "source_job_id", "job_description"), "job_id", "reason"))
    assert got == {("a", "address"), ("b", "text"), ("c", "source id"), ("c", "text"), ("e", "text")}
    assert one(agreement.gold_candidates(new, known, "(?i)data"), "job_id") == ["c", "d"]


def test_text_alone(spark):
    long = " ".join(f"word{i}" for i in range(40))
    df = spark.createDataFrame([("1", "C", "Data", "X", long), ("2", "C", "Cook", "Y", long + " word1"), ("3", "D", "Data", "X", long), ("4", "C", "Data", "X", "wholly different words")], "job_id string, company string, normalized_job_title string, normalized_location string, job_description string")
    assert one(duplicates.near(df), "a", "b") == []
    assert one(duplicates.near(df, text_alone=True), "a", "b") == [("1", "2")]


def test_text_alone_without_titles(spark):
    long = " ".join(f"word{i}" for i in range(40))
    rows = [("1", "C", "Data", "X", long), ("2", "C", None, "Y", long), ("3", "C", " ", "Z", long), ("4", "C", "Đỹ", "X", long), ("5", "C", None, "Y", long), ("6", " ", None, "Y", long), ("7", "C", None, "Y", None), ("8", "C", None, "Y", None)]
    df = spark.createDataFrame(rows, "job_id string, company string, normalized_job_title string, normalized_location string, job_description string")
    assert one(duplicates.near(df), "a", "b") == []
    assert set(one(duplicates.near(df, text_alone=True), "a", "b")) == {("1", "2"), ("1", "3"), ("1", "4"), ("2", "3"), ("2", "4"), ("3", "4")}
    member = dict(one(duplicates.near_classes(df, text_alone=True), "job_id", "representative"))
    assert member == {"1": "1", "2": "2", "3": "3", "4": "4", "5": "2"}


def test_whole_sweep_by_default(monkeypatch):
    import inspect

    from jobweave import catalog
    from jobweave.plans import stages

    assert (cluster.KS, cluster.STARTS, cluster.ROUNDS) == (tuple(range(2, 16)), 10, 100)
    for f in (cluster.fit, cluster.sweep, cluster.stability, cluster._lloyd):
        assert inspect.signature(f).parameters["starts"].default == 10, f
    seen = []
    monkeypatch.setattr(cluster, "sweep", lambda data, ks, starts=cluster.STARTS, rounds=cluster.ROUNDS: (seen.append((tuple(ks), starts, rounds)), 1 / 0))
    monkeypatch.setattr(catalog, "_vectors", lambda *_: None)
    for f in (lambda: catalog.queries()["rq4_k_sweep"](None, ""), lambda: stages._rq4(_Any(), {})):
        monkeypatch.setattr(stages, "settle", lambda df: df)
        for m, n in ((cluster, "skill_vectors"), (stages.basket, "basket"), (stages.basket, "at_least")):
            monkeypatch.setattr(m, n, lambda *_: _Any())
        monkeypatch.setattr(stages, "small", lambda *_: [])
        with pytest.raises(ZeroDivisionError):
            f()
    assert seen == [(tuple(range(2, 16)), 10, 100)] * 2


class _Any:
    def __getattr__(self, name):
        return lambda *_: 1000 if name == "count" else self


def test_stability_of_all_rows(spark, monkeypatch):
    df = generate(spark, 120)
    words = sorted({s for r in df.collect() for s in r["extracted_skills"]})
    data = cluster.skill_vectors(df, "job_id", "extracted_skills", words)
    monkeypatch.setattr(cluster, "STABILITY_ROWS", 3)  # of 3 rows no part has 4
    got = dict(one(cluster.stability(data, [4], 2, starts=3), "k", "stability"))
    monkeypatch.undo()
    assert got[4] > 0.8 and got[4] == pytest.approx(dict(one(cluster.stability(data, [4], 4), "k", "stability"))[4], abs=0.2)


def test_sweep_holds_many_rows_in_tasks(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(cluster, "_stability_spread", lambda *_: 1 / 0)  # a fit of Spark's for each start of each round
    monkeypatch.setattr(cluster, "fit", lambda *_: 1 / 0)
    bits = [F.when(F.col("id") % 3 == i // 3, F.col("id") % 7 != i).otherwise(F.xxhash64("id", F.lit(i)) % 50 == 0).cast("double") for i in range(9)]
    data = cluster.vectors(spark.range(21_000).select("id", F.array(*bits).alias("v")), "id", "v")
    table, models = cluster.sweep(data, [2, 3], starts=3, rounds=2)
    for k, s, db, steady in table.itertuples(index=False):
        labelled = models[k].transform(data)
        assert s == pytest.approx(cluster.silhouette(labelled), abs=1e-4) and db == pytest.approx(cluster.davies_bouldin(labelled), rel=1e-6)
    assert table.stability[1] > 0.99 and table.silhouette[1] > table.silhouette[0]


def test_fit_and_figures_over_distinct_vectors():
    r = np.random.default_rng(7)
    x = (r.random((70, 12)) < 0.25).astype(np.float32)
    x[3] = 0
    x = np.unique(x, axis=0)
    n = r.integers(1, 4, len(x))
    held = cluster._Vectors([np.concatenate([np.flatnonzero(y).astype(np.uint32), y[y != 0].view(np.uint32)]).tobytes() for y in x], n, 12)
    assert (held.dense()[:, :-1] == x).all()
    (label,), (centre,) = cluster._lloyd(held, held.dense(), held.rows[None], 4, r, 5, 50)
    whole, of = np.repeat(x, n, axis=0).astype(float), np.repeat(label, n)
    assert (((x[:, None] - centre[None]) ** 2).sum(2).argmin(1) == label).all()  # the nearest centre, each the mean of its rows
    assert np.allclose([whole[of == c].mean(0) for c in range(4)], centre)
    unit = whole / np.maximum(np.linalg.norm(whole, axis=1), 1e-12)[:, None]
    d = 1 - unit @ unit.T
    np.fill_diagonal(d, 0)
    want = []
    for i, c in enumerate(of):
        inner, outer = d[i, of == c].sum() / max((of == c).sum() - 1, 1), min(d[i, of == e].mean() for e in range(4) if e != c)
        want.append((outer - inner) / max(outer, inner) if (of == c).sum() > 1 else 0)
    assert cluster._figures(held, held.dense(), label, 4)[0] == pytest.approx(np.mean(want))


def test_review_and_batches(spark):
    labels = spark.createDataFrame([("j", "A", 0, 1), ("j", "B", 2, 3), ("j", "C", 4, 5), ("j", "D", 6, 7)], "item string, label string, start int, end int")
    d = spark.createDataFrame([("j", "A", "reject", None, None, None), ("j", "B", "replace", "X", 8, 9), ("j", "C", "fix", None, 3, 5), ("j", "D", "keep", None, None, None), ("j", "E", "add", None, 1, 2), ("j", "D", "add", None, 0, 1)], "item string, label string, action string, new_label string, start int, end int")
    assert sorted(one(agreement.reviewed(labels, d), "label", "start", "end")) == [("C", 3, 5), ("D", 0, 1), ("E", 1, 2), ("X", 8, 9)]
    ids = spark.createDataFrame([(f"{i}",) for i in range(100)], "job_id string")
    got = {r["batch"]: r["count"] for r in agreement.batched_sample(ids, "job_id", 50, 10, 4, "s:").groupBy("batch").count().collect()}
    assert got == {"K": 10, "B1": 10, "B2": 10, "B3": 10, "B4": 10}
    assert set(one(agreement.batched_sample(ids.repartition(5), "job_id", 50, 10, 4, "s:"), "job_id", "batch")) == set(one(agreement.batched_sample(ids, "job_id", 50, 10, 4, "s:"), "job_id", "batch"))


def test_methods(spark):
    df = generate(spark, 200)
    words = sorted({s for r in df.collect() for s in r["extracted_skills"]})
    got = {r["method"]: r for r in cluster.compare_methods(df, "job_id", "extracted_skills", 4, "normalized_job_title", words).collect()}
    assert got["kmeans"]["ari"] > 0.8 and got["average_linkage"]["k"] == 4
    p = profile.profiles(df, "normalized_job_title", "extracted_skills")
    assert sorted(one(cluster.title_order(profile.likeness(p)), "position")) == [0, 1, 2, 3]


def test_methods_of_all_postings(spark, monkeypatch):
    r = np.random.default_rng(4)
    p, size = r.random((60, 3)), r.integers(1, 4, 60)
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    whole = np.repeat(np.arange(60), size)
    for k in (1, 2, 5, 20):
        assert np.array_equal(cluster.average_linkage(d.copy(), size, k)[whole], cluster.upgma(d[np.ix_(whole, whole)], k)), k
    df = generate(spark, 200)
    df = df.union(df.withColumn("job_id", F.concat("job_id", F.lit("-2"))))
    words = sorted({s for x in df.collect() for s in x["extracted_skills"]})
    of = lambda: {x["method"]: x for x in cluster.compare_methods(df, "job_id", "extracted_skills", 4, "normalized_job_title", words).collect()}
    got = of()
    assert {x["n"] for x in got.values()} == {400} and got["average_linkage"]["largest_share"] <= 1 and got["kmeans"]["ari_between"] is not None
    monkeypatch.setattr(cluster, "LINKED", 50)
    got = of()
    assert (got["kmeans"]["n"], got["average_linkage"]["n"]) == (400, 50)


def test_evaluation(spark):
    gold = spark.createDataFrame([("a", "Python"), ("a", "SQL"), ("c", "R"), ("c", None)], "id string, label string").dropna()
    predicted = spark.createDataFrame([("a", "Python"), ("a", "Docker"), ("a", "Python")], "id string, label string")
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "id string").withColumn("label", F.lit("clash"))
    got = agreement.evaluation(gold, predicted, ids)
    whole = got["metrics"].filter("subset = 'all'").first()
    assert (whole["n_items"], whole["n_errors"], whole["tp"], whole["fp"], whole["fn"]) == (3, 2, 1, 1, 2) and whole["precision"] == 0.5
    assert sum(r["n_items"] for r in got["metrics"].filter("subset <> 'all'").collect()) == 3
    assert sorted(one(got["errors"], "id", "false_positives", "false_negatives")) == [("a", "Docker", "SQL"), ("c", "", "R")]
    assert sorted(one(got["predictions"], "id", "labels")) == [("a", "Docker|Python"), ("b", ""), ("c", "")]
    with pytest.raises(ValueError):
        agreement.evaluation(gold, predicted, ids.filter("id <> 'c'"))
    assert agreement.evaluation(gold.limit(0), predicted.limit(0), ids.limit(0))["metrics"].count() == 0


def test_choices(spark):
    rows = [("j1", "x", "DE"), ("j1", "y", "DE"), ("j2", "x", "DE"), ("j2", "y", "DA"), ("j3", "x", "DA"), ("j4", None, "DE"), ("j4", "x", None), ("j1", "x", "DE")]
    long = spark.createDataFrame(rows, "item string, person string, label string")
    got = {r["item"]: r for r in agreement.merge_choices(long).collect()}
    assert {k: (r["label"], r["status"], r["n_people"], r["people"]) for k, r in got.items()} == {"j1": ("DE", "agreed", 2, "x;y"), "j2": (None, "conflict", 2, "x;y"), "j3": ("DA", "single", 1, "x")}
    assert got["j2"]["choices"] == "x: DE | y: DA" and got["j1"]["choices"] is None
    decided = agreement.merge_choices(long, spark.createDataFrame([("j2", "DA")], "item string, label string")).filter("item = 'j2'").first()
    assert (decided["label"], decided["status"]) == ("DA", "adjudicated")
    assert one(agreement.choice_kappa(long), "a", "b", "shared", "agreement", "kappa") == [("x", "y", 2, 0.5, 0.0)]
    assert one(agreement.confused(long), "label_a", "label_b", "n") == [("DA", "DE", 1)]
    assert agreement.merge_choices(long.limit(0)).count() == agreement.choice_kappa(long.limit(0)).count() == 0


def test_dispersion_of_equal_sets(spark, monkeypatch):
    monkeypatch.setattr(profile, "BLOCK", 3)
    sets = [["A", "B"]] * 40 + [["A"]] * 7 + [[]] * 3 + [["B", "C", None, "C"]] * 5 + [[f"s{i}"] for i in range(10)]
    df = spark.createDataFrame([("t", str(i), s) for i, s in enumerate(sets)], "g string, k string, s array<string>")
    plain = [{x for x in s if x} for s in sets]
    like = [len(a & b) / len(a | b) if a | b else 0 for a, b in itertools.combinations(plain, 2)]
    assert one(profile.dispersion(df, "g", "k", "s"), "title", "n_postings", "dispersion") == [("t", len(sets), pytest.approx(1 - sum(like) / len(like), abs=1e-4))]


def test_contexts_are_whole_words(spark):
    tax = spark.createDataFrame([("2", "Computer Vision", "CV", None), ("1", "Python", None, None)], "skill_id string, canonical_name string, abbreviation string, aliases string")
    df = spark.createDataFrame([("a", "CV in vision modeling, Python"), ("b", "CV with image processing and python"), ("c", None)], "k string, t string")
    got = {r["k"]: [m["skill_id"] for m in r["matches"]] for r in matcher.extract(df, "k", "t", tax.coalesce(1)).collect()}
    assert got == {"a": ["1"], "b": ["2", "1"], "c": []}  # in the order of the taxonomy
    counts = matcher.recount(matcher.extract(df, "k", "t", tax))
    checked = spark.createDataFrame([("1", "2"), ("2", "4"), ("3", None)], "skill_id string, observed_count string")
    assert sorted(one(matcher.recount_differs(counts, checked), "skill_id", "observed", "counted")) == [("2", 4, 1), ("3", None, 0)]


def test_csv_in_parts(spark, tmp_path):
    df = spark.range(25_000).select("id", F.concat(F.lit('ô"'), "id").alias("s"))
    runner.write_csv(df, tmp_path / "x.csv")
    lines = (tmp_path / "x.csv").read_text(encoding="utf-8-sig").split("\n")
    assert lines[0] == "id,s" and lines[1] == '0,"ô""0"' and len(lines) == 25_002
    runner.write_csv(df.limit(0), tmp_path / "y.csv")
    assert (tmp_path / "y.csv").read_bytes() == b"\xef\xbb\xbfid,s\n"


def test_shared_folder(spark, monkeypatch):
    from jobweave.plans import staging

    df = staging.settle(spark.range(3))
    assert df.count() == 3 and df.inputFiles()[0].startswith(staging.shared_dir(spark).replace("///", "/").replace("file:/", "file:///"))
    staging.dropped(df)
    with pytest.raises(Exception):
        df.count()

    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077", "applicationId": "x"})

    with pytest.raises(ValueError):
        staging.shared_dir(Elsewhere)


def test_page_log_and_hints(spark):
    rows = [("u1", HTML, 200, "2025-01-01"), ("u2", "gone", 404, None), ("u3", "<title>Just a moment...</title>", 200, None), ("u4", "<p>no title</p>", 200, None), ("u5", None, None, None)]
    df = spark.createDataFrame(rows, "url string, html string, code int, at string").withColumn("status", F.lit("clash"))
    found = pages.details(df, code="code", at="at")
    assert dict(one(found, "source_url", "status")) == {"u1": "SUCCESS", "u2": "HTTP_ERROR", "u3": "ACCESS_BLOCKED", "u4": "VALIDATION_ERROR", "u5": "VALIDATION_ERROR"}
    log = {r["source_url"]: r for r in pages.crawl_log(found).collect()}
    assert (log["u1"]["error_type"], log["u1"]["crawl_timestamp"], log["u1"]["http_status"]) == (None, "2025-01-01", 200)
    assert (log["u2"]["error_type"], log["u2"]["error_message"]) == ("HTTP_ERROR", "HTTP 404")
    html = '<div id="a" class="x y"><p data-k="1">2 years</p><p>2 years</p><script>3 years</script></div>' + "<b>5 years</b>" * 20 + "<i>" + "9 years " * 40 + "</i>"
    got = one(pages.hints(spark.createDataFrame([("u", html)], "url string, html string"), {"experience": r"\d+ years"}).orderBy("rank"), "text", "path")
    assert got == [("2 years", "p[data-k] < div#a.x.y"), ("2 years", "p < div#a.x.y"), ("5 years", "b")]
    assert pages.details(df.limit(0)).count() == pages.hints(df.limit(0), {"x": "x"}).count() == 0


def test_matrix_against_lists(spark):
    names = spark.createDataFrame([("S1", "A"), ("S2", "B")], "skill_id string, canonical_name string")
    matrix = spark.createDataFrame([("a", 1, 0), ("b", 1, 1), ("c", 2, 0), ("d", 0, None), ("x", 0, 0)], "job_id string, S1 int, S2 int")
    lists = spark.createDataFrame([("a", ["A"]), ("b", ["A"]), ("c", ["A"]), ("d", None), ("y", [])], "job_id string, extracted_skills array<string>")
    assert sorted(one(quality.matrix_faults(matrix, lists, names), "job_id", "fault")) == [("b", "differs"), ("c", "cell"), ("d", "cell"), ("x", "extra"), ("y", "missing")]
    with pytest.raises(ValueError):
        quality.matrix_faults(matrix.withColumn("S9", F.lit(0)), lists, names)
    assert quality.matrix_faults(matrix.limit(0), lists.limit(0), names).count() == 0
    df = spark.createDataFrame([("t",)] * 5 + [(None,)], "normalized_job_title string")
    assert tuple(quality.title_check(df).first()) == (True, 1, 1, 5) and tuple(quality.title_check(df.limit(0)).first()) == (False, 0, 0, 0)


def test_like_sets_of_many_common_phrases(spark, monkeypatch):
    from jobweave.operators import alike

    r = np.random.default_rng(7)
    phrases = [[f"p{i}w{j}" for j in range(9)] for i in range(12)]
    texts = [[w for p in r.choice(12, 5, replace=False) for w in phrases[p]] + [f"own{i}x{j}" for j in range(int(r.integers(0, 12)))] for i in range(120)]
    texts += [t[: int(r.integers(1, len(t)))] for t in texts[:40]] + [t + ["ü", "Ω1"] for t in texts[:20]]
    data = [(f"k{i:03d}", " ".join(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "k string, t string")
    sets = {k: {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, t in data for w in [t.lower().split()]}
    reps = sorted({min(j for j in sets if sets[j] == s) for s in sets.values()})
    for least, local in ((0.5, True), (0.8, True), (0.5, False)):
        if not local:
            monkeypatch.setattr(alike, "_local", lambda _: None)
        want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(reps, 2)}
        want = {p: j for p, j in want.items() if j >= least}
        found = duplicates.shingle_pairs(df, "k", "t", least)
        assert {(a, b): j for a, b, j in one(found, "a", "b", "jaccard")} == want and want
        # The pairs are written before they are read; no plan over exploded runs of words is handed on.
        assert "Generate" not in found._jdf.queryExecution().toString() and "SortMergeJoin" not in found._jdf.queryExecution().toString()


def test_like_weights_of_blocks(spark, monkeypatch):
    from jobweave.operators import alike

    monkeypatch.setattr(alike, "BLOCK", 7)
    r = np.random.default_rng(3)
    base = [dict(zip(r.choice(60, 12, replace=False).tolist(), r.random(12) + 0.1)) for _ in range(20)]
    texts = base + [b | {99: 0.2 * i} for i, b in enumerate(base)]
    unit = [{t: v / sum(x * x for x in b.values()) ** 0.5 for t, v in b.items()} for b in texts]
    w = spark.createDataFrame([(f"k{i:02d}", f"t{t}", float(v)) for i, b in enumerate(unit) for t, v in b.items()], "k string, token string, w double")
    rows = spark.createDataFrame([(f"k{i:02d}", "C" if i != 3 else "D") for i in range(40)], "k string, co string")
    found = one(alike.like_weights(w, rows, 0.95), "a", "b")
    want = {(f"k{i:02d}", f"k{j:02d}") for i, j in itertools.combinations(range(40), 2) if 3 not in (i, j) and sum(v * unit[j].get(t, 0) for t, v in unit[i].items()) >= 0.95}
    assert want <= set(found) and len(found) == len(set(found)) and len(found) < 2 * len(want) + 20
