"""The stages of a whole run, each a function of a StageContext: clean, titles, extract, analysis."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.functions.text import document_text
from jobweave.operators import agreement, basket, cleaning, cluster, concentration, duplicates, explore, graph, matcher, profile, quality, titles as title_rules
from jobweave.plans.runner import StageContext, write_csv, write_json
from jobweave.plans.staging import settle, small
from jobweave.sources import readers
from jobweave.sources.schema import FIELDS, conform

TITLE, SKILLS = "normalized_job_title", "extracted_skills"


def _file(p: Path) -> str:
    return f"file://{p}"


def _done(ctx: StageContext, *names: str) -> dict:
    return {"status": "completed", "reason": None, "artifacts": list(names)}


def cleaned(raw: DataFrame, rules: list[tuple[str, str]], tools: list[str], text_alone: bool = False) -> DataFrame:
    """The postings with normalised places and titles, duplicates and quality flags marked; no row is dropped, no given field changed.

    A row with a fatal fault is not relevant, with SCRAPE_ERROR as its reason; which others are relevant is the user's rule and taken as given (true where null).
    Where duplicates are equal otherwise, the one read first stays. text_alone: also mark postings of one company whose texts alone are alike.
    """
    df = conform(raw, ("quality_flags",))
    title = title_rules.normal_title(F.col("raw_job_title"), [p for p, _ in rules], tools)
    df = cleaning.flagged(df.withColumn("_title", title), rules)
    fatal = cleaning.fatal(F.col("raw_job_title"), F.col("source"), F.col("source_url")).isNotNull()
    df = df.withColumns({TITLE: F.col("_title.title"), "relevance_flag": F.when(fatal, False).otherwise(F.coalesce("relevance_flag", F.lit(True))), "exclusion_reason": F.when(fatal, "SCRAPE_ERROR").otherwise(F.col("exclusion_reason"))})
    df = settle(df.withColumn("_ord", F.monotonically_increasing_id()))
    same = settle(duplicates.exact(df, key="_ord").select("_ord", F.col("canonical").alias("exact_of")))
    near = duplicates.repeats(df, "_ord", text_alone=text_alone, without=same)
    ids = df.select(F.col("_ord").alias("_of"), F.col("job_id").alias("duplicate_group_id"))
    both = df.drop("duplicate_group_id").join(same, "_ord", "left").join(near, "_ord", "left").withColumn("_of", F.coalesce("exact_of", "near_of")).join(ids, "_of", "left")
    none = F.array().cast("array<string>")
    mark = F.when(F.col("exact_of").isNotNull(), F.array(F.lit("DUPLICATE_EXACT"))).otherwise(F.coalesce("near_flags", none))
    both = both.withColumns({"duplicate_flag": F.col("_of").isNotNull(), "quality_flags": F.array_distinct(F.concat("quality_flags", F.coalesce("_title.flags", none), mark))})
    return both.orderBy("_ord").select(*FIELDS, "quality_flags")


def clean(ctx: StageContext) -> dict:
    rules = [(r["pattern"], r["label"]) for r in small(readers.location_rules(ctx.spark, _file(ctx.inputs["locations"])).orderBy("rule_idx"))] if "locations" in ctx.inputs else []
    taxonomy = readers.read_taxonomy(ctx.spark, _file(ctx.inputs["taxonomy"])) if "taxonomy" in ctx.inputs else None
    tools = [r[0] for r in small(readers.tech_terms(taxonomy, title_rules.MORE_TOOLS, title_rules.DOMAIN_GROUPS, title_rules.DOMAIN_SKILLS).orderBy("term"))] if taxonomy is not None else list(title_rules.MORE_TOOLS)
    df = settle(cleaned(readers.read_jobs(ctx.spark, _file(ctx.inputs["raw"])), rules, tools, ctx.options.get("allow_jd_only", False)))
    gates = cleaning.gates(df)
    df.select(*FIELDS).write.parquet(_file(ctx.target / "clean.parquet"))
    df.select("job_id", "quality_flags").write.json(_file(ctx.target / "quality_flags.jsonl"))
    write_json(ctx.target / "gates.json", gates | cleaning.clean_counts(df).first().asDict())
    write_csv(cleaning.fatal_ids(df), ctx.target / "scrape_errors.csv")
    return _done(ctx, "clean.parquet", "quality_flags.jsonl", "gates.json", "scrape_errors.csv")


def _clean(ctx: StageContext) -> DataFrame:
    return ctx.spark.read.parquet(_file(ctx.inputs["clean"] / "clean.parquet"))


def titles(ctx: StageContext) -> dict:
    ok = concentration.eligible(_clean(ctx))
    if ok.isEmpty():
        return {"status": "skipped", "reason": "no eligible posting", "artifacts": []}
    tables = {"rq1_summary": concentration.title_summary(ok), "rq1_top20_titles": concentration.top_titles(ok), "rq1_rare_titles": concentration.rare_table(ok)}
    for name, df in tables.items():
        write_csv(df, ctx.target / f"{name}.csv")
    return _done(ctx, *(f"{n}.csv" for n in tables))


def extract(ctx: StageContext) -> dict:
    taxonomy = readers.read_taxonomy(ctx.spark, _file(ctx.inputs["taxonomy"]))
    ok = concentration.eligible(_clean(ctx))
    text = document_text(F.col("raw_job_title"), F.col("job_description"), F.col("job_requirements"))
    found = settle(matcher.extract(ok.select("job_id", text.alias("text")), "job_id", "text", taxonomy))
    matcher.skill_lists(found).write.parquet(_file(ctx.target / "job_skills.parquet"))
    ids = [r[0] for r in taxonomy.select("skill_id").orderBy("skill_id").collect()]
    matcher.skill_matrix(found, "job_id", ids).write.parquet(_file(ctx.target / "job_skill_matrix.parquet"))
    return _done(ctx, "job_skills.parquet", "job_skill_matrix.parquet")


def analysis(ctx: StageContext) -> dict:
    """Tables of skills, titles against skills and clusters, each with its own status; none when a quality check fails, unless told otherwise."""
    skills = ctx.spark.read.parquet(_file(ctx.inputs["extract"] / "job_skills.parquet"))
    base = _clean(ctx)
    checks = settle(quality.checks(base, skills))
    write_csv(checks, ctx.target / "quality_checks.csv")
    names, status = ["quality_checks.csv", "status.json"], {}
    failed = [r["check"] for r in checks.filter("NOT passed").orderBy("check").collect()]
    if failed and ctx.options.get("enforce_quality_checks", True):
        status = {q: {"status": "skipped", "reason": f"failed: {', '.join(failed)}"} for q in ("rq2", "rq3", "rq4")}
    else:
        df = settle(skills.select("job_id", SKILLS).join(base.select("job_id", TITLE), "job_id", "left"))
        for q, make in (("rq2", _rq2), ("rq3", _rq3), ("rq4", _rq4)):
            tables = make(df, ctx.options)
            status[q] = {"status": "skipped", "reason": tables} if isinstance(tables, str) else {"status": "completed", "reason": None}
            for name, t in {} if isinstance(tables, str) else tables.items():
                write_csv(t, ctx.target / f"{name}.csv")
                names.append(f"{name}.csv")
    write_json(ctx.target / "status.json", status)
    return _done(ctx, *names)


def _rq2(df: DataFrame, options: dict) -> dict[str, DataFrame]:
    long = basket.basket(df)
    pairs = settle(basket.association(df, least=options.get("min_joint", basket.PAIR_LEAST)))
    return {
        "rq2_skill_frequency": basket.frequency(long, df.count()),
        "rq2_skills_per_posting": basket.sizes(df),
        "rq2_skill_pairs": pairs,
        "rq2_skill_communities": graph.communities(pairs, long.select("skill").distinct()),
        "rq2_top_pairs_by_metric": basket.top_by_metric(pairs),
        "rq2_negative_pairs": basket.negative(df),
    }


def _rq3(df: DataFrame, options: dict) -> dict[str, DataFrame] | str:
    least = options.get("min_jobs_per_title", profile.TITLE_LEAST)
    found = settle(profile.dispersion(df, TITLE, "job_id", SKILLS, least))
    if found.count() < 3:
        return f"fewer than 3 titles of {least} postings"
    shape = settle(profile.profiles(df, TITLE, SKILLS, least))
    like = settle(profile.likeness(shape))
    return {
        "rq3_title_dispersion": profile.with_baseline(found, profile.baseline(df, "job_id", SKILLS, found, options.get("bootstrap_rounds", profile.ROUNDS))),
        "rq3_title_similarity": like,
        "rq3_notable_pairs": profile.notable(shape, like),
        "rq3_title_profiles": profile.top_skills(shape),
        "rq3_flagged_pairs": profile.flagged(like),
        "rq3_skipped_titles": profile.skipped(df, TITLE, SKILLS, least),
    }


def _rq4(df: DataFrame, options: dict) -> dict[str, DataFrame] | str:
    n = df.count()
    if n < options.get("min_rows", cluster.LEAST_ROWS):
        return f"{n} postings, under {cluster.LEAST_ROWS}"
    words = [r[0] for r in small(basket.at_least(basket.basket(df), 3).select("skill").distinct().orderBy("skill"))]
    data = settle(cluster.skill_vectors(df.fillna({}), "job_id", SKILLS, words))
    table, models = cluster.sweep(data, list(options.get("ks", cluster.KS)), rounds=options.get("stability_iterations", cluster.ROUNDS))
    best = cluster.choose_k(table)
    labelled = settle(models[best].transform(data))
    # Titles come in only now that the labels are fixed.
    with_rows = settle(labelled.select(F.col("id").alias("job_id"), F.col("prediction").alias("cluster")).join(df, "job_id"))
    return {
        "rq4_k_sweep": df.sparkSession.createDataFrame(table),
        "rq4_cluster_assignment": with_rows.select("job_id", "cluster"),
        "rq4_cluster_profiles": cluster.profiles(with_rows, "cluster", SKILLS),
        "rq4_cluster_examples": cluster.exemplars(labelled),
        "rq4_clusters_with_titles": cluster.top_titles(with_rows, "cluster", TITLE),
        "rq4_cluster_title_crosstab": explore.crosstab(with_rows, "cluster", TITLE),
        "rq4_agreement": agreement.partition_agreement(with_rows, "cluster", TITLE),
        "rq4_pca_coordinates": cluster.coordinates(data),
    }
