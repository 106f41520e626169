"""A whole run over planted postings."""

import json

from jobweave.plans import runner
from jobweave.sources.schema import FIELDS
from jobweave.sources.synthetic import COMMON, FAMILIES, generate


def test_whole_run(spark, tmp_path):
    names = sorted({s for v in FAMILIES.values() for s in v} | set(COMMON))
    (tmp_path / "taxonomy.csv").write_text("skill_id,canonical_name,abbreviation,aliases,skill_group,observed_count\n" + "".join(f"S{i:03d},{n},,,g,1\n" for i, n in enumerate(names)))
    (tmp_path / "locations.csv").write_text("raw_pattern,normalized_location,notes\nalpha|alfa,Alpha,\nbeta,Beta,\n")
    lines = []
    for i, r in enumerate(generate(spark, 330).collect()):
        body = f"Posting {i} wants " + ", ".join(r["extracted_skills"]) + ". " + " ".join(f"text{(i * 7 + k) % 997}" for k in range(60))
        lines.append(dict.fromkeys(FIELDS) | {"job_id": r["job_id"], "source": "s", "source_url": f"https://x/{i}", "crawl_timestamp": f"2025-01-01T00:{i % 60:02d}:00+00:00", "parser_version": "v", "raw_job_title": f"Senior {r['true_family']} specialist - alpha", "company": f"c{i % 50}", "raw_location": "Alfa, beta" if i % 2 else "Beta", "raw_experience": "1", "job_description": body, "job_requirements": "Requirements follow in the talk, and there are some of them to come."})
    lines.append(lines[0] | {"job_id": "copy", "crawl_timestamp": "2025-02-01T00:00:00+00:00"})
    lines.append(lines[1] | {"job_id": "near", "source_url": "https://x/near", "job_description": lines[1]["job_description"] + " tail"})
    lines.append(lines[2] | {"job_id": "bad", "source_url": "ftp://x"})
    (tmp_path / "raw.jsonl").write_text("\n".join(map(json.dumps, lines)))
    config = {"version": 1, "inputs": {"raw": "raw.jsonl", "taxonomy": "taxonomy.csv", "locations": "locations.csv"}, "outputs": {s: f"out/{s}" for s in runner.STAGES}, "modules": {s: f"jobweave.plans.stages:{s}" for s in runner.STAGES}, "options": {"ks": [3, 4, 5], "stability_iterations": 4, "bootstrap_rounds": 20, "enforce_quality_checks": False}}
    (tmp_path / "c.json").write_text(json.dumps(config))
    got = runner.run(spark, runner.Config.load(tmp_path / "c.json"), report=tmp_path / "report.json")
    assert got["status"] == "completed" and set(got["stages"]) == set(runner.STAGES)
    clean = {r["job_id"]: r for r in spark.read.parquet(f"file://{tmp_path}/out/clean/clean.parquet").collect()}
    assert len(clean) == 333 and list(clean["copy"].asDict()) == FIELDS
    first = lines[0]["job_id"], lines[1]["job_id"]
    assert clean["copy"]["duplicate_group_id"] == first[0] and {clean["near"]["duplicate_group_id"], clean[first[1]]["duplicate_group_id"]} & {first[1], "near"}
    assert clean["bad"]["relevance_flag"] is False and clean["bad"]["exclusion_reason"] == "SCRAPE_ERROR"
    assert clean[first[1]]["normalized_location"] == "Nhiều địa điểm" and clean[first[0]]["normalized_location"] == "Beta"
    assert all(clean[x["job_id"]]["job_description"] == x["job_description"] for x in lines)
    status = json.loads((tmp_path / "out/analysis/status.json").read_text())
    assert {q: s["status"] for q, s in status.items()} == {"rq2": "completed", "rq3": "completed", "rq4": "completed"}, status
    assert (tmp_path / "out/analysis/rq2_skill_pairs.csv").read_bytes()[:3] == b"\xef\xbb\xbf"
    assert spark.read.parquet(f"file://{tmp_path}/out/extract/job_skill_matrix.parquet").count() == spark.read.parquet(f"file://{tmp_path}/out/extract/job_skills.parquet").count()
