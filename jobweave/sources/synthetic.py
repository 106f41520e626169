"""Postings with planted families of skills, for testing what finds structure."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

# Invented families and their skills, and skills anybody has.
FAMILIES = {"pipelines": ["Spark", "Kafka", "Airflow", "SQL", "dbt"], "learning": ["PyTorch", "TensorFlow", "NLP", "CUDA", "MLflow"], "reports": ["Excel", "PowerBI", "Tableau", "DAX", "Looker"], "analysis": ["UML", "Jira", "BPMN", "Figma", "Visio"]}
COMMON = ["Git", "English", "Linux"]


def generate(spark: SparkSession, n: int = 400, noise: float = 0.05, drop: float = 0.25, seed: int = 42) -> DataFrame:
    """(job_id, true_family, normalized_job_title, extracted_skills): each has its family's skills, less some, and a few others."""
    r = np.random.default_rng(seed)
    names, every = list(FAMILIES), sorted({s for v in FAMILIES.values() for s in v})
    rows = []
    for i in range(n):
        f = names[int(r.integers(len(names)))]
        own = [s for s in FAMILIES[f] if r.random() >= drop] + [s for s in COMMON if r.random() < 0.5] + [s for s in every if s not in FAMILIES[f] and r.random() < noise]
        rows.append((f"j{i:05d}", f, f"{f} specialist", own))
    return spark.createDataFrame(rows, "job_id string, true_family string, normalized_job_title string, extracted_skills array<string>")
