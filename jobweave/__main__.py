"""python -m jobweave --config FILE [--stage NAME|all] [--report FILE]"""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession

from jobweave.plans.runner import STAGES, Config, run


def main() -> None:
    p = argparse.ArgumentParser(prog="jobweave")
    p.add_argument("--config", required=True)
    p.add_argument("--stage", default="all", choices=("all", *STAGES))
    p.add_argument("--report")
    a = p.parse_args()
    spark = SparkSession.builder.appName("jobweave").getOrCreate()
    print(run(spark, Config.load(a.config), STAGES if a.stage == "all" else (a.stage,), Path(a.report) if a.report else None)["status"])


if __name__ == "__main__":
    main()
