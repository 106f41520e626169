"""Stages over files: inputs fingerprinted, outputs made in a scratch folder, checked, and published together or not at all."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from importlib import import_module
from itertools import islice
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from jobweave.sources.schema import FIELDS, ContractError

STAGES = ("clean", "titles", "extract", "analysis")


@dataclass(frozen=True)
class Config:
    """A run: where its inputs and outputs are, which callable runs each stage, and options."""

    inputs: dict[str, Path]
    outputs: dict[str, Path]
    modules: dict[str, str]
    options: dict = field(default_factory=dict)

    @staticmethod
    def load(path: str | Path) -> Config:
        """From JSON, version 1; paths are relative to the file; outputs may be neither equal nor nested, nor inputs of the run."""
        path = Path(path)
        raw = json.loads(path.read_text(encoding="utf-8"))
        if raw.get("version") != 1:
            raise ContractError("config version must be 1")
        at = lambda p: (path.parent / p).resolve()
        c = Config({k: at(p) for k, p in raw["inputs"].items()}, {k: at(p) for k, p in raw["outputs"].items()}, raw.get("modules", {}), raw.get("options", {}))
        if bad := [k for k in c.outputs if k not in STAGES]:
            raise ContractError(f"unknown stages: {bad}")
        if bad := [m for m in c.modules.values() if m.count(":") != 1]:
            raise ContractError(f"not module:function: {bad}")
        places = [*c.outputs.items(), *c.inputs.items()]
        for i, (a, p) in enumerate(places):
            for b, q in places[i + 1 :]:
                if (a in c.outputs or b in c.outputs) and (p == q or p in q.parents or q in p.parents):
                    raise ContractError(f"{a} and {b} share a path")
        return c


@dataclass(frozen=True)
class StageContext:
    spark: SparkSession
    stage: str
    inputs: dict[str, Path]
    target: Path
    options: dict


def digest(path: str | Path) -> str:
    """SHA-256 of a file, or of a folder's files with their names."""
    path, h = Path(path), hashlib.sha256()
    for p in sorted(path.rglob("*")) if path.is_dir() else [path]:
        if p.is_file() and not p.name.endswith(".crc"):
            h.update(str(p.relative_to(path)).encode() + b"\0" if path.is_dir() else b"")
            with p.open("rb") as f:
                while chunk := f.read(1 << 20):
                    h.update(chunk)
    return h.hexdigest()


def write_json(path: str | Path, value: object) -> None:
    """Written beside and renamed, so that a reader never sees half of it."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    aside = path.with_name(f".{path.name}.{os.getpid()}")
    aside.write_text(json.dumps(value, ensure_ascii=False, indent=2, default=str), encoding="utf-8")
    os.replace(aside, path)


def publish(pairs: dict[Path, Path]) -> None:
    """Each scratch path takes the place of its target; after a failure the former targets stand as before."""
    kept: dict[Path, Path] = {}
    done: list[Path] = []
    try:
        for scratch, target in pairs.items():
            target.parent.mkdir(parents=True, exist_ok=True)
            if target.exists():
                kept[target] = target.with_name(f".{target.name}.before")
                os.rename(target, kept[target])
            os.rename(scratch, target)
            done.append(target)
    except BaseException:
        for target in done:
            shutil.rmtree(target) if target.is_dir() else target.unlink()
        for target, old in kept.items():
            os.rename(old, target)
        raise
    for old in kept.values():
        shutil.rmtree(old) if old.is_dir() else old.unlink()


def write_together(tables: dict[str, DataFrame], folder: Path) -> None:
    """All tables as parquet under folder, published by one rename."""
    scratch = folder.with_name(f".{folder.name}.{os.getpid()}")
    shutil.rmtree(scratch, ignore_errors=True)
    try:
        for name, df in tables.items():
            df.write.parquet(f"file://{scratch}/{name}")
        publish({scratch: folder})
    finally:
        shutil.rmtree(scratch, ignore_errors=True)


def write_csv(df: DataFrame, path: Path) -> None:
    """A table as one CSV file with a byte-order mark. Rows pass through the driver a part at a time, never all at once."""
    path.parent.mkdir(parents=True, exist_ok=True)
    rows = df.toLocalIterator(prefetchPartitions=True)
    with path.open("w", encoding="utf-8-sig", newline="") as f:
        pd.DataFrame(columns=df.columns).to_csv(f, index=False)
        while some := list(islice(rows, 10_000)):
            pd.DataFrame(some, columns=df.columns).to_csv(f, index=False, header=False)


def write_clean(df: DataFrame, path: str) -> None:
    """Exactly the posting fields, parquet or line-wise JSON by suffix; the flags beside it."""
    body = df.select(*FIELDS)
    body.write.json(path) if path.endswith(".jsonl") else body.write.parquet(path)
    if "quality_flags" in df.columns:
        df.select("job_id", "quality_flags").write.json(f"{path}.flags.jsonl")


def check_result(result: dict, folder: Path) -> None:
    """status completed with files inside folder that aren't empty, or skipped with a reason; nothing else."""
    if set(result) != {"status", "reason", "artifacts"}:
        raise ContractError("a result has status, reason and artifacts")
    if result["status"] == "skipped":
        if not result["reason"] or result["artifacts"]:
            raise ContractError("skipped needs a reason and no artifacts")
        return
    if result["status"] != "completed" or not result["artifacts"]:
        raise ContractError("completed needs artifacts")
    for a in result["artifacts"]:
        p = (folder / a).resolve()
        if folder.resolve() not in p.parents or not p.exists() or p.is_file() and not p.stat().st_size:
            raise ContractError(f"missing, empty or outside: {a}")


def entry_point(name: str) -> Callable:
    module, _, function = name.partition(":")
    found = getattr(import_module(module), function, None)
    if not callable(found):
        raise ContractError(f"not a callable: {name}")
    return found


def run(spark: SparkSession, config: Config, stages: tuple[str, ...] = STAGES, report: Path | None = None) -> dict:
    """The configured stages in order. The first error stops the run; the report is written in any case."""
    out = {"stages": {}, "status": "completed", "inputs": {}}
    try:
        for stage in [s for s in STAGES if s in stages and s in config.outputs]:
            began = time.time()
            before = {k: digest(p) for k, p in config.inputs.items() if p.exists()}
            out["inputs"] |= before
            call = entry_point(config.modules[stage])
            target = config.outputs[stage]
            scratch = target.with_name(f".{target.name}.scratch")
            shutil.rmtree(scratch, ignore_errors=True)
            scratch.mkdir(parents=True)
            try:
                result = call(StageContext(spark, stage, {**config.inputs, **{k: p for k, p in config.outputs.items() if p.exists()}}, scratch, dict(config.options)))
                if changed := [k for k, h in before.items() if digest(config.inputs[k]) != h]:
                    raise ContractError(f"inputs were changed: {changed}")
                check_result(result, scratch)
                if result["status"] == "completed":
                    publish({scratch: target})
            finally:
                shutil.rmtree(scratch, ignore_errors=True)
            out["stages"][stage] = {**result, "seconds": round(time.time() - began, 3)}
    except Exception as e:
        out["status"], out["error"] = "failed", f"{type(e).__name__}: {e}"
        raise
    finally:
        if report:
            write_json(report, out)
    return out
