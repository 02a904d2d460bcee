"""Case sets as files: one JSON line a case and a manifest, written once and read back verified."""

from __future__ import annotations

import hashlib
from collections import Counter
from pathlib import Path

from pyspark.sql import DataFrame

from ..functions.values import canonical, load_json
from ..sources.files import publishing, read_folder, read_regular
from ..sources.snapshot import write_json
from . import cases as building
from .contract import SPLITS
from .tools import SOURCE_LABEL

LINES, MANIFEST = "cases.jsonl", "manifest.json"
#: All that a run may see of a case.
SAFE = ("case_id", "user_input", "dataset_id", "dataset_version", "split")
COUNTED = {"business_task_counts": "business_task", "capability_counts": "primary_capability", "difficulty_counts": "difficulty", "split_counts": "split"}
IDENTITY = ("dataset_id", "dataset_version", "generator_config_hash")
#: How cases are split.
STRATEGY = {
    "version": "split-v2",
    "unit": "case",
    "statistical_unit": "statistical_cluster_id",
    "development_cases_per_task": 14,
    "public_validation_cases_per_task": 6,
    "public_validation_cases_per_capability": 3,
    "public_validation_difficulty_counts": {"easy": 9, "medium": 12, "hard": 9},
    "cross_split_dataset_isolation": True,
    "cross_split_cluster_isolation": False,
}


def _line(case: dict) -> bytes:
    return canonical(case)


def case_set_id(lines: list[bytes]) -> str:
    return hashlib.sha256(canonical({"lines": [x.decode() for x in lines]})).hexdigest()[:16]


def manifest_of(cases: list[dict]) -> dict:
    """What describes a case set; ValueError if its splits don't have one data set each, or its contracts differ."""
    if not cases:
        raise ValueError("a case set can't be empty")
    owners = {split: {tuple(c[k] for k in IDENTITY) for c in cases if c["split"] == split} for split in SPLITS}
    contracts = {(c["tool_contract_version"], c["tool_contract_sha256"]) for c in cases}
    if any(len(o) != 1 for o in owners.values()) or owners[SPLITS[0]] == owners[SPLITS[1]] or len(contracts) != 1:
        raise ValueError("a case set has one data set for each split and one contract")
    lines = [_line(c) for c in cases]
    [(version, digest)] = contracts
    return {
        "case_schema_version": building.CASE_VERSION,
        "tool_contract": {"version": version, "sha256": digest},
        "datasets": {split: dict(zip(IDENTITY, next(iter(o)))) for split, o in owners.items()},
        "split_strategy": STRATEGY,
        "source_label": SOURCE_LABEL,
        "case_count": len(cases),
        "case_set_id": case_set_id(lines),
        "jsonl_sha256": hashlib.sha256(b"".join(x + b"\n" for x in lines)).hexdigest(),
    } | {name: dict(sorted(Counter(c[key] for c in cases).items())) for name, key in COUNTED.items()}


def write(cases: list[dict], folder: str | Path) -> dict:
    """Publishes a case set; an equal one in place is kept, another one refused."""
    manifest, folder = manifest_of(cases), Path(folder)
    try:
        with publishing(folder) as stage:
            if folder.exists() or folder.is_symlink():
                raise FileExistsError(folder)
            (stage / LINES).write_bytes(b"".join(_line(c) + b"\n" for c in cases))
            write_json(stage / MANIFEST, manifest)
    except FileExistsError:
        held = read_folder(folder, {LINES, MANIFEST})
        if load_json(held[MANIFEST]) != manifest or hashlib.sha256(held[LINES]).hexdigest() != manifest["jsonl_sha256"]:
            raise FileExistsError(f"{folder} holds another case set") from None
    return manifest


def load(folder: str | Path) -> tuple[dict, list[dict]]:
    """The manifest and, of each case, what a run may see, after every hash, count and case was checked."""
    folder = Path(folder)
    manifest = load_json(read_regular(folder / MANIFEST))
    raw = read_regular(folder / LINES)
    if hashlib.sha256(raw).hexdigest() != manifest["jsonl_sha256"]:
        raise ValueError("the lines have another hash")
    rows = raw.split(b"\n")
    if rows.pop() != b"" or any(not row.strip() or b"\r" in row.removesuffix(b"\r") for row in rows):
        raise ValueError("lines are empty, broken or not ended")
    cases = [load_json(row) for row in rows]
    for case in cases:
        building.check_case(case)
        same_set = case["case_version"] == manifest["case_schema_version"] and {"version": case["tool_contract_version"], "sha256": case["tool_contract_sha256"]} == manifest["tool_contract"]
        if not same_set or {k: case[k] for k in IDENTITY} != manifest["datasets"].get(case["split"]):
            raise ValueError(f"{case['case_id']} belongs to another case set")
    if len({c["case_id"] for c in cases}) != len(cases) or manifest_of(cases) != manifest:
        raise ValueError("case ids repeat, or the manifest counts other cases")
    return manifest, [{k: c[k] for k in SAFE} for c in cases]


def scan(spark, folder: str) -> DataFrame:
    """The safe columns of a case file as a DataFrame; a malformed line is an error."""
    schema = ", ".join(f"{c} string" for c in SAFE)
    return spark.read.schema(schema).json(f"{folder}/{LINES}", mode="FAILFAST")
