"""Artifacts of a run: records, summary, policy and manifest, staged, verified and published under a lock."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import canonical, forbidden_keys, load_json
from ..sources.files import publishing, read_folder
from .contract import SPLITS

RECORDS, SUMMARY, POLICY, MANIFEST = "case_runs.jsonl", "summary.json", "policy_snapshot.json", "run_manifest.json"
OUTPUTS = (RECORDS, SUMMARY, POLICY)
STATUSES = ("completed", "failed")
RECORD_KEYS = {"sequence", "case_id", "split", "dataset_id", "dataset_version", "user_input", "status", "final_answer", "prior_tool_executions", "decision_trace", "usage", "error_code"}
RUN_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")
SCHEMA = "sequence int, case_id string, split string, dataset_id string, dataset_version string, user_input string, status string, final_answer string, error_code string"


def check_record(record: dict) -> None:
    """ValueError unless a record is complete, agrees with its status and holds no forbidden key."""
    if set(record) != RECORD_KEYS or record["split"] not in SPLITS or record["status"] not in STATUSES:
        raise ValueError(f"malformed record {record.get('case_id')}")
    use = record["usage"]
    if use is not None and (set(use) != {"prompt_tokens", "completion_tokens", "total_tokens"} or any(type(v) is not int or v < 0 for v in use.values()) or use["prompt_tokens"] + use["completion_tokens"] != use["total_tokens"]):
        raise ValueError(f"{record['case_id']}: usage doesn't add up")
    done = record["status"] == "completed"
    if (record["final_answer"] is not None) != done or (record["error_code"] is None) != done:
        raise ValueError(f"{record['case_id']}: answer and error don't fit its status")
    if not done and not re.fullmatch("[a-z][a-z0-9_]*", record["error_code"]):
        raise ValueError(f"{record['case_id']}: bad error code")
    inside = [e["arguments"] for e in record["prior_tool_executions"]], [e["payload"] for e in record["decision_trace"]]
    if bad := forbidden_keys(inside, record["case_id"]):
        raise ValueError(f"forbidden keys: {bad}")


def check_order(records: list[dict]) -> None:
    if [r["sequence"] for r in records] != list(range(1, len(records) + 1)) or len({r["case_id"] for r in records}) != len(records):
        raise ValueError("records must be numbered from 1 without gaps, one a case")


def status_counts(records: DataFrame) -> DataFrame:
    """split, status, n, first, last (case of the smallest and largest sequence), first_at, last_at."""
    return records.groupBy("split", "status").agg(
        F.count("*").alias("n"), F.min_by("case_id", "sequence").alias("first"), F.max_by("case_id", "sequence").alias("last"), F.min("sequence").alias("first_at"), F.max("sequence").alias("last_at")
    )


def summarise(records: DataFrame) -> dict:
    """The summary of some records (sequence, case_id, split, status); ValueError if their sequence has gaps."""
    cells = status_counts(records).collect()  # splits times statuses
    total = sum(c.n for c in cells)
    if cells and (min(c.first_at for c in cells), max(c.last_at for c in cells)) != (1, total):
        raise ValueError("record sequence has gaps")
    count = lambda **want: sum(c.n for c in cells if all(c[k] == v for k, v in want.items()))
    return {
        "total": total,
        "completed": count(status="completed"),
        "failed": count(status="failed"),
        "stopped": 0,
        "split_counts": {s: count(split=s) for s in SPLITS},
        "split_status_counts": {s: {k: count(split=s, status=k) for k in STATUSES} for s in SPLITS},
        "first_case_id": min(cells, key=lambda c: c.first_at).first if cells else None,
        "last_case_id": max(cells, key=lambda c: c.last_at).last if cells else None,
        "published": True,
        "evaluation_status": "pending_not_run",
    }


def check_summary(summary: dict, records: list[dict]) -> None:
    """ValueError unless a summary says what the records say."""
    by = Counter((r["split"], r["status"]) for r in records)
    of = lambda **want: sum(n for (s, k), n in by.items() if want.get("split", s) == s and want.get("status", k) == k)
    ends = [r["case_id"] for r in records[:1] + records[-1:]] or [None, None]
    want = {"total": len(records), "completed": of(status="completed"), "failed": of(status="failed"), "stopped": 0, "split_counts": {s: of(split=s) for s in SPLITS}}
    want |= {"split_status_counts": {s: {k: of(split=s, status=k) for k in STATUSES} for s in SPLITS}, "first_case_id": ends[0], "last_case_id": ends[-1], "published": True}
    if wrong := [k for k, v in want.items() if summary.get(k) != v]:
        raise ValueError(f"the summary contradicts its records: {wrong}")


def _document(value) -> bytes:
    return canonical(value) + b"\n"


def publish(root: str | Path, run_id: str, records: list[dict], summary: dict, policy: dict, manifest: dict) -> Path:
    """Stages the four files, verifies them as a reader would, and renames them into place; never over another run."""
    if not RUN_ID.fullmatch(run_id):
        raise ValueError(f"bad run id {run_id!r}")
    files = {RECORDS: b"".join(_document(r) for r in records), SUMMARY: _document(summary), POLICY: _document(policy)}
    hashes = {n: hashlib.sha256(b).hexdigest() for n, b in files.items()}
    files[MANIFEST] = _document({**manifest, "run_id": run_id, "policy_snapshot_sha256": hashes[POLICY], "output_files": hashes})
    folder = Path(root) / run_id
    if folder.exists() or folder.is_symlink():
        raise FileExistsError(f"run {run_id} exists")
    with publishing(folder) as stage:
        for name, data in files.items():
            (stage / name).write_bytes(data)
        verify(stage)
    return folder


def _canonical_document(data: bytes, name: str):
    value = load_json(data)
    if _document(value) != data:
        raise ValueError(f"{name} is not in canonical form")
    return value


def verify(folder: str | Path) -> dict:
    """records, summary, policy and manifest of a published run, after every hash, count and form was checked."""
    files = read_folder(Path(folder), {*OUTPUTS, MANIFEST})
    manifest, summary, policy = (_canonical_document(files[n], n) for n in (MANIFEST, SUMMARY, POLICY))
    if files[RECORDS] and not files[RECORDS].endswith(b"\n"):
        raise ValueError("the last record is not ended")
    records = [_canonical_document(line, RECORDS) for line in files[RECORDS].splitlines(keepends=True)]
    hashes = {n: hashlib.sha256(files[n]).hexdigest() for n in OUTPUTS}
    if manifest["output_files"] != hashes or manifest["policy_snapshot_sha256"] != hashes[POLICY]:
        raise ValueError("a file has another hash than its manifest says")
    for record in records:
        check_record(record)
    check_order(records)
    check_summary(summary, records)
    return {"records": records, "summary": summary, "policy": policy, "manifest": manifest}


def scan(spark, folder: str) -> DataFrame:
    """The plain columns of a run's records; a malformed line is an error."""
    return spark.read.schema(SCHEMA).json(f"{folder}/{RECORDS}", mode="FAILFAST")
