"""Runs as a loop of steps, the rules that decide the steps by default, records and batches.

A run asks its policy for the next step until there is an answer, an error, or ``max_steps`` were taken. The policy sees the
request's text and all results so far, and may look into them; it calls a tool, answers or gives up, and may say what the
decision took (``usage``), which the run adds up. Each step of a plan is a lazy DataFrame; only the rows of an answer (five at
most), what a policy fetches, and counts reach the driver.
"""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date
from pathlib import Path

from ..functions import requests
from ..functions.requests import Request, parse
from ..functions.values import total_usage
from ..operators.windows import common_as_of
from . import answers, artifacts
from .tools import DERIVE, PRODUCT, SALES, TRAFFIC, InvalidArguments, InvalidResult, Registry, Result, UnknownTool, default_registry, window_arguments

MAX_STEPS = 8
POLICY_NAME, POLICY_VERSION = "rules", "1"
#: Errors that stand in a record by a code; any other of a tool is ``TOOL_ERROR``.
CODES = {InvalidArguments: "invalid_arguments", InvalidResult: "invalid_result", UnknownTool: "unknown_tool"}
TOOL_ERROR, POLICY_ERROR, REPEATED_CALL, STEP_LIMIT = "tool_error", "policy_error", "repeated_call", "step_limit"
OTHER_ERROR = "case_execution_error"
USAGE = ("prompt_tokens", "completion_tokens", "total_tokens")
log = logging.getLogger(__name__)

# Tools and metrics of each task.
PATHS = {
    "product_anomaly": (PRODUCT, SALES, TRAFFIC, DERIVE),
    "conversion_decline": (TRAFFIC, SALES, DERIVE),
    "next_week_priority": (SALES, TRAFFIC, DERIVE),
    "products_to_watch": (SALES, TRAFFIC, DERIVE),
    "gmv_diagnosis": (SALES, DERIVE),
}
METRICS = {task: [name for part in parts for name, _, _ in part] for task, parts in answers.FIELDS.items()}
#: Where the metrics are asked for in another order than they are shown.
METRICS["conversion_decline"] = "current_visits previous_visits current_orders previous_orders current_cvr previous_cvr cvr_change cvr_change_rate current_observed_days previous_observed_days".split()


@dataclass(frozen=True)
class Call:
    """Run a tool; a run takes each call id once."""

    call_id: str
    tool: str
    arguments: dict


@dataclass(frozen=True)
class Answer:
    text: str


@dataclass(frozen=True)
class GiveUp:
    reason: str


@dataclass(frozen=True)
class Decision:
    action: Call | Answer | GiveUp
    #: Token counts by the names in ``USAGE``, where the policy knows them.
    usage: dict[str, int] | None = None
    #: Events for the trace: kind and payload.
    notes: tuple[tuple[str, dict], ...] = ()


@dataclass(frozen=True)
class State:
    """What a policy sees: the text, the last day of the data, and the results so far, which it may fetch."""

    text: str
    as_of: date
    results: tuple[Result, ...]


Policy = Callable[[State], Decision]


@dataclass(frozen=True)
class Done:
    """What a record says of a tool's result."""

    number: int
    call_id: str
    tool: str
    arguments: dict
    columns: tuple[str, ...]
    dataset_id: str
    warnings: list[str]

    @property
    def result_id(self) -> str:
        return f"result_{self.number:04d}"


@dataclass
class Run:
    status: str
    answer: str | None = None
    error: str | None = None
    executions: list[Done] = field(default_factory=list)
    trace: list[dict] = field(default_factory=list)
    usage: dict[str, int] | None = None

    def note(self, kind: str, **payload) -> None:
        self.trace.append({"sequence": len(self.trace) + 1, "event_type": kind, "payload": payload})

    def failed(self, code: str, kind: str = "failed", **payload) -> Run:
        self.error = code
        self.note(kind, **(payload or {"code": code}))
        return self

    def completed(self, answer: str) -> Run:
        self.status, self.answer = "completed", answer
        self.note("answered", results=[e.result_id for e in self.executions])
        return self


def group_by(request: Request) -> list[str]:
    by_product = request.task in ("product_anomaly", "next_week_priority", "products_to_watch") or (request.task == "conversion_decline" and request.product_ids)
    return ["product_id"] if by_product else []


def plan(request: Request) -> list[tuple[str, dict]]:
    """Tool names and arguments of a request, in order."""
    window, steps = window_arguments(request.windows, request.product_ids), []
    for name in PATHS[request.task]:
        if name == PRODUCT:
            steps += [(name, {"product_ids": list(request.product_ids)})] if request.product_ids else []
        elif name == DERIVE:
            steps.append((name, {"metrics": METRICS[request.task], "group_by": group_by(request)}))
        else:
            steps.append((name, window | {"include_refunds" if name == SALES else "include_missing": True}))
    return steps


def parsed_note(request: Request) -> tuple[str, dict]:
    return "parsed", {"task": request.task, "reason": request.reason, "product_ids": list(request.product_ids)}


def rules() -> Policy:
    """The policy that parses a request once and takes the steps of its plan in order."""
    known: dict[str, Request] = {}

    def decide(state: State) -> Decision:
        if not state.results:
            known[state.text] = parse(state.text, state.as_of)
        request = known[state.text]
        notes = () if state.results else (parsed_note(request),)
        if request.task is None:
            return Decision(GiveUp(request.reason), notes=notes)
        steps = plan(request)
        if len(state.results) < len(steps):
            name, arguments = steps[len(state.results)]
            return Decision(Call(f"call_{len(state.results) + 1:04d}", name, arguments), notes=notes)
        return Decision(Answer(answers.render(request, list(state.results))), notes=notes)

    return decide


def _usage_of(decision: Decision) -> dict[str, int] | None:
    """A decision's usage, or ValueError if it is no set of counts that add up."""
    use = decision.usage
    if use is None:
        return None
    if set(use) != set(USAGE) or any(type(v) is not int or v < 0 for v in use.values()) or use["prompt_tokens"] + use["completion_tokens"] != use["total_tokens"]:
        raise ValueError(f"usage {use} doesn't add up")
    return use


def run(tables, text: str, as_of: date, *, policy: Policy | None = None, registry: Registry | None = None, max_steps: int = MAX_STEPS, dataset_id: str = "") -> Run:
    """Answer one request; failures become a code, not an exception's text (that goes to the log)."""
    registry, policy, out = registry or default_registry(), policy or rules(), Run("failed")
    results: list[Result] = []
    calls: set[str] = set()
    for _ in range(max_steps):
        try:
            decision = policy(State(text, as_of, tuple(results)))
            use = _usage_of(decision)
        except Exception:  # noqa: BLE001  a policy is foreign code
            log.exception("the policy failed")
            return out.failed(POLICY_ERROR)
        out.usage = total_usage([out.usage, use])
        for kind, payload in decision.notes:
            out.note(kind, **payload)
        action = decision.action
        if isinstance(action, Answer):
            return out.completed(action.text)
        if isinstance(action, GiveUp):
            return out.failed(action.reason, "unsupported", reason=action.reason)
        out.note("tool", name=action.tool, arguments=action.arguments)
        if action.call_id in calls:
            return out.failed(REPEATED_CALL)
        calls.add(action.call_id)
        try:
            result = registry.invoke(action.tool, action.arguments, tables, earlier=results, dataset_id=dataset_id)
            out.executions.append(Done(result.number, action.call_id, result.tool, result.arguments, result.columns, dataset_id, result.warnings))
        except (InvalidArguments, InvalidResult, UnknownTool) as e:
            return out.failed(CODES[type(e)])
        except Exception:  # noqa: BLE001  a tool's code
            log.exception("the tool %s failed", action.tool)
            return out.failed(TOOL_ERROR)
        results.append(result)
    return out.failed(STEP_LIMIT)


def policy_snapshot() -> dict:
    """What decided a run, as JSON values."""
    return {
        "policy_name": POLICY_NAME,
        "policy_version": POLICY_VERSION,
        "routing_priority": list(requests.TASKS),
        "routing_keywords": {t: [list(g) for g in groups] for t, groups in requests.TASKS.items()},
        "default_window_days": requests.DEFAULT_DAYS,
        "default_top_k": answers.TOP,
        "tool_paths": {t: list(p) for t, p in PATHS.items()},
        "metrics": METRICS,
        "stable_sort_fields": {t: [":".join(answers.ORDER[t]), "product_id:asc"] if t in answers.ORDER else [] for t in PATHS},
    }


def record(number: int, case: dict, done: Run | None) -> dict:
    """A run of a case as it is published; ``None`` is a run that broke down."""
    done = done or Run("failed")
    return {
        "sequence": number,
        **{k: case[k] for k in ("case_id", "split", "dataset_id", "dataset_version", "user_input")},
        "status": done.status,
        "final_answer": done.answer if done.status == "completed" else None,
        "prior_tool_executions": [{"call_id": e.call_id, "tool_name": e.tool, "arguments": e.arguments, "result_id": e.result_id, "columns": list(e.columns), "warnings": e.warnings} for e in done.executions],
        "decision_trace": done.trace,
        "usage": done.usage,
        "error_code": None if done.status == "completed" else done.error or OTHER_ERROR,
    }


def one_by_one(cases: list[dict], tables, as_of: date, name: str, policy: Policy | None = None) -> list[Run | None]:
    """A run a case, with several jobs each: for policies that look into results."""
    out: list[Run | None] = []
    for case in cases:
        try:
            out.append(run(tables, case["user_input"], as_of, policy=policy, dataset_id=name))
        except Exception:  # noqa: BLE001  one case must not end the batch
            log.exception("case %s failed", case["case_id"])
            out.append(None)
    return out


def batch(spark, cases: list[dict], datasets: dict, out: str | Path | None = None, run_id: str = "run", *, policy: Policy | None = None) -> tuple[list[dict], dict]:
    """Run cases (what ``casefiles.load`` returns) over opened data sets by id; records and their summary.

    Under the default rules, the cases of a data set are one plan (``batched``); another policy runs them one by one. A case
    that fails is a record like any other. With ``out``, the run is published there once.
    """
    from . import batched

    done: dict[int, Run | None] = {}
    for name in dict.fromkeys(c["dataset_id"] for c in cases):
        numbers = [k for k, c in enumerate(cases, 1) if c["dataset_id"] == name]
        own = [cases[k - 1] for k in numbers]
        tables, as_of = datasets[name], common_as_of(datasets[name])
        if policy is None:
            found = batched.run(tables, [c["user_input"] for c in own], as_of, name)
        else:
            found = one_by_one(own, tables, as_of, name, policy)
        done |= zip(numbers, found)
    records = [record(k, case, done[k]) for k, case in enumerate(cases, 1)]
    for r in records:
        artifacts.check_record(r)
    rows = [(r["sequence"], r["case_id"], r["split"], r["status"]) for r in records]
    summary = artifacts.summarise(spark.createDataFrame(rows, "sequence int, case_id string, split string, status string"))
    if out is not None:
        sources = [Path(m.__file__) for m in (answers, batched, requests)] + [Path(__file__)]
        used = total_usage([r["usage"] for r in records])
        manifest = {"artifact_schema_version": "1", "policy_source_sha256": hashlib.sha256(b"".join(p.read_bytes() for p in sources)).hexdigest(), "datasets": sorted({(c["split"], c["dataset_id"], c["dataset_version"]) for c in cases}), "usage_status": "available" if used else "unavailable", "usage": used}
        artifacts.publish(out, run_id, records, summary, policy_snapshot(), manifest)
    return records, summary
