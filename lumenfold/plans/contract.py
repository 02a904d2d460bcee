"""Tasks, capabilities and the tool contract of evaluation cases."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from pathlib import Path

# Names in their order, weights, rules and frozen keys.
TASK_RULES = {
    "gmv_diagnosis": "gmv_change",
    "product_anomaly": "product_anomalies",
    "conversion_decline": "conversion_decline",
    "products_to_watch": "products_to_watch",
    "next_week_priority": "next_week_priorities",
}
#: Order of the cases.
TASKS = ("gmv_diagnosis", "product_anomaly", "conversion_decline", "products_to_watch", "next_week_priority")
WEIGHTS = {
    "basic_query": 0,
    "metric_calculation": 2,
    "tool_selection": 1,
    "parameter_selection": 1,
    "multi_step_reasoning": 5,
    "anomaly_detection": 3,
    "root_cause_analysis": 6,
    "recommendation": 6,
    "data_insufficiency": 4,
    "adversarial_distractor": 4,
}
CAPABILITIES = tuple(WEIGHTS)
SPLITS = ("development", "public_validation")
#: Task, capability and variant of the public validation split.
VALIDATION = (
    ("gmv_diagnosis", "adversarial_distractor", 1),
    ("gmv_diagnosis", "adversarial_distractor", 2),
    ("product_anomaly", "adversarial_distractor", 1),
    ("gmv_diagnosis", "anomaly_detection", 1),
    ("gmv_diagnosis", "anomaly_detection", 2),
    ("product_anomaly", "anomaly_detection", 1),
    ("gmv_diagnosis", "basic_query", 1),
    ("gmv_diagnosis", "basic_query", 2),
    ("product_anomaly", "basic_query", 1),
    ("product_anomaly", "data_insufficiency", 2),
    ("conversion_decline", "data_insufficiency", 1),
    ("conversion_decline", "data_insufficiency", 2),
    ("product_anomaly", "metric_calculation", 2),
    ("conversion_decline", "metric_calculation", 1),
    ("conversion_decline", "metric_calculation", 2),
    ("product_anomaly", "multi_step_reasoning", 2),
    ("products_to_watch", "multi_step_reasoning", 1),
    ("products_to_watch", "multi_step_reasoning", 2),
    ("conversion_decline", "parameter_selection", 1),
    ("conversion_decline", "parameter_selection", 2),
    ("products_to_watch", "parameter_selection", 1),
    ("products_to_watch", "recommendation", 1),
    ("next_week_priority", "recommendation", 1),
    ("next_week_priority", "recommendation", 2),
    ("products_to_watch", "root_cause_analysis", 2),
    ("next_week_priority", "root_cause_analysis", 1),
    ("next_week_priority", "root_cause_analysis", 2),
    ("products_to_watch", "tool_selection", 2),
    ("next_week_priority", "tool_selection", 1),
    ("next_week_priority", "tool_selection", 2),
)
#: Task to the task whose evidence an insufficiency case reads, what that evidence can answer, and what it can't.
INSUFFICIENT = {
    "gmv_diagnosis": ("product_anomaly", ("gmv_change_rate", "aov_change_rate"), ("traffic_change_rate", "current_cvr", "cvr_change")),
    "product_anomaly": ("product_anomaly", ("current_observed_days", "previous_observed_days"), ("traffic_change_rate", "current_cvr", "cvr_change")),
    "conversion_decline": ("product_anomaly", ("previous_cvr", "current_observed_days", "previous_observed_days"), ("current_cvr", "cvr_change")),
    "products_to_watch": ("products_to_watch", ("gmv_change_rate", "refund_rate", "current_observed_days", "previous_observed_days"), ("current_cvr", "cvr_change")),
    "next_week_priority": ("next_week_priority", ("evidence_value", "current_observed_days", "previous_observed_days"), ("current_cvr", "cvr_change")),
}
INSUFFICIENT_PRODUCT = "P005"
TOP = {"gmv_diagnosis": 1, "product_anomaly": 3, "conversion_decline": 3, "products_to_watch": 3, "next_week_priority": 3}
WINDOW = ("start_date", "end_date", "comparison_start_date", "comparison_end_date", "product_ids")


@dataclass(frozen=True)
class Contract:
    version: str
    parameters: dict[str, tuple[str, ...]]
    paths: dict[str, tuple[str, ...]]
    overrides: dict[str, dict]
    sha256: str = "0" * 64

    def tools(self, task: str, capability: str) -> list[str]:
        """The tools of a case, in order: the task's path or the capability's own, after what the capability prepends."""
        override = self.overrides.get(capability, {})
        path = override.get("paths", {}).get(task, self.paths[task])
        return list(dict.fromkeys([*override.get("prepend_tools", ()), *path]))


#: The published contract.
DEFAULT = Contract(
    "1.0",
    {"query_product": ("product_ids",), "query_sales": (*WINDOW, "include_refunds"), "query_traffic": (*WINDOW, "include_missing"), "calculate_metrics": ("metrics", "group_by")},
    {
        "gmv_diagnosis": ("query_sales", "calculate_metrics"),
        "product_anomaly": ("query_product", "query_sales", "query_traffic", "calculate_metrics"),
        "conversion_decline": ("query_traffic", "query_sales", "calculate_metrics"),
        "products_to_watch": ("query_sales", "query_traffic", "calculate_metrics"),
        "next_week_priority": ("query_sales", "query_traffic", "calculate_metrics"),
    },
    {
        "data_insufficiency": {"paths": {"product_anomaly": ("query_product", "query_traffic"), "next_week_priority": ("query_traffic",)}},
        "adversarial_distractor": {"prepend_tools": ("query_product",)},
    },
)


def _names(value, known=None) -> tuple[str, ...]:
    fine = isinstance(value, list) and value and all(isinstance(x, str) and x and (known is None or x in known) for x in value)
    if not fine:
        raise ValueError(f"not a list of {'known ' if known else ''}names: {value!r}")
    return tuple(value)


def load(path: str | Path) -> Contract:
    """A contract from YAML; anything it doesn't define, or defines twice, is a ValueError."""
    import yaml

    raw = Path(path).read_bytes()
    top = yaml.safe_load(raw.decode("utf-8"))
    shape = {"contract_version": str, "tools": dict, "paths": dict, "capability_overrides": dict}
    if not isinstance(top, dict) or any(not isinstance(top.get(k), t) for k, t in shape.items()):
        raise ValueError("the contract lacks a section")
    if set(top["paths"]) != set(TASKS):
        raise ValueError("the contract must give a path for each task")
    if any(not isinstance(spec, dict) for spec in top["tools"].values()):
        raise ValueError("a tool has no specification")
    parameters = {tool: _names(spec.get("required_parameters")) for tool, spec in top["tools"].items()}
    if any(len(set(p)) != len(p) for p in parameters.values()):
        raise ValueError("a tool repeats a parameter")
    paths = {task: _names(tools, parameters) for task, tools in top["paths"].items()}
    overrides = {}
    for capability, override in top["capability_overrides"].items():
        if capability not in WEIGHTS or not isinstance(override, dict) or set(override) - {"paths", "prepend_tools"}:
            raise ValueError(f"bad override {capability}")
        own = override.get("paths", {})
        if not isinstance(own, dict) or set(own) - set(TASKS):
            raise ValueError(f"bad paths of override {capability}")
        overrides[capability] = {"paths": {task: _names(tools, parameters) for task, tools in own.items()}}
        if "prepend_tools" in override:
            overrides[capability]["prepend_tools"] = _names(override["prepend_tools"], parameters)
    return Contract(top["contract_version"], parameters, paths, overrides, hashlib.sha256(raw).hexdigest())
