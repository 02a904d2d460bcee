"""Tools: definitions with checked inputs and outputs, and the registry that runs them.

A tool is a function of tables and arguments that returns a lazy DataFrame. Arguments are checked against the tool's
parameters before the plan is built, names and types of the columns against its output model after; nothing is computed for
either check. The rows themselves are checked where they leave the engine (``Result.payload``), as they are fetched there
anyway: each cell by the kind that the model gives its column, then all of them by the tool's validator.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date
from functools import cached_property
from math import isfinite

from pyspark.sql import DataFrame

from ..functions.values import json_safe
from ..operators import derive, lookups
from ..operators.windows import Windows

SALES, TRAFFIC, MARKETING, PRODUCT, DERIVE = "query_sales", "query_traffic", "query_marketing", "query_product", "calculate_metrics"
#: The label of the data and the warnings of empty results.
SOURCE_LABEL = "Synthetic E-commerce Data"
NO_ROWS, NO_PRIOR_ROWS = "no rows matched the request", "no rows matched the prior results"


class UnknownTool(KeyError):
    pass


class InvalidArguments(ValueError):
    pass


class InvalidResult(ValueError):
    pass


def _is_date(value) -> bool:
    try:
        return date.fromisoformat(value).isoformat() == value
    except (TypeError, ValueError):
        return False


def _distinct(value, fine: Callable[[str], bool]) -> bool:
    return isinstance(value, list) and all(isinstance(x, str) and fine(x) for x in value) and len(set(value)) == len(value)


#: Kind of a parameter: its JSON schema and its check.
KINDS: dict[str, tuple[dict, Callable[[object], bool]]] = {
    "date": ({"type": "string", "format": "date"}, _is_date),
    "flag": ({"type": "boolean"}, lambda v: isinstance(v, bool)),
    "products": ({"type": "array", "items": {"type": "string", "pattern": f"^{lookups.PRODUCT_ID.pattern}$"}, "uniqueItems": True}, lambda v: _distinct(v, lookups.PRODUCT_ID.fullmatch)),
    "metrics": ({"type": "array", "items": {"type": "string", "enum": list(derive.METRICS)}, "minItems": 1, "uniqueItems": True}, lambda v: bool(v) and _distinct(v, derive.METRICS.__contains__)),
    "groups": ({"type": "array", "items": {"type": "string", "enum": list(derive.GROUPS)}, "uniqueItems": True}, lambda v: _distinct(v, derive.GROUPS.__contains__)),
}
#: Kind of a column in an output model: its engine types and the check of a value. A kind with ``?`` may be null.
CELLS: dict[str, tuple[tuple[str, ...], Callable[[object], bool]]] = {
    "product": (("string",), lambda v: bool(lookups.PRODUCT_ID.fullmatch(v))),
    "text": (("string",), bool),
    "period": (("string",), derive.PERIODS.__contains__),
    "date": (("date",), lambda v: isinstance(v, date)),
    "count": (("int", "bigint"), lambda v: v >= 0),
    "amount": (("double", "decimal"), lambda v: isfinite(v) and v >= 0),
    "number": (("double", "decimal"), isfinite),
}


def _fits(kind: str, value) -> bool:
    return kind.endswith("?") if value is None else CELLS[kind.rstrip("?")][1](value)


WINDOW = {"start_date": "date", "end_date": "date", "comparison_start_date": "date", "comparison_end_date": "date", "product_ids": "products"}


def windows_of(arguments: dict) -> Windows:
    return Windows(*(date.fromisoformat(arguments[k]) for k in list(WINDOW)[:4]))


def window_arguments(windows: Windows, product_ids) -> dict:
    dates = (windows.start, windows.end, windows.comparison_start, windows.comparison_end)
    return {k: d.isoformat() for k, d in zip(WINDOW, dates)} | {"product_ids": list(product_ids)}


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    parameters: dict[str, str]
    #: Output model: columns of the result in order with their kinds, given the arguments.
    model: Callable[[dict], dict[str, str]]
    #: (tables, earlier results, arguments) to rows.
    handler: Callable[..., DataFrame]
    needs_products: bool = False
    empty_warning: str = NO_ROWS
    #: (arguments, rows) of a result to what is wrong with it as a whole, or None.
    validator: Callable[[dict, list[dict]], str | None] | None = None

    def columns(self, arguments: dict) -> list[str]:
        return list(self.model(arguments))

    def check_columns(self, arguments: dict, rows: DataFrame) -> None:
        """InvalidResult unless names and types of the columns are those of the output model."""
        model = self.model(arguments)
        if rows.columns != list(model):
            raise InvalidResult(f"{self.name} returned columns {rows.columns}")
        if bad := [f"{c} {kind}" for c, kind in rows.dtypes if kind.partition("(")[0] not in CELLS[model[c].rstrip("?")][0]]:
            raise InvalidResult(f"{self.name} returned other types: {bad}")

    def check_rows(self, arguments: dict, rows: list[dict]) -> None:
        """InvalidResult unless each cell is of its kind and the validator finds nothing."""
        model = self.model(arguments)
        for c, kind in model.items():
            if bad := [r[c] for r in rows if not _fits(kind, r[c])]:
                raise InvalidResult(f"{self.name} returned {c} = {bad[0]!r}, which is no {kind}")
        if problem := self.validator(arguments, rows) if self.validator else None:
            raise InvalidResult(f"{self.name}: {problem}")

    def check(self, arguments: dict) -> dict:
        if not isinstance(arguments, dict) or set(arguments) != set(self.parameters) - ({"product_ids"} - set(arguments) if self.name == MARKETING else set()):
            raise InvalidArguments(f"{self.name} takes {sorted(self.parameters)}")
        bad = [k for k, v in arguments.items() if not KINDS[self.parameters[k]][1](v)]
        if bad or (self.needs_products and not arguments["product_ids"]):
            raise InvalidArguments(f"{self.name}: bad {bad or ['product_ids']}")
        if "start_date" in self.parameters:
            try:
                windows_of(arguments)
            except ValueError as e:
                raise InvalidArguments(f"{self.name}: {e}") from e
        return {"product_ids": [], **arguments} if "product_ids" in self.parameters else arguments

    def schema(self) -> dict:
        properties = {k: dict(KINDS[kind][0]) for k, kind in self.parameters.items()}
        if self.needs_products:
            properties["product_ids"]["minItems"] = 1
        return {"type": "object", "properties": properties, "required": list(self.parameters), "additionalProperties": False}


@dataclass(frozen=True)
class Result:
    """Rows of a tool with what they came from."""

    number: int
    definition: Tool
    arguments: dict
    rows: DataFrame
    dataset_id: str
    source_label: str = SOURCE_LABEL

    @property
    def tool(self) -> str:
        return self.definition.name

    @property
    def columns(self) -> tuple[str, ...]:
        return tuple(self.rows.columns)

    @property
    def result_id(self) -> str:
        return f"result_{self.number:04d}"

    @cached_property
    def warnings(self) -> list[str]:
        """One row is looked for, once."""
        return [self.definition.empty_warning] if self.rows.isEmpty() else []

    def payload(self, limit: int = 100_000) -> dict:
        """The result as JSON values; more than ``limit`` rows are an error, not a cut."""
        found = self.rows.limit(limit + 1).collect()
        if len(found) > limit:
            raise InvalidResult(f"{self.tool} returned more than {limit} rows")
        self.definition.check_rows(self.arguments, [r.asDict() for r in found])
        rows = [{c: json_safe(r[c]) for c in self.columns} for r in found]
        return {"result_id": self.result_id, "tool_name": self.tool, "dataset_id": self.dataset_id, "source_label": self.source_label, "columns": list(self.columns), "rows": rows, "row_count": len(rows), "warnings": self.warnings}


class Registry:
    def __init__(self):
        self._tools: dict[str, Tool] = {}

    def register(self, tool: Tool) -> None:
        if tool.name in self._tools:
            raise ValueError(f"{tool.name} is registered already")
        self._tools[tool.name] = tool

    def get(self, name: str) -> Tool:
        if name not in self._tools:
            raise UnknownTool(name)
        return self._tools[name]

    @property
    def names(self) -> list[str]:
        return sorted(self._tools)

    def export(self) -> list[dict]:
        """The tools as function descriptions, by name."""
        return [{"type": "function", "function": {"name": n, "description": self._tools[n].description, "parameters": self._tools[n].schema()}} for n in self.names]

    def invoke(self, name: str, arguments: dict, tables, *, earlier: list[Result] = (), dataset_id: str = "") -> Result:
        tool = self.get(name)
        arguments = tool.check(arguments)
        try:
            rows = tool.handler(tables, earlier, arguments)
        except ValueError as e:
            raise InvalidArguments(f"{name}: {e}") from e
        tool.check_columns(arguments, rows)
        return Result(len(earlier) + 1, tool, arguments, rows, dataset_id)


def executions(earlier: list[Result]) -> list[derive.Execution]:
    """Window results in the form that metrics are derived from."""
    flags = lambda a: {k: a[k] for k in ("include_refunds", "include_missing") if k in a}
    return [
        derive.Execution(r.tool, windows_of(r.arguments), r.rows, tuple(r.arguments["product_ids"]), **flags(r.arguments), dataset_id=r.dataset_id, source_label=r.source_label, grouped=True)
        for r in earlier
        if r.tool in derive.SUMS
    ]


PRODUCT_ROW = {"product_id": "product", "product_name": "text", "category": "text", "price": "amount", "cost": "amount", "launch_date": "date"}
SALES_ROW = {"period": "period", "product_id": "product", "category": "text", "region": "text", "channel": "text", "gmv": "amount", "orders": "count", "units": "count", "refund_orders": "count"}
TRAFFIC_ROW = {"period": "period", "product_id": "product", "category": "text", "impressions": "count", "clicks": "count", "visits": "count", "observed_days": "count", "missing_days": "count"}
MARKETING_ROW = {"period": "period", "product_id": "product", "category": "text", "campaign_id": "text", "spend": "amount"}
#: Derived metrics that are counts, or may be of either sign; the others are amounts. Ratios are null where they have no value.
COUNTED = ("orders", "impressions", "clicks", "visits", "days")
SIGNED = ("change", "rate", "value")


def metric_kind(name: str) -> str:
    last = name.rpartition("_")[2]
    if last in COUNTED:
        return "count"
    return "number?" if last in SIGNED else "amount" if last in ("gmv", "spend") else "amount?"


def _repeats(rows: list[dict], keys) -> bool:
    return len({tuple(r[k] for k in keys) for r in rows}) != len(rows)


def _window_rows(tool: str):
    """Each key once, only products that were asked for, refunds among orders, and all days of a window accounted for."""

    def problem(arguments: dict, rows: list[dict]) -> str | None:
        asked, windows = set(arguments["product_ids"]), windows_of(arguments)
        if _repeats(rows, derive.KEYS[tool]):
            return "a key repeats"
        if asked and any(r["product_id"] not in asked for r in rows):
            return "a product that was not asked for"
        if tool == SALES and any(r["refund_orders"] > r["orders"] for r in rows):
            return "more refunds than orders"
        if tool == TRAFFIC and any(r["observed_days"] + r["missing_days"] != windows.days(r["period"]) for r in rows):
            return "days don't add up to the window"
        return None

    return problem


def _product_rows(arguments: dict, rows: list[dict]) -> str | None:
    if _repeats(rows, ["product_id"]):
        return "a product repeats"
    return None if {r["product_id"] for r in rows} <= set(arguments["product_ids"]) else "a product that was not asked for"


def _metric_rows(arguments: dict, rows: list[dict]) -> str | None:
    if not arguments["group_by"] and len(rows) != 1:
        return "one row was to be expected"
    return "a group repeats" if _repeats(rows, arguments["group_by"] or ()) and arguments["group_by"] else None


def default_registry() -> Registry:
    registry = Registry()
    window = lambda f, *flags: lambda t, _, a: f(t, windows_of(a), a["product_ids"], *(a[x] for x in flags))
    metrics = lambda a: {g: "product" if g == "product_id" else "text" for g in a["group_by"]} | {m: metric_kind(m) for m in a["metrics"]}
    for tool in (
        Tool(PRODUCT, "Products by id", {"product_ids": "products"}, lambda a: PRODUCT_ROW, lambda t, _, a: lookups.query_product(t, a["product_ids"]), needs_products=True, validator=_product_rows),
        Tool(SALES, "Sales of two windows", WINDOW | {"include_refunds": "flag"}, lambda a: SALES_ROW, window(lookups.query_sales, "include_refunds"), validator=_window_rows(SALES)),
        Tool(TRAFFIC, "Traffic of two windows", WINDOW | {"include_missing": "flag"}, lambda a: TRAFFIC_ROW, window(lookups.query_traffic, "include_missing"), validator=_window_rows(TRAFFIC)),
        Tool(MARKETING, "Marketing spend of two windows", WINDOW, lambda a: MARKETING_ROW, window(lookups.query_marketing), validator=_window_rows(MARKETING)),
        Tool(DERIVE, "Metrics derived from earlier results", {"metrics": "metrics", "group_by": "groups"}, metrics, lambda t, earlier, a: derive.calculate_metrics(executions(earlier), a["metrics"], a["group_by"]), empty_warning=NO_PRIOR_ROWS, validator=_metric_rows),
    ):
        registry.register(tool)
    return registry
