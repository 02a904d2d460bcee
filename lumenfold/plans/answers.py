"""Answers: which rows are shown, whether the evidence allows a conclusion, and the lines as text columns.

Rows are ordered, cut to five and formatted by the engine; at most five finished lines reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formats
from ..functions.requests import Request

TOP = 5
# Phrases, the fields of each task in order with their labels and formats, and the order of its rows.
INSUFFICIENT = "数据不足：{}，无法形成结论。"
REASONS = {"warning": "工具结果包含警告", "no_metrics": "缺少指标结果", "empty": "指标结果为空", "no_task": "任务类型不受支持"}
LIMITED = "限制：实际输出行存在数据不足；以下仅展示工具返回值，不形成肯定判断。"
CONCLUSIONS = {
    "gmv_diagnosis": "结论：当前 GMV、订单量与客单价相对对照期的变化如下。",
    "conversion_decline": "结论：转化、访问与订单的同期变化如下，不据此作因果判断。",
    "product_anomaly": "结论：以下商品指标出现同步变化，仅陈述工具证据。",
    "next_week_priority": "结论：以下商品可按冻结指标顺序进入下周关注队列。",
    "products_to_watch": "结论：以下商品具有工具结果返回的关注信号。",
}
FIELDS = {
    "gmv_diagnosis": (
        (("current_gmv", "当前 GMV", "money"), ("previous_gmv", "对照 GMV", "money"), ("gmv_change_rate", "GMV 变化", "rate")),
        (("current_orders", "当前订单", "count"), ("previous_orders", "对照订单", "count")),
        (("current_aov", "当前客单价", "money"), ("previous_aov", "对照客单价", "money"), ("aov_change_rate", "客单价变化", "rate")),
    ),
    "conversion_decline": (
        (("current_cvr", "当前转化率", "rate"), ("previous_cvr", "对照转化率", "rate"), ("cvr_change", "转化率变化", "rate"), ("cvr_change_rate", "转化率相对变化", "rate")),
        (("current_visits", "当前访问", "count"), ("previous_visits", "对照访问", "count"), ("current_orders", "当前订单", "count"), ("previous_orders", "对照订单", "count")),
        (("current_observed_days", "当前观测天数", "count"), ("previous_observed_days", "对照观测天数", "count")),
    ),
    "product_anomaly": ((
        ("current_gmv", "当前 GMV", "money"), ("previous_gmv", "对照 GMV", "money"), ("gmv_change_rate", "GMV 变化", "rate"), ("current_orders", "当前订单", "count"), ("previous_orders", "对照订单", "count"),
        ("current_refund_rate", "退款率", "rate"), ("current_visits", "当前访问", "count"), ("previous_visits", "对照访问", "count"), ("traffic_change_rate", "访问变化", "rate"), ("current_ctr", "当前点击率", "rate"),
        ("previous_ctr", "对照点击率", "rate"), ("current_cvr", "当前转化率", "rate"), ("previous_cvr", "对照转化率", "rate"), ("cvr_change", "转化率变化", "rate"),
    ),),
    "next_week_priority": ((
        ("current_gmv", "当前 GMV", "money"), ("gmv_change_rate", "GMV 变化", "rate"), ("current_visits", "当前访问", "count"), ("traffic_change_rate", "访问变化", "rate"), ("current_cvr", "当前转化率", "rate"), ("cvr_change", "转化率变化", "rate"),
    ),),
    "products_to_watch": ((
        ("evidence_value", "证据值", "rate"), ("gmv_change_rate", "GMV 变化", "rate"), ("traffic_change_rate", "访问变化", "rate"), ("cvr_change", "转化率变化", "rate"), ("current_refund_rate", "退款率", "rate"),
    ),),
}
ORDER = {
    "product_anomaly": ("gmv_change_rate", "asc"),
    "conversion_decline": ("cvr_change", "asc"),
    "next_week_priority": ("gmv_change_rate", "asc"),
    "products_to_watch": ("evidence_value", "desc"),
}
FORMATS = {"money": formats.money, "count": formats.count, "rate": formats.rate}


def shown_rows(task: str, metrics: DataFrame, top: int = TOP) -> DataFrame:
    """The rows of an answer with their rank: the first ``top`` in the task's order (missing values last in either
    direction, then by id), or the only row of an ungrouped result."""
    if "product_id" not in metrics.columns:
        return metrics.limit(1).withColumn("rank", F.lit(1))
    column, direction = ORDER[task]
    order = [F.col(column).asc_nulls_last() if direction == "asc" else F.col(column).desc_nulls_last(), F.col("product_id").asc_nulls_last()]
    cut = metrics.orderBy(*order).limit(top)  # the rank is counted over these few rows only
    return cut.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def answer_lines(task: str, metrics: DataFrame, names: DataFrame | None = None, top: int = TOP) -> DataFrame:
    """rank, part, line, missing: the formatted lines, and whether a value of the row is missing.

    ``names``: product_id and product_name, for labels; a product without a name is shown by its id.
    """
    rows = shown_rows(task, metrics, top)
    missing = F.exists(F.array(*[F.col(c).isNull() for c in metrics.columns]), lambda x: x)
    grouped = "product_id" in metrics.columns
    parts = [tuple(f for part in FIELDS[task] for f in part)] if grouped else FIELDS[task]
    label = F.lit("")
    if grouped:
        shown = F.coalesce("product_id", F.lit(formats.NO_DATA))
        if names is not None and task in ("product_anomaly", "next_week_priority", "products_to_watch"):
            rows = rows.join(names.select("product_id", "product_name"), "product_id", "left")
            shown = F.coalesce(F.concat("product_name", F.lit("（"), "product_id", F.lit("）")), shown)
        label = F.concat(shown, F.lit("："))
    text = lambda part: F.concat(F.lit("- "), label, F.concat_ws("；", *[F.concat(F.lit(f"{name} "), FORMATS[kind](F.col(c))) for c, name, kind in part]))
    lines = F.posexplode(F.array(*[text(part) for part in parts])).alias("part", "line")
    return rows.select("rank", missing.alias("missing"), lines).select("rank", "part", "line", "missing").orderBy("rank", "part")


def render(request: Request, results: list) -> str:
    """The answer to a request from the results of its tools; a warning or missing evidence leaves no conclusion."""
    by_tool = {r.tool: r for r in results}
    if len(by_tool) != len(results):
        raise ValueError("a tool has two results")
    w = request.windows
    labels = "、".join(dict.fromkeys(r.source_label for r in results)) or formats.NO_DATA
    head = [f"数据来源：{labels}。", f"时间窗口：当前期 {w.start} 至 {w.end}；对照期 {w.comparison_start} 至 {w.comparison_end}。"]
    reason, lines = None, []
    if any(r.warnings for r in results):
        reason = "warning"
    elif "calculate_metrics" not in by_tool:
        reason = "no_metrics"
    elif request.task not in FIELDS:
        reason = "no_task"
    else:
        names = by_tool["query_product"].rows if "query_product" in by_tool else None
        lines = answer_lines(request.task, by_tool["calculate_metrics"].rows, names).collect()  # five rows at most
        reason = None if lines else "empty"
    if reason:
        return "\n".join([*head, INSUFFICIENT.format(REASONS[reason])])
    return "\n".join([*head, LIMITED if any(r.missing for r in lines) else CONCLUSIONS[request.task], *[r.line for r in lines]])
