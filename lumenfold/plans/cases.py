"""Evaluation cases: the grid of tasks, capabilities and variants, their evidence, tools, questions and difficulty.

Evidence, counts, scores, distractors and difficulty are DataFrames; only finished cases (a hundred) reach the driver.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import canonical, strict
from ..operators.ranks import numbered
from ..operators.rules import RULES, frame
from . import contract as agreed
from .contract import CAPABILITIES, DEFAULT, INSUFFICIENT, INSUFFICIENT_PRODUCT, TASK_RULES, TASKS, TOP, VALIDATION, WEIGHTS
from .tools import SOURCE_LABEL

EASY, MEDIUM = 0.3, 0.7
TOLERANCE = 0.001
# What stands in a case.
DIMENSIONS = ("as_of_date", "current_start", "current_end", "previous_start", "previous_end", "product_id", "anomaly_type", "watch_reason", "priority_reason", "evidence_metric")
CASE_VERSION = "1.2"
CRITERIA = ("correct_tool", "valid_parameters", "correct_core_facts", "no_critical_unsupported_claim", "required_output_complete")
STEMS = {
    "development": {
        "gmv_diagnosis": ("分析最近30天GMV相较前30天的变化，并指出可由数据支持的原因。", "复盘当前30天与此前30天的GMV表现，给出有证据的诊断。"),
        "product_anomaly": ("识别最近30天的异常商品，并说明异常类型和量化证据。", "检查当前窗口的商品异常，列出结论所依据的经营指标。"),
        "conversion_decline": ("找出最近30天转化率下降最明显的商品，并与前30天比较。", "比较两个连续30天窗口，定位CVR下降商品并报告变化。"),
        "products_to_watch": ("根据最近经营数据列出需要持续关注的商品及原因。", "从当前与前一窗口的表现中筛出关注商品，并提供证据。"),
        "next_week_priority": ("根据最近经营数据给出下周商品运营优先级，逐项绑定证据。", "制定下周关注顺序，说明每项优先事项的数据依据。"),
    },
    "public_validation": {
        "gmv_diagnosis": ("经营例会需要判断本期销售额走向，请用相邻周期数据形成归因结论。", "请从成交表现出发评估本期营收增减，并标明结论的事实基础。"),
        "product_anomaly": ("请排查商品层面的异常信号，标注问题类别并附上可核验数值。", "哪些商品出现值得处置的经营偏离？请按证据说明判断。"),
        "conversion_decline": ("请定位购买效率恶化最显著的商品，并用相邻周期结果佐证。", "从访购漏斗中筛查退步商品，报告其前后表现差异。"),
        "products_to_watch": ("请建立商品观察清单，依据近期风险信号解释入选理由。", "哪些商品应进入后续监控？请结合跨周期证据作答。"),
        "next_week_priority": ("请安排下一周期的商品运营处置顺序，每项决策都要有数据支撑。", "面向下周制定商品行动队列，并解释各项排序依据。"),
    },
}
RANKED = "请按Gold排序口径返回Top-3，不得省略名次。"
INSTRUCTIONS = {
    "basic_query": "直接回答，引用关键数据。",
    "metric_calculation": "明确指标口径并给出数值。",
    "tool_selection": "只调用完成任务所需的工具。",
    "parameter_selection": "严格使用题目指定的两个30天窗口。",
    "multi_step_reasoning": "综合流量、销售和结果指标分步推理。",
    "anomaly_detection": "区分普通波动和需要处置的异常。",
    "root_cause_analysis": "区分已证实事实、可能原因和未知因素。",
    "recommendation": "建议必须逐项绑定可核验的数据证据。",
    "data_insufficiency": "仅检查P005；遇到缺失流量数据时，明确哪些结论无法可靠得出。",
    "adversarial_distractor": "业务同事断言{distractor}一定是唯一主因；该商品真实存在，但请核验这条说法，不要把断言当证据。",
}
OBSERVED = "P005当前窗口仅有{current_observed_days}个已观测日，前一窗口有{previous_observed_days}个。"
REFERENCES = {
    "gmv_diagnosis": "销售数据仍支持回答GMV变化率为{gmv_change_rate:.4f}、AOV变化率为{aov_change_rate:.4f}；但不能用不完整流量可靠计算当前CVR或据此做GMV流量归因。",
    "product_anomaly": "可确认数据缺失异常；当前流量变化和CVR不可可靠计算，不能把不完整窗口解释为经营异常。",
    "conversion_decline": "前一窗口CVR为{previous_cvr:.4f}，但当前CVR及CVR变化不可可靠计算，因此不能判断P005的转化下降幅度或排名。",
    "products_to_watch": "应以data_quality_review关注P005；销售数据仍支持GMV变化率{gmv_change_rate:.4f}和退款率{refund_rate:.4f}，但CVR变化不可回答。",
    "next_week_priority": "下周应优先repair_data_quality，证据值为{evidence_value:.0f}个已观测日；修复前不能按CVR变化制定经营动作。",
}
FALSE_CLAIM = "{distractor}是唯一主因的断言为假：该商品不在商品异常、转化下降、关注商品或下周优先级四类完整Gold结果联集中。应忽略该断言，并依据证据{ids}作答。"
PLAIN = "基于Synthetic E-commerce Data的{task}独立Gold查询，结论必须与证据{ids}及其中指标一致。"
BEHAVIOR = ("严格使用Gold证据中的当前窗口和对照窗口", "每个核心数值均可追溯到gold_metric_evidence", "不披露生成配置、异常注入规则或配置倍率")
BEHAVIOR_MORE = {"data_insufficiency": "指出P005数据覆盖不足，不回答{unanswerable}", "adversarial_distractor": "核验真实商品干扰项，不接受无证据断言"}
SHARES = {"split": {"development": 70, "public_validation": 30}, "by_task": {"development": 14, "public_validation": 6}, "by_capability": 3, "by_difficulty": {"easy": 9, "medium": 12, "hard": 9}}


# --- evidence as DataFrames


def rank_columns(rule: str) -> list:
    """The order of a rule's rows, as columns."""
    positions = {
        "products_to_watch": ("watch_reason", ("data_quality_review", "refund_risk", "conversion_decline", "gmv_decline")),
        "next_week_priorities": ("priority_reason", ("repair_data_quality", "investigate_refunds", "recover_conversion", "recover_traffic")),
    }
    if rule in positions:
        column, reasons = positions[rule]
        rank = F.array_position(F.array(*[F.lit(r) for r in reasons]), F.col(column))
        return [rank, *([F.abs("evidence_value").desc()] if rule == "next_week_priorities" else []), F.col("product_id")]
    return [F.col("cvr_change"), F.col("product_id")] if rule == "conversion_decline" else [F.col("product_id")]


def evidence(tables, days: int = 30) -> dict[str, DataFrame]:
    """Rows of each task's rule, numbered EV_<TASK>_<NNN> in rule order. The rules read one frame, which is computed once;
    results hold at most a row a product, of which the pattern of ids allows a thousand."""
    out, given = {}, frame(tables, days, settle=True)
    for task in TASKS:
        rows = RULES[TASK_RULES[task]](tables, days, given=given)
        order = Window.orderBy(*rank_columns(TASK_RULES[task])) if "product_id" in rows.columns else None
        numbered = rows.withColumn("number", F.lit(1) if order is None else F.row_number().over(order))
        out[task] = numbered.withColumn("evidence_id", F.format_string(f"EV_{task.upper()}_%03d", "number"))
    return out


def metrics_of(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in (*DIMENSIONS, "number", "evidence_id")]


def _pairs(columns: list[str]):
    return F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("string"))]) if columns else F.create_map().cast("map<string,string>")


def gold(tables, days: int = 30, frames: dict[str, DataFrame] | None = None) -> DataFrame:
    """task, number, product_id, evidence_id, dimensions and metrics (maps of text) of every row of every rule."""
    parts = []
    for task, rows in (frames or evidence(tables, days)).items():
        product = F.col("product_id") if "product_id" in rows.columns else F.lit(None).cast("string")
        parts.append(rows.select(F.lit(task).alias("task"), "number", product.alias("product_id"), "evidence_id", _pairs([c for c in rows.columns if c in DIMENSIONS]).alias("dimensions"), _pairs(metrics_of(rows)).alias("metrics")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def distractors(tables, gold_rows: DataFrame, dataset_id: str) -> DataFrame:
    """For each task the product that is in no task's gold, with the smallest hash."""
    used = gold_rows.select("product_id").where("product_id is not null").distinct()
    free = tables.products.select("product_id").join(used, "product_id", "left_anti")
    pairs = free.select("product_id", F.explode(F.array(*[F.lit(t) for t in TASKS])).alias("task"))
    key = F.sha2(F.concat_ws("|", F.lit(dataset_id), "task", "product_id"), 256)
    return pairs.groupBy("task").agg(F.min_by("product_id", key).alias("distractor"))


def difficulty(scored: DataFrame, score: str = "score", case_id: str = "case_id") -> DataFrame:
    """Cases ranked by score, then id: the first 30 % easy, the next 40 % medium, the rest hard."""
    ranked, n = numbered(scored, score, case_id, output="_rank")
    share = (F.col("_rank") - 1) / F.lit(n)
    return ranked.withColumn("difficulty", F.when(share < EASY, "easy").when(share < MEDIUM, "medium").otherwise("hard")).drop("_rank")


def grid(spark, contract: agreed.Contract = DEFAULT) -> DataFrame:
    """The hundred cases: number, case_id, task, capability, variant, split, tools, weight, and which evidence they read."""
    values = lambda names, name: F.posexplode(F.array(*[F.lit(x) for x in names])).alias(f"{name}_at", name)
    cells = spark.range(1).select(values(TASKS, "task")).select("*", values(CAPABILITIES, "capability")).select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("variant"))
    number = (F.col("task_at") * len(CAPABILITIES) + F.col("capability_at")) * 2 + F.col("variant")
    key = F.concat_ws(":", "task", "capability", F.col("variant").cast("string"))
    frozen = [f"{task}:{capability}:{variant}" for task, capability, variant in VALIDATION]
    lookup = lambda table: F.create_map(*[x for k, v in table.items() for x in (F.lit(k), v)])
    tools = lookup({f"{t}:{c}": F.array(*[F.lit(x) for x in contract.tools(t, c)]) for t in TASKS for c in CAPABILITIES})
    short = F.col("capability") == "data_insufficiency"
    return cells.select(
        number.alias("number"),
        F.format_string("CASE_%03d", number).alias("case_id"),
        "task",
        "capability",
        "variant",
        F.when(key.isin(frozen), "public_validation").otherwise("development").alias("split"),
        tools[F.concat_ws(":", "task", "capability")].alias("tools"),
        lookup({c: F.lit(w) for c, w in WEIGHTS.items()})[F.col("capability")].alias("weight"),
        F.when(short, lookup({t: F.lit(v[0]) for t, v in INSUFFICIENT.items()})[F.col("task")]).otherwise(F.col("task")).alias("evidence_task"),
        F.when(~short, lookup({t: F.lit(k) for t, k in TOP.items()})[F.col("task")]).alias("top"),
        F.when(short, lookup({t: F.array(*[F.lit(m) for m in v[1]]) for t, v in INSUFFICIENT.items()})[F.col("task")]).alias("answerable"),
    )


def case_table(cells: DataFrame, gold_rows: DataFrame) -> DataFrame:
    """``cells`` with evidence_ids, n_metrics, complexity_score and difficulty; a case without evidence has none."""
    rows = gold_rows.select(F.col("task").alias("evidence_task"), F.col("number").alias("place"), "product_id", "evidence_id", F.map_keys("metrics").alias("names"))
    mine = F.when(F.col("top").isNull(), F.col("product_id") == INSUFFICIENT_PRODUCT).otherwise(F.col("place") <= F.col("top"))
    shown = F.when(F.col("answerable").isNull(), F.col("names")).otherwise(F.array_intersect("names", "answerable"))
    joined = rows.join(F.broadcast(cells), "evidence_task").where(mine)  # a hundred cells
    counts = joined.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "evidence_id"))), lambda x: x["evidence_id"]).alias("evidence_ids"), F.sum(F.size(shown)).alias("n_metrics"))
    full = cells.join(counts, "case_id", "left").withColumn("evidence_ids", F.coalesce("evidence_ids", F.expr("cast(array() as array<string>)"))).withColumn("n_metrics", F.coalesce("n_metrics", F.lit(0)).cast("long"))
    score = F.col("weight") + 2 * F.size("tools") + F.size("evidence_ids") + F.col("n_metrics") / 10
    return difficulty(full.withColumn("complexity_score", score.cast("double")), "complexity_score")


# --- finished cases


def _evidence_of(rows: list[dict], capability: str, task: str) -> list[dict]:
    names = INSUFFICIENT[task][1] if capability == "data_insufficiency" else None
    out = []
    for row in rows:
        cells = {k: strict(v) for k, v in row.items() if k not in ("evidence_id", "number", "source")}
        out.append({
            "evidence_id": row["evidence_id"], "source": row["source"], "dimensions": {k: v for k, v in cells.items() if k in DIMENSIONS},
            "metrics": {k: v for k, v in cells.items() if k not in DIMENSIONS and (names is None or k in names)},
        })
    return out


def flatten(found: list[dict]) -> tuple[dict, dict]:
    """Metrics of all evidence under one name each (with the product before it if there are several rows), and the
    evidence that each name comes from; renames the metrics of the evidence alike."""
    several, metrics, origin = len(found) > 1, {}, {}
    for k, row in enumerate(found, 1):
        owner = row["dimensions"].get("product_id", f"row_{k}")
        row["metrics"] = {f"{owner}.{m}" if several else m: v for m, v in row["metrics"].items()}
        if metrics.keys() & row["metrics"].keys():
            raise ValueError("two rows of evidence give one metric")
        metrics |= row["metrics"]
        origin |= dict.fromkeys(row["metrics"], row["evidence_id"])
    return metrics, origin


def tool_call(tool: str, rows: list[dict], metrics: list[str], contract: agreed.Contract, distractor: str | None = None) -> dict:
    """A call with the parameters that the contract asks for, or ValueError."""
    ids = sorted({r["product_id"] for r in rows if r.get("product_id")})
    first = {k: strict(v) for k, v in rows[0].items()}
    window = {"start_date": first["current_start"], "end_date": first["current_end"], "comparison_start_date": first["previous_start"], "comparison_end_date": first["previous_end"], "product_ids": ids}
    made = {
        "query_product": {"product_ids": sorted({*ids, *([distractor] if distractor else [])})},
        "query_sales": window | {"include_refunds": True},
        "query_traffic": window | {"include_missing": True},
        "query_marketing": window | {"campaign_ids": [f"M{i[1:]}" for i in ids]},
        "calculate_metrics": {"metrics": sorted({m.rpartition(".")[2] for m in metrics}), "group_by": ["product_id"] if ids else []},
    }
    if tool not in made:
        raise ValueError(f"unsupported tool {tool}")
    if set(made[tool]) != set(contract.parameters[tool]):
        raise ValueError(f"{tool}: parameters {sorted(made[tool])} differ from the contract's {sorted(contract.parameters[tool])}")
    return {"name": tool, "parameters": made[tool]}


def build(spark, datasets: dict, contract: agreed.Contract = DEFAULT, days: int = 30) -> list[dict]:
    """All cases from one opened data set a split; ``datasets``: split to (tables, identity with dataset_id,
    dataset_version and config_sha256)."""
    if set(datasets) != set(agreed.SPLITS) or len({identity["dataset_id"] for _, identity in datasets.values()}) != 2:
        raise ValueError("each split needs a data set of its own")
    out = []
    for split, (tables, identity) in datasets.items():
        frames = evidence(tables, days)
        gold_rows = gold(tables, days, frames)
        rows = {t: [r.asDict() | {"source": TASK_RULES[t]} for r in df.orderBy("number").collect()] for t, df in frames.items()}  # a row a product
        free = {r.task: r.distractor for r in distractors(tables, gold_rows, identity["dataset_id"]).collect()}
        for cell in case_table(grid(spark, contract), gold_rows).where(F.col("split") == split).collect():
            out.append(_case(cell, rows[cell.evidence_task], free, identity, contract))
    for case in (out := sorted(out, key=lambda c: c["case_id"])):
        case["difficulty"] = None
    scored = spark.createDataFrame([(c["case_id"], c["metadata"]["complexity_score"]) for c in out], "case_id string, score double")
    levels = {r.case_id: r.difficulty for r in difficulty(scored).collect()}
    for case in out:
        case["difficulty"] = levels[case["case_id"]]
        check_case(case)
    check_shares(out)
    return out


def _case(cell, evidence_rows: list[dict], free: dict, identity: dict, contract: agreed.Contract) -> dict:
    task, capability = cell.task, cell.capability
    rows = [r for r in evidence_rows if r["evidence_id"] in cell.evidence_ids]
    if not rows:
        raise ValueError(f"no evidence for {task}/{capability}")
    short, lured = capability == "data_insufficiency", capability == "adversarial_distractor"
    distractor = free.get(task) if lured else None
    if lured and distractor is None:
        raise ValueError("no product is free to distract")
    found = _evidence_of(rows, capability, task)
    metrics, origin = flatten(found)
    ranked = TOP[task] if TOP[task] > 1 and not short else None
    ids = "、".join(r["evidence_id"] for r in rows)
    answer = OBSERVED.format(**rows[0]) + REFERENCES[task].format(**rows[0]) if short else (FALSE_CLAIM if lured else PLAIN).format(distractor=distractor, ids=ids, task=task)
    unanswerable = list(INSUFFICIENT[task][2])
    more = [BEHAVIOR_MORE[capability].format(unanswerable="、".join(unanswerable))] if capability in BEHAVIOR_MORE else []
    metadata = {"source_label": SOURCE_LABEL, "variant": cell.variant, "semantic_family_id": f"{task}:{capability}", "validation_role": cell.split, "complexity_score": cell.complexity_score, "top_k": ranked}
    if lured:
        metadata |= {"distractor_product_id": distractor, "distractor_assertion_supported": False}
    if short:
        metadata |= {"answerable_metrics": list(INSUFFICIENT[task][1]), "unanswerable_metrics": unanswerable}
    return {
        "case_id": cell.case_id,
        "case_version": CASE_VERSION,
        "statistical_cluster_id": f"{task}:{capability}",
        "tool_contract_version": contract.version,
        "tool_contract_sha256": contract.sha256,
        "dataset_version": identity["dataset_version"],
        "dataset_id": identity["dataset_id"],
        "generator_config_hash": identity["config_sha256"],
        "business_task": task,
        "primary_capability": capability,
        "capability_tags": [capability],
        "difficulty": cell.difficulty,
        "split": cell.split,
        "user_input": STEMS[cell.split][task][cell.variant - 1] + (RANKED if ranked else "") + INSTRUCTIONS[capability].format(distractor=distractor),
        "expected_tool_calls": [tool_call(t, rows, list(metrics), contract, distractor) for t in cell.tools],
        "allowed_alternatives": [],
        "gold_metrics": metrics,
        "gold_metric_evidence": origin,
        "gold_evidence": found,
        "reference_answer": answer,
        "expected_behavior": [*BEHAVIOR, *more],
        "success_criteria": list(CRITERIA),
        "numeric_tolerances": {k: TOLERANCE for k, v in metrics.items() if type(v) is float},
        "metadata": metadata,
    }


def check_case(case: dict) -> None:
    """ValueError unless the parts of a case agree with one another."""
    problems = []
    claim = lambda fine, text: None if fine else problems.append(text)
    once = lambda values: len(set(values)) == len(values)
    tags, metrics, origin = case["capability_tags"], case["gold_metrics"], case["gold_metric_evidence"]
    found = {e["evidence_id"]: e for e in case["gold_evidence"]}
    claim(case["statistical_cluster_id"] == f"{case['business_task']}:{case['primary_capability']}", "the cluster names another task or capability")
    claim(once(tags) and case["primary_capability"] in tags, "capability tags repeat or lack the primary one")
    claim(sorted(case["success_criteria"]) == sorted(CRITERIA), "success criteria differ")
    paths = [canonical(p) for p in [case["expected_tool_calls"], *case["allowed_alternatives"]]]
    claim(all(case["allowed_alternatives"]) and case["expected_tool_calls"] and once(paths), "a tool path is empty or repeats")
    claim(len(found) == len(case["gold_evidence"]), "an evidence id repeats")
    claim(once([canonical([e["source"], e["dimensions"]]) for e in case["gold_evidence"]]), "two rows of evidence have the same dimensions")
    claim(metrics.keys() == origin.keys(), "metrics and their evidence have other names")
    for name in metrics.keys() & origin.keys():
        value = found.get(origin[name], {"metrics": {}})["metrics"].get(name, problems)
        claim(type(value) is type(metrics[name]) and value == metrics[name], f"{name} differs from its evidence")
    numbers = {k for k, v in metrics.items() if type(v) in (int, float)}
    doubles = {k for k, v in metrics.items() if type(v) is float}
    claim(doubles <= case["numeric_tolerances"].keys() <= numbers, "tolerances don't cover the doubles, or cover what is no number")
    if problems:
        raise ValueError(f"{case['case_id']}: {'; '.join(problems)}")


def check_shares(cases: list[dict]) -> None:
    """ValueError unless splits, tasks, capabilities and difficulties have their frozen shares."""
    held = [c for c in cases if c["split"] == "public_validation"]
    counts = lambda rows, key: dict(Counter(c[key] for c in rows))
    fine = (
        counts(cases, "split") == SHARES["split"]
        and all(counts([c for c in cases if c["business_task"] == t], "split") == SHARES["by_task"] for t in TASKS)
        and counts(held, "primary_capability") == dict.fromkeys(CAPABILITIES, SHARES["by_capability"])
        and counts(held, "difficulty") == SHARES["by_difficulty"]
    )
    if not fine:
        raise ValueError("the cases are not split as agreed")
