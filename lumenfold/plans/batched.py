"""Many requests as one plan: requests are rows, and those of one tool share its scan through a table of windows.

``answer`` turns a table of parsed requests into a table of answers: the window queries run once over all requests, metrics
are added up by request (and product, where a task asks by product), the rows of each answer are ranked and cut inside their
request, and lines and text are columns. The number of Spark jobs doesn't depend on the number of requests. ``run`` parses
texts and adds the records that ``runner.batch`` publishes, equal to those of one run a request.
"""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formats, requests
from ..functions.request_table import parse_table
from ..functions.requests import Request
from ..operators import periods
from ..operators.ranks import checkpoint_dir
from . import answers, runner
from .tools import DERIVE, PRODUCT, SALES, SOURCE_LABEL, TRAFFIC, default_registry

#: request_id, task, product_ids, start, end: a request whose task is null is not answered.
REQUEST = "request_id string, task string, product_ids array<string>, start date, end date"
#: Group of what is not asked by product.
WHOLE = ""
REGISTRY = default_registry()


def _by_product():
    some = F.size("product_ids") > 0
    return F.col("task").isin("product_anomaly", "next_week_priority", "products_to_watch") | ((F.col("task") == "conversion_decline") & some)


def windows_of(parsed: DataFrame) -> DataFrame:
    """The table of windows of some requests: each asked window, and as many days before it."""
    days = F.datediff("end", "start") + 1
    pair = F.array(F.struct(F.lit("current").alias("period"), F.col("start"), F.col("end")), F.struct(F.lit("previous").alias("period"), F.date_sub("start", days).alias("start"), F.date_sub("start", 1).alias("end")))
    return parsed.select(F.col("request_id").alias("window_id"), "task", "product_ids", F.inline(pair)).select("window_id", "period", "start", "end", "product_ids", "task")


def _scoped(rows: DataFrame, grouped: DataFrame) -> DataFrame:
    """Rows of a result with ``scope``: their product, or the whole request where it is not asked by product."""
    return rows.join(grouped, "window_id").withColumn("scope", F.when(F.col("grouped"), F.col("product_id")).otherwise(WHOLE))


def _case(task_values: dict, default=None):
    """The value of a request's task."""
    out = reduce(lambda c, kv: c.when(F.col("task") == kv[0], kv[1]), list(task_values.items())[1:], F.when(F.col("task") == next(iter(task_values)), next(iter(task_values.values()))))
    return out if default is None else out.otherwise(default)


def answer(tables, parsed: DataFrame) -> DataFrame:
    """For each request with a task: request_id, rows of each tool (null where it is not run), limited, answer."""
    parsed = parsed.where("task is not null")
    windows = windows_of(parsed)
    grouped = parsed.select(F.col("request_id").alias("window_id"), _by_product().alias("grouped"))
    with_traffic = F.col("task") != "gmv_diagnosis"
    results = {SALES: periods.query_sales(tables, windows), TRAFFIC: periods.query_traffic(tables, windows.where(with_traffic))}
    scoped = {name: _scoped(rows, grouped) for name, rows in results.items()}
    keys = ["window_id", "scope"]
    always = grouped.where(~F.col("grouped")).select("window_id", F.lit(WHOLE).alias("scope"))
    joined = reduce(lambda a, b: a.join(b, keys, "full"), [*periods.sums(scoped, keys), always])
    joined = joined.join(periods.completeness(scoped[TRAFFIC], windows, keys), keys, "left")
    wanted = list(dict.fromkeys(m for names in runner.METRICS.values() for m in names))
    asked = parsed.select(F.col("request_id").alias("window_id"), "task", "product_ids", _by_product().alias("grouped"))
    row, by_name = periods.formulas_over(joined)
    rows = row.select(*keys, F.col(f"{SALES}_rows").alias("n_sales"), F.col(f"{TRAFFIC}_rows").alias("n_traffic"), *[by_name[m].alias(f"m_{m}") for m in wanted]).join(asked, "window_id")
    # the rows of an answer: the first in the order of its task, missing values last
    key = _case({task: F.col(f"m_{column}") * (1 if direction == "asc" else -1) for task, (column, direction) in answers.ORDER.items()})
    own = Window.partitionBy("window_id")
    counted = rows.withColumns({"all_sales": F.coalesce(F.sum("n_sales").over(own), F.lit(0)), "all_traffic": F.coalesce(F.sum("n_traffic").over(own), F.lit(0)), "all_rows": F.count("*").over(own), "key": key})
    ranked = counted.withColumn("rank", F.row_number().over(own.orderBy(F.col("key").asc_nulls_last(), F.col("scope")))).where(F.col("rank") <= answers.TOP)
    names = tables.products.select(F.col("product_id").alias("scope"), "product_name")
    ranked = ranked.join(names, "scope", "left")
    named = F.when((F.col("task") == "product_anomaly") & (F.size("product_ids") > 0), F.concat("product_name", F.lit("（"), "scope", F.lit("）")))
    label = F.when(F.col("grouped"), F.concat(F.coalesce(named, F.col("scope")), F.lit("："))).otherwise("")
    text = lambda part: F.concat(F.lit("- "), label, F.concat_ws("；", *[F.concat(F.lit(f"{name} "), answers.FORMATS[kind](F.col(f"m_{c}"))) for c, name, kind in part]))
    split = {task: F.array(*[text(part) for part in parts]) for task, parts in answers.FIELDS.items()}
    whole = {task: F.array(text(tuple(f for part in parts for f in part))) for task, parts in answers.FIELDS.items()}
    missing = _case({task: reduce(lambda a, b: a | b, [F.col(f"m_{m}").isNull() for m in metrics]) for task, metrics in runner.METRICS.items()})
    lines = ranked.select("window_id", "rank", "all_sales", "all_traffic", "all_rows", missing.alias("missing"), F.when(F.col("grouped"), _case(whole)).otherwise(_case(split)).alias("lines"))
    found = lines.groupBy("window_id").agg(F.max("all_sales").alias("n_sales"), F.max("all_traffic").alias("n_traffic"), F.max("all_rows").alias("n_metrics"), F.bool_or("missing").alias("limited"), F.array_sort(F.collect_list(F.struct("rank", "lines"))).alias("parts"))
    ids = parsed.where(F.col("task") == "product_anomaly").select("request_id", F.explode(F.array_distinct("product_ids")).alias("product_id"))
    known = ids.join(tables.products.select("product_id", F.lit(True).alias("there")), "product_id", "left").groupBy("request_id").agg(F.count_if("there").alias("n_products"))
    out = parsed.join(found.withColumnRenamed("window_id", "request_id"), "request_id", "left").join(known, "request_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    out = out.withColumns({"n_sales": zero("n_sales"), "n_traffic": F.when(with_traffic, zero("n_traffic")), "n_metrics": zero("n_metrics"), "limited": F.coalesce("limited", F.lit(False))})
    warned = (F.col("n_sales") == 0) | F.coalesce(F.col("n_traffic") == 0, F.lit(False)) | (F.col("n_metrics") == 0) | F.coalesce(F.col("n_products") == 0, F.lit(False))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    size = F.datediff("end", "start") + 1
    window = F.concat(F.lit("时间窗口：当前期 "), day("start"), F.lit(" 至 "), day("end"), F.lit("；对照期 "), day(F.date_sub("start", size)), F.lit(" 至 "), day(F.date_sub("start", 1)), F.lit("。"))
    conclusion = F.when(warned, answers.INSUFFICIENT.format(answers.REASONS["warning"])).when(F.col("limited"), answers.LIMITED).otherwise(_case({t: F.lit(c) for t, c in answers.CONCLUSIONS.items()}))
    shown = F.when(~warned, F.flatten(F.transform("parts", lambda p: p["lines"])))
    body = F.concat(F.array(F.lit(f"数据来源：{SOURCE_LABEL}。"), window, conclusion), F.coalesce(shown, F.expr("cast(array() as array<string>)")))
    return out.select("request_id", "n_sales", "n_traffic", "n_products", "n_metrics", F.when(~warned, F.col("limited")).alias("limited"), F.array_join(body, "\n").alias("answer"))


def _done(request: Request, row, dataset_id: str) -> runner.Run:
    """A request's run, from its row of ``answer``; without one it has no task."""
    out = runner.Run("failed")
    kind, payload = runner.parsed_note(request)
    out.note(kind, **payload)
    if row is None:
        return out.failed(request.reason, "unsupported", reason=request.reason)
    counts = {PRODUCT: row.n_products, SALES: row.n_sales, TRAFFIC: row.n_traffic, DERIVE: row.n_metrics}
    for number, (name, arguments) in enumerate(runner.plan(request), 1):
        out.note("tool", name=name, arguments=arguments)
        tool = REGISTRY.get(name)
        arguments = tool.check(arguments)
        out.executions.append(runner.Done(number, f"call_{number:04d}", name, arguments, tuple(tool.columns(arguments)), dataset_id, [] if counts[name] else [tool.empty_warning]))
    return out.completed(row.answer)


def run(tables, texts: list[str], as_of: date, dataset_id: str = "") -> list[runner.Run]:
    """A run for each text, from one plan over all of them. The driver holds the texts and one row each."""
    spark = tables.products.sparkSession
    parsed = [requests.parse(text, as_of) for text in texts]
    rows = [(str(k), r.task, list(r.product_ids), r.windows and r.windows.start, r.windows and r.windows.end) for k, r in enumerate(parsed) if r.task]
    found = {}
    if rows:
        found = {int(r.request_id): r for r in answer(tables, spark.createDataFrame(rows, REQUEST)).collect()}
    return [_done(request, found.get(k), dataset_id) for k, request in enumerate(parsed)]


def answer_column(tables, texts: DataFrame, as_of: date, *, text="text", request_id="request_id") -> DataFrame:
    """``answer`` for a table of texts of any size, which are parsed on the executors, once: the parsed requests are
    checkpointed, as the plan reads them in several places."""
    checkpoint_dir(texts.sparkSession)
    parsed = parse_table(texts.select(F.col(request_id).cast("string").alias("request_id"), F.col(text).alias("text")), as_of, output="p")
    return answer(tables, parsed.select("request_id", "p.task", "p.product_ids", "p.start", "p.end").checkpoint())
