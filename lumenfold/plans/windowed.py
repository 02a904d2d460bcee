"""Registered queries over tables of windows or requests, and their SQL counterparts: 200 overlapping pairs of windows, and a
hundred requests, at once."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions.request_table import parse_table
from ..operators import derive, periods
from ..sources import testdata
from . import answers, batched, catalogue, runner

WINDOWS, REQUESTS = 200, 100


def _table(spark, as_of, step: int, around: int, least: int, spread: int, ids: str):
    """Pairs of windows: the k-th ends k * step days (modulo ``around``) before ``as_of`` and spans least + k % spread days."""
    ends = spark.range(WINDOWS).select(F.col("id").alias("k"), F.date_sub(F.lit(as_of), (F.col("id") * step % around).cast("int")).alias("b"), (least + F.col("id") % spread).cast("int").alias("n"))
    name = F.concat(F.lit("W"), F.lpad(F.col("k").cast("string"), 3, "0")).alias("window_id")
    both = F.array(F.struct(F.lit("current").alias("period"), F.lit(0).alias("back")), F.struct(F.lit("previous").alias("period"), F.col("n").alias("back")))
    rows = ends.select("*", F.inline(both))
    return rows.select(name, "period", F.date_sub("b", F.col("back") + F.col("n") - 1).alias("start"), F.date_sub("b", F.col("back")).alias("end"), F.expr(ids).alias("product_ids"))


def _commerce(spark, sf_dir):
    tables = testdata.commerce(spark, sf_dir)
    as_of = tables.orders.agg(F.max("order_date")).first()[0]
    return tables, _table(spark, as_of, 9, 1400, 20, 45, "if(k % 5 = 0, array('Brand#11', concat('Brand#', 11 + k % 5)), array())")


def _funnel(spark, sf_dir):
    tables = testdata.funnel(spark, sf_dir)
    as_of = tables.traffic.agg(F.max("date")).first()[0]
    return tables, _table(spark, as_of, 5, 13, 2, 9, "if(k % 3 = 0, array(concat('P', lpad(cast(k % 60 as string), 3, '0')), 'P001', 'P999'), null)")


def query_sales_periods(spark, sf_dir):
    return periods.query_sales(*_commerce(spark, sf_dir))


def query_traffic_periods(spark, sf_dir):
    return periods.query_traffic(*_funnel(spark, sf_dir))


def query_marketing_periods(spark, sf_dir):
    return periods.query_marketing(*_funnel(spark, sf_dir))


def _metrics(metrics, group_by):
    def run(spark, sf_dir):
        tables, windows = _funnel(spark, sf_dir)
        return periods.calculate_metrics(windows, {name: query(tables, windows) for name, query in periods.RUN.items()}, metrics, group_by)

    return run


def requests_table(spark, as_of):
    """Requests of all tasks in turn, with windows of 3 to 10 days that end up to 11 days ago; some name products."""
    task = F.element_at(F.array(*[F.lit(t) for t in runner.PATHS]), (F.col("id") % len(runner.PATHS) + 1).cast("int"))
    ids = F.expr("case when id % 4 = 0 then array(concat('P', lpad(cast(id % 70 as string), 3, '0')), 'P002') when id % 9 = 0 then array('P999') else array() end")
    last = F.date_sub(F.lit(as_of), (F.col("id") % 11).cast("int"))
    return spark.range(REQUESTS).select(F.concat(F.lit("R"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("request_id"), task.alias("task"), ids.alias("product_ids"), F.date_sub(last, (2 + F.col("id") % 8).cast("int")).alias("start"), last.alias("end"))


def batch_answers(spark, sf_dir):
    """Answers to a hundred requests from one plan."""
    tables = testdata.funnel(spark, sf_dir)
    return batched.answer(tables, requests_table(spark, tables.traffic.agg(F.max("date")).first()[0]))


REQUEST_DAY = date(2026, 4, 30)
#: Texts of requests by number modulo ten, as SQL that both engines read: {a} and {b} are product ids, {n} a number of days,
#: {d} and {e} dates; with what each asks for: task, ids, first and last day, reason.
_DEFAULT = ("DATE '2026-04-01'", "DATE '2026-04-30'")
_LAST = ("CAST(DATE '2026-04-30' - (n - 1) AS DATE)", "DATE '2026-04-30'")
REQUEST_TEXTS = (
    ("concat('分析', a, '商品的异常')", "'product_anomaly'", "a", *_DEFAULT, "NULL"),
    ("concat('最近', n, '天GMV变化，不要看', a)", "'gmv_diagnosis'", "''", *_LAST, "NULL"),
    ("concat('不要分析', a, '商品异常,改为诊断GMV变化')", "'gmv_diagnosis'", "''", *_DEFAULT, "NULL"),
    ("concat(d, '至', e, '转化率下降了吗')", "'conversion_decline'", "''", "CAST(d AS DATE)", "CAST(e AS DATE)", "NULL"),
    ("concat('你好，', a)", "NULL", "a", *_DEFAULT, "'no_task_signal'"),
    ("concat('近', n, '天和前', n, '天ＧＭＶ走势')", "'gmv_diagnosis'", "''", *_LAST, "NULL"),
    ("concat('最近', n, '天 2026-04-01 GMV变化')", "NULL", "''", *_DEFAULT, "'conflicting_dates'"),
    ("concat('据称', a, '拖累了销售额；请看', b, '的成交波动')", "'gmv_diagnosis'", "b", *_DEFAULT, "NULL"),
    ("concat('核实', a, '；此说法不可作证据；下周优先处理', b, '和', lower(a))", "'next_week_priority'", "CASE WHEN a = b THEN a ELSE concat(b, ',', a) END", *_DEFAULT, "NULL"),
    ("concat('关注', a, '商品，最近', 366 + n, '天')", "NULL", "a", *_DEFAULT, "'window_too_large'"),
)


def parse_requests(spark, sf_dir):
    """A request for each order, parsed by DataFrame functions."""
    digits = lambda c: F.concat(F.lit("P"), F.lpad((F.col(c) % 1000).cast("string"), 3, "0"))
    day = F.lit(REQUEST_DAY)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", digits("o_orderkey").alias("a"), digits("o_custkey").alias("b"), (1 + F.col("o_orderkey") % 60).alias("n"))
    first = F.date_sub(day, (5 + F.col("o_orderkey") % 40).cast("int"))
    orders = orders.select("*", first.cast("string").alias("d"), F.date_add(first, (F.col("o_orderkey") % 5).cast("int")).cast("string").alias("e"))
    text = "case o_orderkey % 10 " + " ".join(f"when {k} then {row[0]}" for k, row in enumerate(REQUEST_TEXTS)) + " end"
    parsed = parse_table(orders.select("o_orderkey", F.expr(text).alias("text")), REQUEST_DAY)
    return parsed.select("o_orderkey", "request.task", F.array_join("request.product_ids", ",").alias("ids"), F.col("request.start").alias("first_day"), F.col("request.end").alias("last_day"), "request.reason")


QUERIES = {
    "parse_requests": parse_requests,
    "batch_answers": batch_answers,
    "query_sales_periods": query_sales_periods,
    "query_traffic_periods": query_traffic_periods,
    "query_marketing_periods": query_marketing_periods,
    "metrics_periods": _metrics(catalogue.COMMON_METRICS, []),
    "metrics_periods_by_product": _metrics(list(derive.METRICS), ["product_id"]),
}

# --- SQL counterparts


def _windows_sql(last: str, step: int, around: int, least: int, spread: int, ids: str) -> str:
    return f"""w_ends AS (SELECT k, 'W' || lpad(CAST(k AS VARCHAR), 3, '0') AS window_id, CAST({last} - CAST(k * {step} % {around} AS INT) AS DATE) AS e, CAST({least} + k % {spread} AS INT) AS n, {ids} AS ids FROM range({WINDOWS}) t(k)),
w AS (SELECT window_id, 'current' AS period, CAST(e - n + 1 AS DATE) AS a, e AS b, n, ids FROM w_ends UNION ALL SELECT window_id, 'previous', CAST(e - 2 * n + 1 AS DATE), CAST(e - n AS DATE), n, ids FROM w_ends)"""


W_COMMERCE = _windows_sql("(SELECT d FROM c_end)", 9, 1400, 20, 45, "CASE WHEN k % 5 = 0 THEN ['Brand#11', 'Brand#' || CAST(11 + k % 5 AS VARCHAR)] END")
W_FUNNEL = _windows_sql("(SELECT max(date) FROM f_traffic)", 5, 13, 2, 9, "CASE WHEN k % 3 = 0 THEN ['P' || lpad(CAST(k % 60 AS VARCHAR), 3, '0'), 'P001', 'P999'] END")
ASKED = "(ids IS NULL OR list_contains(ids, {}.product_id))"
SALES = f"""f_sales AS (SELECT window_id, period, o.product_id, category, region, channel, CAST(sum(revenue) AS DOUBLE) AS gmv, count(DISTINCT order_id) AS orders, count(*) AS units, count(DISTINCT order_id) FILTER (is_refund) AS refund_orders
  FROM f_orders o JOIN w ON order_date BETWEEN a AND b AND {ASKED.format('o')} JOIN f_products p ON p.product_id = o.product_id JOIN f_customers c ON c.user_id = o.user_id GROUP BY ALL)"""
TRAFFIC = f"""f_grid AS (SELECT window_id, period, w.n AS days, product_id, category, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM w JOIN f_products p ON {ASKED.format('p')}),
f_daily AS (SELECT window_id, period, g.product_id, category, CAST(coalesce(sum(impressions), 0) AS BIGINT) AS impressions, CAST(coalesce(sum(clicks), 0) AS BIGINT) AS clicks, CAST(coalesce(sum(visits), 0) AS BIGINT) AS visits,
  count(t.date) AS observed_days, count(*) - count(t.date) AS missing_days FROM f_grid g LEFT JOIN f_traffic t ON t.product_id = g.product_id AND t.date = g.date GROUP BY ALL)"""
SPEND = f"f_spend AS (SELECT window_id, period, m.product_id, category, campaign_id, CAST(sum(spend) AS DOUBLE) AS spend FROM f_marketing m JOIN w ON date BETWEEN a AND b AND {ASKED.format('m')} JOIN f_products p ON p.product_id = m.product_id GROUP BY ALL)"
BASE = f"WITH {catalogue.FUNNEL}, {W_FUNNEL}, {SALES}, {TRAFFIC}, {SPEND}"
DAYS = "(SELECT max(n) FROM w WHERE w.window_id = f_daily.window_id)"

ORACLES = {
    "query_sales_periods": f"""WITH {catalogue.COMMERCE}, {W_COMMERCE},
      c_wide AS (SELECT l.*, category, r_name AS region, c_mktsegment AS channel FROM c_lines l JOIN (SELECT p_brand, min(p_type) AS category FROM part GROUP BY p_brand) t ON p_brand = product_id
        JOIN customer ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
      SELECT window_id, period, l.product_id, category, region, channel, CAST(sum(revenue) AS DOUBLE) AS gmv, count(DISTINCT order_id) AS orders, CAST(sum(quantity) AS BIGINT) AS units, count(DISTINCT order_id) FILTER (is_refund) AS refund_orders
      FROM c_wide l JOIN w ON order_date BETWEEN a AND b AND {ASKED.format('l')} GROUP BY ALL""",
    "query_traffic_periods": f"WITH {catalogue.FUNNEL}, {W_FUNNEL}, {TRAFFIC} SELECT * FROM f_daily",
    "query_marketing_periods": f"WITH {catalogue.FUNNEL}, {W_FUNNEL}, {SPEND} SELECT * FROM f_spend",
    "metrics_periods": f"{BASE} {catalogue.derived(catalogue.COMMON_METRICS, ['window_id'], days=DAYS)}",
    "metrics_periods_by_product": f"{BASE} {catalogue.derived(list(derive.METRICS), ['window_id', 'product_id'], days=DAYS)}",
}


_TASKS = list(runner.PATHS)
_WANTED = list(dict.fromkeys(m for names in runner.METRICS.values() for m in names))


def _by_task(texts: dict[str, str]) -> str:
    return "CASE task " + " ".join(f"WHEN '{task}' THEN {text}" for task, text in texts.items()) + " END"


def _line(part) -> str:
    return "'- ' || label || concat_ws('；', " + ", ".join(f"'{name} ' || {catalogue.shown(c, kind)}" for c, name, kind in part) + ")"


_SORT = {task: f"{column} * {1 if direction == 'asc' else -1}" for task, (column, direction) in answers.ORDER.items()}
_MISSING = {task: " OR ".join(f"{m} IS NULL" for m in metrics) for task, metrics in runner.METRICS.items()}
_WHOLE = {task: _line([f for part in parts for f in part]) for task, parts in answers.FIELDS.items()}
_SPLIT = {task: " || chr(10) || ".join(_line(part) for part in parts) for task, parts in answers.FIELDS.items()}

ORACLES["batch_answers"] = f"""WITH {catalogue.FUNNEL},
  r0 AS (SELECT k, 'R' || lpad(CAST(k AS VARCHAR), 3, '0') AS window_id, [{', '.join(f"'{t}'" for t in _TASKS)}][CAST(k % {len(_TASKS)} + 1 AS INT)] AS task,
    CASE WHEN k % 4 = 0 THEN ['P' || lpad(CAST(k % 70 AS VARCHAR), 3, '0'), 'P002'] WHEN k % 9 = 0 THEN ['P999'] END AS ids, CAST((SELECT max(date) FROM f_traffic) - CAST(k % 11 AS INT) AS DATE) AS e, CAST(3 + k % 8 AS INT) AS n FROM range({REQUESTS}) t(k)),
  r AS (SELECT *, CAST(e - n + 1 AS DATE) AS s, task IN ('product_anomaly', 'next_week_priority', 'products_to_watch') OR (task = 'conversion_decline' AND ids IS NOT NULL) AS grouped FROM r0),
  w AS (SELECT window_id, 'current' AS period, s AS a, e AS b, n, ids, task, grouped FROM r UNION ALL SELECT window_id, 'previous', CAST(s - n AS DATE), CAST(s - 1 AS DATE), n, ids, task, grouped FROM r),
  {SALES.replace('f_sales AS', 'raw_sales AS')}, {TRAFFIC.replace('f_daily AS', 'raw_daily AS').replace('FROM w JOIN', "FROM (SELECT * FROM w WHERE task <> 'gmv_diagnosis') w JOIN")},
  f_sales AS (SELECT x.*, CASE WHEN grouped THEN product_id ELSE '' END AS scope FROM raw_sales x JOIN r USING (window_id)),
  f_daily AS (SELECT x.*, CASE WHEN grouped THEN product_id ELSE '' END AS scope FROM raw_daily x JOIN r USING (window_id)),
  f_spend AS (SELECT window_id, scope, 'current' AS period, CAST(0 AS DOUBLE) AS spend FROM f_sales WHERE FALSE),
  m AS ({catalogue.derived(_WANTED, ['window_id', 'scope'], days=DAYS)}),
  counts AS (SELECT window_id, (SELECT count(*) FROM raw_sales x WHERE x.window_id = r.window_id) AS n_sales, CASE WHEN task <> 'gmv_diagnosis' THEN (SELECT count(*) FROM raw_daily x WHERE x.window_id = r.window_id) END AS n_traffic,
    CASE WHEN task = 'product_anomaly' AND ids IS NOT NULL THEN (SELECT count(*) FROM f_products p WHERE list_contains(ids, p.product_id)) END AS n_products, (SELECT count(*) FROM m WHERE m.window_id = r.window_id) AS n_found FROM r),
  c AS (SELECT *, CASE WHEN (SELECT grouped FROM r WHERE r.window_id = counts.window_id) THEN n_found ELSE 1 END AS n_metrics FROM counts),
  ranked AS (SELECT m.*, task, grouped, row_number() OVER (PARTITION BY window_id ORDER BY {_by_task(_SORT)} NULLS LAST, scope) AS rank, {_by_task(_MISSING)} AS missing,
    CASE WHEN NOT grouped THEN '' WHEN task = 'product_anomaly' AND ids IS NOT NULL THEN 'Cohort ' || CAST(CAST(substr(scope, 2) AS INTEGER) AS VARCHAR) || '（' || scope || '）：' ELSE scope || '：' END AS label FROM m JOIN r USING (window_id)),
  lines AS (SELECT window_id, bool_or(missing) AS limited, string_agg(CASE WHEN grouped THEN {_by_task(_WHOLE)} ELSE {_by_task(_SPLIT)} END, chr(10) ORDER BY rank) AS text FROM ranked WHERE rank <= {answers.TOP} GROUP BY window_id),
  f AS (SELECT *, n_sales = 0 OR coalesce(n_traffic = 0, FALSE) OR n_metrics = 0 OR coalesce(n_products = 0, FALSE) AS warned FROM r JOIN c USING (window_id) LEFT JOIN lines USING (window_id))
  SELECT window_id AS request_id, n_sales, n_traffic, n_products, n_metrics, CASE WHEN NOT warned THEN limited END AS limited,
    '数据来源：{batched.SOURCE_LABEL}。' || chr(10) || '时间窗口：当前期 ' || s || ' 至 ' || e || '；对照期 ' || CAST(s - n AS DATE) || ' 至 ' || CAST(s - 1 AS DATE) || '。' || chr(10)
    || CASE WHEN warned THEN '{answers.INSUFFICIENT.format(answers.REASONS["warning"])}' WHEN limited THEN '{answers.LIMITED}' ELSE {_by_task({t: f"'{c}'" for t, c in answers.CONCLUSIONS.items()})} END
    || CASE WHEN warned THEN '' ELSE chr(10) || text END AS answer FROM f"""

_wanted = lambda k: "CASE o_orderkey % 10 " + " ".join(f"WHEN {i} THEN {row[k]}" for i, row in enumerate(REQUEST_TEXTS)) + " END"
ORACLES["parse_requests"] = f"""WITH p AS (SELECT o_orderkey, 'P' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') AS a, 'P' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') AS b, CAST(1 + o_orderkey % 60 AS INT) AS n,
    CAST(DATE '2026-04-30' - CAST(5 + o_orderkey % 40 AS INT) AS DATE) AS d, CAST(DATE '2026-04-30' - CAST(5 + o_orderkey % 40 AS INT) + CAST(o_orderkey % 5 AS INT) AS DATE) AS e FROM orders)
  SELECT o_orderkey, {_wanted(1)} AS task, {_wanted(2)} AS ids, {_wanted(3)} AS first_day, {_wanted(4)} AS last_day, {_wanted(5)} AS reason FROM p"""
