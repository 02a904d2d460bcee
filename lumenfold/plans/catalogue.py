"""Registered queries of the commerce engine over the test tables, and their SQL counterparts.

Rule queries use windows of 15 days on the ``funnel`` reading (its events span 30 days); sales queries also run on the
``commerce`` reading with windows of 30 days.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..functions import formats, requests
from ..operators import derive, kpis, lookups, quality, rules
from ..operators.windows import Windows
from ..sources import testdata
from ..sources.schemas import Tables
from . import answers, artifacts, cases, contract, runner

DAYS = testdata.DAYS


def _rule(name):
    return lambda spark, sf_dir: rules.RULES[name](testdata.funnel(spark, sf_dir), DAYS)


def _funnel_windows(tables):
    return rules.latest(tables, DAYS)


def _commerce_windows(tables) -> Windows:
    return Windows.latest(tables.orders.agg(F.max("order_date")).first()[0], 30)


def _sales(reading, windows_of, **options):
    def run(spark, sf_dir):
        tables = reading(spark, sf_dir)
        return lookups.query_sales(tables, windows_of(tables), **options)

    return run


def query_product(spark, sf_dir):
    return lookups.query_product(testdata.funnel(spark, sf_dir), ["P001", "P004", "P999"])


def _traffic(**options):
    def run(spark, sf_dir):
        tables = testdata.funnel(spark, sf_dir)
        return lookups.query_traffic(tables, _funnel_windows(tables), **options)

    return run


def query_marketing(spark, sf_dir):
    tables = testdata.funnel(spark, sf_dir)
    return lookups.query_marketing(tables, _funnel_windows(tables))


def _executions(tables, windows, tools):
    run = {"query_sales": lookups.query_sales, "query_traffic": lookups.query_traffic, "query_marketing": lookups.query_marketing}
    return [derive.Execution(t, windows, run[t](tables, windows), grouped=True) for t in tools]


ALL_TOOLS = ("query_sales", "query_traffic", "query_marketing")
SALES_METRICS = [m for m, needs in derive.NEEDS.items() if needs == {"query_sales"}]
COMMON_METRICS = [m for m in derive.METRICS if m != "evidence_value"]


def _metrics(reading, windows_of, tools, metrics, group_by):
    def run(spark, sf_dir):
        tables = reading(spark, sf_dir)
        return derive.calculate_metrics(_executions(tables, windows_of(tables), tools), metrics, group_by)

    return run


def daily_kpis(spark, sf_dir):
    return kpis.daily_kpis(testdata.funnel(spark, sf_dir))


def coverage_gaps(spark, sf_dir):
    """Share of cohorts with traffic on each day, where it is not all of them."""
    tables = testdata.funnel(spark, sf_dir)
    n = tables.products.agg(F.count("*").alias("total_rows"))
    days = tables.traffic.groupBy("date").agg(F.count_if(~F.col("is_missing")).alias("observed_rows")).crossJoin(F.broadcast(n))
    return kpis.coverage_gaps(days.withColumn("coverage", F.col("observed_rows") / F.col("total_rows")))


def summary_stats(spark, sf_dir):
    stats = kpis.summary_stats(kpis.daily_kpis(testdata.funnel(spark, sf_dir)))
    return stats.select("metric", "count", *[F.round(c, 6).alias(c) for c in stats.columns[2:]])  # engines add doubles in different orders


def fk_violations(spark, sf_dir):
    """Orders of cohorts that a shortened product table lacks."""
    tables = testdata.funnel(spark, sf_dir)
    fewer = tables.products.where("product_id < 'P050'")
    return quality.broken_references(tables.orders, fewer, "product_id").groupBy("product_id").agg(F.count("*").alias("orders"))


def duplicate_keys(spark, sf_dir):
    return quality.duplicate_keys(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_orderkey", "l_linenumber"])


def grain_gaps(spark, sf_dir):
    tables = testdata.funnel(spark, sf_dir)
    return quality.grain_gaps(tables, tables.traffic)


def funnel_violations(spark, sf_dir):
    """Counts as the rule sees them, with visits lowered on every third day so that some break it."""
    traffic = testdata.funnel(spark, sf_dir).traffic
    lowered = traffic.withColumn("visits", F.when(F.dayofmonth("date") % 3 == 0, F.col("visits") - 2).otherwise(F.col("visits")))
    return quality.funnel_violations(lowered)


def revenue_identity(spark, sf_dir):
    return quality.revenue_violations(testdata.commerce(spark, sf_dir).orders)


def quality_report(spark, sf_dir):
    return quality.report(testdata.funnel(spark, sf_dir), identifiers=False)


def _damaged(spark, sf_dir):
    """The funnel tables with a fault of each kind: an absent and a repeated product, prices without a value, blank
    regions, lowered visits, a lost day, wrong quantities and unknown states."""
    tables = testdata.funnel(spark, sf_dir)
    event, day = F.col("order_id").cast("long"), F.dayofmonth("date")
    n = F.substring("product_id", 2, 3).cast("int")
    products = tables.products.where("product_id <> 'P007'").withColumn("price", F.when(n % 10 != 3, F.col("price")))
    traffic = tables.traffic.where(~((F.col("product_id") == "P013") & (day == 2))).withColumn("visits", F.when(day % 5 == 0, F.col("visits") - 3).otherwise(F.col("visits")))
    quantity = F.when(event % 7 == 0, 2).when(event % 11 == 0, 0).otherwise(1).cast("long")
    return Tables(
        products.unionAll(products.where("product_id = 'P011'")),
        tables.customers.withColumn("region", F.when(F.substring("customer_id", 2, 9).cast("int") % 50 != 0, F.col("region")).otherwise("")),
        traffic,
        tables.marketing,
        tables.orders.withColumn("quantity", quantity).withColumn("status", F.when(event % 13 == 0, "lost").otherwise(F.col("status"))),
    )


def quality_report_damaged(spark, sf_dir):
    return quality.report(_damaged(spark, sf_dir), identifiers=False)


def schema_errors(spark, sf_dir):
    """Broken row rules by table, column and type."""
    return quality.row_errors(_damaged(spark, sf_dir), identifiers=False).groupBy("table", "location", "type").agg(F.count("*").alias("rows"), F.min("key").alias("first_key"))


def id_differences(spark, sf_dir):
    return quality.id_differences(_damaged(spark, sf_dir).products, "product_id", "P", 61)


def evidence_ids(spark, sf_dir):
    """Anomalies numbered in their order."""
    return cases.evidence(testdata.funnel(spark, sf_dir), DAYS)["product_anomaly"].select("evidence_id", "product_id", "anomaly_type")


def gold_evidence(spark, sf_dir):
    """Every row of every rule as evidence, with the number of its metrics."""
    return cases.gold(testdata.funnel(spark, sf_dir), DAYS).select("task", F.col("number").cast("long").alias("number"), "product_id", "evidence_id", F.size("metrics").cast("long").alias("n_metrics"))


def case_table(spark, sf_dir):
    """The hundred cases with split, tools, evidence, score and difficulty."""
    table = cases.case_table(cases.grid(spark), cases.gold(testdata.funnel(spark, sf_dir), DAYS))
    sizes = [F.size("evidence_ids").cast("long").alias("n_evidence"), "n_metrics", "complexity_score", "difficulty"]
    return table.select("case_id", "task", "capability", "variant", "split", F.array_join("tools", ",").alias("tools"), *sizes)


def run_summary(spark, sf_dir):
    """Counts and ends of a batch's records by split and status; here hard cases count as failed."""
    table = cases.case_table(cases.grid(spark), cases.gold(testdata.funnel(spark, sf_dir), DAYS))
    records = table.select(F.col("number").alias("sequence"), "case_id", "split", F.when(F.col("difficulty") == "hard", "failed").otherwise("completed").alias("status"))
    return artifacts.status_counts(records).select("split", "status", "n", "first", "last")


def distractor_min_by_hash(spark, sf_dir):
    """For each task the product without any evidence that has the smallest hash."""
    tables = testdata.funnel(spark, sf_dir)
    return cases.distractors(tables, cases.gold(tables, DAYS), "dataset")


def _answer(task, tools):
    def run(spark, sf_dir):
        tables = testdata.funnel(spark, sf_dir)
        metrics = derive.calculate_metrics(_executions(tables, _funnel_windows(tables), tools), runner.METRICS[task], ["product_id"])
        return answers.answer_lines(task, metrics, tables.products).select("rank", "line", "missing")

    return run


def topk_nulls_last(spark, sf_dir):
    tables = testdata.funnel(spark, sf_dir)
    wide = rules.product_metrics(tables, _funnel_windows(tables))
    return wide.select("product_id", F.round("cvr_change", 9).alias("cvr_change"), F.round("gmv_change_rate", 9).alias("gmv_change_rate")).orderBy(F.asc_nulls_last("cvr_change"), F.desc_nulls_last("gmv_change_rate"), "product_id").limit(5)


def period_union(spark, sf_dir):
    tables = testdata.funnel(spark, sf_dir)
    windows = _funnel_windows(tables)
    parts = [tables.orders.where(windows.within("order_date", p)).agg(F.lit(p).alias("period"), F.sum("revenue").cast("double").alias("gmv"), F.count("*").alias("orders")) for p in windows.periods]
    return parts[0].unionAll(parts[1])


def product_id_extract(spark, sf_dir):
    """Product ids in texts, upper case, each once, in order of appearance."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    digits = lambda c: F.lpad((F.col(c) % 1000).cast("string"), 3, "0")
    text = F.concat(F.lit("XP123 "), F.col("o_orderpriority"), F.lit(" p"), digits("o_custkey"), F.lit("、P"), digits("o_orderkey"), F.lit("。P12 P1234 P"), digits("o_custkey"))
    return orders.select("o_orderkey", F.array_join(requests.product_ids(text), ",").alias("ids"))


def formatters(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    price = F.col("p_retailprice").cast("decimal(18,6)")
    return parts.select("p_partkey", formats.money(price).alias("money"), formats.count(F.col("p_partkey") * 1000).alias("count"), formats.rate((price - 1000) / 1000).alias("rate"))


QUERIES = {
    **{name: _rule(name) for name in rules.RULES},
    "query_product": query_product,
    "query_sales": _sales(testdata.funnel, _funnel_windows),
    "query_sales_commerce": _sales(testdata.commerce, _commerce_windows),
    "query_sales_without_refunds": _sales(testdata.funnel, _funnel_windows, include_refunds=False),
    "query_traffic": _traffic(),
    "query_traffic_complete": _traffic(include_missing=False),
    "query_marketing": query_marketing,
    "metrics_total": _metrics(testdata.funnel, _funnel_windows, ALL_TOOLS, COMMON_METRICS, []),
    "metrics_by_product": _metrics(testdata.funnel, _funnel_windows, ALL_TOOLS, list(derive.METRICS), ["product_id"]),
    "metrics_by_category": _metrics(testdata.funnel, _funnel_windows, ALL_TOOLS, COMMON_METRICS, ["category"]),
    "metrics_by_product_category": _metrics(testdata.funnel, _funnel_windows, ALL_TOOLS, COMMON_METRICS, ["product_id", "category"]),
    "metrics_by_region": _metrics(testdata.funnel, _funnel_windows, ["query_sales"], SALES_METRICS, ["region"]),
    "metrics_by_channel": _metrics(testdata.commerce, _commerce_windows, ["query_sales"], SALES_METRICS, ["channel"]),
    "daily_kpis": daily_kpis,
    "coverage_gaps": coverage_gaps,
    "summary_stats": summary_stats,
    "fk_violations": fk_violations,
    "duplicate_keys": duplicate_keys,
    "grain_gaps": grain_gaps,
    "funnel_violations": funnel_violations,
    "revenue_identity": revenue_identity,
    "quality_report": quality_report,
    "quality_report_damaged": quality_report_damaged,
    "schema_errors": schema_errors,
    "id_differences": id_differences,
    "evidence_ids": evidence_ids,
    "topk_nulls_last": topk_nulls_last,
    "gold_evidence": gold_evidence,
    "case_table": case_table,
    "answer_watch": _answer("products_to_watch", ("query_sales", "query_traffic")),
    "answer_priorities": _answer("next_week_priority", ("query_sales", "query_traffic")),
    "answer_conversion": _answer("conversion_decline", ("query_sales", "query_traffic")),
    "distractor_min_by_hash": distractor_min_by_hash,
    "run_summary": run_summary,
    "period_union": period_union,
    "product_id_extract": product_id_extract,
    "formatters": formatters,
}

# --- SQL counterparts -------------------------------------------------------------------------------------------------

FUNNEL = """
ev AS (SELECT event_id, CAST(ts AS DATE) AS date, user_id, event_type, value, 'P' || lpad(CAST(user_id % 60 AS VARCHAR), 3, '0') AS product_id FROM events),
f_products AS (SELECT DISTINCT product_id, 'K' || CAST((user_id % 60) % 4 AS VARCHAR) AS category, user_id % 60 AS n FROM ev),
f_customers AS (SELECT DISTINCT 'C' || lpad(CAST(user_id AS VARCHAR), greatest(4, length(CAST(user_id AS VARCHAR)))::INT, '0') AS customer_id, user_id,
                'R' || CAST(user_id % 4 AS VARCHAR) AS region, 'H' || CAST(user_id % 3 AS VARCHAR) AS channel FROM ev),
f_traffic AS (SELECT date, product_id, count(*) FILTER (event_type IN ('view', 'click')) AS impressions, count(*) FILTER (event_type = 'click') AS clicks,
              count(*) FILTER (event_type IN ('click', 'signup')) AS visits FROM ev WHERE event_type IN ('view', 'click', 'signup') GROUP BY ALL),
f_marketing AS (SELECT date, product_id, 'M' || lpad(CAST(event_id % 3 AS VARCHAR), 3, '0') AS campaign_id, sum(CAST(value AS DECIMAL(18,2))) AS spend FROM ev WHERE event_type = 'signup' GROUP BY ALL),
f_orders AS (SELECT CAST(event_id AS VARCHAR) AS order_id, product_id, user_id, date AS order_date, CAST(value AS DECIMAL(18,2)) AS revenue, value < 5 AS is_refund FROM ev WHERE event_type = 'purchase'),
bounds AS (SELECT max(date) AS as_of_date, CAST(max(date) - INTERVAL 14 DAY AS DATE) AS current_start, max(date) AS current_end,
           CAST(max(date) - INTERVAL 29 DAY AS DATE) AS previous_start, CAST(max(date) - INTERVAL 15 DAY AS DATE) AS previous_end FROM f_traffic),
periods AS (SELECT 'current' AS period, current_start AS a, current_end AS b FROM bounds UNION ALL SELECT 'previous', previous_start, previous_end FROM bounds),
p_traffic AS (SELECT p.product_id,
    count(t.date) FILTER (t.date BETWEEN current_start AND current_end) AS current_observed_days, count(t.date) FILTER (t.date BETWEEN previous_start AND previous_end) AS previous_observed_days,
    CAST(coalesce(sum(t.visits) FILTER (t.date BETWEEN current_start AND current_end), 0) AS BIGINT) AS current_visits,
    CAST(coalesce(sum(t.visits) FILTER (t.date BETWEEN previous_start AND previous_end), 0) AS BIGINT) AS previous_visits
  FROM f_products p CROSS JOIN bounds LEFT JOIN f_traffic t ON t.product_id = p.product_id GROUP BY p.product_id),
p_orders AS (SELECT p.product_id,
    count(DISTINCT o.order_id) FILTER (o.order_date BETWEEN current_start AND current_end) AS current_orders, count(DISTINCT o.order_id) FILTER (o.order_date BETWEEN previous_start AND previous_end) AS previous_orders,
    CAST(coalesce(sum(o.revenue) FILTER (o.order_date BETWEEN current_start AND current_end), 0) AS DOUBLE) AS current_gmv, CAST(coalesce(sum(o.revenue) FILTER (o.order_date BETWEEN previous_start AND previous_end), 0) AS DOUBLE) AS previous_gmv,
    count(DISTINCT o.order_id) FILTER (o.order_date BETWEEN current_start AND current_end AND o.is_refund) AS current_refunds
  FROM f_products p CROSS JOIN bounds LEFT JOIN f_orders o ON o.product_id = p.product_id GROUP BY p.product_id),
wide AS (SELECT *, CASE WHEN current_observed_days = 15 THEN CAST(current_orders AS DOUBLE) / nullif(current_visits, 0) END AS current_cvr,
    CASE WHEN previous_observed_days = 15 THEN CAST(previous_orders AS DOUBLE) / nullif(previous_visits, 0) END AS previous_cvr,
    CAST(current_refunds AS DOUBLE) / nullif(current_orders, 0) AS refund_rate, CAST(current_visits - previous_visits AS DOUBLE) / nullif(previous_visits, 0) AS traffic_change_rate,
    (current_gmv - previous_gmv) / nullif(previous_gmv, 0) AS gmv_change_rate,
    (current_gmv / nullif(current_orders, 0) - previous_gmv / nullif(previous_orders, 0)) / nullif(previous_gmv / nullif(previous_orders, 0), 0) AS aov_change_rate
  FROM p_traffic JOIN p_orders USING (product_id)),
labelled AS (SELECT *, current_cvr - previous_cvr AS cvr_change, current_observed_days < 15 OR previous_observed_days < 15 AS gaps FROM wide)"""
BOUNDS = "as_of_date, current_start, current_end, previous_start, previous_end"
COMMERCE = """
c_lines AS (SELECT CAST(o_orderkey AS VARCHAR) AS order_id, p_brand AS product_id, o_custkey, CAST(o_orderdate AS DATE) AS order_date, CAST(l_quantity AS BIGINT) AS quantity,
            CAST(l_extendedprice AS DECIMAL(18,2)) AS revenue, l_returnflag = 'R' AS is_refund FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
c_end AS (SELECT max(order_date) AS d FROM c_lines),
c_known AS (SELECT CASE WHEN order_date > d - INTERVAL 30 DAY THEN 'current' ELSE 'previous' END AS period, l.product_id, category, r_name AS region, c_mktsegment AS channel, order_id, revenue, quantity, is_refund
            FROM c_lines l, c_end, (SELECT p_brand, min(p_type) AS category FROM part GROUP BY p_brand) b, customer, nation, region
            WHERE order_date > d - INTERVAL 60 DAY AND b.p_brand = l.product_id AND c_custkey = o_custkey AND c_nationkey = n_nationkey AND n_regionkey = r_regionkey),
c_sales AS (SELECT period, product_id, category, region, channel, CAST(sum(revenue) AS DOUBLE) AS gmv, count(DISTINCT order_id) AS orders, CAST(sum(quantity) AS BIGINT) AS units,
            count(DISTINCT order_id) FILTER (is_refund) AS refund_orders FROM c_known GROUP BY ALL)"""


def _funnel_sales(where: str = "TRUE") -> str:
    return f"""f_sales AS (SELECT period, o.product_id, category, region, channel, CAST(sum(revenue) AS DOUBLE) AS gmv, count(DISTINCT order_id) AS orders, count(*) AS units,
      count(DISTINCT order_id) FILTER (is_refund) AS refund_orders FROM f_orders o JOIN periods ON order_date BETWEEN a AND b JOIN f_products p ON p.product_id = o.product_id JOIN f_customers c ON c.user_id = o.user_id
      WHERE {where} GROUP BY ALL)"""


GRID = """f_grid AS (SELECT period, product_id, category, a, b, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM periods, f_products),
f_daily AS (SELECT period, g.product_id, category, CAST(coalesce(sum(impressions), 0) AS BIGINT) AS impressions, CAST(coalesce(sum(clicks), 0) AS BIGINT) AS clicks, CAST(coalesce(sum(visits), 0) AS BIGINT) AS visits,
  count(t.date) AS observed_days, count(*) - count(t.date) AS missing_days FROM f_grid g LEFT JOIN f_traffic t ON t.product_id = g.product_id AND t.date = g.date GROUP BY ALL)"""
SPEND = "f_spend AS (SELECT period, m.product_id, category, campaign_id, CAST(sum(spend) AS DOUBLE) AS spend FROM f_marketing m JOIN periods ON date BETWEEN a AND b JOIN f_products p ON p.product_id = m.product_id GROUP BY ALL)"


def derived(metrics: list[str], group_by: list[str], *, sales: str = "f_sales", traffic: bool = True, days: str = "15") -> str:
    """SELECT of derived metrics from the CTEs of the window queries."""
    both = ("current", "previous")
    on = ", ".join(group_by)
    by = f"GROUP BY {on}" if on else ""
    lead = f"{on}, " if on else ""

    def sums(table, names):
        exact = lambda n: f"CAST({n} AS DECIMAL(28,6))" if n in ("gmv", "spend") else n
        cells = ", ".join(f"coalesce(sum({exact(n)}) FILTER (period = '{p}'), 0) AS {p}_{n}" for n in names for p in both)
        return f"(SELECT {lead}{cells} FROM {table} {by})"

    parts = [sums(sales, ["gmv", "orders", "refund_orders"])]
    if traffic:
        parts += [sums("f_daily", ["impressions", "clicks", "visits", "observed_days"]), sums("f_spend", ["spend"])]
        inner = ", ".join(f"coalesce(max(observed_days) FILTER (period = '{p}'), -1) = {days} AS {p}_ok" for p in both)
        parts.append(f"(SELECT {lead}{', '.join(f'bool_and({p}_ok) AS {p}_full' for p in both)} FROM (SELECT {lead}product_id AS pid, {inner} FROM f_daily GROUP BY {lead}product_id) {by})")
    source = parts[0] + " s0"
    for k, part in enumerate(parts[1:], 1):
        source += f" FULL JOIN {part} s{k} USING ({on})" if on else f" CROSS JOIN {part} s{k}"
    v = lambda n: f"CAST(coalesce({n}, 0) AS DOUBLE)"
    div = lambda a, b: f"({a} / nullif({b}, 0))"
    rate = lambda a, b: f"(({a} - {b}) / nullif({b}, 0))"
    f = {}
    for p in both:
        f |= {f"{p}_{m}": f"CAST(coalesce({p}_{m}, 0) AS BIGINT)" for m in ("orders", "impressions", "clicks", "visits", "observed_days")}
        f |= {f"{p}_{m}": v(f"{p}_{m}") for m in ("gmv", "spend")}
        f[f"{p}_aov"] = div(v(f"{p}_gmv"), v(f"{p}_orders"))
        f[f"{p}_ctr"] = div(v(f"{p}_clicks"), v(f"{p}_impressions"))
        f[f"{p}_cvr"] = f"CASE WHEN {p}_full THEN {div(v(f'{p}_orders'), v(f'{p}_visits'))} END"
        f[f"{p}_roas"] = div(v(f"{p}_gmv"), v(f"{p}_spend"))
    f["gmv_change_rate"], f["aov_change_rate"] = rate(f["current_gmv"], f["previous_gmv"]), rate(f["current_aov"], f["previous_aov"])
    f["cvr_change"] = f"({f['current_cvr']} - {f['previous_cvr']})"
    f["cvr_change_rate"] = rate(f["current_cvr"].join("()"), f["previous_cvr"].join("()")) if traffic else ""
    f["traffic_change_rate"] = rate(v("current_visits"), v("previous_visits"))
    f["current_refund_rate"] = f["refund_rate"] = div(v("current_refund_orders"), v("current_orders"))
    f["evidence_value"] = f"CASE WHEN NOT coalesce(current_full AND previous_full, FALSE) THEN CAST(least(coalesce(current_observed_days, 0), coalesce(previous_observed_days, 0)) AS DOUBLE) WHEN {f['refund_rate']} >= 0.12 THEN {f['refund_rate']} WHEN {f['cvr_change']} <= -0.01 THEN {f['cvr_change']} WHEN {f['traffic_change_rate']} <= -0.2 THEN {f['traffic_change_rate']} END"
    f["cvr_change"] = f"(({f['current_cvr']}) - ({f['previous_cvr']}))"
    return f"SELECT {lead}{', '.join(f'{f[m]} AS {m}' for m in metrics)} FROM {source}"


_ALL = f"WITH {FUNNEL}, {_funnel_sales()}, {GRID}, {SPEND} "
KPI = """k_traffic AS (SELECT date, count(*) AS observed_rows, count(*) AS total_rows, sum(impressions) AS i, sum(clicks) AS c, sum(visits) AS v FROM f_traffic GROUP BY date),
k_orders AS (SELECT order_date AS date, CAST(sum(revenue) AS DOUBLE) AS gmv, count(DISTINCT order_id) AS orders, count(*) FILTER (is_refund) AS refunds FROM f_orders GROUP BY 1),
k_spend AS (SELECT date, CAST(sum(spend) AS DOUBLE) AS spend FROM f_marketing GROUP BY 1),
kpi AS (SELECT date, observed_rows, total_rows, CAST(observed_rows AS DOUBLE) / total_rows AS coverage, gmv AS "GMV", orders AS "Orders", gmv / nullif(orders, 0) AS "AOV", CAST(c AS DOUBLE) / nullif(i, 0) AS "CTR",
  CAST(orders AS DOUBLE) / nullif(v, 0) AS "CVR", CAST(refunds AS DOUBLE) / nullif(orders, 0) AS "Refund Rate", gmv / nullif(spend, 0) AS "ROAS"
  FROM k_traffic LEFT JOIN k_orders USING (date) LEFT JOIN k_spend USING (date))"""
ANOMALY = """CASE WHEN gaps THEN 'missing_traffic' WHEN refund_rate >= 0.12 THEN 'high_refund' WHEN traffic_change_rate <= -0.3 AND gmv_change_rate <= -0.3 THEN 'multi_factor_drop'
  WHEN traffic_change_rate <= -0.3 THEN 'traffic_drop' WHEN cvr_change <= -0.01 THEN 'conversion_drop' WHEN gmv_change_rate <= -0.3 AND aov_change_rate <= -0.3 THEN 'sales_drop' END"""

ORACLES = {
    "gmv_change": f"""WITH {FUNNEL}, t AS (SELECT {BOUNDS},
        CAST(coalesce(sum(revenue) FILTER (order_date BETWEEN current_start AND current_end), 0) AS DOUBLE) AS current_gmv, CAST(coalesce(sum(revenue) FILTER (order_date BETWEEN previous_start AND previous_end), 0) AS DOUBLE) AS previous_gmv,
        count(DISTINCT order_id) FILTER (order_date BETWEEN current_start AND current_end) AS current_orders, count(DISTINCT order_id) FILTER (order_date BETWEEN previous_start AND previous_end) AS previous_orders
        FROM bounds LEFT JOIN f_orders ON order_date BETWEEN previous_start AND current_end GROUP BY ALL)
      SELECT *, current_gmv / nullif(current_orders, 0) AS current_aov, previous_gmv / nullif(previous_orders, 0) AS previous_aov, (current_gmv - previous_gmv) / nullif(previous_gmv, 0) AS gmv_change_rate,
        (current_gmv / nullif(current_orders, 0) - previous_gmv / nullif(previous_orders, 0)) / nullif(previous_gmv / nullif(previous_orders, 0), 0) AS aov_change_rate FROM t""",
    "product_anomalies": f"""WITH {FUNNEL} SELECT {BOUNDS}, product_id, {ANOMALY} AS anomaly_type, traffic_change_rate, current_cvr, previous_cvr, refund_rate AS current_refund_rate, gmv_change_rate, aov_change_rate,
        current_observed_days, previous_observed_days FROM labelled, bounds WHERE {ANOMALY} IS NOT NULL""",
    "conversion_decline": f"""WITH {FUNNEL} SELECT {BOUNDS}, product_id, current_cvr, previous_cvr, cvr_change, current_orders, previous_orders, current_visits, previous_visits, current_observed_days, previous_observed_days
        FROM labelled, bounds WHERE cvr_change < 0 ORDER BY cvr_change, product_id LIMIT 10""",
    "products_to_watch": f"""WITH {FUNNEL}, r AS (SELECT *, CASE WHEN gaps THEN 1 WHEN refund_rate >= 0.12 THEN 2 WHEN cvr_change <= -0.01 THEN 3 WHEN gmv_change_rate <= -0.2 THEN 4 END AS k FROM labelled)
      SELECT {BOUNDS}, product_id, ['data_quality_review', 'refund_risk', 'conversion_decline', 'gmv_decline'][k] AS watch_reason, gmv_change_rate, cvr_change, refund_rate, current_observed_days, previous_observed_days
      FROM r, bounds WHERE k IS NOT NULL ORDER BY k, product_id LIMIT 10""",
    "next_week_priorities": f"""WITH {FUNNEL}, r AS (SELECT *, CASE WHEN gaps THEN 1 WHEN refund_rate >= 0.12 THEN 2 WHEN cvr_change <= -0.01 THEN 3 WHEN traffic_change_rate <= -0.2 THEN 4 END AS k FROM labelled),
      e AS (SELECT *, CASE k WHEN 1 THEN CAST(least(current_observed_days, previous_observed_days) AS DOUBLE) WHEN 2 THEN refund_rate WHEN 3 THEN cvr_change ELSE traffic_change_rate END AS evidence_value FROM r WHERE k IS NOT NULL)
      SELECT {BOUNDS}, product_id, ['repair_data_quality', 'investigate_refunds', 'recover_conversion', 'recover_traffic'][k] AS priority_reason,
        ['observed_days', 'refund_rate', 'cvr_change', 'traffic_change_rate'][k] AS evidence_metric, evidence_value, current_observed_days, previous_observed_days
      FROM e, bounds ORDER BY k, abs(evidence_value) DESC, product_id LIMIT 10""",
    "query_product": f"""WITH {FUNNEL} SELECT product_id, 'Cohort ' || n AS product_name, category, CAST(10 + n % 7 AS DECIMAL(18,2)) AS price, CAST(5 + n % 7 AS DECIMAL(18,2)) AS cost, DATE '2023-01-01' AS launch_date
        FROM f_products WHERE product_id IN ('P001', 'P004', 'P999')""",
    "query_sales": f"WITH {FUNNEL}, {_funnel_sales()} SELECT * FROM f_sales",
    "query_sales_commerce": f"WITH {COMMERCE} SELECT * FROM c_sales",
    "query_sales_without_refunds": f"WITH {FUNNEL}, {_funnel_sales('NOT is_refund')} SELECT * FROM f_sales",
    "query_traffic": f"WITH {FUNNEL}, {GRID} SELECT * FROM f_daily",
    "query_traffic_complete": f"WITH {FUNNEL}, {GRID} SELECT * FROM f_daily WHERE missing_days = 0",
    "query_marketing": f"WITH {FUNNEL}, {SPEND} SELECT * FROM f_spend",
    "metrics_total": _ALL + derived(COMMON_METRICS, []),
    "metrics_by_product": _ALL + derived(list(derive.METRICS), ["product_id"]),
    "metrics_by_category": _ALL + derived(COMMON_METRICS, ["category"]),
    "metrics_by_product_category": _ALL + derived(COMMON_METRICS, ["product_id", "category"]),
    "metrics_by_region": f"WITH {FUNNEL}, {_funnel_sales()} " + derived(SALES_METRICS, ["region"], traffic=False),
    "metrics_by_channel": f"WITH {COMMERCE} " + derived(SALES_METRICS, ["channel"], sales="c_sales", traffic=False),
    "daily_kpis": f"WITH {FUNNEL}, {KPI} SELECT * FROM kpi",
    "coverage_gaps": f"WITH {FUNNEL}, d AS (SELECT date, count(*) AS observed_rows, (SELECT count(*) FROM f_products) AS total_rows FROM f_traffic GROUP BY date) SELECT *, CAST(observed_rows AS DOUBLE) / total_rows AS coverage FROM d WHERE observed_rows < total_rows",
    "summary_stats": f"WITH {FUNNEL}, {KPI} "
    + " UNION ALL ".join(f"""SELECT '{c}' AS metric, count("{c}") AS count, """ + ", ".join(f"""round(CAST({f.replace('?', f'"{c}"')} AS DOUBLE), 6) AS {n}""" for f, n in (("avg(?)", "mean"), ("stddev_samp(?)", "std"), ("min(?)", "min"), ("quantile_cont(?, 0.25)", "q25"), ("quantile_cont(?, 0.5)", "q50"), ("quantile_cont(?, 0.75)", "q75"), ("max(?)", "max"))) + " FROM kpi" for c in ("coverage", "GMV", "Orders", "AOV", "CTR", "CVR", "Refund Rate", "ROAS")),
    "fk_violations": f"WITH {FUNNEL} SELECT product_id, count(*) AS orders FROM f_orders WHERE product_id NOT IN (SELECT product_id FROM f_products WHERE product_id < 'P050') GROUP BY product_id",
    "duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "grain_gaps": f"""WITH {FUNNEL}, g AS (SELECT product_id, CAST(unnest(generate_series((SELECT min(date) FROM f_traffic), (SELECT max(date) FROM f_traffic), INTERVAL 1 DAY)) AS DATE) AS date FROM f_products)
      SELECT product_id, date, 'absent' AS problem FROM (SELECT product_id, date FROM g EXCEPT SELECT product_id, date FROM f_traffic)""",
    "funnel_violations": f"""WITH {FUNNEL}, l AS (SELECT date, product_id, impressions, clicks, CASE WHEN day(date) % 3 = 0 THEN visits - 2 ELSE visits END AS visits FROM f_traffic) SELECT * FROM l WHERE impressions < clicks OR visits < clicks""",
    "revenue_identity": f"WITH {COMMERCE} SELECT order_id, quantity, revenue AS unit_price, revenue FROM c_lines WHERE round(revenue, 2) <> round(revenue * quantity, 2)",
    "quality_report": f"""WITH {FUNNEL} SELECT * FROM (VALUES ('schema:products', 0::BIGINT), ('schema:customers', 0), ('schema:marketing', (SELECT count(*) FROM f_marketing WHERE spend < 0)), ('key:products', 0), ('key:customers', 0), ('key:traffic', 0), ('key:marketing', 0),
        ('schema:traffic', (SELECT count(*) FROM f_traffic WHERE impressions < clicks OR visits < clicks)), ('schema:orders', (SELECT count(*) FROM f_orders WHERE revenue <= 0)), ('key:orders', 0),
        ('reference:traffic.product_id', 0), ('reference:marketing.product_id', 0), ('reference:orders.product_id', 0), ('reference:orders.customer_id', 0),
        ('grain:traffic', (SELECT (SELECT count(*) FROM f_products) * (max(date) - min(date) + 1) - count(DISTINCT (product_id, date)) FROM f_traffic)),
        ('grain:marketing', (SELECT (SELECT count(*) FROM f_products) * (max(date) - min(date) + 1) - count(DISTINCT (product_id, date)) FROM f_marketing)), ('funnel', 0), ('revenue', 0)) t("check", failed)""",
    "evidence_ids": f"""WITH {FUNNEL} SELECT 'EV_PRODUCT_ANOMALY_' || lpad(CAST(row_number() OVER (ORDER BY product_id) AS VARCHAR), 3, '0') AS evidence_id, product_id, {ANOMALY} AS anomaly_type FROM labelled WHERE {ANOMALY} IS NOT NULL""",
    "topk_nulls_last": f"""WITH {FUNNEL} SELECT product_id, round(cvr_change, 9) AS cvr_change, round(gmv_change_rate, 9) AS gmv_change_rate FROM labelled ORDER BY 2 ASC NULLS LAST, 3 DESC NULLS LAST, 1 LIMIT 5""",
    "period_union": f"WITH {FUNNEL} SELECT period, CAST(sum(revenue) AS DOUBLE) AS gmv, count(*) AS orders FROM periods JOIN f_orders ON order_date BETWEEN a AND b GROUP BY period",
    "product_id_extract": """WITH i AS (SELECT o_orderkey, 'P' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') AS a, 'P' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') AS b FROM orders)
      SELECT o_orderkey, CASE WHEN a = b THEN a ELSE a || ',' || b END AS ids FROM i""",
    "formatters": """WITH p AS (SELECT p_partkey, CAST(p_retailprice AS DECIMAL(18,6)) AS price FROM part)
      SELECT p_partkey, '¥' || format('{:,.2f}', CAST(round(price, 2) AS DECIMAL(18,2))::DOUBLE) AS money, format('{:,}', p_partkey * 1000) AS count,
        CASE WHEN round((price - 1000) / 10, 2) > 0 THEN '+' ELSE '' END || CAST(CAST(round(CAST((price - 1000) AS DECIMAL(28,10)) / 10, 2) AS DECIMAL(20,2)) AS VARCHAR) || '%' AS rate FROM p""",
}

#: Order of each rule's rows in SQL, and how many metrics a row has.
RULE_ROWS = {
    "gmv_diagnosis": ("1", 8),
    "product_anomaly": ("product_id", 8),
    "conversion_decline": ("cvr_change, product_id", 9),
    "products_to_watch": ("list_position(['data_quality_review', 'refund_risk', 'conversion_decline', 'gmv_decline'], watch_reason), product_id", 5),
    "next_week_priority": ("list_position(['repair_data_quality', 'investigate_refunds', 'recover_conversion', 'recover_traffic'], priority_reason), abs(evidence_value) DESC, product_id", 3),
}
GOLD = "gold AS (" + " UNION ALL ".join(
    f"SELECT '{task}' AS task, row_number() OVER (ORDER BY {order}) AS number, {'CAST(NULL AS VARCHAR)' if task == 'gmv_diagnosis' else 'product_id'} AS product_id, CAST({n} AS BIGINT) AS n_metrics FROM ({ORACLES[contract.TASK_RULES[task]]})"
    for task, (order, n) in RULE_ROWS.items()
) + ")"


def _cells() -> str:
    rows = []
    for i, task in enumerate(contract.TASKS):
        for j, (capability, weight) in enumerate(contract.WEIGHTS.items()):
            for variant in (1, 2):
                source, answerable, _ = contract.INSUFFICIENT[task]
                short = capability == "data_insufficiency"
                split = "public_validation" if (task, capability, variant) in contract.VALIDATION else "development"
                tools = contract.DEFAULT.tools(task, capability)
                per_row = len(answerable) if short else RULE_ROWS[task][1]
                rows.append(f"({(i * 10 + j) * 2 + variant}, '{task}', '{capability}', {variant}, '{split}', '{','.join(tools)}', {len(tools)}, {weight}, '{source if short else task}', {'NULL' if short else contract.TOP[task]}, {per_row})")
    return "cells(number, task, capability, variant, split, tools, n_tools, weight, source, top, per_row) AS (VALUES " + ", ".join(rows) + ")"


CASES = f"""WITH {GOLD}, {_cells()},
  counted AS (SELECT c.*, 'CASE_' || lpad(CAST(c.number AS VARCHAR), 3, '0') AS case_id, count(g.number) AS n_evidence FROM cells c LEFT JOIN gold g ON g.task = c.source AND CASE WHEN c.top IS NULL THEN g.product_id = 'P005' ELSE g.number <= c.top END GROUP BY ALL),
  scored AS (SELECT *, n_evidence * per_row AS n_metrics, CAST(weight + 2 * n_tools + n_evidence AS DOUBLE) + CAST(n_evidence * per_row AS DOUBLE) / 10 AS complexity_score FROM counted),
  placed AS (SELECT *, row_number() OVER (ORDER BY complexity_score, case_id) AS place FROM scored),
  cases AS (SELECT *, CASE WHEN place <= 30 THEN 'easy' WHEN place <= 70 THEN 'medium' ELSE 'hard' END AS difficulty FROM placed)"""


def shown(name: str, kind: str) -> str:
    percent = f"round(CAST({name} AS DECIMAL(28,10)) * 100, 2)"
    text = {
        "money": f"'¥' || format('{{:,.2f}}', CAST(CAST(round(CAST({name} AS DECIMAL(28,6)), 2) AS DECIMAL(18,2)) AS DOUBLE))",
        "count": f"format('{{:,}}', {name})",
        "rate": f"CASE WHEN {percent} > 0 THEN '+' ELSE '' END || CAST(CAST({percent} AS DECIMAL(20,2)) AS VARCHAR) || '%'",
    }[kind]
    return f"CASE WHEN {name} IS NULL THEN '{formats.NO_DATA}' ELSE {text} END"


def _answer_sql(task: str) -> str:
    column, direction = answers.ORDER[task]
    label = "product_id" if task == "conversion_decline" else "'Cohort ' || CAST(CAST(substr(product_id, 2) AS INTEGER) AS VARCHAR) || '（' || product_id || '）'"
    cells = ", ".join(f"'{name} ' || {shown(c, kind)}" for part in answers.FIELDS[task] for c, name, kind in part)
    missing = " OR ".join(f"{m} IS NULL" for m in runner.METRICS[task])
    order = f"{column} {direction.upper()} NULLS LAST, product_id"
    metrics = _ALL + derived(runner.METRICS[task], ["product_id"])
    return f"SELECT CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS rank, '- ' || {label} || '：' || concat_ws('；', {cells}) AS line, {missing} AS missing FROM ({metrics}) ORDER BY {order} LIMIT 5"


ORACLES |= {
    "gold_evidence": f"WITH {GOLD} SELECT task, number, product_id, 'EV_' || upper(task) || '_' || lpad(CAST(number AS VARCHAR), 3, '0') AS evidence_id, n_metrics FROM gold",
    "case_table": f"{CASES} SELECT case_id, task, capability, variant, split, tools, n_evidence, n_metrics, complexity_score, difficulty FROM cases",
    "run_summary": f"""{CASES}, records AS (SELECT *, CASE WHEN difficulty = 'hard' THEN 'failed' ELSE 'completed' END AS status FROM cases)
      SELECT split, status, count(*) AS n, arg_min(case_id, number) AS first, arg_max(case_id, number) AS last FROM records GROUP BY split, status""",
    "distractor_min_by_hash": f"""WITH {GOLD}, t(task) AS (VALUES {', '.join(f"('{t}')" for t in contract.TASKS)}), {FUNNEL}
      SELECT task, arg_min(product_id, sha256('dataset|' || task || '|' || product_id)) AS distractor FROM t, f_products WHERE product_id NOT IN (SELECT product_id FROM gold WHERE product_id IS NOT NULL) GROUP BY task""",
    "answer_watch": _answer_sql("products_to_watch"),
    "answer_priorities": _answer_sql("next_week_priority"),
    "answer_conversion": _answer_sql("conversion_decline"),
}

DAMAGED = f"""WITH {FUNNEL},
  d_one AS (SELECT product_id, n, CASE WHEN n % 10 <> 3 THEN CAST(10 + n % 7 AS DECIMAL(18,2)) END AS price, CAST(5 + n % 7 AS DECIMAL(18,2)) AS cost FROM f_products WHERE product_id <> 'P007'),
  d_products AS (SELECT * FROM d_one UNION ALL SELECT * FROM d_one WHERE product_id = 'P011'),
  d_customers AS (SELECT customer_id, CASE WHEN user_id % 50 <> 0 THEN region ELSE '' END AS region FROM f_customers),
  d_traffic AS (SELECT date, product_id, impressions, clicks, CASE WHEN day(date) % 5 = 0 THEN visits - 3 ELSE visits END AS visits FROM f_traffic WHERE NOT (product_id = 'P013' AND day(date) = 2)),
  d_orders AS (SELECT order_id, product_id, CAST(order_id AS BIGINT) AS event, revenue, CASE WHEN CAST(order_id AS BIGINT) % 7 = 0 THEN 2 WHEN CAST(order_id AS BIGINT) % 11 = 0 THEN 0 ELSE 1 END AS quantity FROM f_orders),
  broken AS (
    SELECT 'products' AS "table", product_id AS key, 'price' AS location, 'missing' AS type FROM d_products WHERE price IS NULL
    UNION ALL SELECT 'products', product_id, 'cost', 'value_error' FROM d_products WHERE price IS NULL OR cost <= 0 OR cost >= price
    UNION ALL SELECT 'customers', customer_id, 'region', 'value_error' FROM d_customers WHERE region = ''
    UNION ALL SELECT 'traffic', CAST(date AS VARCHAR) || '|' || product_id, 'impressions', 'value_error' FROM d_traffic WHERE least(impressions, clicks, visits) < 0
    UNION ALL SELECT 'traffic', CAST(date AS VARCHAR) || '|' || product_id, 'clicks', 'value_error' FROM d_traffic WHERE impressions < clicks OR visits < clicks
    UNION ALL SELECT 'marketing', CAST(date AS VARCHAR) || '|' || product_id || '|' || campaign_id, 'spend', 'value_error' FROM f_marketing WHERE spend < 0
    UNION ALL SELECT 'orders', order_id, 'quantity', 'value_error' FROM d_orders WHERE quantity NOT BETWEEN 1 AND 20
    UNION ALL SELECT 'orders', order_id, 'unit_price', 'value_error' FROM d_orders WHERE revenue <= 0
    UNION ALL SELECT 'orders', order_id, 'revenue', 'value_error' FROM d_orders WHERE revenue <> revenue * quantity
    UNION ALL SELECT 'orders', order_id, 'status', 'value_error' FROM d_orders WHERE event % 13 = 0)"""


def _grain(table: str) -> str:
    days = f"(SELECT min(date) AS a, max(date) AS b FROM {table})"
    grid = f"(SELECT product_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM d_products, {days})"
    return f"""((SELECT count(*) FROM {grid} g WHERE NOT EXISTS (SELECT 1 FROM {table} t WHERE t.product_id = g.product_id AND t.date = g.date))
      + (SELECT count(*) FROM (SELECT DISTINCT product_id, date FROM {table}) WHERE product_id NOT IN (SELECT product_id FROM d_products)))"""


_KNOWN = "(SELECT product_id FROM d_products)"
_repeats = lambda table, keys: f"(SELECT count(*) FROM (SELECT 1 FROM {table} GROUP BY {keys} HAVING count(*) > 1))"
_DAMAGED_CHECKS = {
    **{f"schema:{t}": f"""(SELECT count(*) FROM broken WHERE "table" = '{t}')""" for t in ("products", "customers", "traffic", "marketing", "orders")},
    "key:products": _repeats("d_products", "product_id"),
    "key:customers": _repeats("d_customers", "customer_id"),
    "key:traffic": _repeats("d_traffic", "date, product_id"),
    "key:marketing": _repeats("f_marketing", "date, product_id, campaign_id"),
    "key:orders": _repeats("d_orders", "order_id"),
    "reference:traffic.product_id": f"(SELECT count(*) FROM d_traffic WHERE product_id NOT IN {_KNOWN})",
    "reference:marketing.product_id": f"(SELECT count(*) FROM f_marketing WHERE product_id NOT IN {_KNOWN})",
    "reference:orders.product_id": f"(SELECT count(*) FROM d_orders WHERE product_id NOT IN {_KNOWN})",
    "reference:orders.customer_id": "(SELECT count(*) FROM f_orders o WHERE NOT EXISTS (SELECT 1 FROM f_customers c WHERE c.user_id = o.user_id))",
    "grain:traffic": _grain("d_traffic"),
    "grain:marketing": _grain("f_marketing"),
    "funnel": "(SELECT count(*) FROM d_traffic WHERE impressions < clicks OR visits < clicks)",
    "revenue": "(SELECT count(*) FROM d_orders WHERE round(revenue, 2) <> round(revenue * quantity, 2))",
}
ORACLES |= {
    "quality_report_damaged": DAMAGED + " " + " UNION ALL ".join(f"""SELECT '{name}' AS "check", CAST({sql} AS BIGINT) AS failed""" for name, sql in _DAMAGED_CHECKS.items()),
    "schema_errors": DAMAGED + ' SELECT "table", location, type, count(*) AS rows, min(key) AS first_key FROM broken GROUP BY ALL',
    "id_differences": DAMAGED
    + """, want AS (SELECT 'P' || lpad(CAST(i AS VARCHAR), 3, '0') AS id FROM range(1, 62) t(i)), have AS (SELECT product_id AS id, count(*) AS n FROM d_products GROUP BY 1)
      SELECT coalesce(w.id, h.id) AS id, CASE WHEN h.id IS NULL THEN 'absent' WHEN w.id IS NULL THEN 'unexpected' ELSE 'repeated' END AS problem FROM want w FULL JOIN have h ON w.id = h.id WHERE h.id IS NULL OR w.id IS NULL OR n > 1""",
}
