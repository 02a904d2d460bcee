"""Many windows and many requests at once equal one after the other; steps, usage and output models of runs."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import requests
from lumenfold.operators import derive, lookups, periods
from lumenfold.operators.windows import Windows
from lumenfold.plans import artifacts, batched, runner, tools
from lumenfold.sources import generate, schemas
from lumenfold.sources.schemas import Tables

AS_OF = date(2026, 3, 1)


@pytest.fixture(scope="module")
def tables(spark):
    anomalies = (generate.Anomaly("traffic_drop", "P001", 30, 59, 0.5), generate.Anomaly("missing_traffic", "P002", 50, 52))
    made = generate.generate(spark, generate.Config(5, days=60, products=7, customers=20, anomalies=anomalies))
    made = dict(made.items())
    # a day that is stored twice, and one that is not stored
    odd = made["traffic"].where("product_id = 'P003' and date = date'2026-02-20'")
    made["traffic"] = made["traffic"].unionAll(odd).where("not (product_id = 'P004' and date = date'2026-02-10')")
    return Tables(**{name: df.cache() for name, df in made.items()})


def some_windows(n: int) -> dict:
    r, out = random.Random(2), {}
    for k in range(n):
        last, days = AS_OF - timedelta(days=r.randrange(-3, 40)), r.randrange(1, 40)
        ids = r.choice([[], [], ["P003"], ["P001", "P004"], ["P999"]])
        out[f"w{k}"] = Windows.latest(last, days), ids
    out["wide"] = Windows(date(2025, 6, 1), AS_OF, date(2025, 1, 1), date(2025, 5, 31)), []
    out["overlapping"] = Windows(date(2026, 2, 1), AS_OF, date(2026, 2, 10), date(2026, 2, 20)), ["P002"]
    return out


@pytest.mark.parametrize("bin_days", [1, 16])
def test_windows_at_once_equal_one_after_the_other(spark, tables, monkeypatch, bin_days):
    monkeypatch.setattr(periods, "BIN_DAYS", bin_days)
    windows = some_windows(3)
    table = periods.table(spark, windows)
    assert periods.broken(table).count() == 0
    at_once = {name: query(tables, table).cache() for name, query in periods.RUN.items()}
    alone = {"query_sales": lookups.query_sales, "query_traffic": lookups.query_traffic, "query_marketing": lookups.query_marketing}
    for name, (w, ids) in windows.items():
        for tool, query in alone.items():
            want = query(tables, w, ids)
            got = at_once[tool].where(F.col("window_id") == name).select(*want.columns)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), (name, tool)


def test_orders_of_several_days_count_once_a_window(spark, tables):
    """Rows of an order on other days, with another customer, without a number: as one window after the other; and days
    meet the windows, not orders."""
    odd = tables.orders.where("order_date between date'2026-02-05' and date'2026-02-20'")
    far = odd.select(*[F.date_sub("order_date", 12).alias(c) if c == "order_date" else F.lit(True).alias(c) if c == "is_refund" else F.col(c) for c in odd.columns])
    more = odd.select(*[F.lit("C0001").alias(c) if c == "customer_id" else F.col(c) for c in odd.columns])
    nameless = far.select(*[F.lit(None).cast("string").alias(c) if c == "order_id" else F.col(c) for c in far.columns])
    changed = Tables(**{name: df for name, df in tables.items()} | {"orders": tables.orders.unionAll(far).unionAll(more).unionAll(nameless).cache()})
    windows = {k: v for k, v in some_windows(6).items() if k in ("w0", "w3", "wide", "overlapping")}
    at_once = periods.query_sales(changed, periods.table(spark, windows))
    got = at_once.collect()
    for name, (w, ids) in windows.items():
        want = lookups.query_sales(changed, w, ids)
        assert sorted(tuple(r[c] for c in want.columns) for r in got if r.window_id == name) == sorted(map(tuple, want.collect())), name
    plan = at_once._jdf.queryExecution().optimizedPlan().toString()
    met = plan[: plan.index("_bin#")]  # above the join with the windows orders are no longer grouped one by one
    assert "count(1)" not in met and "apart" in met


def test_metrics_at_once_equal_one_after_the_other(spark, tables):
    windows = {k: v for k, v in some_windows(6).items() if k in ("w4", "overlapping")}
    table = periods.table(spark, windows)
    results = {name: query(tables, table) for name, query in periods.RUN.items()}
    for by, names in (([], [m for m in derive.METRICS if m != "evidence_value"]), (["product_id"], list(derive.METRICS))):
        got = periods.calculate_metrics(table, results, names, by).collect()
        for name, (w, ids) in windows.items():
            runs = [derive.Execution(t, w, q(tables, w, ids), tuple(ids), grouped=True) for t, q in (("query_sales", lookups.query_sales), ("query_traffic", lookups.query_traffic), ("query_marketing", lookups.query_marketing))]
            want = derive.calculate_metrics(runs, names, by).collect()
            assert sorted(tuple(r)[1:] for r in got if r.window_id == name) == sorted(map(tuple, want))


def test_windows_meet_facts_without_a_nested_loop(spark, tables, tmp_path):
    table = periods.table(spark, some_windows(2))
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    stored = schemas.read(spark, str(tmp_path))
    for query in periods.RUN.values():
        plan = query(stored, table)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_bad_windows_are_named(spark):
    rows = [("a", "current", date(2026, 1, 2), date(2026, 1, 1), []), ("b", "later", AS_OF, AS_OF, []), ("c", "current", None, AS_OF, None), ("d", "current", date(2024, 1, 1), AS_OF, []), ("e", "current", AS_OF, AS_OF, []), ("e", "current", AS_OF, AS_OF, [])]
    assert {r.window_id for r in periods.broken(spark.createDataFrame(rows, periods.SCHEMA)).collect()} == {"a", "b", "c", "d", "e"}
    none = spark.createDataFrame([], periods.SCHEMA)
    assert periods.broken(none).count() == 0


def test_metrics_need_their_results(spark, tables):
    table = periods.table(spark, some_windows(1))
    with pytest.raises(ValueError):
        periods.calculate_metrics(table, {}, ["current_gmv"])
    with pytest.raises(ValueError):
        periods.calculate_metrics(table, {"query_sales": tables.orders, "query_traffic": tables.traffic}, ["evidence_value"])


# --- requests

TEXTS = ["GMV变化", "你好", "关注商品P001", "P002转化下降", "下周优先处理什么", "P099商品异常", "P003和P004商品异常", "最近999天GMV变化", "P099转化下降", "2026-01-05至2026-01-06 GMV变化", "转化率下降了吗"]


def _cases(texts):
    return [{"case_id": f"CASE_{k:03d}", "split": "development", "dataset_id": "d", "dataset_version": "v", "user_input": t} for k, t in enumerate(texts)]


def test_a_batch_has_the_records_of_single_runs(spark, tables):
    records, summary = runner.batch(spark, _cases(TEXTS), {"d": tables})
    alone = runner.one_by_one(_cases(TEXTS), tables, AS_OF, "d")
    assert records == [runner.record(k, case, run) for k, (case, run) in enumerate(zip(_cases(TEXTS), alone), 1)]
    assert summary["completed"] == 9 and summary["failed"] == 2


def test_jobs_of_a_batch_do_not_grow_with_its_cases(spark, tables):
    def jobs(texts) -> int:
        group = f"batch-{len(texts)}"
        spark.sparkContext.setJobGroup(group, group)
        batched.run(tables, texts, AS_OF)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    some = [t for t in TEXTS if t not in ("你好", "最近999天GMV变化")]
    few, many = jobs(some), jobs(some * 12)
    assert 0 < few and many <= few + 3


def test_an_empty_batch(spark, tables):
    assert batched.run(tables, [], AS_OF) == []
    assert [r.error for r in batched.run(tables, ["你好"], AS_OF)] == ["no_task_signal"]


def test_texts_of_a_table_are_answered_on_the_executors(spark, tables):
    texts = [t for t in TEXTS if requests.parse(t, AS_OF).task]
    frame = spark.createDataFrame(list(enumerate(texts)), "request_id int, text string").repartition(2)
    got = {int(r.request_id): r.answer for r in batched.answer_column(tables, frame, AS_OF).collect()}
    assert [got[k] for k in range(len(texts))] == [r.answer for r in batched.run(tables, texts, AS_OF)]


# --- steps

USE = {"prompt_tokens": 5, "completion_tokens": 2, "total_tokens": 7}
WINDOW = tools.window_arguments(Windows.latest(AS_OF, 7), [])


def _call(state, tool, arguments, number=None):
    return runner.Call(f"c{len(state.results) if number is None else number}", tool, arguments)


def test_a_policy_branches_on_a_result(spark, tables):
    """Looks at sales of two products, and only if they fell, at the traffic of the one that fell most."""

    def policy(state: runner.State) -> runner.Decision:
        if not state.results:
            return runner.Decision(_call(state, "query_sales", WINDOW | {"include_refunds": True, "product_ids": ["P001", "P002"]}), USE)
        if len(state.results) == 1:
            rows, gain = state.results[0].payload()["rows"], {}
            for r in rows:
                gain[r["product_id"]] = gain.get(r["product_id"], 0) + r["gmv"] * (1 if r["period"] == "current" else -1)
            worst = min(gain, key=gain.get)
            if gain[worst] >= 0:
                return runner.Decision(runner.Answer("all rose"))
            return runner.Decision(_call(state, "query_traffic", WINDOW | {"include_missing": True, "product_ids": [worst]}), USE)
        seen = {r["product_id"] for r in state.results[1].payload()["rows"]}
        return runner.Decision(runner.Answer(f"looked at {sorted(seen)}"))

    done = runner.run(tables, "what fell", AS_OF, policy=policy)
    sales = lookups.query_sales(tables, Windows.latest(AS_OF, 7), ["P001", "P002"]).collect()
    gain = {p: sum(r.gmv * (1 if r.period == "current" else -1) for r in sales if r.product_id == p) for p in ("P001", "P002")}
    worst = min(gain, key=gain.get)
    assert done.answer == (f"looked at ['{worst}']" if gain[worst] < 0 else "all rose")
    assert done.usage == {k: v * len(done.executions) for k, v in USE.items()}
    record = runner.record(1, _cases(["what fell"])[0], done)
    artifacts.check_record(record)
    assert record["usage"] == done.usage and [e["call_id"] for e in record["prior_tool_executions"]] == [f"c{k}" for k in range(len(done.executions))]
    with pytest.raises(ValueError):
        artifacts.check_record(record | {"usage": USE | {"total_tokens": 1}})
    records, _ = runner.batch(spark, _cases(["a", "b"]), {"d": tables}, policy=policy)
    assert [r["usage"] for r in records] == [done.usage] * 2 and [r["final_answer"] for r in records] == [done.answer] * 2


def test_steps_end_in_codes(tables):
    sales = WINDOW | {"include_refunds": True}
    run = lambda policy, **o: runner.run(tables, "x", AS_OF, policy=policy, **o)
    forever = lambda s: runner.Decision(_call(s, "query_sales", sales), USE)
    done = run(forever, max_steps=3)
    assert (done.status, done.error, len(done.executions), done.usage["total_tokens"]) == ("failed", runner.STEP_LIMIT, 3, 21)
    assert run(lambda s: runner.Decision(_call(s, "query_sales", sales, 0))).error == runner.REPEATED_CALL
    assert run(lambda s: runner.Decision(_call(s, "no_tool", {}))).error == "unknown_tool"
    assert run(lambda s: runner.Decision(_call(s, "query_sales", {}))).error == "invalid_arguments"
    assert run(lambda s: runner.Decision(runner.GiveUp("no_idea"), USE)).usage == USE
    assert run(lambda s: 1 / 0).error == runner.POLICY_ERROR
    assert run(lambda s: runner.Decision(runner.Answer("x"), {"total_tokens": 1})).error == runner.POLICY_ERROR
    registry = tools.Registry()
    registry.register(tools.Tool("query_sales", "", {"product_ids": "products"}, lambda a: {}, lambda t, e, a: 1 / 0))
    assert run(lambda s: runner.Decision(_call(s, "query_sales", {"product_ids": []})), registry=registry).error == runner.TOOL_ERROR
    assert run(None).error == "no_task_signal"


def test_output_models(spark, tables):
    registry = tools.default_registry()
    sales = registry.invoke("query_sales", WINDOW | {"include_refunds": True, "product_ids": ["P001"]}, tables)
    traffic = registry.invoke("query_traffic", WINDOW | {"include_missing": True}, tables)
    assert sales.payload()["row_count"] and traffic.payload()["row_count"]
    derived = registry.invoke("calculate_metrics", {"metrics": list(derive.METRICS)[:14], "group_by": []}, tables, earlier=[registry.invoke(n, WINDOW | {f: True}, tables) for n, f in (("query_sales", "include_refunds"), ("query_traffic", "include_missing"))])
    assert derived.payload()["row_count"] == 1

    def rows(tool, arguments, change) -> tools.Result:
        one = registry.get(tool)
        broken = tools.Tool(one.name, "", one.parameters, one.model, lambda t, e, a: change(one.handler(t, e, a)), validator=one.validator)
        other = tools.Registry()
        other.register(broken)
        return other.invoke(tool, arguments, tables)

    asked = WINDOW | {"include_refunds": True, "product_ids": ["P001"]}
    days = WINDOW | {"include_missing": True}
    for tool, arguments, change in (
        ("query_sales", asked, lambda d: d.withColumn("orders", -F.col("orders"))),
        ("query_sales", asked, lambda d: d.withColumn("gmv", F.lit(float("nan")))),
        ("query_sales", asked, lambda d: d.withColumn("period", F.lit("later"))),
        ("query_sales", asked, lambda d: d.withColumn("region", F.lit(None).cast("string"))),
        ("query_sales", asked, lambda d: d.withColumn("product_id", F.lit("P002"))),
        ("query_sales", asked, lambda d: d.unionAll(d)),
        ("query_sales", asked, lambda d: d.withColumn("refund_orders", F.col("orders") + 1)),
        ("query_traffic", days, lambda d: d.withColumn("missing_days", F.col("missing_days") + 1)),
        ("query_product", {"product_ids": ["P001"]}, lambda d: d.withColumn("product_id", F.lit("P002"))),
    ):
        with pytest.raises(tools.InvalidResult):
            rows(tool, arguments, change).payload()
    for change in (lambda d: d.withColumn("orders", F.col("orders").cast("string")), lambda d: d.drop("orders"), lambda d: d.withColumnRenamed("gmv", "sum")):
        with pytest.raises(tools.InvalidResult):
            rows("query_sales", asked, change)
