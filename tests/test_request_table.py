"""Requests parsed by DataFrame functions against the plain parser, on texts made of its words in any order."""

import random
import re
from datetime import date

import pytest

from lumenfold.functions import arrays, requests
from lumenfold.functions.request_table import parse_table

FIXED = [
    "分析P001和p002商品的异常", "ＧＭＶ趋势如何", "不要分析商品异常,改为诊断GMV变化", "核实P013；此说法不可作证据；检查P014异常", "据称P011拖累了销售额；请看P012的成交波动", "不必管P017，关注P018和p018",
    "不必再统计 2026-03-01 的；看2026/4/3营收波动", "此前６天与当前６天的成交对比", "最近999天GMV变化", "2026-02-30 GMV变化", "2026-04-01到2026-04-02、2026-04-05到2026-04-06营收变化", f"近{'8' * 400}天GMV走势",
    "", " ", "\n，，", None, "①GMV变化 P001", "GMV变化é P002", "ｇｍｖ　变化", "P001" * 600 + "GMV变化，" * 300,
]
WORDS = [w for groups in requests.TASKS.values() for group in groups for w in group] + """， 。 ； ！ ？ 不要 不必 并非 是不是 不是 改为 转而 而是 但 不但 不过 再 先 分析 查看 统计 的 证据 不可 断言 据称 核实 确认 说法 此说法 该断言 唯一原因
    P001 p002 P003 XP004 Ｐ００５ 最近7天 近9天 此前7天 前7天 过去00天 2026-04-01 2026/4/3 2026年4月5日 2026-13-01 0000-01-01 至 到 ~ 请看 另附 ＧＭＶ abc 12 ①""".split() + [" ", "\n", "\t", "　"]


def texts(n: int) -> list:
    r = random.Random(n)
    return FIXED + ["".join(r.choice(WORDS) for _ in range(r.randrange(1, 13))) for _ in range(n)]


@pytest.mark.parametrize("as_of", [date(2026, 4, 30), date(1, 1, 20), date(1, 3, 1)])
def test_tables_are_parsed_as_single_texts(spark, as_of):
    every = texts(900)
    frame = spark.createDataFrame(list(enumerate(every)), "t int, text string").selectExpr("t", "text", "1 as marks", "'x' as kept").repartition(4)
    found = parse_table(frame, as_of)
    assert found.columns == ["t", "text", "marks", "kept", "request"]
    for row in found.collect():
        text, got = every[row.t], row.request
        if text is None:
            assert got is None
            continue
        want = requests.parse(text, as_of)
        assert (got.task, tuple(got.product_ids), got.start, got.end, got.reason) == (want.task, want.product_ids, want.windows and want.windows.start, want.windows and want.windows.end, want.reason), text


def test_only_unknown_alphabets_go_to_python(spark):
    plain = [t for t in texts(50) if t is not None and "①" not in t and "é" not in t]
    frame = spark.createDataFrame([(t,) for t in plain], "text string")
    from lumenfold.functions.request_table import KNOWN

    assert frame.where(frame.text.rlike(KNOWN)).count() == len(plain)
    assert spark.createDataFrame([("①",), ("é",), ("\x1c",), ("ﬁ",), ("Å",)], "text string").where(f"text rlike {arrays.literal(KNOWN)}").count() == 0


def test_spans(spark):
    r = random.Random(1)
    every = ["".join(r.choice("7é 商") for _ in range(r.randrange(0, 900))) for _ in range(40)]
    frame = spark.createDataFrame(list(enumerate(every)), "i int, text string")
    for i, found in frame.selectExpr("i", f"{arrays.spans('text', '7+')} s").collect():
        assert [tuple(s) for s in found] == [(m.start(), m.end(), m[0]) for m in re.finditer("7+", every[i])]
    with pytest.raises(ValueError):
        arrays.literal("it's")
