import os

import pytest

from lumenfold.llm import neardup, scratch


def tables(spark) -> set:
    top = scratch.shared_dir(spark).removeprefix("file://") + "/lumenfold"
    return set(os.listdir(top)) if os.path.isdir(top) else set()


def test_workspaces_delete_what_is_not_kept(spark):
    before = tables(spark)
    with scratch.Workspace(spark) as outer:
        with scratch.Workspace(spark) as inner:
            kept, gone = (scratch.materialize(spark.range(3), name) for name in ("kept", "gone"))
            inner.keep(kept)
        assert kept.count() == 3 and len(tables(spark) - before) == 1 and gone is not None
        outer.keep(scratch.materialize(kept, "result"))
    [left] = tables(spark) - before
    assert left.startswith("result")
    with pytest.raises(ZeroDivisionError), scratch.Workspace(spark):
        scratch.materialize(spark.range(3), "lost")
        1 / 0
    assert tables(spark) - before == {left}


def test_near_duplicates_leave_two_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "x")], "doc_id long, text string")
    before = tables(spark)
    found = neardup.find(docs)
    assert {t.rsplit("-", 1)[0] for t in tables(spark) - before} == {"neardup-signatures", "neardup-roots"} and found.count() == 3


def test_shared_folder_is_qualified_and_needed_on_clusters(spark, monkeypatch):
    assert scratch.shared_dir(spark).startswith("file:///")
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: None)

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        conf, sparkContext = spark.conf, Context()

    with pytest.raises(RuntimeError):
        scratch.shared_dir(Session())


def test_byte_slices():
    import pyarrow as pa

    column = pa.array(["a" * 10, None, "b" * 30, "c", "", "d" * 9])
    assert list(scratch.byte_slices(column, 10)) == [(0, 2), (2, 3), (3, 6)]
    assert list(scratch.byte_slices(column.slice(2), 100)) == [(0, 4)] and list(scratch.byte_slices(column.slice(0, 0), 10)) == []


def test_workers_drop_tables_of_other_operators():
    table = scratch.cache()
    scratch.enter("one")
    table["a"] = 1
    scratch.enter("one")
    assert table == {"a": 1}
    scratch.enter("two")
    assert table == {}
