"""Streamed logical hashes against rows one by one; the commit protocol of distributed snapshots under several writers."""

import threading
import tracemalloc
from datetime import date, timedelta
from decimal import Decimal

import pyarrow.parquet as pq
import pytest

from lumenfold.sources import lake, snapshot
from lumenfold.sources.schemas import SCHEMAS, TABLES, Tables

ODD = ["plain", "", 'quo"te', "back\\slash", "new\nline\ttab\rreturn\bback\ffeed", "\x01\x1f\x0b control", "\x7f del", "商品 é 😀", "</script>", "a,b]", None]


def by_hand(path) -> str:
    table = pq.read_table(path)
    doubles = {n for n in table.column_names if str(table.schema.field(n).type) == "int64" and table.column(n).null_count}
    return snapshot.logical_sha256(table.to_batches(), table.column_names, doubles)


def tables_of(spark, tag: str = "a", n: int = 30) -> Tables:
    day = date(2026, 1, 1)
    rows = {
        "products": [(f"P{k:03d}", ODD[k % len(ODD)], tag, Decimal(k * 10) / 100, Decimal("-0.50") if k % 2 else Decimal("100.00"), day) for k in range(n)],
        "customers": [(f"C{k:04d}", None if k % 5 == 0 else k % 2 == 0, tag, ODD[-k % len(ODD)]) for k in range(n)],
        "traffic": [(day + timedelta(days=k % 9), f"P{k:03d}", None if k % 4 == 0 else k * 10**k if k < 12 else k, k, 10**15 + k, k % 2 == 0) for k in range(n)],
        "marketing": [(day + timedelta(days=k % 9), f"P{k:03d}", tag, None if k % 3 == 0 else Decimal(k)) for k in range(n)],
        "orders": [(f"O{k}", f"P{k:03d}", "C", day + timedelta(days=k % 9), k - 3, Decimal("1.10"), Decimal("0.00"), True, tag) for k in range(n)],
    }
    return Tables(**{name: spark.createDataFrame(rows[name], SCHEMAS[name]).repartition(3) for name in TABLES})


@pytest.mark.parametrize("range_rows", [4, 50_000])
def test_streamed_hashes_equal_rows_one_by_one(spark, tmp_path, monkeypatch, range_rows):
    monkeypatch.setattr(snapshot, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(snapshot, "BATCH_ROWS", 7)
    for name, df in tables_of(spark).items():
        for part, rows in (("all", df), ("none", df.where("false"))):
            path = tmp_path / f"{name}-{part}.parquet"
            entry = snapshot.write_table(name, rows, path)
            assert entry["rows"] == rows.count() and entry["logical_sha256"] == by_hand(path)
            assert snapshot.check_table(path) == entry
            stored = pq.read_table(path)
            keys = [tuple(r[k] for k in snapshot.ORDER[name]) for r in stored.to_pylist()]
            assert keys == sorted(keys) and stored.schema.names == SCHEMAS[name].names


def test_numbers_too_large_for_the_hash_are_refused(spark, tmp_path):
    day = date(2026, 1, 1)
    rows = spark.createDataFrame([(day, "P001", 10**17, 1, 1, False), (day, "P002", None, 1, 1, True)], SCHEMAS["traffic"])
    with pytest.raises(Exception, match="too large"):
        snapshot.write_table("traffic", rows, tmp_path / "x.parquet")
    assert snapshot.write_table("traffic", rows.where("impressions is not null"), tmp_path / "y.parquet")["rows"] == 1


def test_memory_stays_flat_as_rows_grow(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshot, "RANGE_ROWS", 2000)
    monkeypatch.setattr(snapshot, "BATCH_ROWS", 1000)

    def peak(n: int) -> int:
        made = spark.range(n).selectExpr("concat('C', id) customer_id", "true is_new_customer", "repeat('r', 50) region", "cast(id as string) channel")
        tracemalloc.start()
        assert snapshot.write_table("customers", made, tmp_path / f"{n}.parquet")["rows"] == n
        assert snapshot.check_table(tmp_path / f"{n}.parquet")["rows"] == n
        size = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return size

    peak(100)
    assert peak(50_000) < 1.5 * peak(5_000) + (1 << 20)


# --- the commit protocol


def test_of_several_writers_one_wins_and_readers_see_all_or_nothing(spark, tmp_path):
    folder, won, lost, seen, errors = f"file://{tmp_path}/lake", [], [], [], []
    ending = threading.Event()

    def writer(tag: str) -> None:
        try:
            won.append((tag, lake.write(tables_of(spark, tag), folder)))
        except FileExistsError:
            lost.append(tag)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    def reader() -> None:
        while not ending.is_set():
            try:
                _, tables = lake.read(spark, folder)
                seen.append({r.category for r in tables.products.collect()} | {r.status for r in tables.orders.collect()})
            except ValueError as e:
                if "holds no snapshot" not in str(e):
                    errors.append(e)

    watching = threading.Thread(target=reader)
    watching.start()
    writers = [threading.Thread(target=writer, args=(tag,)) for tag in "ab"]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    _, tables = lake.read(spark, folder)
    ending.set()
    watching.join()
    (tag, manifest), rest = won[0], won[1:]
    assert not errors and not rest and len(lost) == 1
    assert {r.category for r in tables.products.collect()} == {tag} and all(s == {tag} for s in seen)
    assert sorted(p.name for p in (tmp_path / "lake").iterdir() if not p.name.endswith(".crc")) == sorted([manifest["data"], lake.MANIFEST])


def test_a_writer_that_dies_leaves_nothing_visible(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/lake"
    stray = tmp_path / "lake" / "data-dead" / "products"
    stray.mkdir(parents=True)
    (stray / "part.parquet").write_bytes(b"half")
    with pytest.raises(ValueError, match="holds no snapshot"):
        lake.read(spark, folder)

    def fail(*_):
        raise OSError("no space")

    with monkeypatch.context() as m:
        m.setattr(lake, "_put", fail)
        with pytest.raises(OSError):
            lake.write(tables_of(spark), folder)
    assert [p.name for p in (tmp_path / "lake").iterdir()] == ["data-dead"]
    manifest = lake.write(tables_of(spark), folder)
    assert lake.sweep(spark, folder, older_than=3600) == [] and lake.sweep(spark, folder, older_than=0) == ["data-dead"]
    assert lake.read(spark, folder)[0] == manifest


def test_rename_without_a_hard_link(spark, tmp_path, monkeypatch):
    """The way of other file systems, tried on the local one."""
    real = lake._file

    class Other:
        def __init__(self, files):
            self._files = files

        def getScheme(self):
            return "other"

        def __getattr__(self, name):
            return getattr(self._files, name)

    monkeypatch.setattr(lake, "_file", lambda s, p: (Other(real(s, p)[0]), real(s, p)[1]))
    (tmp_path / "a").write_text("a")
    (tmp_path / "b").write_text("b")
    assert lake._rename_once(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/m")
    assert not lake._rename_once(spark, f"file://{tmp_path}/b", f"file://{tmp_path}/m")
    assert (tmp_path / "m").read_text() == "a"


def test_manifests_are_checked(spark, tmp_path):
    folder = f"file://{tmp_path}/lake"
    lake.write(tables_of(spark), folder)
    path = tmp_path / "lake" / lake.MANIFEST
    text = path.read_text()
    for old, new in (('"rows": 30', '"rows": 31'), ('"data": "data-', '"data": "../data-'), ('"tables"', '"other"')):
        path.write_text(text.replace(old, new, 1))
        (path.parent / f".{path.name}.crc").unlink(missing_ok=True)
        with pytest.raises(ValueError):
            lake.read(spark, folder)
