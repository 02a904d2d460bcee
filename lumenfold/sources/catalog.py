"""A read-only catalog over a verified snapshot: one SELECT at a time, over its five tables only."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..functions.values import json_safe
from . import guard, schemas, snapshot


class Catalog:
    def __init__(self, session: SparkSession, tables: schemas.Tables, dataset_id: str, label: str):
        self.session, self.dataset_id, self.label, self._closed = session, dataset_id, label, False
        self.tables = tables

    def __enter__(self) -> Catalog:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self._closed = True

    def check(self, sql: str) -> None:
        """PermissionError unless ``sql`` is exactly one query over the catalog's tables."""
        guard.check(self.session, sql, schemas.TABLES)

    def execute(self, sql: str, args=None) -> DataFrame:
        if self._closed:
            raise RuntimeError("the catalog is closed")
        self.check(sql)
        return self.session.sql(sql, args=args) if args else self.session.sql(sql)

    def fetch(self, sql: str, args=None, *, limit: int = 100_000) -> tuple[list[str], list[dict]]:
        """Column names and rows (values as JSON holds them); more than ``limit`` rows are an error, not a cut."""
        found = self.execute(sql, args)
        rows = found.limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError(f"more than {limit} rows")
        return found.columns, [{c: json_safe(v) for c, v in zip(found.columns, row)} for row in rows]


def open_dataset(spark: SparkSession, folder: str | Path, label: str = "") -> Catalog:
    """Verify a snapshot and open it in a session of its own."""
    manifest = snapshot.verify(folder)
    session = spark.newSession()
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    tables = schemas.read(session, f"file://{Path(folder).resolve()}")
    tables.register()
    return Catalog(session, tables, manifest["dataset_id"], label or Path(folder).name)
