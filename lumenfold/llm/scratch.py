"""What the operators share: tables in the folder that all executors see, bounded Arrow batches, unused column names."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of one Arrow batch on its way to or from a Python worker (a longer row is a batch of its own).
BATCH_BYTES = 4 << 20
#: For tables whose rows take MBs: a writer otherwise counts its bytes once in 100 rows, and a reader takes a row group of up
#: to 4,096 rows at once.
WIDE_ROWS = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1, "parquet.enable.dictionary": False}
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, on the default file system where it has no scheme.

    A local session without the setting gets a temporary one; a cluster without it is an error, as executors there
    don't share local folders.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lumenfold-")
        spark.conf.set("spark.checkpoint.dir", path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    full = files.makeQualified(at).toString().rstrip("/")
    return full if "://" in full else full.replace("file:/", "file:///", 1)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lumenfold/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, *, compression: str = "snappy", wide: bool = False) -> DataFrame:
    """Write df once and return a reader of the written table: lineage ends there and a lost executor costs
    a reread only. The shuffle files of the write are deleted with its end. ``wide``: rows take MBs."""
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**(WIDE_ROWS if wide else {})).parquet(path, compression=compression)
    finally:
        spark.conf.set(CLEANUP, before)
    written = spark.read.schema(df.schema).parquet(path)
    written._scratch = path
    if _open():
        _open()[-1].paths.append(path)
    return written


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop(df: DataFrame) -> None:
    """Delete the files of a materialized table that no later plan reads."""
    _delete(df.sparkSession, df._scratch)
    for work in _open():
        work.paths = [p for p in work.paths if p != df._scratch]


class Workspace:
    """Deletes, at its end, the tables that were materialized inside and not kept; what is kept passes to the workspace
    around it, if there is one."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.kept = spark, [], []

    def __enter__(self) -> Workspace:
        _open().append(self)
        return self

    def keep(self, *tables: DataFrame) -> None:
        """Tables (as ``materialize`` returned them) that the result still reads."""
        self.kept += [t._scratch for t in tables]

    def __exit__(self, *_) -> None:
        _open().remove(self)
        for path in self.paths:
            if path not in self.kept:
                _delete(self.spark, path)
        if _open():
            _open()[-1].paths += [p for p in self.paths if p in self.kept]


_state = threading.local()


def _open() -> list[Workspace]:
    """The workspaces of this thread, the innermost last."""
    return _state.__dict__.setdefault("open", [])


def bound_batches(spark: SparkSession) -> None:
    """Cut the session's Arrow batches by bytes, unless it has a smaller setting of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).lower().rstrip("b")
    if now.isdigit() and int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


_caches: list[dict] = []
_operator = ""


def cache() -> dict:
    """A table that a Python worker keeps from one task of an operator to the next."""
    _caches.append({})
    return _caches[-1]


def enter(operator: str) -> None:
    """Called by a task in a Python worker: tables that another operator left in it are dropped."""
    global _operator
    if operator != _operator:
        for table in _caches:
            table.clear()
        _operator = operator
        release()


def release() -> None:
    """Give a Python worker's free memory back to the system: workers outlive their tasks, and the next stage's add to
    them."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def sorted_distinct(x):
    """The distinct values of an array, sorted (several times faster than numpy.unique on short arrays)."""
    import numpy as np

    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def byte_slices(column, limit: int = BATCH_BYTES):
    """(first, last) of slices of an Arrow text column with at most ``limit`` bytes each, or one row."""
    import numpy as np
    import pyarrow.compute as pc

    if not len(column):
        return
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64))
    first = 0
    while first < len(ends):
        base = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield first, last
        first = last


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, underscored until no column of the frames has it."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
