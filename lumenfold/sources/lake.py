"""Snapshots of any size: the five tables as Parquet written by the executors, with digests that need no order.

A writer works in a folder of its own, ``data-<id>`` below the snapshot's, and names that folder and each of its files, with
their lengths, in a manifest. The manifest is written aside and put in place by one step that fails if there is one already:
the first writer wins, a later one removes what it wrote. Readers open the manifest and nothing that it doesn't name, so
they see a whole snapshot or none, whatever writers do or leave behind; ``sweep`` removes what dead writers left.

A table's digest is its row count and the sum of a 64-bit hash of every row (as a decimal, so it neither overflows nor
depends on partitioning). The driver holds the names of the files.

The step that decides is a hard link on a local file system and a rename without overwriting elsewhere (atomic on HDFS; on an
object store as far as its connector makes it so).
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import canonical, load_json
from .schemas import SCHEMAS, TABLES, Tables, conform

MANIFEST = "manifest.json"
#: Daily facts are stored by day, so that a window reads the folders of its days only.
BY_DAY = {"traffic": "date", "marketing": "date", "orders": "order_date"}


def digest(df: DataFrame) -> dict:
    """rows and the sum of row hashes, in one pass."""
    found = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(20,0)")), F.lit(0)).cast("string").alias("hash_sum")).first()
    return {"rows": found["rows"], "hash_sum": found["hash_sum"]}


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _identity(entries: dict) -> str:
    return hashlib.sha256(canonical({n: {"rows": e["rows"], "hash_sum": e["hash_sum"]} for n, e in entries.items()})).hexdigest()[:16]


def _files(spark: SparkSession, folder: str) -> dict[str, int]:
    """Data files below a folder by relative path, with their lengths."""
    files, at = _file(spark, folder)
    root, found = files.makeQualified(at).toString().rstrip("/") + "/", {}
    if not files.exists(at):
        return found
    each = files.listFiles(at, True)
    while each.hasNext():
        one = each.next()
        path = one.getPath().toString().removeprefix(root)
        if path.endswith(".parquet"):
            found[path] = one.getLen()
    return found


def _rename_once(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a file unless the target exists; whether it was renamed."""
    jvm = spark._jvm
    files, at = _file(spark, target)
    if files.getScheme() == "file":
        try:
            os.link(*(_file(spark, p)[1].toUri().getPath() for p in (source, target)))
        except FileExistsError:
            return False
        files.delete(_file(spark, source)[1], False)
        return True
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(_file(spark, source)[1], at, spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def _put(spark: SparkSession, path: str, data: bytes) -> None:
    files, at = _file(spark, path)
    out = files.create(at, False)
    out.write(bytearray(data))
    out.close()


def write(tables: Tables, folder: str) -> dict:
    """Writes a snapshot; returns its manifest. A folder that holds one, by the end, is an error."""
    spark = tables.products.sparkSession
    files, at = _file(spark, f"{folder}/{MANIFEST}")
    if files.exists(at):
        raise FileExistsError(f"{folder} holds a snapshot")
    name, entries = f"data-{uuid.uuid4().hex}", {}
    own = f"{folder}/{name}"
    done = False
    try:
        for table, df in tables.items():
            rows, path = conform(table, df), f"{own}/{table}"
            if table in BY_DAY:
                # rebalanced, so that days come together but a large day is many files
                rows.withColumnRenamed(BY_DAY[table], "day").hint("rebalance", "day").write.partitionBy("day").parquet(path)
            else:
                rows.write.parquet(path)
            entries[table] = {"files": _files(spark, path)}
            entries[table] |= digest(_stored(spark, own, table, entries[table]["files"]))
        manifest = {"dataset_id": _identity(entries), "data": name, "tables": entries}
        aside = f"{folder}/.{MANIFEST}-{uuid.uuid4().hex}"
        _put(spark, aside, json.dumps(manifest, sort_keys=True, indent=2).encode())
        done = _rename_once(spark, aside, f"{folder}/{MANIFEST}")
        if not done:
            files.delete(_file(spark, aside)[1], False)
            raise FileExistsError(f"{folder} holds a snapshot")
        return manifest
    finally:
        if not done:
            files.delete(_file(spark, own)[1], True)


def _stored(spark: SparkSession, own: str, table: str, files: dict[str, int]) -> DataFrame:
    """The rows of the named files, the day of a file being part of its name."""
    if not files:
        return spark.createDataFrame([], SCHEMAS[table])
    names = {"day": BY_DAY[table]} if table in BY_DAY else {}
    root = f"{own}/{table}"
    stored = spark.read.option("basePath", root).parquet(*[f"{root}/{f}" for f in sorted(files)]).withColumnsRenamed(names)
    return conform(table, stored.select(*SCHEMAS[table].names))


def manifest_of(spark: SparkSession, folder: str) -> dict:
    """The manifest of a snapshot, after its form was checked."""
    files, at = _file(spark, f"{folder}/{MANIFEST}")
    if not files.exists(at):
        raise ValueError(f"{folder} holds no snapshot")
    stream = files.open(at)
    manifest = load_json(bytes(stream.readAllBytes()))
    stream.close()
    entries = manifest.get("tables", {})
    fine = set(manifest) == {"dataset_id", "data", "tables"} and set(entries) == set(TABLES) and all(set(e) == {"rows", "hash_sum", "files"} for e in entries.values())
    if not fine or _identity(entries) != manifest["dataset_id"] or "/" in manifest["data"] or any(part == ".." for e in entries.values() for f in e["files"] for part in f.split("/")):
        raise ValueError("the manifest is malformed")
    return manifest


def read(spark: SparkSession, folder: str, *, check: bool = True) -> tuple[dict, Tables]:
    """The manifest and the tables, after files and digests were compared."""
    manifest = manifest_of(spark, folder)
    own, tables = f"{folder}/{manifest['data']}", {}
    for name, entry in manifest["tables"].items():
        there = _files(spark, f"{own}/{name}")
        if lost := [f for f, n in entry["files"].items() if there.get(f) != n]:
            raise ValueError(f"{name}: files are missing or of another length: {sorted(lost)[:3]}")
        tables[name] = _stored(spark, own, name, entry["files"])
        if check and digest(tables[name]) != {k: entry[k] for k in ("rows", "hash_sum")}:
            raise ValueError(f"{name}: rows differ")
    return manifest, Tables(**{n: tables[n] for n in TABLES})


def sweep(spark: SparkSession, folder: str, *, older_than: float) -> list[str]:
    """Remove what writers left that the manifest doesn't name and nobody touched for ``older_than`` seconds; their names."""
    files, at = _file(spark, folder)
    keep = {MANIFEST}
    if files.exists(_file(spark, f"{folder}/{MANIFEST}")[1]):
        keep.add(manifest_of(spark, folder)["data"])
    gone = []
    for one in files.listStatus(at):
        name = one.getPath().getName()
        if name not in keep and name.startswith(("data-", f".{MANIFEST}-")) and one.getModificationTime() / 1000 <= time.time() - older_than:
            files.delete(one.getPath(), True)
            gone.append(name)
    return sorted(gone)
