"""Global ranks without one partition: rows are sorted by ranges, and each range is numbered from the rows before it.

The ranges are checkpointed in the folder that spark.checkpoint.dir names, so what was counted is what is numbered, and a lost
executor costs a reread. The driver sees one count a range.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLACE = 33  # bits of a row's place in its partition, as monotonically_increasing_id gives it


def checkpoint_dir(spark: SparkSession) -> None:
    """The session's folder; a local session without one gets its own, a cluster without one is an error."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lumenfold-")
    context.setCheckpointDir(path)


def numbered(rows: DataFrame, *keys, output: str = "rank", ranges: int | None = None) -> tuple[DataFrame, int]:
    """``rows`` with their rank from 1 in the order of ``keys``, and how many there are. Rows that agree in all keys get
    neighbouring ranks in either order."""
    spark = rows.sparkSession
    checkpoint_dir(spark)
    dealt = rows.repartitionByRange(ranges, *keys) if ranges else rows.repartitionByRange(*keys)
    placed = dealt.sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_at", PLACE)
    counts, before, total = sorted(map(tuple, placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())), [], 0
    for number, n in counts:
        before.append((number, total))
        total += n
    offsets = F.broadcast(spark.createDataFrame(before, "_part long, _before long"))  # one row a range
    joined = placed.join(offsets, part == F.col("_part"))
    return joined.withColumn(output, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << PLACE) - 1)) + 1).drop("_at", "_part", "_before"), total
