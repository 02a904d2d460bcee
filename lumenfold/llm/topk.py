"""Exact top-k inner-product search with block-at-a-time pruning.

Components become integers floor(1024 * x). Rows are cut into blocks of consecutive ids; a block holds its forward
index (the integer matrix of its rows) and, for each term (dimension), the largest and smallest value. The sum over
terms of the larger of q * max and q * min bounds every score in the block. Each query visits blocks in descending order
of bound and stops when the bound falls below its kth score; a block whose bound equals the kth score is still scored, as
it may hold a tie with a smaller id.

The rows are written once as ranges (ids and integer matrix of at most ``RANGE_ROWS`` rows or ``RANGE_BYTES``), the queries
likewise as blocks. Ranges are dealt to runs of about ``RUN_BYTES``, query blocks to groups of about ``GROUP_BYTES``, and each
run meets each group once, by key: a run goes out once for each group, a group once for each run. There, the blocks of all
ranges of the run are ordered together for each query, and a query keeps its k best; so memory is one run and one group,
whatever the number of queries. A window over the k rows of each query and run picks the k best.

Defined results: rows with a null id or vector, or with a null or non-finite component, take no part; a shorter vector
counts as padded with zeros; equal scores go to the smaller id; a repeated candidate row is as many candidates; a query
is its id with one vector (of several, the one that sorts first); an empty table gives an empty result. Integer sums that
double arithmetic can't hold exactly are computed with Python integers; a score outside 64 bits is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import bound_batches, materialize

SCALE, K = 1024, 10
BLOCK_ROWS, QUERY_ROWS = 256, 2048
RANGE_ROWS, RANGE_BYTES = 8192, 4 << 20
RUN_BYTES = GROUP_BYTES = 32 << 20
RESULT = "query_id long, vec_id long, score long"


def usable(vectors: DataFrame, *, id_column="vec_id", vector_column="embedding") -> DataFrame:
    """id and double components of the rows that take part."""
    x = F.transform(F.col(vector_column), lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vectors.where(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull() & fine).select(F.col(id_column).cast("long").alias("id"), x.alias("x"))


class Blocks:
    """Rows of one run, cut into blocks of consecutive ids."""

    def __init__(self, ids, values, block_rows: int = BLOCK_ROWS):
        import numpy as np

        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        self.spans = [(a, min(a + block_rows, len(ids))) for a in range(0, len(ids), block_rows)]
        self.high = np.array([self.values[a:b].max(0) for a, b in self.spans])
        self.low = np.array([self.values[a:b].min(0) for a, b in self.spans])
        self.scored = 0

    def search(self, query_ids, queries, k: int, best: dict):
        """Improves ``best``: position of a query to the ids and scores of its k best rows so far."""
        import numpy as np

        exact = np.abs(queries).max(initial=0) * max(np.abs(self.high).max(initial=0), np.abs(self.low).max(initial=0)) * max(1, queries.shape[1]) < 2**52

        def product(a, b):
            if exact:
                return (a @ b.T).astype(np.int64)
            wide = np.array([[int(v) for v in row] for row in b], object)
            return np.array([[sum(int(p) * q for p, q in zip(row, other)) for other in wide] for row in a], object)

        if exact:
            bounds = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
        else:  # rounded sums are no bound: visit every block
            bounds = np.full((len(queries), len(self.spans)), np.inf)
        visit = np.argsort(-bounds, axis=1, kind="stable")
        kth = np.array([best[q][1][-1] if q in best and len(best[q][1]) == k else -np.inf for q in range(len(queries))])
        for step in range(len(self.spans)):
            block = visit[:, step]
            live = np.flatnonzero(bounds[np.arange(len(queries)), block] >= kth)
            if not len(live):
                break
            for b in np.unique(block[live]):
                asking = live[block[live] == b]
                start, end = self.spans[b]
                scores = product(queries[asking], self.values[start:end])
                self.scored += len(asking)
                for row, q in zip(scores, asking.tolist()):
                    keep = (row >= kth[q]) & (self.ids[start:end] != query_ids[q])
                    if not keep.any():
                        continue
                    old = best.get(q, (np.empty(0, np.int64), np.empty(0, row.dtype)))
                    ids, got = np.concatenate([old[0], self.ids[start:end][keep]]), np.concatenate([old[1], row[keep]])
                    top = np.lexsort((ids, -got))[:k]
                    best[q] = (ids[top], got[top])
                    if len(top) == k:
                        kth[q] = got[top[-1]]


def pack(rows: DataFrame, n_rows: int) -> DataFrame:
    """Rows of (id, x) in ranges: width, and the ids and integer components of at most ``n_rows`` rows each."""

    def ranges(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = np.asarray(batch.column(0), np.int64), batch.column(1)
            offsets, flat = np.asarray(x.offsets, np.int64), np.asarray(x.flatten(), np.float64)
            offsets, widths = offsets - offsets[0], np.diff(offsets)
            step = max(1, min(n_rows, RANGE_BYTES // (8 * max(1, int(widths.max())))))
            out = {"width": [], "ids": [], "values": []}
            for at in range(0, len(ids), step):
                mine = widths[at : at + step]
                width = max(1, int(mine.max()))
                matrix = np.zeros((len(mine), width))
                matrix[np.arange(width) < mine[:, None]] = flat[offsets[at] : offsets[at + len(mine)]]
                for name, value in zip(out, (width, ids[at : at + step].tobytes(), np.floor(SCALE * matrix).tobytes())):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict({"width": pa.array(out["width"], pa.int32()), "ids": pa.array(out["ids"], pa.binary()), "values": pa.array(out["values"], pa.binary())})

    return rows.mapInArrow(ranges, "width int, ids binary, values binary")


def _parts(packed: DataFrame, size: int, least: int) -> int:
    """How many parts of about ``size`` bytes; at least ``least``, where there are so many rows to deal."""
    found = packed.agg(F.count("*").alias("n"), F.sum(F.octet_length("values")).alias("bytes")).first()
    return max(1, -(-(found["bytes"] or 0) // size), min(least, found["n"]))


def search(vectors: DataFrame, queries: DataFrame, *, k: int = K, query_rows: int = QUERY_ROWS, block_rows: int = BLOCK_ROWS, range_rows: int = RANGE_ROWS, **names) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows of ``vectors`` for each row of ``queries``."""
    bound_batches(vectors.sparkSession)
    ranges = materialize(pack(usable(vectors, **names), range_rows), "topk-ranges")
    asked = usable(queries, **names).groupBy("id").agg(F.min("x").alias("x"))
    blocks = materialize(pack(asked, query_rows), "topk-queries")
    runs = _parts(ranges, RUN_BYTES, vectors.sparkSession.sparkContext.defaultParallelism)
    groups = _parts(blocks, GROUP_BYTES, 1)
    dealt = lambda n: F.pmod(F.xxhash64("ids", "width"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    sides = ranges.select("*", dealt(runs).alias("run"), every(groups).alias("group")), blocks.select("*", dealt(groups).alias("group"), every(runs).alias("run"))

    def scan(own, asking):
        import numpy as np
        import pyarrow as pa

        out = {"query_id": [], "vec_id": [], "score": []}
        by_width: dict = {}
        for width, ids, values in zip(*(own.column(c).to_pylist() for c in ("width", "ids", "values"))):
            by_width.setdefault(width, []).append((np.frombuffer(ids, np.int64), np.frombuffer(values).reshape(-1, width)))
        stored = [(width, Blocks(np.concatenate([i for i, _ in parts]), np.concatenate([v for _, v in parts]), block_rows)) for width, parts in sorted(by_width.items())]
        by_width.clear()
        for width, ids, values in zip(*(asking.column(c).to_pylist() for c in ("width", "ids", "values"))):
            query_ids, best = np.frombuffer(ids, np.int64), {}
            asked = np.frombuffer(values).reshape(len(query_ids), width)
            for wide, rows in stored:
                # what is longer than the other side meets zeros there
                fit = np.pad(asked, ((0, 0), (0, wide - width))) if wide > width else asked[:, :wide]
                rows.search(query_ids, fit, k, best)
            for q, (found, scores) in best.items():
                out["query_id"] += [query_ids[q]] * len(found)
                out["vec_id"] += found.tolist()
                out["score"] += [int(s) for s in scores]
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    found = sides[0].groupBy("run", "group").cogroup(sides[1].groupBy("run", "group")).applyInArrow(scan, RESULT)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.where("vec_id % 100 = 0"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""
