"""Quality: Bradley-Terry scores learnt from preference pairs, cut at a score quantile.

A document's strength is linear in its features; the chance that one document is preferred to another is the logistic
function of the difference of their strengths. Preference pairs come from labels: a document of label 1 is preferred to one
of label 0. Each labelled document meets ``PAIRS`` others of the other label, and the weights minimise the logistic loss of
the differences of the pairs' features, with a small penalty.

Features of a text are shares, so that they don't grow with its length: the square root of the share of each byte value;
the shares of short and long words, of words equal to the one, two or three places before, and of lines that stood before;
the mean length of words, and the logarithm of their number. They are scaled by their spread over the sample.

The cut is the quantile of strengths at the share of label 0: as large a part of the labelled documents lies below it as was
labelled 0. The score is the logistic function of the strength, moved so that the cut has the score ``THRESHOLD``.

All usable labels are learnt from, with one text an id (of several, the one with the smallest hash). Their features are
written once in blocks of about ``BLOCK`` documents, dealt by a hash of the id; a document's others are drawn in its block,
and of a label that is rare its documents also stand in more blocks, as others only. The minimum is found by Newton's method:
a pass over the blocks adds up loss, gradient and second derivatives, of which the driver gets one sum a task (at most
``SUMS``). The quantile is exact, by bins that narrow. A caller may bound the labels by ``max_labels``: ids by a hash, half
of them kept for label 1; in the quantile they count by the share of their label. Scoring reads every whole text.

Defined results: a null or empty text has all features 0 and a score like others; a null id is never held out and never used
for learning; label rows with a null or another value are ignored; several labels of one document count as 1 if any is 1;
with labels of one class only, or none, every score is the smoothed rate of label 1, (n1 + 1) / (n + 2); an empty table gives
an empty result; extra columns are ignored by ``score`` and kept by ``keep_best``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Workspace, bound_batches, enter, materialize, release, unused

#: At most so many labelled ids are broadcast; more are joined as Spark plans it.
BROADCAST_IDS = 1_000_000
#: Documents of a block, and how many of each label it has at least, on average, where there are so many.
BLOCK, LEAST = 512, 32
#: Sums that reach the driver at once, of FEATURES * FEATURES numbers each.
SUMS = 64
#: Bins of a step towards the quantile, and values that are looked at one by one.
BINS, FEW = 1024, 4096
PAIRS = 16
THRESHOLD = 0.3
PENALTY = 1e-3
FOLDS = 5
SHORT, LONG = 2, 12
LAGS = (1, 2, 3)
FEATURES = 256 + 5 + len(LAGS)


def features(text: str | None):
    import operator

    import numpy as np

    data = (text or "").encode("utf-8", "replace")
    out = np.zeros(FEATURES)
    if not data:
        return out
    out[:256] = np.sqrt(np.bincount(np.frombuffer(data, np.uint8), minlength=256) / len(data))
    words, lines = data.split(), [x for x in data.split(b"\n") if x]
    if words:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out[256:259] = (sizes <= SHORT).mean(), (sizes >= LONG).mean(), min(sizes.mean(), 100) / 10
        out[259] = np.log1p(len(words)) / 10
        out[260] = 1 - len(set(lines)) / len(lines)
        for k, lag in enumerate(LAGS):
            out[261 + k] = sum(map(operator.eq, words, words[lag:])) / len(words)
    return out


@dataclass
class Model:
    """Strength is ``features @ weights + offset``; the score is its logistic function."""

    weights: object
    offset: float


def held_out(id_column: str = "doc_id"):
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % FOLDS == 0


def training_rows(documents: DataFrame, labels: DataFrame, *, label="quality", id_column="doc_id", text_column="text", max_labels: int | None = None) -> tuple[DataFrame, DataFrame]:
    """One label for each usable id; id, label and text of all ids outside the held-out fold, or of ``max_labels``."""
    usable = labels.where(F.col(id_column).isNotNull() & F.col(label).isin(0, 1) & ~held_out(id_column))
    one_each = usable.groupBy(F.col(id_column).cast("long").alias("_id")).agg(F.max(label).cast("int").alias("_label"))
    sample = one_each
    if max_labels is not None:
        order, half = [F.xxhash64("_id"), F.col("_id")], max_labels // 2
        sample = one_each.where("_label = 1").orderBy(*order).limit(half).unionAll(one_each.where("_label = 0").orderBy(*order).limit(half))
    texts = documents.select(F.col(id_column).cast("long").alias("_doc"), F.col(text_column).alias("_text"))
    found = texts.join(F.broadcast(sample) if sample.count() <= BROADCAST_IDS else sample, F.col("_doc") == F.col("_id"))
    # copies of an id meet as hashes first, combined in each task; then one text of each is taken
    first = found.groupBy("_id", "_label").agg(F.min(F.struct(F.xxhash64("_text").alias("h"), F.coalesce("_text", F.lit("")).alias("t"))).alias("m"))
    return one_each, first.select("_id", "_label", F.col("m.t").alias("_text"))


def pairs(label, count: int, seed: int = 13):
    """Rows of preferred and other documents: each row meets ``count`` rows of the other label."""
    import numpy as np

    better, worse = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    draw = np.random.default_rng(seed)
    left = [np.repeat(better, count), draw.choice(better, len(worse) * count)]
    right = [draw.choice(worse, len(better) * count), np.repeat(worse, count)]
    return np.concatenate(left), np.concatenate(right)


def terms(z, label, own, w, *, count: int = PAIRS, seed: int = 13):
    """Over the pairs that ``own`` rows of a block draw: their number, and the sums of loss, gradient and second derivatives
    (one after the other), s = z @ w."""
    import numpy as np

    n = len(z)
    i, j = pairs(label, count, seed)
    drawn = np.concatenate([np.repeat(own[label == k], count) for k in (1, 0)])
    i, j, s = i[drawn], j[drawn], z @ w
    gap = s[i] - s[j]
    back = 1 / (1 + np.exp(np.clip(gap, -35, 35)))
    slope = z.T @ (np.bincount(j, back, n) - np.bincount(i, back, n))
    met = np.bincount(i * n + j, back * (1 - back), n * n).reshape(n, n)
    bend = z.T @ ((met.sum(0) + met.sum(1))[:, None] * z - (met + met.T) @ z)
    return np.concatenate([[len(i), np.logaddexp(0, -gap).sum()], slope, bend.ravel()])


def newton(sums, width: int, penalty: float = PENALTY, steps: int = 60):
    """Weights that minimise the mean of log(1 + exp(-(s_i - s_j))) over pairs (i preferred to j) with the penalty, from the
    ``terms`` of all pairs; a step that doesn't lower it is halved."""
    import numpy as np

    def at(w):
        got = sums(w)
        n, loss = max(got[0], 1), got[1]
        return loss / n + penalty / 2 * w @ w, got[2 : 2 + width] / n + penalty * w, got[2 + width :].reshape(width, width) / n + penalty * np.eye(width)

    w = np.zeros(width)
    value, slope, bend = at(w)
    for _ in range(steps):
        step = np.linalg.solve(bend, slope)
        gain, rate = slope @ step, 1.0
        if gain < 1e-7:
            break
        new = at(w - step)
        while new[0] > value - 1e-4 * rate * gain and rate > 1e-6:
            rate /= 2
            new = at(w - rate * step)
        w = w - rate * step
        value, slope, bend = new
    return w


def fit(x, label, *, count: int = PAIRS, penalty: float = PENALTY):
    """Weights for the rows of one block."""
    import numpy as np

    spread = x.std(axis=0)
    scale = np.where(spread > 1e-9, 1 / np.maximum(spread, 1e-9), 0.0)
    z, own = (x - x.mean(axis=0)) * scale, np.ones(len(x), bool)
    return newton(lambda w: terms(z, label, own, w, count=count), x.shape[1], penalty) * scale


def blocks(rows: DataFrame, n1: int, n0: int) -> DataFrame:
    """Written once: block, x, label, own (arrays as bytes) from id, label, x."""

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        enter("ranking")
        names = ["block", "x", "label", "own"]

        def flush(block, held):
            x, label, own = zip(*held)
            return pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "x": [b"".join(x)], "label": [np.array(label, np.int8).tobytes()], "own": [np.array(own, bool).tobytes()]})

        held, current = [], None
        for batch in batches:
            for block, *row in zip(*(batch.column(c).to_pylist() for c in names)):
                if held and block != current:
                    yield flush(current, held)
                    held = []
                current = block
                held.append(row)
        if held:
            yield flush(current, held)
        release()

    many = max(1, -(-(n1 + n0) // BLOCK))
    copies = F.when(F.col("label") == 1, F.lit(min(many, -(-LEAST * many // max(n1, 1))))).otherwise(F.lit(min(many, -(-LEAST * many // max(n0, 1)))))
    dealt = rows.select("id", "label", "x", F.posexplode(F.sequence(F.lit(0), copies - 1)).alias("k", "turn"))
    # copies of a document stand in blocks that are evenly apart
    block = F.pmod(F.pmod(F.xxhash64("id"), F.lit(many)) + F.floor(F.col("k") * F.lit(many) / copies), F.lit(many)).cast("long")
    dealt = dealt.select(block.alias("block"), "x", "label", (F.col("k") == 0).alias("own"), "id")
    tasks = min(-(-many // 4), 2000)
    return materialize(dealt.repartition(tasks, "block").sortWithinPartitions("block", "id").mapInArrow(pack, "block long, x binary, label binary, own binary"), "ranking-blocks", compression="zstd", wide=True)


def _opened(batches):
    """Number, features, labels and own rows of each block."""
    import numpy as np

    for batch in batches:
        for row in batch.to_pylist():
            yield row["block"], np.frombuffer(row["x"], np.float32).reshape(-1, FEATURES).astype(float), np.frombuffer(row["label"], np.int8), np.frombuffer(row["own"], bool)


def _added(table: DataFrame, function):
    """The sum of ``function(number, x, label, own)`` over the blocks; at most SUMS partial sums reach the driver."""

    def add(batches):
        import pyarrow as pa

        enter("ranking")
        first, total = None, 0
        for number, *block in _opened(batches):
            first, total = number if first is None else first, total + function(number, *block)
        if first is not None:
            yield pa.RecordBatch.from_pydict({"first": pa.array([first], pa.int64()), "total": [total.tobytes()]})
        release()

    import numpy as np

    found = table.coalesce(SUMS).mapInArrow(add, "first long, total binary").toArrow().sort_by("first").to_pylist()
    return sum(np.frombuffer(r["total"]) for r in found)


def cut_at(strengths: DataFrame, share: float) -> float:
    """``quantile`` of a table: s and weight."""
    bounds = strengths.agg(F.min("s").alias("a"), F.max("s").alias("b"), F.sum("weight").alias("w"), F.count("*").alias("n")).first()
    low, high, n, below, before = bounds["a"], bounds["b"], bounds["n"], 0.0, None
    target = share * bounds["w"] * (1 + 1e-12)
    while True:
        inside = strengths.where(F.col("s").between(low, high))
        few = n <= FEW or low == high
        key = F.col("s") if few else F.least(F.floor((F.col("s") - low) / (high - low) * BINS), F.lit(BINS - 1))
        found = sorted(inside.groupBy(key.alias("k")).agg(F.sum("weight").alias("w"), F.min("s").alias("a"), F.max("s").alias("b"), F.count("*").alias("n")).collect())
        for r in found:
            if below + r["w"] > target:
                break
            below, before = below + r["w"], r["b"]
        else:
            return float(before + 1e-9)
        if few:
            return float(r["a"] if before is None else (before + r["a"]) / 2)
        low, high, n = r["a"], r["b"], r["n"]


def quantile(values, weights, share: float) -> float:
    """Between the last value that belongs to the first ``share`` of the weight, and the next one."""
    import numpy as np

    order = np.argsort(values, kind="stable")
    v, total = values[order], np.cumsum(weights[order])
    at = int(np.searchsorted(total, share * total[-1] * (1 + 1e-12), side="right"))
    if not 0 < at < len(v):
        return float(v[0] if at == 0 else v[-1] + 1e-9)
    return float((v[at - 1] + v[at]) / 2)


def train(documents: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, **options) -> Model:
    with Workspace(documents.sparkSession):
        return _train(documents, labels, threshold, **options)


def _train(documents: DataFrame, labels: DataFrame, threshold: float, **options) -> Model:
    import numpy as np

    bound_batches(documents.sparkSession)

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enter("ranking")
        for batch in batches:
            yield pd.DataFrame({"id": batch["_id"], "label": batch["_label"], "x": [features(t).astype(np.float32).tobytes() for t in batch["_text"]]})
        release()

    usable, sample = training_rows(documents, labels, **options)
    counts = usable.agg(F.sum(F.col("_label").cast("long")).alias("n1"), F.count("*").alias("n")).first()
    n1, n0 = counts["n1"] or 0, counts["n"] - (counts["n1"] or 0)
    rows = materialize(sample.mapInPandas(describe, "id long, label int, x binary"), "ranking-train", compression="zstd")
    seen = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(seen) < 2:
        return Model(np.zeros(FEATURES), float(np.log((n1 + 1) / (n0 + 1))))
    table = blocks(rows, seen[1], seen[0])
    n = seen[0] + seen[1]
    mean = _added(table, lambda _, x, label, own: x[own].sum(axis=0)) / n
    spread = np.sqrt(_added(table, lambda _, x, label, own: ((x[own] - mean) ** 2).sum(axis=0)) / n)
    scale = np.where(spread > 1e-7, 1 / np.maximum(spread, 1e-7), 0.0)
    weights = newton(lambda w: _added(table, lambda k, x, label, own: terms((x - mean) * scale, label, own, w, seed=13 + k)), FEATURES) * scale

    def strong(batches):
        import pyarrow as pa

        for _, x, label, own in _opened(batches):
            yield pa.RecordBatch.from_pydict({"label": pa.array(label[own], pa.int32()), "s": x[own] @ weights})

    share = F.when(F.col("label") == 1, F.lit(n1 / seen[1])).otherwise(F.lit(n0 / seen[0]))
    strengths = materialize(table.mapInArrow(strong, "label int, s double").select("s", share.alias("weight")), "ranking-strengths")
    return Model(weights, float(np.log(threshold / (1 - threshold)) - cut_at(strengths, n0 / (n0 + n1))))


def score(documents: DataFrame, model: Model, *, text_column="text", output="score") -> DataFrame:
    """``documents`` with a score between 0 and 1 added."""
    bound_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast((model.weights, model.offset))  # FEATURES numbers

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        enter("ranking")
        weights, offset = shared.value
        for texts in batches:
            z = np.array([features(t) @ weights for t in texts], float) + offset
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -35, 35))))
        release()

    return documents.withColumn(output, F.pandas_udf(scores, "double").asNondeterministic()(F.col(text_column)))


def keep_best(documents: DataFrame, labels: DataFrame, *, threshold=THRESHOLD, **options) -> DataFrame:
    """The rows of ``documents`` whose score reaches the threshold; same columns."""
    found = unused("quality", documents)
    scored = score(documents, train(documents, labels, threshold=threshold, **options), text_column=options.get("text_column", "text"), output=found)
    return scored.where(F.col(found) >= threshold).select(*[F.col(f"`{c}`") for c in documents.columns])


def op13_quality(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(documents, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
