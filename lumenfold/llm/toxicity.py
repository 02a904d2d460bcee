"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct byte n-grams (orders 3 to 6) of the lower-cased text with white space runs as one blank,
hashed into ``2 ** BITS`` buckets. From the labelled documents each bucket gets its document counts by class; its scale
is the log ratio of the smoothed class rates. A logistic regression is then fitted on these scaled presence features.
Buckets whose counts say nothing about the class (a likelihood-ratio test at p = 0.001) keep weight 0; every other
bucket is a feature, whatever their number.

The labelled sample is bounded by ``MAX_LABELS`` ids, chosen by a hash of the id, half of it kept for label 1, with one
text an id (of several, the one with the smallest hash); that bound is what makes the broadcast and the collected matrix
bounded. Scoring reads every whole text.

Defined results: a null or empty text has no features and gets the score of the intercept; a null id is never held out
(its remainder is unknown) and never used for learning; label rows with a null are ignored; several labels of one
document count as 1 if any is 1; with one class only (or none), every score is the smoothed rate of label 1, (n1 + 1) / (n + 3); extra columns are
ignored by ``score`` and kept by ``reject``.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Workspace, bound_batches, enter, materialize, release, sorted_distinct, unused

BITS = 22
ORDERS = (3, 4, 5, 6)
MAX_LABELS = 12_000
MIN_G2 = 10.8  # likelihood-ratio statistic at p = 0.001
SMOOTHING = 1.0
THRESHOLD = 0.5
FOLDS = 5
#: Documents whose features leave a Python worker together: a document has thousands of them.
ROWS = 128


def features(text: str | None, among=None):
    """Sorted distinct buckets of a text; with ``among`` (a mask of buckets) only those."""
    import numpy as np

    data = b" " + b" ".join((text or "").lower().encode("utf-8", "replace").split()) + b" "
    if len(data) < 3:
        return np.empty(0, np.uint32)
    x = np.frombuffer(data, np.uint8).astype(np.uint64)
    found = []
    for n in ORDERS:
        if len(x) < n:
            break
        packed = np.zeros(len(x) - n + 1, np.uint64)
        for k in range(n):
            packed |= x[k : k + len(packed)] << np.uint64(8 * k)
        packed |= np.uint64(n << 56)
        packed *= np.uint64(0x9E3779B97F4A7C15)
        buckets = (packed >> np.uint64(64 - BITS)).astype(np.uint32)
        found.append(buckets if among is None else buckets[among[buckets]])
    return sorted_distinct(np.concatenate(found))


@dataclass
class Model:
    """Weight (classifier weight times log-count ratio) of each bucket in ``buckets``, and the intercept."""

    buckets: object
    weights: object
    intercept: float

    def table(self):
        import numpy as np

        table = np.zeros(1 << BITS, np.float32)
        table[self.buckets] = self.weights
        return table


def held_out(id_column: str = "doc_id"):
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % FOLDS == 0


def training_rows(documents: DataFrame, labels: DataFrame, *, label="toxic", id_column="doc_id", text_column="text", max_labels=MAX_LABELS) -> tuple[DataFrame, DataFrame]:
    """All usable labels, one an id; id, label and one text of at most ``max_labels`` ids outside the held-out fold."""
    usable = labels.where(F.col(id_column).isNotNull() & F.col(label).isin(0, 1) & ~held_out(id_column))
    one_each = usable.groupBy(F.col(id_column).alias("_id")).agg(F.max(label).alias("_label"))
    order = [F.xxhash64("_id"), F.col("_id")]
    half = max_labels // 2
    positive = one_each.where("_label = 1").orderBy(*order).limit(half)
    negative = one_each.where("_label = 0").orderBy(*order).limit(half)
    sample = positive.unionAll(negative)
    texts = documents.select(F.col(id_column).alias("_doc"), F.col(text_column).alias("_text"))
    found = texts.join(F.broadcast(sample), F.col("_doc") == F.col("_id"))  # at most max_labels ids
    # texts of an id meet as one from each task
    first = found.groupBy("_id", "_label").agg(F.min(F.struct(F.xxhash64("_text").alias("h"), F.coalesce("_text", F.lit("")).alias("t"))).alias("m"))
    return one_each, first.select("_id", "_label", F.col("m.t").alias("_text"))


def train(documents: DataFrame, labels: DataFrame, **options) -> Model:
    with Workspace(documents.sparkSession):
        return _train(documents, labels, **options)


def _train(documents: DataFrame, labels: DataFrame, **options) -> Model:
    import numpy as np

    bound_batches(documents.sparkSession)

    def presence(batches):
        import numpy as np

        enter("toxicity")
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                some = batch.iloc[at : at + ROWS]
                yield pd.DataFrame({"label": some["_label"], "buckets": [features(t).astype(np.int32) for t in some["_text"]]})
        release()

    usable, sample = training_rows(documents, labels, **options)
    share = usable.agg(F.sum(F.col("_label").cast("double")).alias("n1"), F.count("*").alias("n")).first()
    rows = materialize(sample.mapInPandas(presence, "label int, buckets array<int>"), "toxicity-train")
    classes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = float(classes.get(0, 0)), float(classes.get(1, 0))
    base = float(np.log((n1 + SMOOTHING) / (n0 + 2 * SMOOTHING)))  # no labels: a third
    # the sample holds more of the rarer label than the labels do; the intercept takes that back
    shift = float(np.log(((share["n1"] or 0.0) + SMOOTHING) / (share["n"] - (share["n1"] or 0.0) + 2 * SMOOTHING))) - base
    if not n0 or not n1:
        return Model(np.empty(0, np.int64), np.empty(0, np.float32), base + shift)
    counts = rows.select("label", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.sum(F.col("label") * 1.0).alias("c1"), F.sum(1.0 - F.col("label")).alias("c0"))

    def term(observed: str, expected: str):
        return f"if({observed} > 0, {observed} * ln({observed} / ({expected})), 0D)"

    both, n = "(c0 + c1)", n0 + n1
    g2 = " + ".join([term("c1", f"{both} * {n1 / n}D"), term("c0", f"{both} * {n0 / n}D"), term(f"({n1}D - c1)", f"({n}D - {both}) * {n1 / n}D"), term(f"({n0}D - c0)", f"({n}D - {both}) * {n0 / n}D")])
    telling = counts.withColumn("g2", F.expr(f"2 * ({g2})")).where(F.col("g2") >= MIN_G2)
    kept = telling.select("bucket", "c1", "c0").toArrow().sort_by("bucket")  # at most 2 ** BITS rows of 20 bytes
    if not kept.num_rows:
        return Model(np.empty(0, np.int64), np.empty(0, np.float32), base + shift)
    buckets = kept.column("bucket").to_numpy().astype(np.int64)
    c1, c0 = (kept.column(c).to_numpy() for c in ("c1", "c0"))
    ratio = np.log((c1 + SMOOTHING) / (n1 + 2 * SMOOTHING)) - np.log((c0 + SMOOTHING) / (n0 + 2 * SMOOTHING))

    def restrict(batches):
        for batch in batches:
            out = []
            for row in batch["buckets"]:
                at = np.searchsorted(buckets, row)
                at[at == len(buckets)] = 0
                out.append(at[buckets[at] == row].astype(np.int32).tobytes())
            yield pd.DataFrame({"label": batch["label"], "columns": out})

    labelled = rows.mapInPandas(restrict, "label int, columns binary").toArrow()  # at most max_labels rows, one an id
    cells = [np.frombuffer(c.as_buffer(), np.int32) for c in labelled.column("columns")]
    y = labelled.column("label").to_numpy().astype(float)
    weights, intercept = fit(cells, ratio, y, base)
    return Model(buckets, (weights * ratio).astype(np.float32), intercept + shift)


def fit(cells, ratio, y, base: float, *, l2: float = 1e-3, steps: int = 100, memory: int = 8):
    """Logistic regression on the rows x[c] = ratio[c] for c in cells[row], by L-BFGS with step halving. The intercept is
    not penalised; the end is a flat gradient, no gain, or ``steps``."""
    import numpy as np

    n, d = len(y), len(ratio)
    blocks = []
    for at in range(0, n, 1000):
        some = cells[at : at + 1000]
        sizes = np.array([len(c) for c in some])
        full = np.flatnonzero(sizes)
        blocks.append((at + full, sizes[full], np.cumsum(sizes[full]) - sizes[full], np.concatenate(some)))

    def loss(theta):
        scaled, z = ratio * theta[:d], np.full(n, theta[d])
        for rows, _, starts, columns in blocks:
            if len(rows):
                z[rows] += np.add.reduceat(scaled[columns], starts)
        value = (np.logaddexp(0, z) - y * z).mean() + l2 / 2 * theta[:d] @ theta[:d]
        slopes, grad = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y) / n, np.zeros(d + 1)
        for rows, sizes, _, columns in blocks:
            if len(rows):
                grad[:d] += np.bincount(columns, np.repeat(slopes[rows], sizes), d)
        grad[:d] = grad[:d] * ratio + l2 * theta[:d]
        grad[d] = slopes.sum()
        return value, grad

    theta = np.append(np.zeros(d), base)
    value, grad = loss(theta)
    past: list = []
    for _ in range(steps):
        move, kept = grad.copy(), []
        for s, t, r in reversed(past):
            kept.append(r * (s @ move))
            move -= kept[-1] * t
        if past:
            s, t, r = past[-1]
            move *= 1 / (r * (t @ t))
        for (s, t, r), k in zip(past, reversed(kept)):
            move += (k - r * (t @ move)) * s
        size, downhill = 1.0 if past else 1 / max(1.0, np.abs(grad).max() * d**0.5), grad @ move
        while True:
            new = theta - size * move
            new_value, new_grad = loss(new)
            if new_value <= value - 1e-4 * size * downhill or size < 1e-8:
                break
            size /= 2
        s, t = new - theta, new_grad - grad
        if s @ t > 1e-14:
            past = [*past, (s, t, 1 / (s @ t))][-memory:]
        gain, theta, value, grad = value - new_value, new, new_value, new_grad
        if gain <= 1e-9 * max(1.0, abs(value)) or np.abs(grad).max() < 1e-7:
            break
    return theta[:d], float(theta[d])


def score(documents: DataFrame, model: Model, *, text_column="text", output="score") -> DataFrame:
    """``documents`` with a score between 0 and 1 added."""
    bound_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast((model.buckets, model.weights, model.intercept))  # at most 2 ** BITS weights

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        enter("toxicity")
        buckets, weights, intercept = shared.value
        table = Model(buckets, weights, intercept).table()
        among = table != 0
        for texts in batches:
            z = np.array([table[features(t, among)].sum(dtype=np.float64) for t in texts]) + intercept
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -35, 35))))
        del table
        release()

    scorer = F.pandas_udf(scores, "double").asNondeterministic()  # run once, where it stands
    return documents.withColumn(output, scorer(F.col(text_column)))


def reject(documents: DataFrame, labels: DataFrame, *, threshold=THRESHOLD, **options) -> DataFrame:
    """The rows of ``documents`` whose score is under the threshold; same columns."""
    text_column, found = options.get("text_column", "text"), unused("toxicity", documents)
    scored = score(documents, train(documents, labels, **options), text_column=text_column, output=found)
    return scored.where(F.col(found) < threshold).select(*[F.col(f"`{c}`") for c in documents.columns])


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(documents, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
