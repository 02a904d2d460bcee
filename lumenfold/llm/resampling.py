"""Importance resampling towards a target distribution: hashed n-gram weights, then an exact top-k draw.

Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters. Features of a text are its runs of 1 to
``max_n`` consecutive words, joined by one space, repeats counted; a feature's bucket is the crc32 of its UTF-8 bytes
modulo ``buckets``. With S and T features in the raw and the target texts, s and t of them in a bucket, a bucket's gain is
``floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets))))``. A document's weight is the floored mean of its
features' gains, its score that weight plus a Gumbel noise made from its id alone; the highest scores among documents of
at least ``min_words`` words are drawn, ties to the smaller id.

The texts are read twice: once for the bucket counts, of which each task returns one histogram, and once for the weights,
looked up in the array of gains. The draw is exact and sorts only what it takes: the key (score descending, id, number of
features, row) is cut into digits from the top, each pass counts the rows by one digit inside the range that holds the
k-th row, and at most ``2 ** DIGIT`` counts reach the driver a pass. Rows up to that key are then sorted by range and
numbered; no partition ever holds more than its range, however many rows tie.

Defined results: a null or empty text has no features, weight 0, and is not drawn unless ``min_words`` is 0; a null id is
hashed as ``null`` and comes after all others; repeated rows are rows like others and are drawn one by one; without target
texts all gains come from the raw counts alone; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bound_batches, byte_slices, cache, drop, enter, materialize, release

BUCKETS = 10_000
MAX_N = 1
MIN_WORDS = 20
PERCENT = 10
SEED = "2024"
#: Bits of one digit of the key.
DIGIT = 12
#: Bytes of a text that are cut into words at once (a longer word is taken whole).
CHUNK = 1 << 20
#: Words that a Python worker remembers the bucket of.
REMEMBERED = 200_000
#: A-Z lower-cased; digits, letters and bytes of non-ASCII characters kept; all else a blank.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_known = cache()


class _Buckets(dict):
    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        import zlib

        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found


def features(text: bytes, buckets: int = BUCKETS, max_n: int = MAX_N):
    """Yields (number of words, buckets of their features) for consecutive pieces of a text."""
    import numpy as np

    data, before, at = text.translate(FOLD), [], 0
    table = _known.get(buckets)
    if table is None or len(table) > REMEMBERED:
        table = _known[buckets] = _Buckets(buckets)
    while at < len(data):
        end = data.find(b" ", at + CHUNK) if at + CHUNK < len(data) else -1
        end = len(data) if end < 0 else end
        words = data[at:end].split()
        found = [np.fromiter(map(table.__getitem__, words), np.int32, len(words))]
        for n in range(2, max_n + 1):
            run = before[len(before) - n + 1 :] + words if len(before) >= n else before + words
            found.append(np.fromiter((table[b" ".join(run[k : k + n])] for k in range(len(run) - n + 1)), np.int32))
        before = (before + words)[-max_n + 1 :] if max_n > 1 else before
        yield len(words), np.concatenate(found) if len(found) > 1 else found[0]
        at = end


def histogram(texts: DataFrame, *, text_column="text", buckets=BUCKETS, max_n=MAX_N):
    """Features in each bucket, as an array of ``buckets`` counts: a histogram from each task, summed by bucket."""
    import numpy as np

    def count(batches):
        import numpy as np
        import pyarrow as pa

        enter("resampling")
        seen = np.zeros(buckets, np.int64)
        for batch in batches:
            column = batch.column(0).cast(pa.binary())
            for a, b in byte_slices(column):
                for text in column.slice(a, b - a).to_pylist():
                    for _, found in features(text or b"", buckets, max_n):
                        seen += np.bincount(found, minlength=buckets)
        there = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(seen[there])], names=["bucket", "n"])
        release()

    bound_batches(texts.sparkSession)
    each = texts.select(text_column).mapInArrow(count, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in each.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(raw, target):
    """Gain of each bucket from the counts of the raw and the target features."""
    import numpy as np

    buckets, s_all, t_all = len(raw), int(raw.sum()), int(target.sum())
    ratio = (target + 1.0) * (s_all + buckets) / ((raw + 1.0) * (t_all + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(documents: DataFrame, gain, *, text_column="text", id_column="doc_id", max_n=MAX_N) -> DataFrame:
    """doc_id, n_words, n_features, weight of each row."""
    bound_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(gain)  # one number a bucket
    buckets = len(gain)

    def look_up(batches):
        import pyarrow as pa

        enter("resampling")
        gain = shared.value
        for batch in batches:
            column, n_words, n_features, weights = batch.column(1).cast(pa.binary()), [], [], []
            for a, b in byte_slices(column):
                for text in column.slice(a, b - a).to_pylist():
                    words = found = total = 0
                    for n, those in features(text or b"", buckets, max_n):
                        words, found, total = words + n, found + len(those), total + int(gain[those].sum())
                    n_words.append(words)
                    n_features.append(found)
                    weights.append(total // found if found else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weights))], names=["doc_id", "n_words", "n_features", "weight"])
        release()

    rows = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(look_up, "doc_id long, n_words long, n_features long, weight long")


def noise(id_column: str = "doc_id", seed: str = SEED):
    """Thousandths of a Gumbel variate made from the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def kth_key(rows: DataFrame, keys: list[str], k: int) -> list[int]:
    """The k-th smallest composite key (k from 1, long columns, most significant first) by radix selection.

    Each pass counts one digit of the first column in which the range still holds several values.
    """
    found: list[int] = []
    for key in keys:
        ends = rows.agg(F.min(key).alias("least"), F.max(key).alias("most")).first()
        least, most = ends["least"], ends["most"]
        while least < most:
            # as unsigned numbers, so that the sign is the highest bit; all bits above the digit agree in the range
            apart = (least + (1 << 63)) ^ (most + (1 << 63))
            shift = max(0, apart.bit_length() - DIGIT)
            digit = F.shiftrightunsigned(F.col(key).bitwiseXOR(F.lit(-(1 << 63))), shift).bitwiseAND(F.lit((1 << DIGIT) - 1))
            inside = rows.where(F.col(key).between(least, most)).groupBy(digit.alias("digit"))
            counts = inside.agg(F.count("*").alias("n"), F.min(key).alias("least"), F.max(key).alias("most"))
            for r in sorted(counts.collect()):  # at most 2 ** DIGIT rows
                if k <= r["n"]:
                    least, most = r["least"], r["most"]
                    break
                k -= r["n"]
        found.append(least)
        rows = rows.where(F.col(key) == least)
    return found


def up_to(keys: list[str], bound: list[int]):
    """Rows whose composite key is at most ``bound``."""
    *head, last = zip(keys, bound)
    out = F.col(last[0]) <= last[1]
    for key, value in reversed(head):
        out = (F.col(key) < value) | ((F.col(key) == value) & out)
    return out


def numbered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, 3 ... in the order of ``keys``: sorted by range, each range numbered from the rows
    before it. The driver sees one count a range."""
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # the id is the partition's number above 33 bits of the place in it
    placed = materialize(ordered.withColumn("place", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("range", F.shiftright("place", 33)).withColumn("place", F.col("place").bitwiseAND(F.lit((1 << 33) - 1)))
    counts, before, at = sorted((r["range"], r["n"]) for r in placed.groupBy("range").agg(F.count("*").alias("n")).collect()), [], 0
    for number, n in counts:
        before.append((number, at))
        at += n
    offsets = F.broadcast(rows.sparkSession.createDataFrame(before, "range long, before long"))  # one row a partition
    return placed.join(offsets, "range").withColumn("rank", F.col("before") + F.col("place") + 1).drop("range", "before", "place")


def resample(documents: DataFrame, target: DataFrame, *, text_column="text", id_column="doc_id", target_column="text", buckets=BUCKETS, max_n=MAX_N, min_words=MIN_WORDS, percent=PERCENT, seed=SEED) -> DataFrame:
    """Each row's doc_id, n_words, n_features, weight, score, and rank of those drawn (null for the others)."""
    gain = gains(histogram(documents, text_column=text_column, buckets=buckets, max_n=max_n), histogram(target, text_column=target_column, buckets=buckets, max_n=max_n))
    weighed = weigh(documents, gain, text_column=text_column, id_column=id_column, max_n=max_n).withColumn("score", F.col("weight") + noise(seed=seed))
    # numbered as they are written: equal rows have an order, and it stays
    scored = materialize(weighed.withColumn("row", F.monotonically_increasing_id()), "resampling-scores")
    keyed = scored.withColumns({"k_score": -1 - F.col("score"), "k_id": F.coalesce("doc_id", F.lit((1 << 63) - 1))})
    keys, fit = ["k_score", "k_id", "n_features", "row"], F.col("n_words") >= min_words
    k = keyed.where(fit).count() * percent // 100
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    if not k:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    chosen = fit & up_to(keys, kth_key(keyed.where(fit), keys, k))
    drawn = numbered(keyed.where(chosen), keys, "resampling-drawn").select(*columns, "rank")
    return drawn.unionAll(keyed.where(~chosen).select(*columns, F.lit(None).cast("long").alias("rank")))


def draw(documents: DataFrame, target: DataFrame, *, id_column="doc_id", **options) -> DataFrame:
    """The rows of ``documents`` whose id was drawn, all columns as they are. Rows that share an id stay together: they are
    drawn by the best of them."""
    ranked = resample(documents, target, id_column=id_column, **options)
    ids = materialize(ranked.where("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct(), "resampling-ids")
    return documents.join(ids, F.col(f"`{id_column}`").eqNullSafe(F.col("_drawn")), "left_semi")


def op11_resample(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    return resample(documents, target).select("doc_id", "n_features", "weight", "score", "rank")


#: crc32 is written out by its table of 256 entries, over the distinct words.
ORACLE = r"""
WITH crc AS MATERIALIZED (
  SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i, range(0, 8)),
    lambda a, s: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
words AS MATERIALIZED (
  SELECT 'd' AS side, doc_id AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
each AS MATERIALIZED (SELECT side, id, w, count(*) AS n FROM words GROUP BY ALL),
bytes AS (SELECT w, list_transform(range(0, octet_length(encode(w))), lambda i: ('0x' || substr(hex(w), 2 * i + 1, 2))::BIGINT) AS b FROM (SELECT DISTINCT w FROM each)),
bucket AS MATERIALIZED (
  SELECT w, xor(list_reduce(list_prepend(4294967295, b), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, crc),
counted AS MATERIALIZED (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t FROM each JOIN bucket USING (w) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM counted),
weight AS (SELECT id AS doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM each JOIN bucket USING (w) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY id),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN weight USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""
