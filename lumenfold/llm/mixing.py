"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

A source's target is ``level * weight`` words, but never more than ``max_epochs`` times its size. The level is found by
rounds: sources above their cap are clamped and what they leave is shared by weight among the others, until none is
above. One row a source takes part in that, as a distributed table.

A source is then sampled for ``target / size`` repetitions: each document whole ``floor(r)`` times, and a seeded choice
of documents once more. Documents are dealt by a seeded hash to strata of about ``stratum_rows`` rows; inside a
stratum they are visited by size class, then hash, and a document is taken when that brings the words taken closer to
the fraction of the words visited. A stratum is bounded whatever the size of its source, so a hot source is just more
strata, and its error is at most about half of its smallest documents.

Defined results: a null text or a text without words has size 0 and is never repeated by the fraction; a null source
is a source of its own, last in order; rows that agree in id, source and size share one decision; an empty table gives
an empty result; extra columns pass through ``mix`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Workspace, materialize, unused

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MAX_EPOCHS = 2.0
STRATUM_ROWS = 512
#: Above this number of sources their plan is joined by shuffle instead of broadcast.
BROADCAST_SOURCES = 50_000


def size_of(text: str | Column) -> Column:
    """Words in a text, 0 for null. Counted as places where a word starts, without building the words."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def cyclic_weight(position: Column, weights=WEIGHTS) -> Column:
    """Weights repeating over positions 0, 1, 2, ..."""
    return F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (position % len(weights) + 1).cast("int"))


def water_fill(sources: DataFrame, total: float, *, size="size", weight="weight", max_epochs=MAX_EPOCHS) -> DataFrame:
    """Add ``target`` to one row a source, for a budget of ``total`` words.

    The level starts as if no source were clamped; sources above their cap are clamped and the rest of the budget is
    shared anew, until none is above. Each round is one aggregate over the sources (Newton's method on a concave
    function, so few rounds), and only the level is on the driver.
    """
    cap, share = F.col(size).cast("double") * F.lit(float(max_epochs)), F.col(weight).cast("double")
    level, clamped = 0.0, -1
    while True:
        above = cap < F.lit(level) * share
        found = sources.agg(F.count_if(above).alias("n"), F.sum(F.when(above, cap)).alias("spent"), F.sum(F.when(~above, share)).alias("left")).first()
        if found["n"] == clamped or found["left"] is None:
            break
        clamped, level = found["n"], (float(total) - (found["spent"] or 0.0)) / found["left"]
    if found["left"] is None:  # every source is clamped (or there is none)
        return sources.withColumn("target", cap)
    return sources.withColumn("target", F.least(cap, F.lit(level) * share))


def numbered(sources: DataFrame) -> DataFrame:
    """Sources with their position (from 0) by code point, null last. Ranges are ordered apart from one another; the
    driver sees one count for each."""
    placed = sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id())
    placed = materialize(placed, "mix-sources")
    counts = sorted((r["range"], r["n"]) for r in placed.groupBy("range").agg(F.count("*").alias("n")).collect())
    if not counts:
        return placed.select("*", F.lit(0).cast("long").alias("position")).drop("range")
    before, at = [], 0
    for number, n in counts:
        before += [F.lit(number), F.lit(at).cast("long")]
        at += n
    inside = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())) - 1
    return placed.withColumn("position", F.create_map(*before)[F.col("range")] + inside).drop("range")


def source_plan(sized: DataFrame, *, weights=WEIGHTS, total_share=TOTAL_SHARE, max_epochs=MAX_EPOCHS) -> DataFrame:
    """One row a source: source, source_size, source_rows, target."""
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("rows").alias("source_rows"))
    ranked = numbered(by_source)
    ranked = materialize(ranked.withColumn("weight", cyclic_weight(F.col("position"), weights)), "mix-ranked")
    total = (ranked.agg(F.sum("source_size")).first()[0] or 0) * float(total_share)
    return water_fill(ranked, total, size="source_size", max_epochs=max_epochs).drop("position", "weight")


def seeded(seed: int, key: Column) -> Column:
    """60 pseudo-random bits of a key; the same in any engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("-")))), 1, 15), 16, 10).cast("long")


def decide(documents: DataFrame, *, seed: int = 7, weights=WEIGHTS, total_share=TOTAL_SHARE, max_epochs=MAX_EPOCHS, id_column="doc_id", source_column="source", text_column="text") -> DataFrame:
    """One row for each distinct (id, source, size): doc_id, source, size, rows, source_size, target, copies.

    ``copies`` is how often each of these rows stands in the mix.
    """
    sized = documents.select(F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), size_of(text_column).alias("size"))
    sized = materialize(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")).withColumn("words", F.col("size") * F.col("rows")), "mix-sizes")
    with Workspace(documents.sparkSession) as work:
        plan = materialize(source_plan(sized.select("source", F.col("words").alias("size"), "rows"), weights=weights, total_share=total_share, max_epochs=max_epochs), "mix-plan")
        work.keep(plan)
    few = plan.count() <= BROADCAST_SOURCES
    joined = sized.alias("d").join(F.broadcast(plan).alias("p") if few else plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).select("d.*", "source_size", "source_rows", "target")
    repeats = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    draw = seeded(seed, F.col("doc_id"))
    joined = (
        joined.withColumn("repeats", repeats)
        .withColumn("draw", draw)
        .withColumn("stratum", F.col("draw") % F.ceil(F.col("source_rows") / F.lit(STRATUM_ROWS)))
        .withColumn("fraction", F.col("repeats") - F.floor("repeats"))
    )
    # size class first, so that the last documents visited are the smallest
    visit = F.struct((-F.length(F.bin("words"))).alias("rank"), F.col("draw").alias("draw"), F.col("doc_id").alias("doc_id"), F.col("size").alias("size"), F.col("words").alias("words"), F.col("rows").alias("rows"))
    strata = joined.groupBy("source", "stratum", "source_size", "target", "repeats", "fraction").agg(F.sort_array(F.collect_list(visit)).alias("docs"))
    chosen = F.expr(
        """aggregate(docs,
                     named_struct('seen', 0D, 'got', 0L, 'taken', cast(array() as array<boolean>)),
                     (s, x) -> named_struct(
                        'seen', s.seen + fraction * x.words,
                        'got', s.got + if(x.words > 0 and s.seen + fraction * x.words - s.got >= x.words / 2D, x.words, 0L),
                        'taken', concat(s.taken, array(x.words > 0 and s.seen + fraction * x.words - s.got >= x.words / 2D))),
                     s -> s.taken)"""
    )
    picked = strata.withColumn("x", F.explode(F.arrays_zip("docs", chosen.alias("taken"))))
    return picked.select(
        F.col("x.docs.doc_id").alias("doc_id"),
        "source",
        F.col("x.docs.size").alias("size"),
        F.col("x.docs.rows").alias("rows"),
        "source_size",
        "target",
        (F.floor("repeats") + F.col("x.taken").cast("long")).cast("int").alias("copies"),
    )


def mix(documents: DataFrame, *, id_column="doc_id", source_column="source", text_column="text", **options) -> DataFrame:
    """The mixed rows, each row of ``documents`` as often as the mix repeats it; same columns."""
    picked = decide(documents, id_column=id_column, source_column=source_column, text_column=text_column, **options)
    key, copies = unused("mix_key", documents), unused("mix_copies", documents)
    picked = picked.select(F.struct("doc_id", "source", "size").alias("picked"), F.col("copies").alias("n")).alias("p")
    keyed = documents.withColumn(key, F.struct(F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), size_of(text_column).alias("size")))
    return (
        keyed.alias("d").join(picked.where("n > 0"), F.col(f"d.{key}").eqNullSafe(F.col("p.picked")))
        .select(*[F.col(f"d.`{c}`") for c in documents.columns], F.explode(F.expr("sequence(1, p.n)")).alias(copies))
        .drop(copies)
    )


def op1_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    picked = decide(docs)
    each = picked.withColumn("_n", F.explode(F.expr("sequence(1L, rows)")))
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
g AS (SELECT doc_id, source, size, count(*) AS n, size * count(*) AS words FROM d GROUP BY doc_id, source, size),
s AS (SELECT source, sum(words) AS source_size, sum(n) AS source_rows,
             CASE (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
      FROM g GROUP BY source),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level FROM c
      WINDOW o AS (ORDER BY cap / w, cap, source COLLATE "C" NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, CAST(source_rows AS BIGINT) AS source_rows,
             least(cap, coalesce((SELECT level FROM l WHERE level * w <= cap ORDER BY cap / w, cap, source COLLATE "C" NULLS LAST LIMIT 1) * w, cap)) AS target FROM l),
j AS (SELECT g.*, p.source_size, p.target, p.source_rows,
             CASE WHEN p.source_size > 0 THEN p.target / p.source_size ELSE 0.0::DOUBLE END AS r,
             CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '-')), 1, 15) AS BIGINT) AS draw
      FROM g JOIN p ON g.source IS NOT DISTINCT FROM p.source),
b AS (SELECT source, source_size, target, r, r - floor(r) AS f,
             list({'k': -length(CASE WHEN words = 0 THEN '0' ELSE bin(words) END), 'draw': draw, 'doc_id': doc_id, 'size': size, 'words': words, 'n': n}
                  ORDER BY -length(CASE WHEN words = 0 THEN '0' ELSE bin(words) END), draw, doc_id, size, words, n) AS docs
      FROM j GROUP BY source, draw % CAST(ceil(source_rows / 512.0) AS BIGINT), source_size, target, r),
t AS (SELECT *, list_reduce(list_transform(docs, lambda x: {'f': f, 'words': x.words, 'seen': 0.0::DOUBLE, 'got': 0::BIGINT, 'taken': []::BOOLEAN[]}),
        lambda s, x: {'f': f, 'words': x.words, 'seen': s.seen + x.f * x.words,
                      'got': s.got + CASE WHEN x.words > 0 AND s.seen + x.f * x.words - s.got >= x.words / 2.0::DOUBLE THEN x.words ELSE 0 END,
                      'taken': list_append(s.taken, x.words > 0 AND s.seen + x.f * x.words - s.got >= x.words / 2.0::DOUBLE)},
        {'f': f, 'words': 0::BIGINT, 'seen': 0.0::DOUBLE, 'got': 0::BIGINT, 'taken': []::BOOLEAN[]}).taken AS taken FROM b),
e AS (SELECT source_size, target, r, unnest(docs) AS x, unnest(taken) AS taken FROM t)
SELECT x.doc_id AS doc_id, x.size AS size, source_size, target, x.size * CAST(floor(r) + CAST(taken AS INT) AS BIGINT) AS taken
FROM (SELECT *, unnest(range(x.n)) FROM e)
"""
