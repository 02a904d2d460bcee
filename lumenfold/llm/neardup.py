"""Near-duplicate documents by min-max hashing.

Each document is its set of distinct word shingles. Under each of ``PERMUTATIONS`` permutations both the smallest and
the largest hash are kept, so half the hash evaluations give the same number of signature values; both agree between two
sets with probability equal to their similarity. ``BANDS`` bands of 4 values make candidates: at similarity 0.85 a pair
is missed with probability (1 - 0.85^4)^20, about 4 in 10 million; at 0.8, 2 in 100,000.

Documents with equal sets are one class, joined by their set's 128-bit hash before anything else, so exact copies cost
one row each. Bands connect classes to candidate clusters (linear: each class to the smallest of its bucket), and inside
a cluster every pair of classes is decided exactly on the full sets: an inverted index counts intersections, and only
links that join two parts are returned. A cluster above ``CLUSTER_ROWS`` classes or ``CLUSTER_SHINGLES`` shingles is not
given to one task: all its classes are first compared with a few pivots. What that leaves in different parts meets in its
buckets (as ids; texts are fetched for buckets of several parts only): the classes outside a bucket's largest part are
compared with all others of the bucket, in pairs of chunks. Nothing is capped or dropped.

Defined results: null, empty and wordless texts have the empty set, no class and no links, and are their own component;
rows with a null id are kept, with a null component; rows that share an id but not a text each follow their own text,
rows that share both are one document and stay or go together; an empty table gives an empty result; ``keep_one`` keeps the columns of its input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Workspace, bound_batches, cache, enter, materialize, release, sorted_distinct, unused

PERMUTATIONS, BANDS = 40, 20
SIZE, PERCENT = 3, 85
STAGE_SIZE, STAGE_PERCENT = 5, 80
CLUSTER_ROWS, CLUSTER_SHINGLES = 1024, 2_000_000
PIVOTS = 8
TABLE_WORDS = 400_000
#: A-Z lower-cased, all other bytes kept.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

_hashes: dict[bytes, int] = cache()


def mix64(x):
    """A bijection of 64-bit values (murmur finaliser)."""
    import numpy as np

    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, size: int):
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(_hashes) > TABLE_WORDS:
        _hashes.clear()
    get, digest = _hashes.get, xxhash.xxh64_intdigest
    hashes = [get(w) for w in words]
    if None in hashes:
        for k, h in enumerate(hashes):
            if h is None:
                hashes[k] = _hashes[words[k]] = digest(words[k])
    h = np.array(hashes, np.uint64)
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out + h[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return sorted_distinct(mix64(out))


def signature(values, multipliers, addends):
    """Min and max of each permutation, shape (2 * permutations,)."""
    import numpy as np

    low, high = None, None
    for at in range(0, len(values), 2048):
        p = (values[at : at + 2048, None] ^ addends) * multipliers
        a, b = p.min(0), p.max(0)
        low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
    return np.stack([low, high], 1).reshape(-1)


def band_hashes(values):
    """One 64-bit key for each band, the band's number mixed in."""
    import numpy as np

    random = np.random.default_rng(20240229)
    multipliers = random.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    addends = random.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2)
    rows = signature(values, multipliers, addends).reshape(BANDS, -1)
    keys = np.arange(BANDS, dtype=np.uint64)
    for k in range(rows.shape[1]):
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return keys.view(np.int64)


def signatures(documents: DataFrame, size: int, *, id_column="doc_id", text_column="text") -> DataFrame:
    """doc_id, text_hash, n_shingles, h1, h2 (hash of the set; null if empty), bands."""

    def sign(batches):
        import numpy as np
        import pandas as pd
        import xxhash

        enter("neardup")
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 1024):
                counts, h1, h2, bands = [], [], [], []
                for text in texts.slice(at, 1024).to_pylist():
                    s = shingles(text, size)
                    counts.append(len(s))
                    digest = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                    h1.append(None if digest is None else int.from_bytes(digest[:8], "little", signed=True))
                    h2.append(None if digest is None else int.from_bytes(digest[8:], "little", signed=True))
                    bands.append(band_hashes(s) if len(s) else np.empty(0, np.int64))
                import pyarrow as pa

                yield pa.RecordBatch.from_arrays([ids.slice(at, 1024), batch.column(2).slice(at, 1024), pa.array(counts, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "n_shingles", "h1", "h2", "bands"])
        release()

    bound_batches(documents.sparkSession)
    rows = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(sign, "doc_id long, text_hash long, n_shingles long, h1 long, h2 long, bands array<long>")


def linked(sets, percent: int, apart=None):
    """Links that join parts of a list of sets: pairs (i, j) with 100 |A & B| >= percent |A | B|, one spanning forest.

    ``apart``: labels; pairs within one label are known to be joined.
    """
    import numpy as np

    n = len(sets)
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    if apart is not None:
        first = {}
        for i, label in enumerate(apart):
            parent[root(i)] = root(first.setdefault(label, i))
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(column, kind="stable")
    posting, begin = owner[order], np.concatenate([[0], np.cumsum(np.bincount(column))])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    found = []
    for i in range(n - 1):
        if i % 64 == 0 and len({root(j) for j in range(n)}) == 1:
            break
        mine = column[bounds[i] : bounds[i + 1]]
        lists = [posting[begin[c] : begin[c + 1]] for c in mine]
        shared = np.bincount(np.concatenate(lists), minlength=n)[i + 1 :]
        close = 100 * shared >= percent * (sizes[i] + sizes[i + 1 :] - shared)
        for j in np.flatnonzero(close) + i + 1:
            a, b = root(i), root(int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
                found.append((i, int(j)))
    return found


def _by_unit(frame: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) inside each unit of (unit, id, text[, label])."""
    with_labels = "label" in frame.columns

    def decide(batches):
        import pandas as pd

        def flush(rows):
            if len(rows) < 2:
                return None
            found = linked([r[1] for r in rows], percent, [r[2] for r in rows] if with_labels else None)
            return pd.DataFrame([(rows[i][0], rows[j][0]) for i, j in found], columns=["a", "b"]) if found else None

        enter("neardup")
        unit, rows = None, []
        for batch in batches:
            labels = batch["label"] if with_labels else batch["id"]
            for u, i, text, label in zip(batch["unit"], batch["id"], batch["text"], labels):
                if u != unit:
                    if (out := flush(rows)) is not None:
                        yield out
                    unit, rows = u, []
                if not rows or rows[-1][0] != i:
                    rows.append((i, shingles(text, size), label))
        if (out := flush(rows)) is not None:
            yield out
        rows = []
        release()

    return frame.repartition("unit").sortWithinPartitions("unit", "id").mapInPandas(decide, "a long, b long")


def _hot_links(hot: DataFrame, bands: DataFrame, size: int, percent: int, cluster_rows: int) -> DataFrame:
    """All links of clusters too large for one task; ``hot``: cluster, id, text; ``bands``: band, id."""
    # pivots: the smallest salted hash in each of PIVOTS draws, combined before the shuffle
    draws = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.xxhash64("id", F.lit(k)).alias("h")) for k in range(PIVOTS)])).alias("x")
    pivots = hot.select("cluster", "id", draws).groupBy("cluster", "x.k").agg(F.min_by("id", "x.h").alias("pivot")).select("cluster", "pivot").distinct()
    texts = pivots.join(hot.select(F.col("id").alias("pivot"), F.col("text").alias("pivot_text")), "pivot")
    pairs = hot.join(texts, "cluster").where("id <> pivot").select("id", "text", "pivot", "pivot_text")

    def compare(batches):
        import numpy as np
        import pandas as pd

        sets: dict = {}
        for batch in batches:
            out = []
            for i, text, p, pivot_text in batch.itertuples(index=False):
                if p not in sets:
                    if len(sets) > 4 * PIVOTS:
                        sets.clear()
                    sets[p] = shingles(pivot_text, size)
                mine = shingles(text, size)
                shared = len(np.intersect1d(mine, sets[p], assume_unique=True))
                if 100 * shared >= percent * (len(mine) + len(sets[p]) - shared):
                    out.append((i, p))
            yield pd.DataFrame(out, columns=["a", "b"])

    stars = materialize(pairs.mapInPandas(compare, "a long, b long"), "neardup-pivots")
    parts = components(stars)
    labelled = hot.select("id").join(parts.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("label"))
    # what the pivots leave apart meets in its buckets, as ids; a bucket of one part has nothing left to decide
    placed = materialize(bands.join(labelled, "id"), "neardup-placed")
    sizes = placed.groupBy("band", "label").agg(F.count("*").alias("n")).groupBy("band").agg(F.max_by("label", "n").alias("main"), F.max("n").alias("most"), F.sum("n").alias("n"))
    half = cluster_rows // 2
    open_ = sizes.where("most < n").select("band", "main", F.ceil((F.col("n") - F.col("most")) / half).cast("int").alias("loose_chunks"), F.ceil(F.col("n") / half).cast("int").alias("chunks"))
    # every pair with a loose end meets in the unit (chunk of the loose one, chunk of the other)
    dealt = placed.join(open_, "band").withColumn("loose", F.expr("label <> main")).withColumn("mine", F.expr("pmod(xxhash64(id), loose_chunks)")).withColumn("other", F.expr("pmod(xxhash64(id, 1), chunks)"))
    as_other = dealt.select("band", "id", "label", F.explode(F.expr("sequence(0, loose_chunks - 1)")).alias("i"), F.col("other").alias("j"))
    as_loose = dealt.where("loose").select("band", "id", "label", F.col("mine").alias("i"), F.explode(F.expr("sequence(0, chunks - 1)")).alias("j"))
    units = as_other.unionAll(as_loose).select(F.xxhash64("band", "i", "j").alias("unit"), "id", "label").distinct()
    return stars.unionAll(_by_unit(units.join(hot.select("id", "text"), "id").select("unit", "id", "text", "label"), size, percent))


def find(documents: DataFrame, *, size=STAGE_SIZE, percent=STAGE_PERCENT, id_column="doc_id", text_column="text", cluster_rows=CLUSTER_ROWS, cluster_shingles=CLUSTER_SHINGLES) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id for each row of ``documents``."""
    with Workspace(documents.sparkSession) as work:
        return _find(work, documents, size, percent, id_column, text_column, cluster_rows, cluster_shingles)


def _find(work: Workspace, documents: DataFrame, size: int, percent: int, id_column: str, text_column: str, cluster_rows: int, cluster_shingles: int) -> DataFrame:
    signed = materialize(signatures(documents, size, id_column=id_column, text_column=text_column), "neardup-signatures")
    usable = signed.where("h1 is not null and doc_id is not null")
    # one class for each set, with a number of its own; its first document and one of that document's texts speak for it
    classes = usable.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.min_by("text_hash", "doc_id").alias("rep_hash"), F.max("n_shingles").alias("n"))
    classes = materialize(classes.withColumn("id", F.monotonically_increasing_id()), "neardup-classes")
    speaking = usable.join(classes, ["h1", "h2"]).where("doc_id = rep and text_hash = rep_hash").dropDuplicates(["id"])
    bands = materialize(speaking.select(F.explode("bands").alias("band"), "id"), "neardup-bands")
    buckets = bands.groupBy("band").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("band", "least")
    clusters = components(bands.join(buckets, "band").select(F.col("id").alias("a"), F.col("least").alias("b")))
    clusters = materialize(clusters.select(F.col("node").alias("id"), F.col("root").alias("cluster")), "neardup-clusters")
    sizes = clusters.join(classes, "id").groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / cluster_rows), F.ceil(F.sum("n") / cluster_shingles)).cast("int").alias("chunks"))
    texts = documents.select(F.col(id_column).cast("long").alias("rep"), F.col(text_column).alias("text")).where("text is not null").withColumn("rep_hash", F.xxhash64("text"))
    # texts move once, by a plan that doesn't change with the number of members; repeated rows are one text
    wanted = clusters.join(sizes, "cluster").join(classes.select("id", "rep", "rep_hash"), "id")
    members = wanted.hint("merge").join(texts, ["rep", "rep_hash"]).select("cluster", "id", "text", "chunks")
    members = materialize(members, "neardup-members")
    links = _by_unit(members.where("chunks = 1").select(F.col("cluster").alias("unit"), "id", "text"), size, percent)
    if not sizes.where("chunks > 1").isEmpty():
        hot = materialize(members.where("chunks > 1").dropDuplicates(["id"]), "neardup-large")
        links = links.unionAll(_hot_links(hot, bands, size, percent, cluster_rows))
    joined = materialize(components(links), "neardup-joined")
    least = joined.join(classes, joined["node"] == classes["id"]).groupBy("root").agg(F.min("rep").alias("component_id"))
    named = joined.join(least, "root").select(F.col("node").alias("id"), "component_id")
    roots = classes.join(named, "id", "left").select("h1", "h2", F.coalesce("component_id", "rep").alias("component_id"))
    roots = materialize(roots, "neardup-roots")
    work.keep(signed, roots)
    known = usable.select("doc_id", "text_hash", "n_shingles", "h1", "h2").join(roots, ["h1", "h2"]).select("doc_id", "text_hash", "n_shingles", "component_id")
    alone = signed.where("h1 is null or doc_id is null").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"))
    return known.unionAll(alone)


def keep_one(documents: DataFrame, *, id_column="doc_id", text_column="text", **options) -> DataFrame:
    """The rows of ``documents`` that are the first of their component (or have no id); same columns."""
    found = find(documents, id_column=id_column, text_column=text_column, **options)
    name, text_hash = unused("dropped", documents), unused("dropped_hash", documents)
    dropped = found.where("doc_id <> component_id").select(F.col("doc_id").alias(name), F.col("text_hash").alias(text_hash)).distinct().hint("merge")
    same = (F.col(f"`{id_column}`").cast("long") == F.col(name)) & (F.xxhash64(F.col(f"`{text_column}`")) == F.col(text_hash))
    return documents.join(dropped, same, "left_anti")


def op7_neardup(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=SIZE, percent=PERCENT)
    return found.drop("text_hash").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
