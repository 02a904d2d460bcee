"""Fuzzy line dedup by MinHash over character shingles (DataFrame functions only).

Lines are normalised (trimmed, white-space runs as one blank, lower case); equal ones become one distinct line with a
number of its own and the place of its first occurrence, and all that follows works on distinct lines. A line of at
least ``SHINGLE`` characters is the set of its ``SHINGLE``-character shingles. Shingles are generated and hashed inside
one generated stage: a line is encoded with four bytes a character, so that each shingle is a slice at a known place, and
``ROWS * BANDS`` minima of ``hash xor seed`` are kept for each line, ``BLOCK`` shingles at a time. xor with a random seed is an
order of its own, in which the minimum is the shingle hash that agrees with the seed in the most leading bits. ``BANDS``
bands of ``ROWS`` minima make buckets: a pair at similarity 0.8 shares a bucket with probability 1 - (1 - 0.8^3)^8, or 0.997; at 0.9, more
than 0.9999.

Every two lines of a bucket end as if compared on their full shingle sets: lines with Jaccard similarity of at least
``SIMILARITY`` are linked, and components of links are found by rounds of joins. A bucket's lines first meet its smallest
and its largest member, and in larger buckets the others of a cell of about ``CELL_ROWS`` lines. What this leaves outside
its bucket's largest component then meets the whole bucket, in chunks of about ``CHUNK_ROWS`` lines (lines inside need not
meet each other, so a large family doesn't cost the square of its lines), on ``64 * WORDS`` bits of their sets: each bit
that differs stands for a shingle that only one set has, so a pair with too many is surely apart. The others are compared
in full. Nothing is capped or dropped.
The occurrence with the smallest (document, line number) in a component stays.

Defined results: blank lines and lines shorter than ``SHINGLE`` are compared exactly only (blank lines are never
removed); null texts have no lines; rows with a null id sort after all others; rows that share an id are documents of
their own, in the order in which they are read, so of repeated rows one keeps its lines; an empty table gives an empty
result; ``dedup`` keeps the columns of its input, whatever their names, and changes the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Workspace, drop, materialize

SHINGLE = 10
ROWS, BANDS = 3, 8
SIMILARITY = 0.8
#: Lines of a larger bucket are dealt in chunks of about so many.
CHUNK_ROWS = 512
#: Lines of a larger bucket first meet in cells of about so many.
CELL_ROWS = 32
#: Shingles a generated row.
BLOCK = 8
#: Words of 64 bits that tell sets apart before they are compared.
WORDS = 16
#: Seeds of the orders: any distinct 64-bit values with random leading bits.
SEED = 42


def _numbered(documents: DataFrame, id_column: str, text_column: str, *others: str) -> DataFrame:
    """Written once: row (a number of its own for each row), doc_id, text and other columns by place."""
    more = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)]
    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text"), *more)
    return materialize(rows, "lines-documents", compression="zstd")


def split_lines(numbered: DataFrame) -> DataFrame:
    """row, doc_id, line_no (from 0), norm."""
    lines = numbered.select("row", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    # the pattern runs only where there is something to replace
    marks = " or ".join(f"contains(line, {m})" for m in ("'  '", r"'\t'", r"'\r'", "char(11)", "char(12)"))
    return lines.select("row", "doc_id", "line_no", F.expr(rf"lower(trim(if({marks}, regexp_replace(line, r'\s+', ' '), line)))").alias("norm"))


def distinct_lines(lines: DataFrame) -> DataFrame:
    """lid (a number of its own for each distinct line that is not blank), norm, first (place of its first occurrence)."""
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row", "line_no")
    one = lines.where("norm <> ''").groupBy("norm").agg(F.min(place).alias("first"))
    return materialize(one.select(F.monotonically_increasing_id().alias("lid"), "norm", "first"), "lines-distinct", compression="zstd")


def _blocks(texts: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and the hashes h0, h1, ... of ``BLOCK`` neighbouring shingles of ``norm`` a row; a line's last row repeats
    its last shingle."""
    coded = texts.where(F.char_length("norm") >= SHINGLE).select(*keys, F.encode("norm", "UTF-32").alias("coded"))
    coded = coded.select(*keys, "coded", F.expr(f"octet_length(coded) div 4 - {SHINGLE}").alias("last"))
    each = coded.select(*keys, "coded", "last", F.explode(F.expr(f"sequence(0, last, {BLOCK})")).alias("at"))
    return each.select(*keys, *[F.expr(f"xxhash64(substring(coded, 4 * least(at + {i}, last) + 1, {4 * SHINGLE}))").alias(f"h{i}") for i in range(BLOCK)])


def signatures(lines: DataFrame) -> DataFrame:
    """lid and ``bands``: one hash for each band of minima."""
    seeds = [F.xxhash64(F.lit(SEED), F.lit(k)) for k in range(ROWS * BANDS)]
    minima = [F.min(F.least(*[F.col(f"h{i}").bitwiseXOR(seed) for i in range(BLOCK)])).alias(f"m{k}") for k, seed in enumerate(seeds)]
    signed = _blocks(lines, "lid").groupBy("lid").agg(*minima)
    bands = [F.xxhash64(F.lit(b), *[F.col(f"m{b * ROWS + r}") for r in range(ROWS)]) for b in range(BANDS)]
    return signed.select("lid", F.array(*bands).alias("bands"))


def _shingles(coded: str) -> str:
    """Shingle hashes of an encoded line. The line is a variable of the outer function, so that it is made once, not once
    a shingle."""
    each = f"transform(sequence(1, octet_length(c) - {4 * SHINGLE - 1}, 4), i -> xxhash64(substring(c, i, {4 * SHINGLE})))"
    return f"transform(array({coded}), c -> {each})[0]"


def _marks(texts: DataFrame) -> DataFrame:
    """lid, n (places of shingles), which of ``64 * WORDS`` bits the shingles fall to, and p (how many bits): the set has p
    shingles at least and n at most."""
    each = _blocks(texts.withColumn("n", F.char_length("norm") - (SHINGLE - 1)), "lid", "n")
    places = [F.expr(f"cast(shiftrightunsigned(h{i}, 6) & {WORDS - 1} as int)").alias(f"p{i}") for i in range(BLOCK)]
    each = each.select("lid", "n", *places, *[F.expr(f"shiftleft(1L, cast(h{i} & 63 as int))").alias(f"b{i}") for i in range(BLOCK)])
    words = [F.expr(f"bit_or({' | '.join(f'if(p{i} = {w}, b{i}, 0L)' for i in range(BLOCK))})") for w in range(WORDS)]
    marked = each.groupBy("lid", "n").agg(F.array(*words).alias("w"))
    return marked.select("lid", "n", F.expr(" + ".join(f"bit_count(w[{k}])" for k in range(WORDS))).alias("p"), "w")


def _may(similarity: float) -> str:
    """Whether (n, p, w) and (m, q, v) can be similar: sizes differ by a bounded factor, and bits that differ are at most as
    many as shingles in one set only."""
    bits = " + ".join(f"bit_count(w[{k}] ^ v[{k}])" for k in range(WORDS))
    return f"n >= {similarity}D * q - 1e-6D and m >= {similarity}D * p - 1e-6D and {1 + similarity}D * ({bits}) <= {1 - similarity}D * (n + m) + 1e-6D"


def _compared(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar. The texts move, an eighth of the size of their sets."""
    both = pairs.join(texts.select(F.col("lid").alias("a"), F.col("norm").alias("x")), "a").join(texts.select(F.col("lid").alias("b"), F.col("norm").alias("y")), "b")
    # sets: what repeats in a line counts once
    sets = both.select("a", "b", *[F.array_distinct(F.expr(_shingles(f"encode({c}, 'UTF-32')"))).alias(c) for c in "xy"])
    shared = sets.select("a", "b", F.size("x").alias("n"), F.size("y").alias("m"), F.size(F.array_intersect("x", "y")).alias("k"))
    return shared.where(F.col("k") >= similarity * (F.col("n") + F.col("m") - F.col("k"))).select("a", "b")


def _met(left: DataFrame, right: DataFrame, keys: list[str], which: str, similarity: float) -> DataFrame:
    """Pairs (a, b) of lines u and t that meet by ``keys``, are in different components and may be similar."""
    left = left.select(*keys, F.col("lid").alias("u"), F.col("root").alias("ru"), "n", "p", "w")
    right = right.select(*keys, F.col("lid").alias("t"), F.col("root").alias("rt"), F.col("out").alias("ot"), F.col("n").alias("m"), F.col("p").alias("q"), F.col("w").alias("v"))
    met = left.join(right, keys).where(f"ru <> rt and {which}").where(_may(similarity))
    return met.select(F.least("u", "t").alias("a"), F.greatest("u", "t").alias("b")).distinct()


def _open_lines(shared: DataFrame, joined: DataFrame, marks: DataFrame) -> DataFrame:
    """Lines of buckets that hold several components (``joined``: node, root), but for a bucket's ends, which have met every
    line of it: band, size (of the bucket), lid, root, n, p, w; ``shared``: lid, band, low, high."""
    placed = shared.join(joined.withColumnRenamed("node", "lid"), "lid", "left").select("band", "lid", "low", "high", F.coalesce("root", "lid").alias("root"))
    placed = materialize(placed, "lines-placed")
    sizes = placed.groupBy("band").agg(F.count("*").alias("size"), F.min("root").alias("r"), F.max("root").alias("s"))
    # of two lines both are ends
    sizes = sizes.where("r < s and size > 3").select("band", "size")
    inner = placed.join(sizes, "band").where("lid <> low and lid <> high")
    inner = materialize(inner.join(marks, "lid").select("band", "size", "lid", "root", "n", "p", "w"), "lines-open")
    drop(placed)
    return inner


def _cell_pairs(inner: DataFrame, similarity: float, cell_rows: int) -> DataFrame:
    """Pairs of a cell of a large bucket: as many a line, however large the bucket."""
    cells = inner.where(F.col("size") > cell_rows).withColumn("cell", F.expr(f"pmod(xxhash64(lid, band), cast(ceil(size / {cell_rows}) as long))")).withColumn("out", F.lit(True))
    return _met(cells, cells, ["band", "cell"], "u < t", similarity)


def _rooted(inner: DataFrame, found: DataFrame) -> DataFrame:
    """``inner`` with the components that the links ``found`` (a, b) join."""
    roots = inner.select("lid", "root").distinct()
    ends = found.join(roots.select(F.col("lid").alias("a"), F.col("root").alias("ra")), "a").join(roots.select(F.col("lid").alias("b"), F.col("root").alias("rb")), "b")
    now = components(ends.select("ra", "rb"), "ra", "rb").select(F.col("node").alias("root"), F.col("root").alias("now"))
    return inner.join(now, "root", "left").select("band", "size", "lid", F.coalesce("now", "root").alias("root"), "n", "p", "w")


def _outside_pairs(inner: DataFrame, similarity: float, chunk_rows: int) -> DataFrame:
    """Lines outside the largest component of their bucket with all lines of the bucket. A large bucket is dealt as pairs of
    chunks of its outside and of its lines."""
    counts = inner.groupBy("band", "root").agg(F.count("*").alias("k"))
    most = counts.groupBy("band").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.sum("k").alias("all"), F.max("k").alias("k"))
    most = most.where("k < all").select("band", "main", F.expr(f"cast(ceil((all - k) / {chunk_rows}) as int)").alias("outer"), F.expr(f"cast(ceil(all / {chunk_rows}) as int)").alias("chunks"))
    dealt = inner.join(most, "band").withColumn("out", F.col("root") != F.col("main"))
    left = dealt.where("out").withColumn("i", F.expr("cast(pmod(xxhash64(lid), outer) as int)")).withColumn("j", F.explode(F.expr("sequence(0, chunks - 1)")))
    right = dealt.withColumn("j", F.expr("cast(pmod(xxhash64(lid), chunks) as int)")).withColumn("i", F.explode(F.expr("sequence(0, outer - 1)")))
    return _met(left, right, ["band", "i", "j"], "(not ot or u < t)", similarity)


def _linked(lines: DataFrame, similarity: float, chunk_rows: int, cell_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links with the ends of buckets, the components (node, root) that they make, and the other links."""
    # dealt once, for the ends and for the lines that meet them
    rows = signatures(lines).select("lid", F.explode("bands").alias("band")).repartition("band")
    ends = rows.groupBy("band").agg(F.min("lid").alias("low"), F.max("lid").alias("high")).where("low < high")
    shared = materialize(rows.join(ends, "band"), "lines-shared")
    # a line meets the two ends of its buckets, whichever band
    pairs = shared.select("lid", F.explode(F.array("low", "high")).alias("end")).where("lid <> end")
    pairs = materialize(pairs.select(F.least("lid", "end").alias("a"), F.greatest("lid", "end").alias("b")).distinct(), "lines-pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("lid")).distinct()
    texts = materialize(lines.select("lid", "norm").join(wanted.hint("merge"), "lid", "left_semi"), "lines-texts")
    marks = materialize(_marks(texts), "lines-marks")
    near = pairs.join(marks.withColumnRenamed("lid", "a"), "a").join(marks.select(F.col("lid").alias("b"), F.col("n").alias("m"), F.col("p").alias("q"), F.col("w").alias("v")), "b").where(_may(similarity)).select("a", "b")
    first = materialize(_compared(near, texts, similarity), "lines-ends")
    joined = components(first)
    inner = _open_lines(shared, joined, marks)
    drop(shared)
    cells = materialize(_compared(_cell_pairs(inner, similarity, cell_rows), texts, similarity), "lines-cells")
    inner = materialize(_rooted(inner, cells), "lines-rooted")
    # what the ends and the cells have left apart meets inside its bucket
    rest = materialize(_outside_pairs(inner, similarity, chunk_rows), "lines-rest")
    return first, joined, cells.unionAll(_compared(rest, texts, similarity))


def links(lines: DataFrame, similarity: float = SIMILARITY, *, chunk_rows: int = CHUNK_ROWS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Verified links (a, b) between distinct lines, which join all lines that share a bucket and are similar."""
    first, _, more = _linked(lines, similarity, chunk_rows, cell_rows)
    return first.unionAll(more)


def kept_lines(numbered: DataFrame, *, similarity: float = SIMILARITY) -> DataFrame:
    """row and line_no of each line that stays, blank ones left out (they all stay)."""
    with Workspace(numbered.sparkSession) as work:
        one = distinct_lines(split_lines(numbered))
        _, stars, more = _linked(one, similarity, CHUNK_ROWS, CELL_ROWS)
        joined = materialize(components(stars.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(more)), "lines-components")
        work.keep(one, joined)
    alone = one.select("lid", "first").join(joined, F.col("lid") == F.col("node"), "left").select("first", "root")
    linked = alone.where("root is not null").groupBy("root").agg(F.min("first").alias("first")).select("first.row", "first.line_no")
    return alone.where("root is null").select("first.row", "first.line_no").unionAll(linked)


#: How many lines ``text`` has, and the numbers of the blank ones; the parts are a variable of the outer function, so that
#: they are made once.
LINES = r"""transform(array(split(text, '\n', -1)), p -> struct(size(p) as n, filter(sequence(0, size(p) - 1), i -> trim(BOTH concat(' \t\r', char(11), char(12)) FROM p[i]) = '') as blanks))[0]"""


def _all_kept(kept: DataFrame) -> DataFrame:
    return kept.groupBy("row").agg(F.collect_list("line_no").alias("chosen"))


def _numbers(blanks):
    """Sorted numbers of all lines that stay."""
    return F.array_sort(F.concat(F.coalesce(blanks, F.expr("cast(array() as array<int>)")), F.coalesce("chosen", F.expr("cast(array() as array<int>)"))))


def decide(documents: DataFrame, *, similarity: float = SIMILARITY, id_column="doc_id", text_column="text") -> DataFrame:
    """doc_id, n_lines, kept (sorted line numbers, from 0) for each row of ``documents``."""
    numbered = _numbered(documents, id_column, text_column)
    kept = _all_kept(kept_lines(numbered, similarity=similarity))
    sizes = numbered.select("row", "doc_id", F.when(F.col("text").isNotNull(), F.expr(LINES)).alias("lines"))
    n_lines = F.coalesce(F.col("lines.n").cast("long"), F.lit(0).cast("long"))
    return sizes.join(kept, "row", "left").select("doc_id", n_lines.alias("n_lines"), _numbers(F.col("lines.blanks")).alias("kept"))


def dedup(documents: DataFrame, *, id_column="doc_id", text_column="text", **options) -> DataFrame:
    """``documents`` with removed lines cut from the text; a text left without lines is empty, a null text stays null."""
    others = [c for c in documents.columns if c not in (id_column, text_column)]
    numbered = _numbered(documents, id_column, text_column, *others)
    left = numbered.join(_all_kept(kept_lines(numbered, **options)).hint("merge"), "row", "left").withColumn("kept", _numbers(F.expr(f"{LINES}.blanks")))
    cut = r"transform(array(split(text, '\n', -1)), p -> transform(kept, k -> p[k]))[0]"
    text = F.when(F.col("text").isNotNull(), F.array_join(F.expr(cut), "\n"))
    names = {id_column: F.col("doc_id"), text_column: text} | {c: F.col(f"c{k}") for k, c in enumerate(others)}
    return left.select(*[names[c].alias(c) for c in documents.columns])


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    """One row a document: how many lines it has, how many stay, and the numbers of those that go."""
    decided = decide(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    gone = F.when(F.col("n_lines") > 0, F.array_except(F.expr("sequence(0, cast(n_lines - 1 as int))"), "kept"))
    return decided.select("doc_id", "n_lines", F.size("kept").cast("long").alias("n_kept"), F.coalesce(F.array_join(gone, ","), F.lit("")).alias("removed_lines"))
