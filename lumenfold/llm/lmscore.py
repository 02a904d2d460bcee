"""Language-model scoring by cross-entropy difference.

Two word bigram models of one form share one vocabulary, all distinct words of the corpus and an end symbol. Words are
parted by ASCII white space with A-Z lower-cased; the end symbol closes each document and stands before its first word. The
target model is counted over documents labelled as good. The background model is counted over a sample of the other
documents that has as many tokens: documents are dealt to ``SLOTS`` slots by a hash of the id, and whole slots are taken, in
order, until the target's tokens are matched as nearly as slots allow (or the documents run out). Labelled documents of one
fold in ``FOLDS`` (by a hash of the id) are in neither, so that the score can be measured on them.

A word w after u has the probability (c(u, w) + K * p(w)) / (c(u) + K), with p(w) = (c(w) + D) / (n + D * v), v being the size
of the vocabulary, K = ``PRIOR`` and D = ``DISCOUNT``. A document's score is the mean over its tokens (a word or the end,
given the token before) of target loss minus background loss, in nats; lower means more like the target.

How it is done: texts are written once as batches, each with its distinct words (by 63-bit hash) and its tokens as places
among them. A batch's distinct words and bigrams, with their counts in either sample, are sorted by code and dealt by code
to as many parts as the text has ``part_tokens``; so a part gets a code at most once a batch, however often it stands there.
A part adds up its codes and answers each batch in the order it was asked; a batch's answers side by side are the counts of
its codes, and the batch scores its documents by them. What is gathered grows with the corpus, none of it on the driver, which
sees one pair of counts a slot and the sums of the samples. A lost executor costs a reread: batches stand written, so that
they stay what they are.

Defined results: a null or empty text is one token, the end symbol; without any target document both samples are empty and
all losses the logarithm of the vocabulary's size; label rows with a null are ignored, any good label of a document counts;
a null id is never in the target; an empty table gives an empty result; repeated rows are scored and counted each; other
columns of the documents are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import BATCH_BYTES, bound_batches, drop, enter, materialize, release

FOLDS = 5
PRIOR = 200.0
DISCOUNT = 0.1
SLOTS = 4096
#: Tokens of a part of the codes, on average; a part is held in memory, at up to a hundred bytes a token.
PART_TOKENS = 700_000
#: Text of a batch (a longer document is a batch of its own). A Python worker takes about 30 times that.
BATCH_TEXT = 5 << 20
#: More parts than this share tasks, one after the other.
MAX_TASKS = 20_000
#: At most so many ids are broadcast (8 MB); more are joined as Spark plans it.
BROADCAST_IDS = 1_000_000
#: Bytes that are hashed at once (a longer word is hashed whole).
CHUNK = 1 << 17
#: A-Z lower-cased, all other bytes kept; and the bytes that part words.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SPACES = b" \t\n\x0b\x0c\r"
#: Fixed hash of the end of a document (also what stands before its first word).
END = 0x5BD1E9955BD1E995
BASE = 0x9E3779B97F4A7C15 | 1
#: Kinds of documents.
HELD, OTHER, GOOD = 0, 1, 2

_tables: dict = {}


def _powers(n: int):
    import numpy as np

    if _tables.get("n", 0) < n:
        size, inverse = max(n, 2 * CHUNK), np.uint64(pow(BASE, -1, 1 << 64))
        _tables.update(n=size, up=np.cumprod(np.full(size, np.uint64(BASE))), down=np.cumprod(np.full(size, inverse)))
    return _tables["up"], _tables["down"]


def mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


def word_hashes(data, starts, ends):
    """Hash and text of each word of some texts that lie side by side in ``data`` (bytes as an array)."""
    import numpy as np

    lower, space = np.frombuffer(LOWER, np.uint8), np.zeros(256, bool)
    space[list(SPACES)] = True
    hashes, rows = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    base, last = (int(starts[0]), int(ends[-1])) if len(starts) else (0, 0)
    blank = space[data[base:last]]
    edge = np.zeros(last - base + 1, bool)  # where a text starts
    edge[starts - base] = True
    opens = np.flatnonzero(~blank & (edge[:-1] | np.concatenate([[True], blank[:-1]])))
    closes = np.flatnonzero(~blank & (edge[1:] | np.concatenate([blank[1:], [True]]))) + 1
    at = 0
    while at < len(opens):
        begin = int(opens[at])
        until = max(at + 1, int(np.searchsorted(closes, begin + CHUNK, side="right")))
        o, c = opens[at:until] - begin, closes[at:until] - begin
        n = int(c[-1])
        up, down = _powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((lower[data[base + begin : base + begin + n]].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        hashes.append(mix((sums[c] - sums[o]) * down[o] + (c - o).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
        rows.append(np.searchsorted(ends - base, opens[at:until], side="right"))
        at = until
    return np.concatenate(hashes), np.concatenate(rows)


def tokens_of(data, starts, ends):
    """Distinct words of some texts (the end among them), each token's place in them, and the tokens of each text."""
    import numpy as np

    word, row = word_hashes(data, starts, ends)
    counts = np.bincount(row, minlength=len(starts))
    token = np.empty(len(word) + len(starts), np.uint64)
    token[np.arange(len(word)) + row] = word
    token[np.cumsum(counts) + np.arange(len(starts))] = END
    words, place = np.unique(token, return_inverse=True)
    return words, place.astype(np.uint32), counts + 1


def codes_of(words, place):
    """Sorted codes of the distinct words (even) and bigrams (odd), where each word and each distinct bigram went, and for
    each token its bigram, for each bigram its two words."""
    import numpy as np

    end = int(np.searchsorted(words, np.uint64(END)))
    before = np.concatenate([[end], place[:-1]]).astype(np.int64)  # the end of one text stands before the next
    pair, bigram = np.unique(before * len(words) + place, return_inverse=True)
    first, second = pair // len(words), pair % len(words)
    single = mix(words) & ~np.uint64(1)
    double = mix(mix(words[first]) * np.uint64(0x9E3779B97F4A7C15) ^ words[second]) | np.uint64(1)
    codes = np.concatenate([single, double])
    order = np.argsort(codes, kind="stable")
    at = np.empty(len(codes), np.int64)
    at[order] = np.arange(len(codes))
    return codes[order], at[: len(words)], at[len(words) :], bigram, first, second


def packed(*arrays) -> bytes:
    """Integers of one length, compressed byte by byte place: most are small, and sorted codes travel as differences."""
    import numpy as np
    import zstandard

    planes = [np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes() for x in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpacked(data: bytes, *dtypes):
    """What ``packed`` was given, of these types."""
    import numpy as np
    import zstandard

    whole = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    sizes = [np.dtype(d).itemsize for d in dtypes]
    n, at, out = len(whole) // sum(sizes), 0, []
    for dtype, size in zip(dtypes, sizes):
        out.append(np.ascontiguousarray(whole[at : at + n * size].reshape(size, n).T).view(dtype).reshape(n))
        at += n * size
    return out


BATCHES = "batch long, docs array<long>, sizes array<int>, kinds array<tinyint>, slots array<int>, words binary, places binary"


def _batches(documents: DataFrame) -> DataFrame:
    """A row a batch, from doc_id, text, kind, slot."""

    def emit(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from .scratch import byte_slices
        from .suffixdedup import raw

        enter("lmscore")
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        schema = pa.schema([("batch", pa.int64()), ("docs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("kinds", pa.list_(pa.int8())), ("slots", pa.list_(pa.int32())), ("words", pa.binary()), ("places", pa.binary())])

        def flush():
            some = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            words, place, sizes = tokens_of(*raw(some.column(1)))
            row = {"batch": number, "docs": some.column(0).to_pylist(), "sizes": sizes.tolist(), "kinds": some.column(2).to_pylist(), "slots": some.column(3).to_pylist(), "words": words.tobytes(), "places": packed(place)}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for a, b in byte_slices(batch.column(1)):
                held.append(batch.slice(a, b - a))
                size += held[-1].column(1).nbytes
                if size >= BATCH_TEXT:
                    yield flush()
                    number, held, size = number + 1, [], 0
        if held:
            yield flush()
        release()

    return documents.mapInArrow(emit, BATCHES)


def _expand(row, threshold: int):
    """Tokens of a batch's row: words, places, text of each token, and which belong to the target and the background."""
    import numpy as np

    words, place = np.frombuffer(row["words"], np.uint64), unpacked(row["places"], np.uint32)[0]
    kinds, slots = np.array(row["kinds"], np.int8), np.array(row["slots"])
    text = np.repeat(np.arange(len(kinds)), np.array(row["sizes"]))
    return words, place, text, (kinds == GOOD)[text], ((kinds == OTHER) & (slots < threshold))[text]


PACKET = "part int, batch long, codes binary"
ANSWER = "part int, batch long, target binary, background binary, words long, n_target long, n_background long"


def _packets(batches: DataFrame, parts: int, threshold: int) -> DataFrame:
    """A packet for each batch and part: codes in order, with their counts in the batch's target and background."""

    def emit(tables):
        import numpy as np
        import pyarrow as pa

        enter("lmscore")
        for table in tables:
            for row in table.to_pylist():
                words, place, _, good, other = _expand(row, threshold)
                codes, single, double, bigram, _, _ = codes_of(words, place)
                counts = np.zeros((2, len(codes)), np.uint32)
                for k, chosen in enumerate((good, other)):
                    if chosen.any():
                        counts[k, single] = np.bincount(place[chosen], minlength=len(single))
                        counts[k, double] = np.bincount(bigram[chosen], minlength=len(double))
                part = ((codes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
                heads = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                spans = list(zip(heads.tolist(), [*heads[1:].tolist(), len(part)]))
                step = max(1, len(heads) * BATCH_BYTES // (16 * len(codes)))
                for at in range(0, len(heads), step):  # not all packets of a batch at once
                    some = spans[at : at + step]
                    data = [packed(np.diff(codes[a:b], prepend=np.uint64(0)), counts[0, a:b], counts[1, a:b]) for a, b in some]
                    yield pa.RecordBatch.from_arrays([pa.array(part[heads[at : at + step]]), pa.array([row["batch"]] * len(some), pa.int64()), pa.array(data, pa.binary())], names=["part", "batch", "codes"])
        release()

    return batches.mapInArrow(emit, PACKET)


def _answers(packets: DataFrame, parts: int) -> DataFrame:
    """Each packet with its codes' counts over all batches; and a row for each part with its words and tokens."""

    def add_up(tables):
        import numpy as np
        import pyarrow as pa

        enter("lmscore")
        names = ["part", "batch", "target", "background", "words", "n_target", "n_background"]
        schema = pa.schema([("part", pa.int32()), ("batch", pa.int64()), *((n, pa.binary()) for n in names[2:4]), *((n, pa.int64()) for n in names[4:])])

        def flush(part, held):
            each = [unpacked(c, np.uint64, np.uint32, np.uint32) for _, c in held]
            ends, counts = np.cumsum([len(x) for x, *_ in each]), [np.concatenate([x[1 + k] for x in each]) for k in (0, 1)]
            codes = np.concatenate([np.cumsum(x) for x, *_ in each])
            del each
            order = np.argsort(codes, kind="stable")
            heads = np.flatnonzero(np.concatenate([[True], codes[order[1:]] != codes[order[:-1]]]))
            times, words = np.diff(np.append(heads, len(codes))), codes[order[heads]] & np.uint64(1) == 0
            back, sums = np.empty((2, len(codes)), np.uint64), []
            for k in (0, 1):
                total = np.add.reduceat(counts[k][order].astype(np.uint64), heads)
                back[k, order] = np.repeat(total, times)
                sums.append(int(total[words].sum()))
            at = 0
            for (batch, _), until in zip(held, ends.tolist()):
                yield pa.RecordBatch.from_pylist([{"part": part, "batch": batch, "target": packed(back[0, at:until]), "background": packed(back[1, at:until])}], schema=schema)
                at = until
            yield pa.RecordBatch.from_pylist([{"part": part, "batch": -1, "words": int(words.sum()), "n_target": sums[0], "n_background": sums[1]}], schema=schema)

        held, current = [], None
        for table in tables:
            for part, *packet in zip(*(c.to_pylist() for c in table.columns)):
                if held and part != current:
                    yield from flush(current, held)
                    held = []
                current = part
                held.append(packet)
        if held:
            yield from flush(current, held)
        release()

    return packets.repartitionById(min(parts, MAX_TASKS), F.col("part") % MAX_TASKS).sortWithinPartitions("part").mapInArrow(add_up, ANSWER)


def _scores(batches: DataFrame, answers: DataFrame, words: int, totals: tuple[int, int]) -> DataFrame:
    """doc_id, n, t, b: tokens and summed losses of each document, from batches and the answers to them. There are as many
    tasks as batches, as a batch and its answers take tens of MB and a task sorts what it has."""

    def gather(tables):
        import numpy as np
        import pyarrow as pa

        enter("lmscore")

        def flush(row, target, background):
            w, place, text, _, _ = _expand(row, 0)
            _, single, double, bigram, first, second = codes_of(w, place)
            out = []
            for packets, n in zip((target, background), totals):
                count = np.concatenate([unpacked(p, np.uint64)[0] for p in packets]).astype(float)
                alone = (count[single] + DISCOUNT) / (n + DISCOUNT * words)
                chance = (count[double] + PRIOR * alone[second]) / (count[single][first] + PRIOR)
                out.append(np.bincount(text, -np.log(chance)[bigram], len(row["sizes"])))
            return pa.RecordBatch.from_arrays([pa.array(row["docs"], pa.int64()), pa.array(row["sizes"], pa.int64()), *map(pa.array, out)], names=["doc_id", "n", "t", "b"])

        row, target, background = None, [], []
        for table in tables:
            for got in table.to_pylist():  # a batch, then its answers by part
                if got["part"] < 0:
                    if row is not None:
                        yield flush(row, target, background)
                    row, target, background = got, [], []
                else:
                    target.append(got["target"])
                    background.append(got["background"])
        if row is not None:
            yield flush(row, target, background)
        release()

    both = batches.withColumn("part", F.lit(-1)).unionByName(answers.select("part", "batch", "target", "background"), allowMissingColumns=True)
    tasks = min(max(1, batches.count()), MAX_TASKS)
    return both.repartition(tasks, "batch").sortWithinPartitions("batch", "part").mapInArrow(gather, "doc_id long, n long, t double, b double")


def held_out(id_column: str = "doc_id"):
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % FOLDS == 0


def matched(batches: DataFrame) -> tuple[int, int]:
    """The number of slots, from the first, that hold as many tokens of other documents as the target has; all tokens."""
    each = batches.select(F.explode(F.arrays_zip("sizes", "kinds", "slots")).alias("d")).select("d.*")
    tokens = each.groupBy("slots").agg(F.sum(F.when(F.col("kinds") == GOOD, F.col("sizes"))).alias("good"), F.sum(F.when(F.col("kinds") == OTHER, F.col("sizes"))).alias("other"), F.sum("sizes").alias("all"))
    rows = sorted(tokens.collect())  # at most SLOTS rows
    wanted, seen = sum(r["good"] or 0 for r in rows), 0
    best = wanted, 0
    for r in rows:
        seen += r["other"] or 0
        best = min(best, (abs(wanted - seen), r["slots"] + 1))
    return best[1], sum(r["all"] for r in rows)


def score(documents: DataFrame, labels: DataFrame, *, label="quality", id_column="doc_id", text_column="text", part_tokens: int = PART_TOKENS) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (mean nats a token), score (their difference)."""
    bound_batches(documents.sparkSession)
    rows = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    usable = labels.where(F.col(id_column).isNotNull() & F.col(label).isNotNull())
    marks = usable.groupBy(F.col(id_column).cast("long").alias("label_id")).agg(F.max(F.when(held_out(id_column), HELD).when(F.col(label) == 1, GOOD).otherwise(OTHER)).alias("mark")).where(F.col("mark") != OTHER)
    marks = materialize(marks, "lm-labels")
    known = F.broadcast(marks) if marks.count() <= BROADCAST_IDS else marks
    slot = F.pmod(F.xxhash64("doc_id", F.lit("background")), F.lit(SLOTS)).cast("int")
    kinds = rows.join(known, F.col("doc_id") == F.col("label_id"), "left").select("doc_id", "text", F.coalesce("mark", F.lit(OTHER)).cast("tinyint").alias("kind"), slot.alias("slot"))
    batches = materialize(_batches(kinds), "lm-batches", compression="zstd", wide=True)
    drop(marks)
    threshold, tokens = matched(batches)
    parts = max(1, -(-tokens // part_tokens))
    answers = materialize(_answers(_packets(batches, parts, threshold), parts), "lm-answers", compression="zstd", wide=True)
    totals = answers.where("batch = -1").agg(F.sum("words").alias("v"), F.sum("n_target").alias("t"), F.sum("n_background").alias("b")).first()
    found = _scores(batches, answers.where("batch >= 0"), totals["v"] or 0, (totals["t"] or 0, totals["b"] or 0))
    mean = lambda c: F.col(c) / F.col("n")
    return found.select("doc_id", F.col("n").alias("n_tokens"), mean("t").alias("target_loss"), mean("b").alias("background_loss")).withColumn("score", F.col("target_loss") - F.col("background_loss"))


def op9_lm_score(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
