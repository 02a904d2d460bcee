"""Benchmark decontamination with an FM-index for each shard of training documents.

Words are cut and lower-cased bytewise, and replaced by numbers: words of the benchmark from 2, all others 1. A phrase
can only occur inside a run of benchmark words that is at least as long as the shortest phrase, so a shard's text is the
runs of at least that length, parted by 1; everything else cannot match and is left out of the index, which makes this
exact. The shard's text is sorted by suffix; its Burrows-Wheeler transform goes into a wavelet matrix of packed bits
with a count for each 64 of them, and all phrases are searched backward at once. Occurrences are located from suffix positions sampled every ``SAMPLE`` words by walking the transform.
Overlapping and touching occurrences merge into removal spans.

A shard is a run of rows of a partition with at most ``SHARD_BYTES`` of text (or one longer text). The benchmark is read
in blocks of at most ``BLOCK_BYTES`` of text; each block is broadcast and passes over the documents inside the same stage,
so the benchmark may be of any size.

Defined results: null and empty texts have no words, no spans and are not contaminated; null or wordless benchmark items
match nothing; several items with one id count as one item; an empty benchmark or table is no error; repeated rows and
ids are rows like others; columns of any other name are kept as they are by ``annotate`` and ``drop_contaminated``.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bound_batches, byte_slices, enter, release, unused

WINDOW = 13
SAMPLE = 8
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 4 << 20
#: Bytes that are part of a word (0-9, a-z, A-Z lower-cased, all of 0x80 and above).
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

FOUND = "words long, starts array<int>, ends array<int>, items array<long>"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(TABLE).split()


class Phrases:
    """The distinct windows of a block of benchmark items and the items that each belongs to."""

    def __init__(self, items: list[tuple[int, str | None]], window: int = WINDOW):
        import numpy as np

        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words(text)]
            for at in range(max(1, len(ids) - window + 1)) if ids else ():
                found.setdefault(tuple(ids[at : at + window]), set()).add(item)
        keys = sorted(found, key=len)
        self.items = [found[k] for k in keys]
        self.lengths = np.array([len(k) for k in keys], np.int64)
        self.matrix = np.zeros((len(keys), window), np.int64)  # right-aligned: backward search starts at the right end
        for row, key in enumerate(keys):
            self.matrix[row, window - len(key) :] = key
        self.shortest, self.longest = (len(keys[0]), len(keys[-1])) if keys else (0, 0)


class WaveletMatrix:
    """Rank of any symbol in any prefix: for each binary digit one packed bit vector with a count for each 64 bits."""

    def __init__(self, symbols, bits: int):
        import numpy as np

        self.levels = []
        for bit in range(bits - 1, -1, -1):
            ones = ((symbols >> bit) & 1).astype(bool)
            padded = np.zeros((len(ones) // 64 + 1) * 64, bool)  # one bit more at least, for the rank at the end
            padded[: len(ones)] = ones
            words = np.packbits(padded, bitorder="little").view("<u8")
            counts = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.levels.append((bit, words, counts, len(ones) - int(counts[-1])))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    @staticmethod
    def _ones(words, counts, position):
        import numpy as np

        at = position >> 6
        below = (np.uint64(1) << (position & 63).astype(np.uint64)) - np.uint64(1)
        return counts[at] + np.bitwise_count(words[at] & below)

    def rank(self, symbol, position):
        """Occurrences of symbol[i] before position[i], for arrays."""
        import numpy as np

        start = np.zeros_like(position)
        for bit, words, counts, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            s, p = self._ones(words, counts, start), self._ones(words, counts, position)
            start, position = np.where(one, zeros + s, start - s), np.where(one, zeros + p, position - p)
        return position - start

    def access(self, position):
        import numpy as np

        symbol = np.zeros_like(position)
        for bit, words, counts, zeros in self.levels:
            one = (words[position >> 6] >> (position & 63).astype(np.uint64)) & np.uint64(1) == 1
            before = self._ones(words, counts, position)
            symbol |= one.astype(symbol.dtype) << bit
            position = np.where(one, zeros + before, position - before)
        return symbol


def suffix_order(text):
    """Starts of the sorted suffixes of ``text``, by doubling the sorted depth."""
    import numpy as np

    n, span = len(text), 1
    rank = text.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    while True:
        second = np.zeros(n, np.int64)
        second[: max(0, n - span)] = rank[span:] + 1
        key = rank * (int(rank.max()) + 2 + n) + second
        order = np.argsort(key, kind="stable")
        step = np.zeros(n, np.int64)
        step[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        if rank[order[-1]] == n - 1:
            return order
        span *= 2


class FMIndex:
    """Backward search and locating over a text of numbers that ends with its only 0."""

    def __init__(self, text, symbols: int, sample: int = SAMPLE):
        import numpy as np

        order = suffix_order(text)
        transform = text[order - 1]
        self.n = len(text)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        self.wavelet = WaveletMatrix(transform.astype(np.int64), max(1, int(symbols).bit_length()))
        self.sampled = order % sample == 0
        self.samples = order[self.sampled]
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled, dtype=np.int64)])

    def search(self, phrases: Phrases):
        """Suffix interval of each phrase."""
        import numpy as np

        low, high = np.zeros(len(phrases.lengths), np.int64), np.full(len(phrases.lengths), self.n, np.int64)
        live = np.arange(len(low))
        width = phrases.matrix.shape[1]
        for step in range(width):
            live = live[(low[live] < high[live]) & (phrases.lengths[live] > step)]
            if not len(live):
                break
            symbol = phrases.matrix[live, width - 1 - step]
            base = self.first[symbol]
            low[live], high[live] = base + self.wavelet.rank(symbol, low[live]), base + self.wavelet.rank(symbol, high[live])
        return low, high

    def locate(self, rows):
        """Text positions of suffix ranks, by walking back to a sampled one."""
        import numpy as np

        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            at = self.sampled[rows[live]]
            done = live[at]
            out[done] = self.samples[self.sample_rank[rows[done]]] + steps[done]
            live = live[~at]
            symbol = self.wavelet.access(rows[live])
            rows[live] = self.first[symbol] + self.wavelet.rank(symbol, rows[live])
            steps[live] += 1
        return out


def find(texts: list[str | None], phrases: Phrases):
    """For each text: number of words, merged spans of hit words (starts, ends), sorted items found."""
    import numpy as np

    get, rows, counts = phrases.vocabulary.get, [], np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        ids = [get(w, 1) for w in words(text)]
        counts[k] = len(ids)
        rows.append(np.array(ids, np.int32))
    result = [(int(c), [], [], []) for c in counts]
    if not phrases.shortest or not counts.sum():
        return result
    flat = np.concatenate([np.append(r, np.int32(1)) for r in rows])  # a 1 ends each document
    begins = np.concatenate([[0], np.cumsum(counts + 1)])
    edge = np.diff(np.concatenate([[0], (flat > 1).astype(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = last - first >= phrases.shortest
    first, last = first[long], last[long]
    if not len(first):
        return result
    sizes = last - first + 1  # with the 1 after each run
    shift = np.repeat(first - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    origin = np.arange(len(shift)) + shift  # place in flat of each place in the index
    index = FMIndex(np.append(flat[origin], np.int32(0)), len(phrases.vocabulary) + 1)
    low, high = index.search(phrases)
    hit = np.flatnonzero(high > low)
    if not len(hit):
        return result
    times = high[hit] - low[hit]
    which = np.repeat(hit, times)
    ranks = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low[hit], times)
    starts = origin[index.locate(ranks)]
    order = np.argsort(starts, kind="stable")
    starts, which = starts[order], which[order]
    ends = starts + phrases.lengths[which]
    docs = np.searchsorted(begins, starts, side="right") - 1
    for doc in np.unique(docs):
        a, b = np.searchsorted(docs, [doc, doc + 1])
        s, e = starts[a:b] - begins[doc], np.maximum.accumulate(ends[a:b]) - begins[doc]
        new = np.concatenate([[True], s[1:] > e[:-1]])
        last_of = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(s) - 1]])
        items = set().union(*[phrases.items[w] for w in np.unique(which[a:b])])
        result[doc] = (int(counts[doc]), s[new].tolist(), e[last_of].tolist(), sorted(items))
    return result


def merge_spans(starts, ends, more_starts, more_ends):
    spans: list[list[int]] = []
    for s, e in sorted([*zip(starts, ends), *zip(more_starts, more_ends)]):
        if spans and s <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], e)
        else:
            spans.append([s, e])
    return [s for s, _ in spans], [e for _, e in spans]


def blocks(benchmark: DataFrame, *, item_column="item_id", text_column="text", block_bytes=BLOCK_BYTES):
    """Benchmark items in lists of at most ``block_bytes`` of text (one item, if it is longer)."""
    rows, size = [], 0
    for row in benchmark.select(F.col(item_column).cast("long"), text_column).toLocalIterator():
        n = len(row[1] or "") * 4
        if rows and size + n > block_bytes:
            yield rows
            rows, size = [], 0
        if row[0] is not None:
            rows.append((row[0], row[1]))
            size += n
    if rows:
        yield rows


def annotate(documents: DataFrame, benchmark: DataFrame, *, text_column="text", output="contamination", window=WINDOW, shard_bytes=SHARD_BYTES, **options) -> DataFrame:
    """``documents`` with a column ``output``: words, starts, ends (word spans hit, end exclusive) and items.

    Only texts go to Python and only spans come back; all other columns stay where they are. A column of the input that
    is named like the output is an error.
    """
    import pyarrow as pa

    if output.lower() in {c.lower() for c in documents.columns}:
        raise ValueError(f"the documents have a column {output} already")
    bound_batches(documents.sparkSession)
    context = documents.sparkSession.sparkContext
    shape = pa.struct([("words", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("items", pa.list_(pa.int64()))])
    column = None
    for rows in blocks(benchmark, **options) if not benchmark.isEmpty() else [[]]:
        shared = context.broadcast(rows)  # at most block_bytes of text

        def scan(batches, shared=shared):
            enter("decontaminate")
            phrases = Phrases(shared.value, window)
            for batch in batches:
                texts, earlier = batch if isinstance(batch, tuple) else (batch, None)
                new = []
                for first, last in byte_slices(texts, shard_bytes):
                    new += find(texts.slice(first, last - first).to_pylist(), phrases)
                if earlier is not None:
                    new = [(n, *merge_spans(e["starts"], e["ends"], starts, ends), sorted({*e["items"], *items})) for e, (n, starts, ends, items) in zip(earlier.to_pylist(), new)]
                yield pa.array([dict(zip(("words", "starts", "ends", "items"), row)) for row in new], shape)
            del phrases
            release()

        scanner = F.arrow_udf(scan, FOUND, F.ArrowUDFType.SCALAR_ITER).asNondeterministic()  # run once, where it stands
        column = scanner(F.col(text_column)) if column is None else scanner(F.col(text_column), column)
    return documents.withColumn(output, column)


def n_hits(found: str) -> F.Column:
    """Words hit, of a column made by ``annotate``."""
    return F.expr(f"aggregate(zip_with(`{found}`.starts, `{found}`.ends, (s, e) -> cast(e - s as long)), 0L, (a, x) -> a + x)")


def is_contaminated(hits: F.Column, total: F.Column) -> F.Column:
    return (hits > 0) & (20 * hits >= total)


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``documents`` that are not contaminated; same columns."""
    found = unused("contamination", documents)
    marked = annotate(documents, benchmark, output=found, **options)
    return marked.where(~is_contaminated(n_hits(found), F.col(f"{found}.words"))).select(*[F.col(f"`{c}`") for c in documents.columns])


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = annotate(documents, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), output="found").drop("text").withColumn("n_hit", n_hits("found"))
    names = F.array_join(F.array_sort(F.transform("found.items", lambda x: x.cast("string"))), ",")
    n_words = F.col("found.words")
    return found.select("doc_id", n_words.alias("n_words"), "n_hit", F.size("found.items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), is_contaminated(F.col("n_hit"), n_words).alias("contaminated"))


def brute_force(texts: dict, items: dict, window: int = WINDOW) -> dict:
    """What op4 returns for small inputs, by comparing words."""
    out = {}
    cut = {i: words(t) for i, t in items.items()}
    for doc, text in texts.items():
        own, hit, got = words(text), set(), set()
        for item, ws in cut.items():
            size = min(window, len(ws))
            for at in range(len(ws) - size + 1) if ws else ():
                for k in range(len(own) - size + 1):
                    if own[k : k + size] == ws[at : at + size]:
                        hit.update(range(k, k + size))
                        got.add(item)
        names = ",".join(sorted(map(str, got)))
        out[doc] = (len(own), len(hit), len(got), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(own))
    return out
