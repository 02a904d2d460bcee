"""Periodic runs of words: a suffix automaton whose end positions are merged small to large.

A run of a text is a stretch of consecutive words whose smallest period is q (words q apart are the same), of at least
``max(min_words, min_exponent * q)`` words, that no neighbouring word extends with period q. Words are parted by ASCII
white space and compared as they stand. Collapsing a text drops each word that some run contains after that run's first q
words.

The automaton of a stretch of words has one state for each set of equal end positions; a state's set is the union of its
children's (the states whose suffix link it is) and of its own position. Sets are ordered lists, and the smaller one is
put into the larger, word by word. Two end positions that become neighbours in a state of length n have exactly n words in
common to their left, so a distance of at most n is a square that starts n words before the first of them and can't
start earlier. Of the squares with one start and distance the longest is extended to the right; that is a run, and among runs over the same
words the smallest distance is the period. Every run of exponent 2 or more is found so: the word in front of its last
period repeats nowhere nearer, or the period were not the smallest.

Only stretches that can hold a run of the size asked for get an automaton, which loses none: in such a run each three
consecutive words occur at least ``min(min_words - 2, min_exponent - 1)`` times, and it has ``min_words - 2`` of them side
by side. Array operations over a batch of texts count them (by hash: what collides is kept) and cut the texts at those that
occur less often, again and again until nothing goes. What is left of plain prose is a few hundredths.

Memory: a task holds a batch of a few MB of text, or one text, as words (about ten times its bytes), and the automaton of
one stretch, about half a kilobyte a word. Nothing is shuffled; no text meets another.

Defined results: a null, empty or blank text has no words, no runs, and collapses to an empty text; a null id is an id
like others; repeated rows are rows like others; an empty table gives an empty result; the other columns of the input pass
through under their own names.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bound_batches, byte_slices, enter, release, unused

MIN_WORDS = 6
MIN_EXPONENT = 4
#: Consecutive words whose occurrences are counted.
GRAM = 3
#: Text that is cut into words at once (a longer row is taken whole).
BATCH_TEXT = 2 << 20
WORD = r"[^\x20\x09-\x0D]+"


def states(words):
    """Suffix automaton: length, suffix link, and own end position (-1 for clones) of each state; state 0 is the root."""
    nexts, link, length, own = [{}], [-1], [0], [-1]
    last = 0
    for i, word in enumerate(words):
        new = len(nexts)
        nexts.append({})
        length.append(i + 1)
        link.append(0)
        own.append(i)
        p = last
        while p >= 0 and word not in nexts[p]:
            nexts[p][word] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][word]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(nexts)
                nexts.append(nexts[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                own.append(-1)
                link[q] = link[new] = clone
                while p >= 0 and nexts[p].get(word) == q:
                    nexts[p][word] = clone
                    p = link[p]
        last = new
    return length, link, own


def squares(words) -> dict:
    """(start, distance) of squares that can't start earlier, to the furthest end seen."""
    length, link, own = states(words)
    found: dict = {}
    # positions are kept negated, in ascending order: a state's own position comes before all of its children's
    ends = [[-e] if e >= 0 else [] for e in own]
    for state in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
        parent = link[state]
        small, ends[state] = ends[state], None
        if not parent:
            continue  # no distance is within the root's length
        large, n = ends[parent], length[parent]
        if len(large) < len(small):
            small, large = large, small
        before = None
        for e in small:
            at = bisect_left(large, e)
            large.insert(at, e)
            if at and large[at - 1] != before:  # the neighbour that ends later; two of one child were neighbours there
                later = -large[at - 1]
                if later + e <= n:
                    key = 1 - e - n, later + e
                    if found.get(key, -1) < later:
                        found[key] = later
            if at + 1 < len(large):
                earlier = -large[at + 1]
                if -e - earlier <= n:
                    key = earlier - n + 1, -e - earlier
                    if found.get(key, -1) < -e:
                        found[key] = -e
            before = e
        ends[parent] = large
    return found


def runs_of(words, min_words=MIN_WORDS, min_exponent=MIN_EXPONENT) -> list:
    """(start, length, period) of the runs of a list of words, by start, then period."""
    period: dict = {}
    for (start, distance), end in squares(words).items():
        while end + 1 < len(words) and words[end + 1] == words[end + 1 - distance]:
            end += 1
        if end - start + 1 >= max(min_words, min_exponent * distance):
            key = start, end
            period[key] = min(distance, period.get(key, distance))
    return sorted((start, end - start + 1, q) for (start, end), q in period.items())


def stretches(marks, starts, min_words=MIN_WORDS, min_exponent=MIN_EXPONENT):
    """First and last word of each stretch that may hold a run. ``marks`` has a number a word (equal words have equal ones)
    of texts side by side, of which ``starts`` has the first words."""
    import numpy as np

    least, side_by_side = min(min_words - GRAM + 1, min_exponent - 1), min_words - GRAM + 1
    if len(marks) < max(min_words, GRAM):
        return np.empty((0, 2), np.int64)
    edge = np.zeros(len(marks), np.int64)
    np.add.at(edge, starts[starts < len(marks)], 1)
    text = np.cumsum(edge)
    x = marks.astype(np.uint64)
    odd = np.uint64(0x9E3779B97F4A7C15)
    gram = x[: len(x) - GRAM + 1].copy()
    for k in range(1, GRAM):
        gram = (gram ^ (gram >> np.uint64(29))) * odd + x[k : len(x) - GRAM + 1 + k]
    at = np.flatnonzero(text[: len(gram)] == text[GRAM - 1 :])
    stretch = text[at]
    while len(at):
        bits = max(12, int(len(at)).bit_length() + 2)
        mixed = (gram[at] ^ stretch.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) * odd
        bucket = ((mixed ^ (mixed >> np.uint64(32))) * odd >> np.uint64(64 - bits)).astype(np.int64)
        keep = np.bincount(bucket, minlength=1 << bits)[bucket] >= least
        left = at[keep]
        # a stretch ends where the next word's three are gone, or the text ends
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(left) != 1) | (np.diff(stretch[keep]) != 0)])) if len(left) else np.empty(0, np.int64)
        sizes = np.diff(np.append(cut, len(left)))
        fine = sizes >= side_by_side
        if len(left) == len(at) and fine.all():
            return np.stack([left[cut], left[cut + sizes - 1] + GRAM - 1], axis=1)
        at, stretch = left[np.repeat(fine, sizes)], np.repeat(np.arange(len(cut)), sizes)[np.repeat(fine, sizes)]
    return np.empty((0, 2), np.int64)


def analyse(texts: list, min_words=MIN_WORDS, min_exponent=MIN_EXPONENT):
    """Number of words, runs and collapsed text of each of some texts (bytes or None)."""
    import numpy as np

    words, starts = [], [0]
    for text in texts:
        words += (text or b"").split()
        starts.append(len(words))
    starts = np.array(starts)
    # a process has one hash for a word; equal hashes of other words only keep more than need be
    marks = np.fromiter(map(hash, words), np.int64, len(words))
    found: list = [[] for _ in texts]
    for first, last in stretches(marks, starts[:-1], min_words, min_exponent).tolist():
        row = int(np.searchsorted(starts, first, side="right")) - 1
        shift = first - int(starts[row])
        found[row] += [(shift + s, n, q) for s, n, q in runs_of(words[first : last + 1], min_words, min_exponent)]
    out = []
    for row, runs in enumerate(found):
        own = words[starts[row] : starts[row + 1]]
        kept = own
        if runs:
            runs.sort(key=lambda r: (r[0], r[2]))
            gone = np.zeros(len(own) + 1, np.int64)
            for s, n, q in runs:
                gone[s + q] += 1
                gone[s + n] -= 1
            kept = [own[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]
        out.append((len(own), runs, b" ".join(kept)))
    return out


def find_runs(documents: DataFrame, *, text_column="text", min_words=MIN_WORDS, min_exponent=MIN_EXPONENT) -> DataFrame:
    """``documents`` with ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed``, the text
    without the repetitions, words joined by one space. The texts themselves are left out."""
    if min_words < GRAM or min_exponent < 2:
        raise ValueError("runs of at least three words and two periods are found")
    bound_batches(documents.sparkSession)
    keep = [c for c in documents.columns if c != text_column]
    names = {f"_run_k{i}": c for i, c in enumerate(keep)}  # a column of the input may be named like one of ours
    rows = documents.select(F.col(f"`{text_column}`").alias("text"), *[F.col(f"`{c}`").alias(n) for n, c in names.items()])

    def walk(batches):
        import pyarrow as pa

        enter("periodic")
        run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in batches:
            column = batch.column(0).cast(pa.binary())
            for a, b in byte_slices(column, BATCH_TEXT):
                got = analyse(column.slice(a, b - a).to_pylist(), min_words, min_exponent)
                runs = [[{"start": s, "length": n, "period": q} for s, n, q in r] for _, r, _ in got]
                columns = [pa.array([n for n, _, _ in got], pa.int64()), pa.array(runs, pa.list_(run)), pa.array([t for _, _, t in got], pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[1:]), *columns], names=[*names, "n_words", "runs", "collapsed"])
        release()

    kinds = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names)
    found = rows.mapInArrow(walk, f"{kinds + ', ' if kinds else ''}n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    ours = [F.col(c).alias(unused(c, documents)) for c in ("n_words", "runs", "collapsed")]
    return found.select(*[F.col(n).alias(c) for n, c in names.items()], *ours)


def collapse(documents: DataFrame, *, text_column="text", **options) -> DataFrame:
    """``documents`` with each text collapsed; a null text stays null. Same columns."""
    marked = documents.withColumn(name := unused("was_null", documents), F.col(f"`{text_column}`").isNull())
    found = find_runs(marked, text_column=text_column, **options)
    text = F.when(~F.col(name), F.col(unused("collapsed", marked)))
    return found.select(*[text.alias(c) if c == text_column else F.col(f"`{c}`") for c in documents.columns])


def repeated_tail(text_column="text", id_column="doc_id"):
    """The text, with every word from a certain one on replaced so that the tail has a period; for a tenth of the ids."""
    h = f"crc32(cast(cast(`{id_column}` as string) as binary))"
    g = f"cast(floor({h} / 10) as bigint)"
    # variables of lambdas, as an expression inside one would be computed for each word
    place = "if(i < v.a, i, v.a + (i - v.a) % v.p)"
    altered = f"""element_at(transform(transform(transform(array(regexp_extract_all(`{text_column}`, r'{WORD}', 0)),
          w -> named_struct('w', w, 'n', cast(size(w) as bigint), 'a', {g} % size(w))),
          v -> named_struct('w', v.w, 'n', v.n, 'a', v.a, 'p', 1 + cast(floor((v.n - v.a) / (3 + {g} % 8)) as bigint))),
          v -> array_join(transform(sequence(0L, v.n - 1), i -> element_at(v.w, cast({place} + 1 as int))), ' ')), 1)"""
    return F.expr(f"case when {h} % 10 = 0 and `{text_column}` rlike r'{WORD}' then {altered} else `{text_column}` end")


def op12_runs(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", repeated_tail().alias("text"))
    found = find_runs(documents)
    best = "element_at(array_sort(runs, (a, b) -> case when a.length <> b.length then int(sign(b.length - a.length)) when a.start <> b.start then int(sign(a.start - b.start)) else int(sign(a.period - b.period)) end), 1)"
    found = found.withColumn("best", F.expr(f"if(size(runs) > 0, {best}, null)"))
    lines = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')"
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.expr(lines).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
