"""Removal of byte strings that occur earlier in the corpus, with run-length Burrows-Wheeler indexes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a document with a smaller id, or at a
smaller place of the same one. One index over everything would have to be one task, and indexes over shards would have to
meet in pairs; so content decides what meets. Every window of ``LENGTH`` bytes has an anchor: the leftmost smallest hash of
its ``GRAM``-byte grams. Windows with one anchor in a row make a segment. The anchor depends on the window's bytes alone, so
equal windows always lie in segments with equal anchors, at equal offsets.

1. Each document gives its anchors, each with a hash of its segment. By anchor, occurrences are counted (combined before the
   shuffle); an anchor that occurs once has nothing to be compared with.
2. Equal segments are one string, known by 128 bits (anchor and segment hash): its first occurrence speaks for it, the others
   go. An anchor with one string is settled by that.
3. The strings of the other anchors meet by anchor, in lots of about ``LOT_BYTES``. A lot is a run-length index: the
   run-compressed transform of its strings, with suffix positions sampled at the first and last row of each run, and the
   earliest string of each interval of rows that agree in ``LENGTH`` bytes. Each string is streamed through it from its end:
   where the row before holds the next byte, the match grows by a step; where not, it jumps to the nearest run of that byte
   above or below, whose sampled position tells how much of the match is left. That is the matching statistic of each place;
   where it reaches ``LENGTH``, the row's interval tells whether an earlier string holds the window, and the window is marked.
   (A matching statistic alone says that a window occurs, not that it occurs earlier.)
4. An anchor with more than ``SPLIT`` occurrences is dealt finer, on the same path: its windows in blocks of ``BLOCK`` offsets,
   each block by the bytes that all of its windows share. Equal blocks become one string before they are dealt, so a group
   holds strings that differ in ``2 * (BLOCK - 1)`` outer bytes only.
5. Marked windows come back to their documents as spans and merge into removals.

Defined results: a null text is empty; a null id comes after all others; rows that share an id are one document as far as
"earlier" goes: of two equal windows the one at the smaller place is earlier, and at equal places neither is, so repeated
rows keep the same; texts shorter than ``LENGTH`` bytes stay whole; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Workspace, bound_batches, drop, enter, materialize

LENGTH, GRAM = 100, 28
SPLIT, BLOCK = 4096, 4
LOT_BYTES = 1 << 18
#: Bytes that are hashed at once.
CHUNK = 1 << 16
LAST = (1 << 63) - 1
POSITION_BITS = 20
BASE = 0x9E3779B97F4A7C15 | 1

_tables: dict = {}


def _table(n: int):
    """Powers of the base and of its inverse modulo 2^64."""
    import numpy as np

    if _tables.get("n", 0) < n:
        size = max(n, 2 * CHUNK)
        inverse = np.uint64(pow(BASE, -1, 1 << 64))
        with np.errstate(over="ignore"):
            _tables.update(n=size, up=np.cumprod(np.full(size, np.uint64(BASE))), down=np.cumprod(np.full(size, inverse)))
    return _tables["up"], _tables["down"]


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _segments(data, starts, ends, length: int, gram: int):
    """Columns row, anchor, whole, place, first, last for texts that lie side by side in ``data``."""
    import numpy as np

    base, n = int(starts[0]), int(ends[-1] - starts[0])
    counts = np.maximum(ends - starts - length + 1, 0)
    if n < length or not counts.any():
        return np.empty((6, 0), np.int64)
    x = data[base : base + n].astype(np.uint64) + np.uint64(1)
    up, down = _table(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(x * up[:n], out=sums[1:])
    hashes = _mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    low = np.uint64((1 << POSITION_BITS) - 1)
    order = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)  # ties go to the leftmost
    width, span = length - gram + 1, 1
    while span * 2 <= width:
        order = np.minimum(order[:-span], order[span:])
        span *= 2
    if span < width:
        order = np.minimum(order[: len(order) - (width - span)], order[width - span :])
    # windows that lie inside one text
    window = np.repeat(starts - base - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    places = (order[window] & low).astype(np.int64)
    change = np.flatnonzero(np.diff(places)) + 1
    first, last = window[np.concatenate([[0], change])], window[np.concatenate([change - 1, [len(window) - 1]])]
    place = places[np.concatenate([[0], change])]
    whole = _mix((sums[last + length] - sums[first]) * down[first] + (last - first).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    row = np.searchsorted(ends - base, first, side="right")
    return np.stack([row, hashes[place].view(np.int64), whole.view(np.int64), place + base, first + base, last + base])


def segments(data, starts, ends, length: int = LENGTH, gram: int = GRAM, chunk: int = CHUNK):
    """Columns row, anchor, whole (hash), place of the anchor, first window, last window of all segments, in order.

    ``data`` holds the texts side by side, text k from ``starts[k]`` to ``ends[k]``; places are places in ``data``. A long
    text is taken in pieces, each from the start of the last segment of the one before.
    """
    import numpy as np

    parts, row = [np.empty((6, 0), np.int64)], 0
    while row < len(starts):
        until = max(row + 1, int(np.searchsorted(ends, starts[row] + chunk, side="right")))
        a, b = starts[row:until], ends[row:until]
        while True:
            stop = np.minimum(b, a[0] + chunk) if until == row + 1 else b
            part = _segments(data, a, stop, length, gram)
            unfinished = stop[0] < b[0] and until == row + 1
            part[0] += row
            parts.append(part[:, :-1] if unfinished else part)
            if not unfinished:
                break
            a = part[4, -1:].copy()
        row = until
    return np.concatenate(parts, axis=1)


def raw(column):
    """Bytes, starts and ends of an Arrow text column (nulls are empty)."""
    import numpy as np
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), at[:-1].copy(), at[1:].copy()


def _firsts(row, anchor, whole):
    """Which segments are the first of their kind in their text."""
    import numpy as np

    order = np.lexsort((whole, anchor, row))
    same = (np.diff(row[order]) == 0) & (np.diff(anchor[order]) == 0) & (np.diff(whole[order]) == 0)
    out = np.ones(len(row), bool)
    out[order[1:][same]] = False
    return out


def _lists(column, names):
    """Row and fields of the elements of an Arrow column of struct lists."""
    import numpy as np

    inner = column.flatten()
    sizes = np.asarray(column.value_lengths().fill_null(0), np.int64)
    return np.repeat(np.arange(len(column)), sizes), *(np.asarray(inner.field(n), np.int64) for n in names)


def _named(row, place, whole, found, starts):
    """Index of the segment that each (row, place in text, hash) names, and whether there is one."""
    import numpy as np

    at = starts[row] + place
    k = np.minimum(np.searchsorted(found[3], at), max(0, found.shape[1] - 1))
    if not found.shape[1]:
        return k, np.zeros(len(k), bool)
    return k, (found[3][k] == at) & (found[0][k] == row) & (found[2][k] == whole)


class RunIndex:
    """Run-compressed transform of some byte strings, with positions sampled at run ends.

    Rows are the suffixes of all strings in order; equal ones are ordered by string.
    """

    def __init__(self, strings: list[bytes], length: int = LENGTH):
        import numpy as np

        sizes = np.array([len(s) for s in strings])
        self.ends = np.cumsum(sizes + 1) - 1  # place of the 0 after each string
        text = np.frombuffer(b"\0".join([*strings, b""]), np.uint8).astype(np.int64) + 1
        text[self.ends] = 0
        self.text, self.owner, n = text, np.repeat(np.arange(len(strings)), sizes + 1), len(text)
        left = self.ends[self.owner] - np.arange(n) + 1  # symbols up to the end of the own string, with its 0
        self.ranks = []  # (span, rank of each suffix by its first span symbols)
        self.order = self._sort(left, int(sizes.max()) + 1)
        transform = text[self.order - 1]
        self.run_start = np.flatnonzero(np.concatenate([[True], transform[1:] != transform[:-1]]))
        self.run_symbol = transform[self.run_start]
        self.run_end = np.append(self.run_start[1:], n)
        #: Text positions of the first and the last row of each run, from which jumps start. The sort's ranks stay beside them,
        #: to measure common prefixes: runs save steps here, and no memory.
        self.sample_first, self.sample_last = self.order[self.run_start], self.order[self.run_end - 1]
        # with the runs sorted by symbol, what comes before a run is all smaller symbols and its symbol's earlier runs
        self.by_symbol = np.argsort(self.run_symbol * (n + 1) + self.run_start)
        self.run_key = (self.run_symbol * (n + 1) + self.run_start)[self.by_symbol]
        lengths = (self.run_end - self.run_start)[self.by_symbol]
        self.step = np.cumsum(lengths) - lengths - self.run_start[self.by_symbol]
        agree = self._agree(self.order[1:], self.order[:-1], length)
        self.interval = np.flatnonzero(np.concatenate([[True], ~agree]))
        self.n = n

    def _sort(self, left, depth: int):
        """Suffix order by doubling spans; a suffix ends with its string."""
        import numpy as np

        n, span = len(self.text), 7
        key = np.zeros(n, np.int64)
        for k in range(span):  # nine bits a symbol, nothing after the own string
            shifted = np.zeros(n, np.int64)
            shifted[: n - k] = self.text[k:]
            key = (key << 9) | np.where(left > k, shifted, 0)
        while True:
            order = np.argsort(key)
            new = np.zeros(n, np.int64)
            new[1:] = key[order[1:]] != key[order[:-1]]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new) + 1
            self.ranks.append((span, rank))
            if span >= depth:
                return np.argsort(rank * (len(self.ends) + 1) + self.owner)
            second = np.zeros(n, np.int64)
            second[: n - span] = rank[span:]
            key = rank * (n + 2) + np.where(left > span, second, 0)
            span *= 2
            if span >= depth and (n + 2) ** 2 * (len(self.ends) + 1) < 1 << 62:  # the last round, with the owner in the key
                return np.argsort(key * (len(self.ends) + 1) + self.owner)

    def _agree(self, a, b, length: int):
        """Whether suffixes agree in their first ``length`` symbols (and have so many)."""
        import numpy as np

        span, rank = max((r for r in self.ranks if r[0] <= length), key=lambda r: r[0])
        full = (self.ends[self.owner[a]] - a >= length) & (self.ends[self.owner[b]] - b >= length)
        out = full.copy()
        for at in [*range(0, length - span, span), length - span]:
            i = np.flatnonzero(out)
            out[i] = rank[a[i] + at] == rank[b[i] + at]
        return out

    def common(self, a, b, limit):
        """Length of the common prefix of suffixes, up to ``limit``."""
        import numpy as np

        got = np.zeros(len(a), np.int64)
        last = len(self.text) - 1
        for span, rank in reversed(self.ranks):
            i, j = np.minimum(a + got, last), np.minimum(b + got, last)
            got = np.where((rank[i] == rank[j]) & (got < limit), got + span, got)
        for _ in range(self.ranks[0][0] - 1):
            i, j = np.minimum(a + got, last), np.minimum(b + got, last)
            more = (self.text[i] == self.text[j]) & (self.text[i] > 0) & (got < limit)
            if not more.any():
                break
            got += more
        return np.minimum(got, limit)

    def statistics(self, strings: list[bytes]):
        """Streams strings through the index from their ends, side by side: yields, step by step, the strings that still
        have a byte, the place of that byte, the length of its longest match in the index, and a row that has the match."""
        import numpy as np

        sizes = np.array([len(s) for s in strings])
        data = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 1
        begin = np.cumsum(sizes) - sizes
        row, place, match = np.zeros(len(sizes), np.int64), np.full(len(sizes), self.order[0]), np.zeros(len(sizes), np.int64)
        live = np.argsort(-sizes, kind="stable")
        for t in range(1, int(sizes.max(initial=0)) + 1):
            live = live[: int(np.searchsorted(-sizes[live], -t, side="right"))]
            symbol = data[begin[live] + sizes[live] - t]
            r, p, m = row[live], place[live], match[live]
            at = np.searchsorted(self.run_key, symbol * (self.n + 1) + r, side="right") - 1
            above = self.by_symbol[np.maximum(at, 0)]
            has_above = (at >= 0) & (self.run_symbol[above] == symbol)
            inside = has_above & (r < self.run_end[above])
            jump = np.flatnonzero(~inside)
            if len(jump):
                s, old, limit = symbol[jump], p[jump], m[jump]
                up, ok_up = above[jump], has_above[jump]
                below = np.minimum(at[jump] + 1, len(self.run_key) - 1)
                down = self.by_symbol[below]
                ok_down = (self.run_symbol[down] == s) & (at[jump] + 1 < len(self.run_key))
                left_up = np.where(ok_up, self.common(self.sample_last[up], old, limit), -1)
                left_down = np.where(ok_down, self.common(self.sample_first[down], old, limit), -1)
                go_up = left_up >= left_down
                m[jump] = np.maximum(left_up, left_down)  # -1: the symbol is not in the index
                p[jump] = np.where(go_up, self.sample_last[up], self.sample_first[down])
                r[jump] = np.where(go_up, self.run_end[up] - 1, self.run_start[down])
                at[jump] = np.where(go_up, at[jump], below)
            gone = m < 0
            r = np.where(gone, r, r + self.step[np.maximum(at, 0)])
            row[live], place[live], match[live] = r, np.where(gone, p, p - 1), m + 1
            yield live, sizes[live] - t, match[live], row[live]

    def repeats(self, strings: list[bytes], turns, length: int = LENGTH):
        """String and start of each window that a string of an earlier turn holds."""
        import numpy as np

        earliest = np.minimum.reduceat(turns[self.owner[self.order]], self.interval)
        which, start = [], []
        for k, at, match, row in self.statistics(strings):
            full = np.flatnonzero(match >= length)
            if len(full):
                k, at = k[full], at[full]
                marked = earliest[np.searchsorted(self.interval, row[full], side="right") - 1] < turns[k]
                which.append(k[marked])
                start.append(at[marked])
        if not which:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        which, start = np.concatenate(which), np.concatenate(start)
        order = np.lexsort((start, which))
        return which[order], start[order]


def _occurrences(documents: DataFrame) -> DataFrame:
    """anchor, seg, doc, place: the first occurrence of each segment in each row."""

    def emit(batches):
        import numpy as np
        import pyarrow as pa

        enter("suffixdedup")
        for batch in batches:
            data, starts, ends = raw(batch.column(1))
            found = segments(data, starts, ends)
            found = found[:, _firsts(*found[:3])]
            if found.shape[1]:
                row = found[0]
                docs = np.asarray(batch.column(0), np.int64)
                yield pa.RecordBatch.from_pydict({"anchor": found[1], "seg": found[2], "doc": docs[row], "place": (found[3] - starts[row]).astype(np.int32)})

    return documents.mapInArrow(emit, "anchor long, seg long, doc long, place int")


STRING = "key long, doc long, place int, seg long, start int, body binary, split boolean"


def _strings(documents: DataFrame) -> DataFrame:
    """The strings that a document speaks for, from doc, text, told (place, seg, kind: 1 whole, 2 dealt in blocks)."""

    def emit(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        enter("suffixdedup")
        for batch in batches:
            data, starts, ends = raw(batch.column(1))
            found = segments(data, starts, ends)
            row, place, seg, kind = _lists(batch.column(2), ("place", "seg", "kind"))
            k, fine = _named(row, place, seg, found, starts)
            chosen, kind = k[fine & (kind > 0)], kind[fine & (kind > 0)]
            if not len(chosen):
                continue
            docs, buffer = np.asarray(batch.column(0), np.int64), data.tobytes()
            row, anchor, whole, place, first, last = found[:, chosen]
            key, part, begin, end = anchor, np.arange(len(chosen)), first, last
            if (kind == 2).any():
                keys, parts, begins, ends_ = [], [], [], []
                for i, (a, p, f, e, kd) in enumerate(zip(*(c.tolist() for c in (anchor, place, first, last, kind)))):
                    if kd == 1:
                        keys.append(a), parts.append(i), begins.append(f), ends_.append(e)
                        continue
                    for b in range((p - e) // BLOCK, (p - f) // BLOCK + 1):
                        high = p - b * BLOCK  # last window of the block, of which this segment may hold a part
                        core = buffer[high : high - BLOCK + 1 + LENGTH]
                        name = xxhash.xxh64_intdigest(core, (a + b * BASE) & (1 << 64) - 1)
                        keys.append(name - (1 << 64) if name >> 63 else name)
                        parts.append(i), begins.append(max(f, high - BLOCK + 1)), ends_.append(min(e, high))
                key, part, begin, end = (np.array(c, np.int64) for c in (keys, parts, begins, ends_))
            body = [buffer[f : e + LENGTH] for f, e in zip(begin.tolist(), end.tolist())]
            row, offset = row[part], starts[row[part]]
            yield pa.RecordBatch.from_pydict({
                "key": key, "doc": docs[row], "place": (place[part] - offset).astype(np.int32), "seg": whole[part],
                "start": (begin - offset).astype(np.int32), "body": pa.array(body, pa.binary()), "split": kind[part] == 2,
            })

    return documents.mapInArrow(emit, STRING)


MARK = "doc long, place int, seg long, start int, stop int"


def _mark_lots(strings: DataFrame) -> DataFrame:
    """Removals among the strings of each key, lot by lot."""

    def mark(batches):
        import numpy as np
        import pyarrow as pa

        def flush(lot):
            seen: dict = {}
            bodies, turns, places, out, turn, last = [], [], [], [], 0, None
            for key, doc, place, seg, start, body in lot:  # in order of key, doc, place
                if (key, doc, place) != last:
                    turn, last = turn + 1, (key, doc, place)
                if (first := seen.setdefault((key, body), turn)) == turn and (not places or places[-1] != (doc, place, seg, start)):
                    bodies.append(body), turns.append(turn), places.append((doc, place, seg, start))
                elif first < turn:  # the same string again
                    out.append((doc, place, seg, start, start + len(body)))
            if len(bodies) > 1:
                which, at = RunIndex(bodies).repeats(bodies, np.array(turns))
                if len(which):
                    new = np.concatenate([[True], (np.diff(which) > 0) | (np.diff(at) > LENGTH)])
                    heads = np.flatnonzero(new)
                    tails = np.append(heads[1:], len(which)) - 1
                    for k, a, b in zip(which[heads].tolist(), at[heads].tolist(), at[tails].tolist()):
                        doc, place, seg, start = places[k]
                        out.append((doc, place, seg, start + a, start + b + LENGTH))
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc", "place", "seg", "start", "stop"])

        enter("suffixdedup")
        lot, size, current = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= LOT_BYTES and row[0] != current:
                    yield flush(lot)
                    lot, size = [], 0
                current = row[0]
                lot.append(row)
                size += len(row[5]) + 1
        if lot:
            yield flush(lot)

    ordered = strings.repartition("key").sortWithinPartitions("key", "doc", "place", "start")
    return ordered.select("key", "doc", "place", "seg", "start", "body").mapInArrow(mark, MARK)


def _distinct_blocks(strings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of strings dealt in blocks: those that no smaller document has, and removals of the others."""
    keyed = strings.withColumn("b1", F.xxhash64("body")).withColumn("b2", F.xxhash64(F.lit(7), "body"))
    holders = keyed.groupBy("key", "b1", "b2").agg(F.min("doc").alias("holder"))
    keyed = keyed.join(holders, ["key", "b1", "b2"])
    stop = (F.col("start") + F.octet_length("body")).alias("stop")
    return keyed.where("doc = holder").select(*strings.columns), keyed.where("doc > holder").select("doc", "place", "seg", "start", stop)


def removals(documents: DataFrame, *, id_column="doc_id", text_column="text", split: int = SPLIT) -> DataFrame:
    """``doc_id``, n_bytes, spans (merged removals, starts and stops in bytes), kept (the remaining bytes)."""
    bound_batches(documents.sparkSession)
    with Workspace(documents.sparkSession) as work:
        return _removals(work, documents, id_column, text_column, split)


def _removals(work: Workspace, documents: DataFrame, id_column: str, text_column: str, split: int) -> DataFrame:
    docs = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(id_column).cast("long"), F.lit(LAST)).alias("doc"), F.col(text_column).alias("text"))
    occ = materialize(_occurrences(docs.select("doc", "text")), "repeat-anchors")
    by_anchor = occ.groupBy("anchor").agg(F.min("seg").alias("low"), F.max("seg").alias("high"), F.min("doc").alias("least"), F.count("*").alias("n")).where("n > 1")
    telling = materialize(by_anchor.select("anchor", F.expr(f"case when low = high then 0 when n <= {split} then 1 else 2 end").alias("kind"), "least"), "repeat-telling")
    told = materialize(occ.join(telling, "anchor"), "repeat-told")
    drop(occ)
    drop(telling)
    several = told.where("kind > 0")
    holders = several.groupBy("anchor", "seg").agg(F.min("doc").alias("holder"))
    several = several.join(holders, ["anchor", "seg"]).select("doc", "place", "seg", F.expr("if(doc = holder, kind, 0)").alias("kind"))
    # one string: the first document keeps it; if several rows have its id, the lots tell their places apart
    single = told.where("kind = 0").select("doc", "place", "seg", F.expr("if(doc = least, 1, 0)").alias("kind"))
    repeated = materialize(docs.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc"), "repeat-ids")
    shared = single.where("kind = 0").unionAll(single.where("kind = 1").join(repeated, "doc", "left_semi"))
    entry = F.struct("place", "seg", F.col("kind").cast("tinyint").alias("kind"))
    lists = materialize(several.unionAll(shared).groupBy("doc").agg(F.collect_list(entry).alias("told")), "repeat-lists")
    drop(told)
    speaking = lists.where("exists(told, x -> x.kind > 0)").select("doc", F.expr("filter(told, x -> x.kind > 0)").alias("told"))
    strings = materialize(_strings(docs.select("doc", "text").join(speaking.hint("merge"), "doc").select("doc", "text", "told")), "repeat-strings")
    blocks, copies = _distinct_blocks(strings.where("split"))
    marks = _mark_lots(strings.where("not split").unionAll(blocks)).unionAll(copies)
    marked = marks.groupBy("doc").agg(F.collect_list(F.struct("place", "seg", "start", "stop")).alias("marked"))
    marked = materialize(marked, "repeat-marked")
    work.keep(lists, marked)
    gone = lists.select("doc", F.expr("filter(told, x -> x.kind = 0)").alias("gone")).join(marked, "doc", "full")
    joined = docs.join(gone.hint("merge"), "doc", "left").select("doc_id", "text", "gone", "marked")
    return joined.mapInArrow(_cut, "doc_id long, n_bytes long, spans array<struct<start:int,stop:int>>, kept binary")


def _cut(batches):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        if not batch.num_rows:
            continue
        data, starts, ends = raw(batch.column(1))
        base, total = int(starts[0]), int(ends[-1] - starts[0])
        found = segments(data, starts, ends)
        again = np.flatnonzero(~_firsts(*found[:3]))
        row, place, seg = _lists(batch.column(2), ("place", "seg"))
        k, fine = _named(row, place, seg, found, starts)
        whole = np.concatenate([again, k[fine]])
        row, place, seg, start, stop = _lists(batch.column(3), ("place", "seg", "start", "stop"))
        _, fine = _named(row, place, seg, found, starts)
        row, start, stop = row[fine], start[fine], stop[fine]
        opens = np.concatenate([found[4][whole], starts[row] + start]) - base
        closes = np.concatenate([found[5][whole] + LENGTH, starts[row] + stop]) - base
        cover = np.cumsum(np.bincount(opens, minlength=total + 1) - np.bincount(closes, minlength=total + 1))[:total] > 0
        # spans end with their text
        head, tail = cover.copy(), cover.copy()
        head[1:] &= ~cover[:-1]
        tail[:-1] &= ~cover[1:]
        inner = starts[1:][starts[1:] < ends[-1]] - base
        inner = inner[inner > 0]
        head[inner] = cover[inner]
        tail[inner - 1] = cover[inner - 1]
        head, tail = np.flatnonzero(head), np.flatnonzero(tail) + 1
        owner = np.searchsorted(ends - base, head, side="right")
        offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(starts)))]).astype(np.int32)
        spans = pa.StructArray.from_arrays([pa.array((x - starts[owner] + base).astype(np.int32)) for x in (head, tail)], names=["start", "stop"])
        left = np.concatenate([[0], np.cumsum(~cover)])
        kept = data[base : base + total][~cover]
        bounds = left[np.concatenate([starts, ends[-1:]]) - base].astype(np.int32)
        kept = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(kept)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ends - starts), pa.ListArray.from_arrays(offsets, spans), kept], names=["doc_id", "n_bytes", "spans", "kept"])


def op5_repeats(spark, sf_dir: str) -> DataFrame:
    found = removals(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + (x["stop"] - x["start"]).cast("long"))
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[tuple[int, str | None]], length: int = LENGTH) -> list:
    """n_bytes, n_removed, n_spans, kept bytes of each (id, text), by a table of all windows."""
    earliest: dict[bytes, tuple[int, int]] = {}
    rows = [(doc, (text or "").encode("utf-8", "replace")) for doc, text in texts]
    for doc, data in rows:
        for s in range(len(data) - length + 1):
            window = data[s : s + length]
            earliest[window] = min(earliest.get(window, (doc, s)), (doc, s))
    out = []
    for doc, data in rows:
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            if earliest[data[s : s + length]] < (doc, s):
                gone[s : s + length] = b"\1" * length
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(data), sum(gone), runs, bytes(b for b, g in zip(data, gone) if not g)))
    return out
