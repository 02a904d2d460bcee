"""Token-ID files: independent zstandard frames with a trailing seek table and per-frame checksums.

A file is a sequence of zstandard frames, one for each document (its ids as little-endian unsigned 32-bit integers), a
skippable frame with the document ids, and the seek table of the public seekable zstandard format (a skippable frame:
compressed size, size and low 32 bits of XXH64 for each frame, then a 9-byte footer). A reader fetches footer, table and
document ids, then only the byte ranges of the frames it wants.

Writing range-partitions the documents by id, so the files in order hold ascending ids; each task writes its own file
under a name that holds the task attempt, and only the files named by committed rows exist for readers. A lost executor
or a second attempt leaves at worst an unreferenced file.

Text is cut where the tokenizer's pattern always cuts and each distinct cut is encoded once by the ``tokenizers`` library
and kept in a bounded table. Where no two white-space characters meet, that is before each of them (a blank stays with
the word after it). Other texts are cut by the whole pattern, or, if they hold characters whose class depends on the
Unicode version, given to the library whole, as are texts with a special token. All ways give the same ids.

Defined results: a null text is encoded as the empty text; null ids come first and are kept as null; repeated rows are
written as often as they occur, ties ordered by a hash of the text; an empty table writes no files and reads back empty.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import BATCH_BYTES, bound_batches, cache, enter, materialize, new_path, release

END_ID = 0
LEVEL = 1
#: Fixed values of the seekable zstandard format.
SEEK_MAGIC, SEEK_FOOTER_MAGIC, SKIPPABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
#: Fixed values of the vocabulary file: the split pattern, with its white space written out.
SPACE = r"\t-\r " + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
PIECES = rf"'(?:s|t|re|ve|m|ll|d)| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Characters outside these ranges may be classed differently by two Unicode versions.
RANGES = ((0x00, 0x377), (0x391, 0x3A1), (0x3A3, 0x481), (0x48A, 0x527), (0x2000, 0x2044), (0x20A0, 0x20B9), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FCB), (0xAC00, 0xD7A3))
SETTLED = "[^" + "".join(f"{chr(a)}-{chr(b)}" for a, b in RANGES) + "]"
#: White space to Python, not to the tokenizer.
SEPARATORS = "\x1c\x1d\x1e\x1f"
TABLE_PIECES, PIECE_CHARS = 1_400_000, 48
#: New pieces that are encoded as lines of one text.
LINES = 256

FILE_SCHEMA = "part int, path string, docs long, ids long"
ROW_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


class Encoder:
    """Text to the bytes of its ids."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import re

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split = regex.compile(PIECES).findall
        # letters up to a mark or white space, other runs up to white space, a single white-space character before a
        # word; all ends are ends of the tokenizer's pieces, and what is skipped tells the texts that need the pattern
        self.cut = re.compile(r" ?[^\W\d_]+(?=[\s.,;:!?|])| ?\S+|[^\S ](?=\S)").findall
        self.unsettled = re.compile(SETTLED).search
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        (self.line,) = self.tokenizer.encode("\n", add_special_tokens=False).ids

    def _library(self, texts: list[str]) -> list[bytes]:
        from array import array

        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece. Pieces that are no white space stand in lines of one text, as the tokenizer's pattern cuts
        before and after a line end there: the library's work for a text is done once for many pieces."""
        import numpy as np

        if any("\n" in p or p.isspace() for p in pieces):
            plain = [p for p in pieces if "\n" not in p and not p.isspace()]
            odd = [p for p in pieces if "\n" in p or p.isspace()]
            known = dict(zip([*plain, *odd], [*self._pieces(plain), *self._library(odd)]))
            return [known[p] for p in pieces]
        out: list[bytes] = []
        for at, ids in zip(range(0, len(pieces), LINES), self._library(["\n".join(pieces[a : a + LINES]) for a in range(0, len(pieces), LINES)])):
            ends = np.flatnonzero(np.frombuffer(ids, np.uint32) == self.line).tolist()
            some = pieces[at : at + LINES]
            if len(ends) != len(some) - 1:  # an unknown tokenizer file may join lines
                out += self._library(some)
                continue
            out += [ids[4 * a : 4 * b] for a, b in zip([0, *[e + 1 for e in ends]], [*ends, len(ids) // 4])]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        table, out, open_cells, new = self.known, [None] * len(texts), [], set()
        if len(table) > TABLE_PIECES:
            table.clear()
        for k, text in enumerate(texts):
            if any(s in text for s in self.special):
                out[k] = self._library([text])[0]
                continue
            pieces = self.cut(text)
            if sum(map(len, pieces)) != len(text) or any(c in text for c in SEPARATORS):
                if not text.isascii() and self.unsettled(text):
                    out[k] = self._library([text])[0]
                    continue
                pieces = self.split(text)
            ids = list(map(table.get, pieces))
            if None in ids:
                holes = [i for i, v in enumerate(ids) if v is None]
                new.update([pieces[i] for i in holes])
                open_cells.append((k, pieces, ids, holes))
            else:
                out[k] = b"".join(ids)
        new = list(new)
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            table.update(zip(some, self._pieces(some)))
        for k, pieces, ids, holes in open_cells:
            for i in holes:
                ids[i] = table[pieces[i]]
            out[k] = b"".join(ids)
        for p in new:
            if len(p) > PIECE_CHARS:
                del table[p]
        return out


_encoders: dict[str, Encoder] = cache()


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class FrameWriter:
    """Writes one token-ID file to an open binary stream."""

    def __init__(self, stream, level: int = LEVEL):
        import zstandard

        self.stream, self.compress = stream, zstandard.ZstdCompressor(level=level, write_content_size=True).compress
        self.entries: list[bytes] = []
        self.doc_ids: list[int | None] = []
        self.ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        import xxhash

        frame = self.compress(ids)
        self.stream.write(frame)
        self.entries.append(struct.pack("<III", len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.doc_ids.append(doc_id)
        self.ids += len(ids) // 4

    def close(self) -> None:
        names = bytes(d is None for d in self.doc_ids) + struct.pack(f"<{len(self.doc_ids)}q", *[d or 0 for d in self.doc_ids])
        names = self.compress(names)
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(names)) + names)
        entries = b"".join(self.entries)
        # the document-id frame is listed like any other, with its header, so that frame offsets add up
        entries += struct.pack("<III", len(names) + 8, 0, 0)
        footer = struct.pack("<IBI", len(self.entries) + 1, 0x80, SEEK_FOOTER_MAGIC)
        self.stream.write(struct.pack("<II", SEEK_MAGIC, len(entries) + len(footer)) + entries + footer)


class FrameReader:
    """Random access to a token-ID file; reads the table first, then only what is asked for."""

    def __init__(self, stream, size: int):
        import numpy as np
        import zstandard

        self.stream, self.decompress = stream, zstandard.ZstdDecompressor().decompress
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_FOOTER_MAGIC or flags != 0x80:
            raise ValueError("no seek table")
        table = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), dtype="<u4").reshape(n, 3)
        self.offsets = np.concatenate([[0], np.cumsum(table[:, 0], dtype=np.int64)])
        self.sizes, self.sums = table[:-1, 1], table[:-1, 2]
        names = self.decompress(self._at(int(self.offsets[-2]) + 8, int(table[-1, 0]) - 8))
        self.nulls = np.frombuffer(names, np.bool_, n - 1)
        self.doc_ids = np.frombuffer(names, "<i8", offset=n - 1)

    def _at(self, offset: int, size: int) -> bytes:
        self.stream.seek(offset)
        return self.stream.read(size)

    def __len__(self) -> int:
        return len(self.sizes)

    def frames(self, first: int, last: int) -> Iterator[bytes]:
        """Ids of the documents first..last-1, fetched in one read."""
        import xxhash

        base = int(self.offsets[first])
        block = self._at(base, int(self.offsets[last]) - base)
        for k in range(first, last):
            ids = self.decompress(block[int(self.offsets[k]) - base : int(self.offsets[k + 1]) - base])
            if len(ids) != self.sizes[k] or xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"frame {k} is damaged")
            yield ids

    def find(self, doc_id: int) -> list[bytes]:
        """Ids of each row of one document; other frames stay compressed and unread."""
        import numpy as np

        return [next(self.frames(int(k), int(k) + 1)) for k in np.flatnonzero((self.doc_ids == doc_id) & ~self.nulls)]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_tokens(documents: DataFrame, folder: str | None = None, *, tokenizer: str | None = None, id_column="doc_id", text_column="text") -> DataFrame:
    """Encode and write ``documents``; one row a file, in order: part, path, docs, ids.

    ``folder`` is a URI that driver and executors share; by default a new one under the session's checkpoint folder.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    folder, tokenizer = folder or new_path(spark, "token-files"), tokenizer or default_tokenizer()

    def write(batches):
        from pyspark import TaskContext

        enter("tokens")
        context, writer, stream = TaskContext.get(), None, None
        encode = encoder(tokenizer).encode
        files, root = _filesystem(folder)
        path = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.ids.zst"
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                files.create_dir(root, recursive=True)
                stream = files.open_output_stream(f"{root}/{path}", compression=None)
                writer = FrameWriter(stream)
            at = 0
            while at < batch.num_rows:  # a few MB of text at once
                part = batch.slice(at, 256)
                for doc_id, ids in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()])):
                    writer.add(doc_id, ids + struct.pack("<I", END_ID))
                at += 256
        if writer is not None:
            import pyarrow as pa

            writer.close()
            stream.close()
            release()
            yield pa.RecordBatch.from_pydict({"part": pa.array([context.partitionId()], pa.int32()), "path": [f"{folder}/{path}"], "docs": [len(writer.doc_ids)], "ids": [writer.ids]})

    rows = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.withColumn("tie", tie).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    return materialize(ordered.mapInArrow(write, FILE_SCHEMA), "token-manifest")


def read_tokens(spark: SparkSession, files: DataFrame, doc_ids: list[int] | None = None) -> DataFrame:
    """Rows read from written files: doc_id, start (ids of all earlier documents), n_tokens, ids_crc32.

    With ``doc_ids`` only the frames of those documents are read.
    """
    wanted = None if doc_ids is None else set(doc_ids)

    def read(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            for path, first in zip(batch["path"], batch["before"]):
                system, local = _filesystem(path)
                with system.open_input_file(local) as stream:
                    frames = FrameReader(stream, stream.size())
                    starts = first + np.concatenate([[0], np.cumsum(frames.sizes.astype(np.int64) // 4)])
                    ends = np.cumsum(frames.sizes.astype(np.int64))
                    at = 0
                    while at < len(frames):
                        # frames of BATCH_BYTES as they were before compression, or one
                        until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_BYTES, side="right")))
                        span, at = range(at, until), until
                        if wanted is not None:
                            keep = [k for k in span if not frames.nulls[k] and int(frames.doc_ids[k]) in wanted]
                            sums = [zlib.crc32(next(frames.frames(k, k + 1))) for k in keep]
                        else:
                            keep, sums = list(span), [zlib.crc32(x) for x in frames.frames(span.start, span.stop)]
                        ids = pd.array(frames.doc_ids[keep], dtype="Int64")
                        ids[frames.nulls[keep]] = pd.NA
                        yield pd.DataFrame({"doc_id": ids, "start": starts[keep], "n_tokens": frames.sizes[keep].astype(np.int64) // 4, "ids_crc32": np.array(sums, dtype=np.int64)})

    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    ordered = files.withColumn("before", F.coalesce(F.sum("ids").over(earlier), F.lit(0).cast("long")))
    spread = ordered.select("path", "before").repartition(max(1, min(files.count(), 100_000)))
    return spread.mapInPandas(read, ROW_SCHEMA)


def op10_tokens(spark, sf_dir: str) -> DataFrame:
    files = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return read_tokens(spark, files)
