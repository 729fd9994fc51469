"""Token ids in binary files: one concatenated id array per file, document boundaries in Elias-Fano form.

A file holds documents in ascending id order. Both of its ascending sequences, the boundaries in the id array and the document
ids, are Elias-Fano coded: about 2 + log2(range / n) bits each, with a sampled select structure, so that offsets number a to b are
read from the bits between two samples, without a table of all numbers. Layout, little-endian: the header (see HEADER), the boundaries, the document ids, the
token ids (16 bits each where all ids fit, else 32).

Files are written by Spark tasks, into the shared folder or one given, through pyarrow's file systems: under a temporary name
first, then moved, so that a repeated or doubled task leaves one whole file. A manifest has each file's documents and ids;
running totals of it give each file's first id number. One task holds one file's documents at a time, at most about
``IDS_PER_FILE`` ids and one text more. Rows are dealt by ranges of (id, text's hash, place), so that an id with a third of all
rows is spread over tasks and files, still in ascending order.

Defined cases: a null text counts as empty (only the end id); null document ids come first (their number is in the header);
repeated ids keep their rows, ordered by the text's hash; an empty table writes no file; extra columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_dir, settled, starts
from .tokenize import encoder, tokenizer_path

MAGIC = b"EFTK0001"
#: magic, bytes per id, null document ids, smallest document id, documents, ids; then the two Elias-Fano parts and the ids.
HEADER = struct.Struct("<8sIIqQQ")
PART = struct.Struct("<QQI")
IDS_PER_FILE = 1 << 22
#: The most files that one reading task opens, one after the other.
FILES_PER_TASK = 16
#: A select sample for each so many values.
SAMPLE = 256


def _bits(data: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[:count]


class EliasFano:
    """An ascending sequence of numbers from 0: low bits packed, high bits in unary, one select sample for SAMPLE values."""

    def __init__(self, n: int, top: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.top, self.low_bits, self.low, self.high, self.samples = n, top, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = b""
        if low_bits:
            wide = (v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
            low = np.packbits(wide.astype(np.uint8).ravel(), bitorder="little").tobytes()
        at = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        high[at] = 1
        return cls(n, top, low_bits, low, np.packbits(high, bitorder="little").tobytes(), at[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        return PART.pack(self.n, self.top, self.low_bits) + struct.pack("<III", len(self.low), len(self.high), len(self.samples)) + self.low + self.high + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, top, low_bits = PART.unpack_from(data, at)
        a, b, c = struct.unpack_from("<III", data, at + PART.size)
        at += PART.size + 12
        out = cls(n, top, low_bits, bytes(data[at : at + a]), bytes(data[at + a : at + a + b]), np.frombuffer(data[at + a + b : at + a + b + 4 * c], "<u4"))
        return out, at + a + b + 4 * c

    def selects(self, a: int, b: int) -> np.ndarray:
        """Values number a to b (exclusive), from the sample before a on; only the bits up to the sample after b are looked at."""
        a, b = max(a, 0), min(b, self.n)
        if a >= b:
            return np.zeros(0, np.uint64)
        first, after = a // SAMPLE, -(-b // SAMPLE)
        begin = int(self.samples[first])
        end = int(self.samples[after]) if after < len(self.samples) else 8 * len(self.high)
        window = _bits(self.high[begin >> 3 : -(-end >> 3)], 8 * len(self.high))
        window[: begin & 7] = 0
        at = np.flatnonzero(window)[a - first * SAMPLE : b - first * SAMPLE] + (begin >> 3 << 3)
        out = (at - np.arange(a, b)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            begin, end = a * self.low_bits, b * self.low_bits
            wide = _bits(self.low[begin >> 3 : -(-end >> 3)], end - (begin >> 3 << 3))[begin & 7 :]
            out |= (wide.reshape(b - a, self.low_bits).astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return out

    def select(self, i: int) -> int:
        """Value number i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.selects(i, i + 1)[0])


def pack_file(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """The file's bytes. ``ids``: little-endian unsigned 32-bit ids of each document; doc_ids ascending, nulls first."""
    whole = np.frombuffer(b"".join(ids), "<u4")
    width = 2 if not len(whole) or whole.max() < 1 << 16 else 4
    nulls = sum(x is None for x in doc_ids)
    least = doc_ids[nulls] if nulls < len(doc_ids) else 0
    names = EliasFano.of(np.array([x - least for x in doc_ids[nulls:]], np.uint64))
    ends = EliasFano.of(np.cumsum([len(x) // 4 for x in ids], dtype=np.uint64))
    head = HEADER.pack(MAGIC, width, nulls, least, len(doc_ids), len(whole))
    return head + ends.to_bytes() + names.to_bytes() + whole.astype("<u2" if width == 2 else "<u4").tobytes()


class TokenFile:
    """A file's documents, for reading by position."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        magic, width, nulls, least, self.n_docs, self.n_ids = HEADER.unpack_from(view)
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.ends, at = EliasFano.from_bytes(view, HEADER.size)
        self.names, at = EliasFano.from_bytes(view, at)
        self.nulls, self.least = nulls, least
        self.ids = np.frombuffer(view[at:], "<u2" if width == 2 else "<u4")

    def spans(self, a: int, b: int) -> np.ndarray:
        """The offsets of documents a to b (exclusive): where each begins, and where the last ends."""
        before = self.ends.selects(a - 1, b).astype(np.int64)
        return before if a else np.concatenate([[0], before])

    def doc_ids(self, a: int, b: int) -> list[int | None]:
        named = self.names.selects(a - self.nulls, b - self.nulls)
        return [None] * (b - a - len(named)) + [int(x) + self.least for x in named]

    def document(self, i: int) -> np.ndarray:
        begin, end = self.spans(i, i + 1).tolist()
        return self.ids[begin:end]


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")


def _put(system, folder: str, name: str, data: bytes) -> str:
    system.create_dir(folder, recursive=True)
    temporary, final = f"{folder}/.{name}.{uuid.uuid4().hex}", f"{folder}/{name}"
    with system.open_output_stream(temporary) as out:
        out.write(data)
    try:
        system.move(temporary, final)
    except OSError:  # some stores don't move onto a file: another attempt has left the same one
        system.delete_file(temporary)
    return final


MANIFEST = "file string, part long, docs long, ids long"


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files of ``docs`` below ``folder``; returns the manifest, settled: file, part (ascending), docs, ids."""
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def write_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), []
        encode, (system, root) = encoder(tokenizer, True).encode, _files(folder)
        names: list[int | None] = []
        ids: list[bytes] = []
        held = 0

        def flush() -> None:
            nonlocal held
            if names:
                number = (part << 20) + len(made)
                made.append((_put(system, root, f"{number:012x}.eft", pack_file(names, ids)), number, len(names), held // 4))
                names.clear()
                ids.clear()
                held = 0

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                for name, own in zip(some.column(0).to_pylist(), encode([t or "" for t in some.column(1).to_pylist()])):
                    names.append(name)
                    ids.append(own + end)
                    held += len(own) + len(end)
                    if held >= 4 * IDS_PER_FILE:
                        flush()
        flush()
        files, numbers, n_docs, n_ids = zip(*made) if made else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), *[pa.array(x, pa.int64()) for x in (numbers, n_docs, n_ids)]], names=["file", "part", "docs", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"), F.monotonically_increasing_id().alias("place"))
    dealt = rows.repartitionByRange("id", "hash", "place").sortWithinPartitions("id", "hash").select("id", "text")
    return settled(dealt.mapInArrow(write_part, MANIFEST))


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document of the files: doc_id, start (ids before it, in all files), ids (unsigned 32-bit, as bytes)."""

    def read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _files(folder)
        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with system.open_input_file(file) as source:
                    held = TokenFile(source.read())
                for at in range(0, held.n_docs, 512):
                    after = min(at + 512, held.n_docs)
                    offsets = held.spans(at, after)
                    ids = [held.ids[x:y].astype("<u4").tobytes() for x, y in zip(offsets, offsets[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(held.doc_ids(at, after), pa.int64()), pa.array(offsets[:-1] + base), pa.array(ids, pa.binary())], names=["doc_id", "start", "ids"])

    based = settled(_with_base(manifest).select("file", "base"))
    files, cores = based.count(), manifest.sparkSession.sparkContext.defaultParallelism
    # a number of partitions that is asked for isn't coalesced: names are small, files aren't
    return based.repartition(max(1, min(files, max(4 * cores, -(-files // FILES_PER_TASK))))).mapInArrow(read_files, "doc_id long, start long, ids binary")


def _with_base(manifest: DataFrame) -> DataFrame:
    """base: the ids of all files before. A part number is the task's number and the file's number in it, 20 bits."""
    tasks = manifest.groupBy(F.expr("part >> 20").alias("task")).agg(F.sum("ids").alias("task_ids"))
    tasks = starts(tasks.withColumn("all", F.lit(0)), ["all"], "task", "task_ids", "task_base").select("task", "task_base")
    files = manifest.withColumn("task", F.expr("part >> 20")).withColumn("number", F.expr("part & 1048575"))
    files = starts(files, ["task"], "number", "ids", "file_base")
    return files.join(tasks, "task").withColumn("base", F.col("task_base") + F.col("file_base"))


def round_trip(docs: DataFrame, tokenizer: str | None = None, end_id: int | None = 0, folder: str | None = None, **columns) -> DataFrame:
    """Writes the files and reads them back."""
    folder = folder or new_dir(docs.sparkSession, "token-files")
    manifest = write(docs, folder, tokenizer or tokenizer_path("byte_bpe_50k.json"), end_id, **columns)
    return read(manifest, folder)
