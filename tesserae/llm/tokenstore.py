"""Token ids in files of independent zstandard frames with a trailing seek table.

A file is: one zstandard frame for each run of whole documents (about FRAME_BYTES of ids,
more for a long document), then a skippable frame with the document table (id, number of
ids, and how many documents without an id come first), then a skippable frame in the public seekable format: for each frame the compressed
and the decompressed size and the low 32 bits of the XXH64 of its content, the number of
frames, a descriptor and the magic number 0x8F92EAB1. Any zstandard tool can decompress a
file; a reader needs the two tables and only the frames of the documents asked for.

Files are written by tasks over ranges of doc_id to a temporary name and renamed, so a
task that is run again replaces its file by an equal one.

Edge cases: null text counts as empty and has only the end id; null ids sort first and
share a file; repeated rows are stored as often as they come; an empty table writes no
file and returns no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession

from . import bpe
from .common import file_system, shared_path, texts

FRAME_BYTES = 64 * 1024
LEVEL = 1
SKIP_DOCS, SKIP_SEEK, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1


class Writer:
    """Appends documents to a binary stream; close() writes the tables."""

    def __init__(self, out, dtype: np.dtype):
        self.out, self.dtype = out, np.dtype(dtype)
        self.pending: list[bytes] = []
        self.size = 0
        self.docs: list[tuple[int, int]] = []
        self.nulls = 0  # documents without an id, which come first
        self.frames: list[tuple[int, int, int]] = []
        self.packer = zstandard.ZstdCompressor(level=LEVEL)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.pending and self.size + len(ids) > FRAME_BYTES:
            self.flush()
        self.pending.append(ids)
        self.size += len(ids)
        if doc_id is None and self.nulls < len(self.docs):
            raise ValueError("documents without an id come first")
        self.nulls += doc_id is None
        self.docs.append((doc_id or 0, len(ids) // self.dtype.itemsize))

    def flush(self) -> None:
        if self.pending:
            raw = b"".join(self.pending)
            packed = self.packer.compress(raw)
            self.out.write(packed)
            self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.pending, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = zstandard.ZstdCompressor(level=LEVEL).compress(struct.pack("<BQQ", self.dtype.itemsize, len(self.docs), self.nulls) + np.array(self.docs, "<i8").reshape(-1, 2).T.tobytes())
        table = struct.pack("<I", zlib.crc32(table)) + table
        self.out.write(struct.pack("<II", SKIP_DOCS, len(table)) + table)
        seek = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIP_SEEK, len(seek)) + seek)


@dataclass
class Span:
    doc_id: int | None
    frame: int
    first: int
    length: int
    before: int


class Reader:
    """Reads documents from a seekable file; only their frames are decompressed."""

    def __init__(self, source):
        self.source = source
        size = source.seek(0, 2) or source.tell()
        source.seek(size - 9)
        count, descriptor, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_MAGIC or descriptor != 0x80:
            raise ValueError("no seek table at the end of the file")
        begin = size - 9 - 12 * count - 8
        source.seek(begin)
        head, length = struct.unpack("<II", source.read(8))
        if head != SKIP_SEEK or length != 12 * count + 9:
            raise ValueError("the seek table is damaged")
        self.frames = np.frombuffer(source.read(12 * count), "<u4").reshape(-1, 3)
        self.at = np.concatenate([[0], np.cumsum(self.frames[:, 0].astype(np.int64))])
        source.seek(int(self.at[-1]))
        head, length = struct.unpack("<II", source.read(8))
        table = source.read(length)
        if head != SKIP_DOCS or zlib.crc32(table[4:]) != struct.unpack("<I", table[:4])[0]:
            raise ValueError("the document table is damaged")
        raw = zstandard.ZstdDecompressor().decompress(table[4:])
        width, docs, self.nulls = struct.unpack("<BQQ", raw[:17])
        self.dtype = np.dtype(f"<u{width}")
        self.ids, self.lengths = np.frombuffer(raw[17:], "<i8").reshape(2, docs)

    def frame(self, k: int) -> np.ndarray:
        packed, plain, check = (int(x) for x in self.frames[k])
        self.source.seek(int(self.at[k]))
        raw = zstandard.ZstdDecompressor().decompress(self.source.read(packed), max_output_size=plain)
        if len(raw) != plain or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(raw, self.dtype)

    def spans(self) -> list[Span]:
        out, k, used, before = [], 0, 0, 0
        for at, (i, n) in enumerate(zip(self.ids.tolist(), self.lengths.tolist(), strict=True)):
            while used + n > int(self.frames[k][1]) // self.dtype.itemsize:
                k, used = k + 1, 0
            out.append(Span(None if at < self.nulls else i, k, used, n, before))
            used += n
            before += n
        return out

    def read(self, spans: Iterable[Span]) -> Iterator[tuple[Span, np.ndarray]]:
        last, data = -1, np.zeros(0, self.dtype)
        for s in spans:
            if s.frame != last:
                last, data = s.frame, self.frame(s.frame)
            yield s, data[s.first : s.first + s.length]


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 0) -> list[tuple[str, int, int]]:
    """Writes docs in ascending doc_id order; returns name, documents and ids of each file, in that order."""
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}.zst"
        fs, base = file_system(folder)
        out, writer, total, temporary = None, None, 0, f"{base}/.{name}-{context.taskAttemptId()}"
        encoder = None
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                encoder = bpe.encoder(path)
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(temporary)
                writer = Writer(out, encoder.dtype)
            end = np.array([end_id], encoder.dtype).tobytes()
            ids, all_texts = b.column(0).to_pylist(), texts(b.column(1))
            for at in range(0, len(ids), 500):
                for i, x in zip(ids[at : at + 500], encoder.encode(all_texts[at : at + 500]), strict=True):
                    writer.add(i, x + end)
                    total += len(x) // encoder.dtype.itemsize + 1
        if out is not None:
            writer.close()
            out.close()
            fs.move(temporary, f"{base}/{name}")
            yield pa.RecordBatch.from_pydict({"name": pa.array([name]), "n_docs": pa.array([len(writer.docs)], pa.int64()), "n_ids": pa.array([total], pa.int64())})

    # one row for each file
    return sorted(tuple(r) for r in ordered.mapInArrow(run, "name string, n_docs long, n_ids long").collect())


def read(spark: SparkSession, folder: str, files: list[tuple[str, int, int]]) -> DataFrame:
    """Every document of the files: doc_id, start over all files, n_tokens, ids_crc32 and file."""
    rows, before = [], 0
    for name, _, n in files:
        rows.append((name, before))
        before += n
    out = "doc_id long, start long, n_tokens long, ids_crc32 long, file string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        for b in batches:
            for name, start in zip(*[c.to_pylist() for c in b.columns], strict=True):
                with fs.open_input_file(f"{base}/{name}") as f:
                    reader = Reader(f)
                    found = [(s.doc_id, start + s.before, s.length, zlib.crc32(ids.astype("<u4").tobytes()), name) for s, ids in reader.read(reader.spans())]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found, strict=True), kinds, strict=True)], names=[c.split()[0] for c in out.split(", ")])

    named = spark.createDataFrame(rows, "name string, start long")
    return named.repartition(max(1, len(rows))).mapInArrow(run, out)


def fetch(spark: SparkSession, folder: str, name: str, wanted: set[int]) -> dict[int, np.ndarray]:
    """Ids of some documents of one file; only their frames are read."""
    fs, base = file_system(folder)
    with fs.open_input_file(f"{base}/{name}") as f:
        reader = Reader(f)
        return {s.doc_id: ids.copy() for s, ids in reader.read(s for s in reader.spans() if s.doc_id in wanted)}


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    folder = shared_path(docs.sparkSession, "tokens")
    return read(docs.sparkSession, folder, write(docs, folder, path))
