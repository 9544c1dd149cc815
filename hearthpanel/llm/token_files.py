"""Token ids on disk as independent zstandard frames with a trailing seek table.

A file is a run of zstandard frames, each holding the little-endian unsigned
32-bit ids of one or more whole documents, then two frames that decoders skip:

* the index: one byte per document that is 1 where its id is null, the signed
  64-bit document ids, the unsigned 64-bit ends of the documents counted in ids
  from the start of the file, the number of documents, the size of this payload;
* the seek table of the public seekable zstandard format: compressed size,
  size, and checksum (low half of the 64-bit xxhash) of every frame, then the
  number of frames, the descriptor and the magic number.

A reader fetches the tail, then only the frames that hold what it asks for.
"""

from __future__ import annotations

import itertools
import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthpanel.llm.common import chunks, new_folder, store
from hearthpanel.llm.tokens import encoder

# Fixed values of the public formats.
SKIPPABLE = 0x184D2A50
SEEK_TABLE = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
CHECKSUMS = 0x80
#: A frame is closed once it holds this many ids.
FRAME_IDS = 16_384
MANIFEST = "part int, file string, n_docs long, n_ids long, n_frames long, n_bytes long"
TOKENS = "doc_id long, start long, ids binary, file string, frame long"


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


class Writer:
    """Writes one file, a frame at a time."""

    def __init__(self, sink, level: int = 3):
        self.sink = sink
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.waiting: list[bytes] = []
        self.frames: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.ends: list[int] = []
        self.held = self.written = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.waiting.append(ids)
        self.held += len(ids) // 4
        self.ids.append(doc_id)
        self.ends.append((self.ends[-1] if self.ends else 0) + len(ids) // 4)
        if self.held >= FRAME_IDS:
            self._flush()

    def _write(self, data: bytes) -> None:
        self.sink.write(data)
        self.written += len(data)

    def _flush(self) -> None:
        if self.waiting:
            raw = b"".join(self.waiting)
            packed = self.zstd.compress(raw)
            self._write(packed)
            self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.waiting, self.held = [], 0

    def close(self) -> None:
        self._flush()
        null = bytes(x is None for x in self.ids)
        index = null + np.array([x or 0 for x in self.ids], "<i8").tobytes() + np.array(self.ends, "<u8").tobytes()
        index += struct.pack("<QQ", len(self.ids), len(index) + 16)
        self._write(struct.pack("<II", SKIPPABLE, len(index)) + index)
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEK_MAGIC)
        self._write(struct.pack("<II", SEEK_TABLE, len(table)) + table)


def read_file(uri: str, wanted: Iterable[int | None] | None = None) -> Iterator[tuple[int | None, int, bytes, int]]:
    """(doc_id, start in the file, ids, frame) of the wanted documents, or of all, one frame in memory at a time."""
    files, path = _open(uri)
    with files.open_input_file(path) as source:
        end = source.size()
        n_frames, flags, magic = struct.unpack("<IBI", source.read_at(9, end - 9))
        if magic != SEEK_MAGIC or flags != CHECKSUMS:
            raise ValueError(f"{uri} has no seek table with checksums")
        at = end - 9 - 12 * n_frames
        table = np.frombuffer(source.read_at(12 * n_frames, at), "<u4").reshape(-1, 3).astype(np.int64)
        at -= 8
        n, size = struct.unpack("<QQ", source.read_at(16, at - 16))
        index = source.read_at(size, at - size)
        null = np.frombuffer(index, np.uint8, n)
        ids = np.frombuffer(index, "<i8", n, n)
        ends = np.frombuffer(index, "<u8", n, 9 * n).astype(np.int64)
        starts = np.concatenate([[0], ends[:-1]]) if n else ends
        first = np.concatenate([[0], np.cumsum(table[:, 1]) // 4])
        places = np.concatenate([[0], np.cumsum(table[:, 0])])
        # A frame holds whole documents and is closed after one that is never empty of ids, so an empty one opens the next.
        frame = np.minimum(np.searchsorted(first, starts, side="right") - 1, max(0, n_frames - 1))
        keep = None if wanted is None else set(wanted)
        zstd = zstandard.ZstdDecompressor()
        opened, raw = -1, b""
        for i in range(n):
            doc = None if null[i] else int(ids[i])
            if keep is not None and doc not in keep:
                continue
            if (f := int(frame[i])) != opened:
                raw = zstd.decompress(source.read_at(int(table[f, 0]), int(places[f])), max_output_size=int(table[f, 1]))
                if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != table[f, 2]:
                    raise ValueError(f"frame {f} of {uri} is damaged")
                opened = f
            a, b = 4 * (int(starts[i]) - int(first[f])), 4 * (int(ends[i]) - int(first[f]))
            yield doc, int(starts[i]), raw[a:b], f


def write_tokens(docs: DataFrame, folder: str, *, tokenizer: str, end_id: int) -> DataFrame:
    """Encode ``docs`` (doc_id, text) in ascending doc_id order into one file per partition; returns the manifest.

    Null texts count as empty; null ids come first; rows with equal ids are
    ordered by their text. An empty table gives no file. Other columns are not
    read. A task writes under a name of its own and moves the file when it is
    whole, and the stored manifest names the file of the attempt that counted,
    so a lost executor leaves at most a file that nothing refers to.
    """
    placed = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = chunks(batches)
        head = next(pieces, None)
        if head is None:
            return
        part = TaskContext.get().partitionId()
        files, root = _open(folder)
        files.create_dir(root, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.zst"
        end = np.array([end_id], "<u4").tobytes()
        with files.open_output_stream(f"{root}/.{name}", compression=None) as sink:
            out = Writer(sink)
            for piece in itertools.chain([head], pieces):
                ids = encoder(tokenizer).encode(piece.column("text"))
                for doc, row in zip(piece.column("doc_id").to_pylist(), ids):
                    out.add(doc, row + end)
            out.close()
        files.move(f"{root}/.{name}", f"{root}/{name}")
        row = [part, f"{folder}/{name}", len(out.ids), out.ends[-1], len(out.frames), out.written]
        yield pa.RecordBatch.from_arrays(
            [pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.string(), *[pa.int64()] * 4))],
            ["part", "file", "n_docs", "n_ids", "n_frames", "n_bytes"],
        )

    return store(placed.mapInArrow(write, MANIFEST), "token-manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Every document of the files of a manifest: doc_id, start (ids of all documents before it), ids, file, frame.

    The manifest has one row per file, so the running total over files is small.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    listed = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "ids", "file", "frame"]
        types = [pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64()]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for files in batches:
            for uri, base in zip(files.column("file").to_pylist(), files.column("base").to_pylist()):
                rows, size = [], 0
                for doc, start, ids, frame in read_file(uri):
                    rows.append((doc, base + start, ids, uri, frame))
                    size += len(ids) + 64
                    if size > 4 << 20:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    return listed.repartition(max(1, manifest.count())).mapInArrow(read, TOKENS)


def token_files(docs: DataFrame, *, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    """Write ``docs`` to token files in a new shared folder and read them back."""
    return read_tokens(write_tokens(docs, new_folder(docs.sparkSession, "tokens"), tokenizer=tokenizer, end_id=end_id))
