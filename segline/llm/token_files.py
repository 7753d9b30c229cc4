"""Token-id files: fixed-size blocks of ids, transposed into byte or bit planes, each compressed on its own."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segline.sources.segment_store import opened

from .arrow import batches_of, rows
from .storage import Workspace
from .vocab import encoder

MAGIC, BLOCK, FILE_IDS = b"IDPLANE1", 1 << 16, 1 << 22
_HEAD = struct.Struct("<8sIBxxxQQQ")  # magic, ids in a block, bits of a plane (1 or 8), ids, documents, place of the index


def _planes(ids: np.ndarray, bits: int) -> list[bytes]:
    """A block's planes, lowest first: plane k holds byte (or bit) k of every id."""
    by_byte = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if bits == 8:
        return [np.ascontiguousarray(by_byte[:, k]).tobytes() for k in range(4)]
    every = np.unpackbits(by_byte, axis=1, bitorder="little")
    return [np.packbits(every[:, k], bitorder="little").tobytes() for k in range(32)]


def _from_planes(planes: list[bytes], n: int, bits: int) -> np.ndarray:
    if bits == 8:
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).reshape(-1).view("<u4")
    every = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
    return np.packbits(every, axis=1, bitorder="little").reshape(-1).view("<u4")


def write_image(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, bits: int = 8, level: int = 3) -> bytes:
    """One file: head, compressed planes of each block, then the index.

    Index: size of each plane (blocks x planes), then the documents' ids, whether each has one, and lengths.
    A reader finds any block by adding up sizes, and any id by its block.
    """
    squeeze = zstandard.ZstdCompressor(level=level, write_content_size=True).compress
    body, sizes = [], []
    for at in range(0, len(ids), BLOCK):
        for plane in _planes(ids[at : at + BLOCK], bits):
            body.append(squeeze(plane))
            sizes.append(len(body[-1]))
    named = np.array([d is not None for d in doc_ids], np.uint8)
    index = [np.array(sizes, "<u4"), np.array([d or 0 for d in doc_ids], "<i8"), named, np.array(lengths, "<u4")]
    packed = squeeze(b"".join(x.tobytes() for x in index))
    place = _HEAD.size + sum(sizes)
    return b"".join([_HEAD.pack(MAGIC, BLOCK, bits, len(ids), len(doc_ids), place), *body, packed])


class Image:
    """A file's reader by ranges: the head and the index are read when it is made, a block when it is asked for.

    read(at, n) gives n bytes at a place of a file of so many bytes; `total` counts what was read.
    """

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self._read, self.total = read, 0
        magic, self.block, self.bits, self.n_ids, n_docs, place = _HEAD.unpack(self._bytes(0, _HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        self.per = 32 // self.bits
        self.blocks = -(-self.n_ids // self.block)
        index = zstandard.ZstdDecompressor().decompress(self._bytes(place, size - place))
        at = 4 * self.blocks * self.per
        self.sizes = np.frombuffer(index, "<u4", self.blocks * self.per)
        self.places = _HEAD.size + np.concatenate(([0], np.cumsum(self.sizes, dtype=np.int64)))
        ids, named = np.frombuffer(index, "<i8", n_docs, at), np.frombuffer(index, np.uint8, n_docs, at + 8 * n_docs)
        self.doc_ids = [int(d) if ok else None for d, ok in zip(ids, named, strict=True)]
        self.lengths = np.frombuffer(index, "<u4", n_docs, at + 9 * n_docs)

    @classmethod
    def of(cls, data: bytes) -> Image:
        return cls(lambda at, n: data[at : at + n], len(data))

    @classmethod
    @contextmanager
    def at(cls, address: str) -> Iterator[Image]:
        files, path = opened(address)
        with files.open_input_file(path) as source:
            yield cls(lambda at, n: source.read_at(n, at), source.size())

    def _bytes(self, at: int, n: int) -> bytes:
        self.total += n
        return self._read(int(at), int(n))

    def read_block(self, k: int) -> np.ndarray:
        """One block's ids; its planes lie side by side and are one read."""
        undo = zstandard.ZstdDecompressor().decompress
        first = self.places[k * self.per]
        body = self._bytes(first, self.places[(k + 1) * self.per] - first)
        ends = self.places[k * self.per : (k + 1) * self.per + 1] - first
        planes = [undo(body[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
        return _from_planes(planes, min(self.block, self.n_ids - k * self.block), self.bits)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids from start to stop, from the blocks they lie in alone."""
        if start >= stop:
            return np.empty(0, "<u4")
        a = start // self.block
        found = np.concatenate([self.read_block(k) for k in range(a, -(-stop // self.block))])
        return found[start - a * self.block : stop - a * self.block]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, place in the file, ids; one block after another: memory holds a document and a block."""
        at, k, held = 0, 0, np.empty(0, "<u4")
        for doc, n in zip(self.doc_ids, self.lengths.tolist(), strict=True):
            more = [held]
            have = len(held)
            while have < n:
                more.append(self.read_block(k))
                have, k = have + len(more[-1]), k + 1
            held = np.concatenate(more) if len(more) > 1 else held
            yield doc, at, held[:n]
            held, at = held[n:], at + n


def write_token_files(docs: DataFrame, path: str, folder: str, *, end_id: int = 1, bits: int = 8) -> DataFrame:
    """Files in folder of all documents' ids in ascending doc_id order: part, seq, n_ids, n_docs, file (its address).

    Texts are dealt by ranges of doc_id and sorted in each range, then encoded and written in that order in
    one task each; a range gives files of about FILE_IDS ids, so neither a task nor a file gathers more.
    (part, seq) is the files' order. Equal doc_ids are dealt apart by a row number, null ones come first. A task that
    is tried again writes files of other names; those that a row of the result names are the ones that count, so the
    result must be written before it is read twice. Extra columns are ignored.
    """
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_ids", pa.int64()), ("n_docs", pa.int64()), ("file", pa.string())])

    def run(batches):
        units, end, part = encoder(path, False), end_id.to_bytes(4, "little"), TaskContext.get().partitionId()

        def stored(seq, names, lengths, held):
            files, root = opened(folder)
            files.create_dir(root, recursive=True)
            name = f"{part:06d}-{seq:06d}-{uuid.uuid4().hex}.ids"
            with files.open_output_stream(f"{root}/{name}") as out:
                out.write(write_image(names, lengths, np.frombuffer(b"".join(held), "<u4"), bits))
            return f"{folder}/{name}"

        def found():
            seq, held, names, lengths, total = 0, [], [], [], 0
            for doc, text, _ in rows(batches):
                ids = units.encode(text or "") + end
                held.append(ids)
                names.append(doc)
                lengths.append(len(ids) // 4)
                total += lengths[-1]
                if total >= FILE_IDS:
                    yield part, seq, total, len(names), stored(seq, names, lengths, held)
                    seq, held, names, lengths, total = seq + 1, [], [], [], 0
            if names:
                yield part, seq, total, len(names), stored(seq, names, lengths, held)

        return batches_of(found(), schema, 1)

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row")).repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row")
    return ordered.mapInArrow(run, "part int, seq int, n_ids long, n_docs long, file string")


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files, decoded from their planes.

    start counts the ids of all documents before it. Only each file's number of ids is added up over files.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        def found():
            for file, first in rows(batches):
                with Image.at(file) as image:
                    for doc, at, ids in image.documents():
                        yield doc, first + at, len(ids), crc32(ids.tobytes())

        return batches_of(found(), schema)

    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier_parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("p"))  # one row a range
    earlier_files = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = files.withColumn("f", earlier_files).join(earlier_parts, "part").select("part", "seq", "file", (F.col("p") + F.col("f")).alias("first"))
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # rows are small: by their bytes all would be one task
    return placed.repartition(tasks, "part", "seq").select("file", "first").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_on_disk(docs: DataFrame, path: str, *, end_id: int = 1) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32: every row of docs written to token-id files in the shared folder and read back.

    Null and empty texts are the end id alone; repeated and null doc_ids stay rows of their own; extra columns are
    ignored; an empty table gives an empty one.
    """
    ws = Workspace(docs.sparkSession, "tokens")
    return read_token_files(ws.save(write_token_files(docs, path, f"{ws.path}/ids", end_id=end_id), "files"))
