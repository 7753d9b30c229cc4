"""The segment store as a data source: directories become partitions, chosen ones only, and headers are read by seeks.

Layout: root / channel / "periods" / period / type_set / representation / number.ext, ids encoded as by encode_id;
an init file is init.mp4 beside a representation's segments.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import struct
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone
from threading import Lock

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from segline.functions.scalars import _PLAIN_ID
from segline.session import on_workers
from segline.sources.boxes import FACTS, HEADERS, JUDGED, box_facts

PATHS = "channel_id string, period_id string, media_type string, as_id string, rep_id string, seg_no bigint, ext string, path string, length bigint, modified timestamp"
#: Bytes of a read where only a few are asked for; the most that a box of headers may have.
CHUNK, MOST_HEADER = 4096, 1 << 20
_SEGMENT, _SET = re.compile(r"(\d{1,18})\.(m4s|mp4|ts|vtt)"), re.compile(r"([^/_]+)_([^/]+)")
_PLAIN = re.compile(_PLAIN_ID)
_REGISTERING = Lock()


def encoded(ident: str) -> str:
    """encode_id for one id."""
    return ident if _PLAIN.search(ident) else "~" + base64.urlsafe_b64encode(ident.encode()).decode().rstrip("=")


def decoded(name: str) -> str:
    """The id of a directory; a legacy name that is no encoded id is the id itself."""
    if name.startswith("~"):
        try:
            ident = base64.b64decode(name[1:].translate({45: 43, 95: 47}) + "=" * (-len(name[1:]) % 4), validate=True).decode()
            return name if _PLAIN.search(ident) else ident
        except (binascii.Error, UnicodeDecodeError):
            pass
    return name


def _plain_name(name: str | None) -> bool:
    """Whether it can be the name of a directory: a filter's value must not lead elsewhere."""
    return bool(name) and "/" not in name and name not in (".", "..")


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a root and the root's path in it. file:, s3:, gs: and hdfs: addresses and plain paths."""
    found, path = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", root))
    return found, path.rstrip("/")


class Reads:
    """Reads of one file at places, each of CHUNK bytes at least; `total` counts what was read."""

    def __init__(self, source, size: int):
        self.source, self.size, self.total, self.at, self.held = source, size, 0, 0, b""

    def __call__(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if at < self.at or at + n > self.at + len(self.held):
            self.at, self.held = at, self.source.read_at(min(max(n, CHUNK), self.size - at), at)
            self.total += len(self.held)
        return self.held[at - self.at : at - self.at + n]


def header_facts(read: Callable[[int, int], bytes], size: int) -> dict:
    """box_facts of a file of which only the boxes of headers are read: others, as mdat, are stepped over by their sizes."""
    data, at, error = bytearray(), 0, None
    while at + 8 <= size:
        head = read(at, 16)
        n, kind = struct.unpack_from(">I4s", head)
        body = 8
        if n == 1 and at + 16 <= size:
            n, body = struct.unpack_from(">Q", head, 8)[0], 16
        elif n == 0:
            n = size - at
        if n < body or at + n > size:
            error = f"box {kind.decode('latin-1')} is cut off"
            break
        if kind not in HEADERS:
            data += struct.pack(">I4s", 8, kind)
        elif n > MOST_HEADER:
            error = f"box {kind.decode('latin-1')} is too large"
            break
        else:
            data += struct.pack(">I4s", 8 + n - body, kind) + read(at + body, n - body)
        at += n
    found = box_facts(bytes(data))
    return found | {"error": error} if error and found["error"] in JUDGED else found


class Directories(InputPartition):
    """Periods (channel, directory of the period) and which part of their numbers a task reads."""

    def __init__(self, periods: list[tuple[str, str]], part: int, parts: int):
        self.periods, self.part, self.parts = periods, part, parts


class StoreReader(DataSourceReader):
    """channels and periods choose directories, which are then the only ones listed; least and most (not included) of
    numbers choose files before any is opened."""

    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.facts, self.inits = (options.get(k, "false").lower() == "true" for k in ("facts", "inits"))
        self.groups, self.parts, self.threads = (int(options.get(k, n)) for k, n in (("groups", 64), ("parts", 4), ("threads", 8)))
        self.channels, self.periods = (json.loads(options[k]) if k in options else None for k in ("channels", "periods"))
        self.least, self.most = (int(options.get(k, n)) for k, n in (("least", 0), ("most", 1 << 63)))

    def _below(self, files: fs.FileSystem, path: str) -> list[fs.FileInfo]:
        return files.get_file_info(fs.FileSelector(path, allow_not_found=True))

    def _directories(self, files: fs.FileSystem, path: str) -> list[str]:
        return sorted(f.base_name for f in self._below(files, path) if f.type == fs.FileType.Directory)

    def partitions(self) -> list[Directories]:
        """The driver lists the names of channels and periods only, and not even those that were chosen; a group of periods
        is `parts` tasks, each of which takes a part of the numbers, so a period with most files is no single task."""
        files, root = opened(self.root)
        channels = self._directories(files, root) if self.channels is None else sorted(set(filter(_plain_name, self.channels)))
        found = []
        with ThreadPoolExecutor(self.threads) as pool:
            if self.periods is None:
                for channel, names in zip(channels, pool.map(lambda c: self._directories(files, f"{root}/{c}/periods"), channels), strict=True):
                    found += [(channel, name) for name in names]
            else:
                names = sorted({d for p in self.periods if p for d in (encoded(p), p) if _plain_name(d)})
                asked = [(c, name) for c in channels for name in names]
                infos = files.get_file_info([f"{root}/{c}/periods/{name}" for c, name in asked])
                found = [x for x, info in zip(asked, infos, strict=True) if info.type == fs.FileType.Directory]
        groups = min(self.groups, len(found))
        return [Directories(found[g::groups], part, self.parts) for g in range(groups) for part in range(self.parts)]

    def _files(self, files: fs.FileSystem, root: str, task: Directories) -> Iterator[tuple]:
        """Rows of PATHS, the last but two left as a file's information."""
        for channel, period in task.periods:
            top = f"{root}/{channel}/periods/{period}"
            for kind_set in self._directories(files, top):
                if not (kind := _SET.fullmatch(kind_set)):
                    continue
                for rep in self._directories(files, f"{top}/{kind_set}"):
                    of = channel, decoded(period), kind[1], decoded(kind[2]), decoded(rep)
                    for info in self._below(files, f"{top}/{kind_set}/{rep}"):
                        if info.type != fs.FileType.File:
                            continue
                        named = _SEGMENT.fullmatch(info.base_name)
                        if self.inits and info.base_name == "init.mp4" and task.part == 0:
                            yield *of, None, "mp4", info
                        elif not self.inits and named and int(named[1]) % task.parts == task.part and self.least <= int(named[1]) < self.most:
                            yield *of, int(named[1]), named[2], info

    def read(self, partition: Directories | None) -> Iterator[tuple]:
        """Files of a task (None where there are none); headers of several are read at the same time, for a read waits
        more than it works."""
        if partition is None:
            return
        files, root = opened(self.root)

        def row(found: tuple) -> tuple:
            *of, info = found
            at = datetime.fromtimestamp(info.mtime_ns / 1e9, timezone.utc)
            out = *of, self.root.rstrip("/") + info.path[len(root) :], info.size, at
            if not self.facts:
                return out
            with files.open_input_file(info.path) as source:
                read = Reads(source, info.size)
                facts = header_facts(read, info.size)
            return *out, *facts.values(), read.total

        rows, held = self._files(files, root, partition), []
        with ThreadPoolExecutor(self.threads) as pool:
            for found in rows:
                held.append(found)
                if len(held) == 64 * self.threads:
                    yield from pool.map(row, held)
                    held = []
            yield from pool.map(row, held)


class Written(WriterCommitMessage):
    def __init__(self, n: int):
        self.n = n


class StoreWriter(DataSourceWriter):
    """Each row is a file, written beside its place and moved there in one step: a task that is tried again replaces its
    own files, and a reader never sees half of one."""

    def __init__(self, options: dict[str, str], names: list[str]):
        self.root, self.names = options["path"], names

    def write(self, iterator: Iterator) -> Written:
        files, root = opened(self.root)
        n, made = 0, set()
        for row in iterator:
            r = dict(zip(self.names, row, strict=True))
            folder = f"{root}/{r['channel_id']}/periods/{encoded(r['period_id'])}/{r['media_type']}_{encoded(r['as_id'])}/{encoded(r['rep_id'])}"
            if folder not in made:
                files.create_dir(folder, recursive=True)
                made.add(folder)
            name = "init.mp4" if r["seg_no"] is None else f"{r['seg_no']}.{r['ext']}"
            part = f"{folder}/{name}.{uuid.uuid4().hex}.part"
            with files.open_output_stream(part) as out:
                out.write(bytes(r["content"]))
            files.move(part, f"{folder}/{name}")
            n += 1
        return Written(n)


class SegmentStore(DataSource):
    """format("segment_store"). Options: path; facts (read headers), inits (init files in place of segments), groups, parts
    and threads. Written from channel_id, period_id, media_type, as_id, rep_id, seg_no (null: the init), ext, content."""

    @classmethod
    def name(cls) -> str:
        return "segment_store"

    def schema(self) -> str:
        return PATHS + (f", {FACTS}, bytes_read bigint" if self.options.get("facts", "false").lower() == "true" else "")

    def reader(self, schema) -> StoreReader:
        return StoreReader(self.options)

    def writer(self, schema, overwrite: bool) -> StoreWriter:
        return StoreWriter(self.options, schema.names)


def registered(spark: SparkSession) -> SparkSession:
    """The session, knowing the source, and active in this thread: a source is looked up in the active session."""
    on_workers(spark)
    spark.createDataFrame([], "id int")  # makes it active
    with _REGISTERING:
        spark.dataSource.register(SegmentStore)
    return spark


def scan_segment_store(spark: SparkSession, root: str, *, facts: bool = False, inits: bool = False, channels: list[str] | None = None, periods: list[str] | None = None, numbers: tuple[int, int] | None = None, **options) -> DataFrame:
    """S2, with facts S5: the files below root, channel_id to modified, and with facts what their headers say and how many
    bytes were read for that. inits: the init files (seg_no null) in place of segments. Other files are skipped; a file
    that is cut off has an error.

    channels, periods: only these are listed. numbers: from, and to but not including. These are parameters and not
    pushed filters, for Spark keeps one reader for a relation: what one use of a DataFrame pushes, another use of it in
    the same query, as in a union, would get as well.
    """
    chosen = {"channels": json.dumps(channels) if channels is not None else None, "periods": json.dumps(periods) if periods is not None else None, "least": numbers and numbers[0], "most": numbers and numbers[1]}
    options |= {k: v for k, v in chosen.items() if v is not None}
    return registered(spark).read.format("segment_store").options(facts=facts, inits=inits, **options).load(root)


def write_segment_store(files: DataFrame, root: str) -> None:
    """Files of the store from rows; several rows of one place leave one of them."""
    names = ["channel_id", "period_id", "media_type", "as_id", "rep_id", "seg_no", "ext", "content"]
    registered(files.sparkSession)
    files.select(*names).write.format("segment_store").mode("append").save(root)


def drop_channels(spark: SparkSession, root: str) -> None:
    """Remove all channels of a store, each by a task, and then the root."""
    on_workers(spark)
    files, top = opened(root)
    names = [(f.base_name,) for f in files.get_file_info(fs.FileSelector(top, allow_not_found=True)) if f.type == fs.FileType.Directory]

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = opened(root)
        for batch in batches:
            for name in batch.column("channel_id").to_pylist():
                files.delete_dir(f"{top}/{name}")
            yield batch

    if names:
        spark.createDataFrame(names, "channel_id string").repartition(min(len(names), 2 * spark.sparkContext.defaultParallelism)).mapInArrow(drop, "channel_id string").count()
        files.delete_dir(top)
