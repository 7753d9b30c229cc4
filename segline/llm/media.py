"""ISO media columns: writing 8-bit samples into boxes, and reading boxes and sample tables without decoding."""

from __future__ import annotations

import struct
from hashlib import sha256
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segline.session import on_workers

from .arrow import batches_of, rows

RATE, FRAME, GROUP = 8000, 1024, 16  # samples a second, bytes of a sample, samples from one keyframe to the next
_CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, version: int = 0) -> bytes:
    return _box(kind, bytes([version, 0, 0, 0]), *parts)


def write_container(payload: bytes) -> bytes:
    """One audio track of unsigned 8-bit PCM ('raw ') whose samples are FRAME bytes of the payload each.

    The last sample may be shorter; each GROUP-th is marked as a sync sample and starts a chunk. The
    payload lies in mdat as it is. Equal payloads give equal files.
    """
    n = -(-len(payload) // FRAME)
    last = len(payload) - FRAME * (n - 1) if n else 0
    u32 = lambda *x: struct.pack(f">{len(x)}I", *x)
    head = _box(b"ftyp", b"qt  ", u32(0), b"qt  ")
    matrix = u32(0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    times = [(n - 1, FRAME), (1, last)] if n > 1 and last != FRAME else [(n, last)] if n == 1 else [(n, FRAME)] if n else []
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    stsd = _full(b"stsd", u32(1), entry)
    stts = _full(b"stts", u32(len(times)), *(u32(*t) for t in times))
    chunks = -(-n // GROUP)
    runs = [(1, min(GROUP, n), 1)] if n else []
    if chunks > 1 and n % GROUP:
        runs.append((chunks, n % GROUP, 1))
    stsc = _full(b"stsc", u32(len(runs)), *(u32(*r) for r in runs))
    stsz = _full(b"stsz", u32(0, n), u32(*([FRAME] * (n - 1) + [last])) if n else b"")
    stss = _full(b"stss", u32(chunks, *range(1, n + 1, GROUP)))

    def movie(first: int) -> bytes:
        co64 = _full(b"co64", u32(chunks), struct.pack(f">{chunks}Q", *range(first, first + len(payload), FRAME * GROUP)))
        stbl = _box(b"stbl", stsd, stts, stsc, stsz, stss, co64)
        minf = _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", u32(1), _box(b"url ", bytes([0, 0, 0, 1])))), stbl)
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, len(payload), 0x55C4, 0), version=1), _full(b"hdlr", u32(0), b"soun", bytes(12), b"\0"), minf)
        tkhd = _full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, len(payload)), bytes(8), struct.pack(">hhhh", 0, 0, 0x100, 0), matrix, u32(0, 0), version=1)
        mvhd = _full(b"mvhd", struct.pack(">QQIQ", 0, 0, RATE, len(payload)), u32(0x10000), struct.pack(">HH", 0x100, 0), bytes(8), matrix, bytes(24), u32(2), version=1)
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    wide = 16 if len(payload) + 8 >= 1 << 32 else 8
    return head + (moov := movie(len(head) + len(movie(0)) + wide)) + _box(b"mdat", payload)


def boxes(data: bytes, start: int = 0, stop: int | None = None, depth: int = 0):
    """(path, start of body, end) of every box, parents before children; raises ValueError on a bad size."""
    stop = len(data) if stop is None else stop
    while start + 8 <= stop:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = stop - start
        if size < body - start or start + size > stop:
            raise ValueError(f"box {kind!r} at {start} goes beyond its parent")
        yield (kind,), body, start + size
        if kind in _CONTAINERS and depth < 16:
            for path, a, b in boxes(data, body, start + size, depth + 1):
                yield (kind, *path), a, b
        start += size


class Track:
    """A track's codec, time scale, duration and sample tables; its samples' places follow from them.

    Samples of movie fragments follow those of the tables. Edit lists are not applied: times are the media's own.
    """

    def __init__(self):
        self.number, self.codec, self.handler, self.scale, self.duration = 0, "", "", 0, 0
        self.times, self.runs, self.sizes, self.sync, self.chunks = [], [], [], None, []
        self.defaults = (0, 0, 0)  # duration, size and flags of a fragment's samples
        self.fragments: list[tuple[int, int, bool]] = []  # offset, size, whether a sync sample

    def samples(self) -> int:
        return len(self.sizes) + len(self.fragments)

    def places(self) -> list[tuple[int, int]]:
        """(offset, size) of each sample: chunks' offsets, with samples to a chunk run by run."""
        out, k = [], 0
        for i, (first, per, _) in enumerate(self.runs):
            stop = self.runs[i + 1][0] if i + 1 < len(self.runs) else len(self.chunks) + 1
            for chunk in range(first, stop):
                at = self.chunks[chunk - 1]
                for size in self.sizes[k : k + per]:
                    out.append((at, size))
                    at += size
                k += per
        return out + [(at, size) for at, size, _ in self.fragments]

    def keyframe_ranges(self) -> list[tuple[int, int]]:
        """(first byte, last byte + 1) of every sync sample; all samples where there is no table of them."""
        places, n = self.places(), len(self.sizes)
        picked = [s - 1 for s in (self.sync if self.sync is not None else range(1, n + 1))]
        picked += [n + i for i, (_, _, sync) in enumerate(self.fragments) if sync]
        return [(places[s][0], sum(places[s])) for s in picked]

    def add_run(self, data: bytes, at: int, end: int, base: int, given: tuple[int, int, int]) -> int:
        """One run of a fragment's samples from the body at `at`; returns where its bytes end."""
        flags, n = int.from_bytes(data[at + 1 : at + 4], "big"), struct.unpack_from(">I", data, at + 4)[0]
        at += 8
        if flags & 1:
            base, at = base + struct.unpack_from(">i", data, at)[0], at + 4
        first = struct.unpack_from(">I", data, at)[0] if flags & 4 else None
        at += 4 if flags & 4 else 0
        fields = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
        if at + 4 * len(fields) * n > end or n > len(data):
            raise ValueError(f"a run of {n} samples goes beyond its box")
        for i in range(n):
            own = dict(zip(fields, struct.unpack_from(f">{len(fields)}I", data, at + 4 * len(fields) * i), strict=True))
            size, mark = own.get(0x200, given[1]), own.get(0x400, first if i == 0 and first is not None else given[2])
            self.fragments.append((base, size, not mark & 0x10000))
            self.duration += own.get(0x100, given[0])
            base += size
        return base


def tracks(data: bytes) -> list[Track]:
    out: list[Track] = []

    def table(at: int, stop: int, row: str, n: int) -> list:
        """n rows of a table, which must end in its box: a torn file's count is never believed."""
        if at + struct.calcsize(">" + row) * n > stop:
            raise ValueError(f"a table of {n} entries goes beyond its box")
        return [x if len(x) > 1 else x[0] for x in struct.iter_unpack(">" + row, data[at : at + struct.calcsize(">" + row) * n])]

    for path, a, end in boxes(data):
        kind = path[-1]
        if kind == b"trak":
            out.append(Track())
        if path[0] == b"moof":
            if kind == b"moof":
                moof = a - 8
            elif kind == b"traf":
                now, base, given = None, moof, (0, 0, 0)
            elif kind == b"tfhd":
                flags, number = int.from_bytes(data[a + 1 : a + 4], "big"), struct.unpack_from(">I", data, a + 4)[0]
                now = next((t for t in out if t.number == number), None)
                own, at = {}, a + 8
                for bit, row in ((1, "Q"), (2, "I"), (8, "I"), (0x10, "I"), (0x20, "I")):
                    if flags & bit:
                        (own[bit],) = struct.unpack_from(">" + row, data, at)
                        at += struct.calcsize(">" + row)
                base = own.get(1, moof)
                given = tuple(own.get(bit, usual) for bit, usual in zip((8, 0x10, 0x20), now.defaults if now else (0, 0, 0), strict=True))
            elif kind == b"trun" and now:
                base_after = now.add_run(data, a, end, base, given)
                base = base if data[a + 3] & 1 else base_after
            continue
        if not out or path[0] != b"moov":
            continue
        if kind == b"trex":
            number, _, *usual = struct.unpack_from(">5I", data, a + 4)
            for t in out:
                if t.number == number:
                    t.defaults = tuple(usual)
            continue
        t, many = out[-1], lambda at: struct.unpack_from(">I", data, at)[0]
        if kind == b"tkhd":
            t.number = many(a + (20 if data[a] else 12))
        elif kind == b"mdhd":
            t.scale, t.duration = struct.unpack_from(">IQ", data, a + 20) if data[a] else struct.unpack_from(">II", data, a + 12)
        elif kind == b"hdlr":
            t.handler = data[a + 8 : a + 12].decode("latin-1")
        elif kind == b"stsd" and many(a + 4):
            t.codec = data[a + 12 : a + 16].decode("latin-1")
        elif kind == b"stts":
            t.times = table(a + 8, end, "II", many(a + 4))
        elif kind == b"stsc":
            t.runs = table(a + 8, end, "III", many(a + 4))
        elif kind == b"stsz":
            fixed, n = struct.unpack_from(">II", data, a + 4)
            if fixed * n > len(data):
                raise ValueError(f"{n} samples of {fixed} bytes go beyond the file")
            t.sizes = [fixed] * n if fixed else table(a + 12, end, "I", n)
        elif kind == b"stz2":  # sizes of 4, 8 or 16 bits
            bits, n = data[a + 7], many(a + 8)
            packed = table(a + 12, end, "H" if bits == 16 else "B", -(-n * bits // 8) if bits < 16 else n)
            t.sizes = [x >> s & 15 for x in packed for s in (4, 0)][:n] if bits == 4 else packed
        elif kind == b"stss":
            t.sync = table(a + 8, end, "I", many(a + 4))
        elif kind in (b"stco", b"co64"):
            t.chunks = table(a + 8, end, "I" if kind == b"stco" else "Q", many(a + 4))
    return out


def payload_of(data: bytes) -> bytes:
    """The first track's samples in order, found through its tables."""
    found = tracks(data)
    return b"".join(data[a : a + n] for a, n in found[0].places()) if found else b""


def feature_of(data: bytes) -> str:
    """codec|duration in seconds|samples|keyframe byte ranges, for each track, tracks joined by ;"""
    return ";".join(f"{t.codec.strip()}|{t.duration / t.scale if t.scale else 0:.6f}|{t.samples()}|" + ",".join(f"{a}-{b - 1}" for a, b in t.keyframe_ranges()) for t in tracks(data))


def media_column(docs: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """docs with the text's bytes, padded with zeros to a positive multiple of 64, as an ISO media file."""
    on_workers(docs.sparkSession)
    @F.pandas_udf("binary")
    def stored(texts):
        def one(t):
            raw = t.encode("utf-8", "surrogatepass") if t is not None else b""
            return write_container(raw + bytes(-len(raw) % 64 if raw else 64))

        return texts.map(one)

    return docs.withColumn(out, stored(F.col(text)))


def media_facts(df: DataFrame, media: str = "media") -> DataFrame:
    """df with what its media column's boxes tell: array of (codec, handler, duration_s, samples, keyframes).

    A null or torn file gives an empty array and the reason in media_error; payloads are never decoded.
    """
    on_workers(df.sparkSession)
    kind = "struct<tracks:array<struct<codec:string,handler:string,duration_s:double,samples:long,keyframes:array<struct<first:long,last:long>>>>,error:string>"

    def facts(data):
        if data is None:
            return {"tracks": [], "error": "no file"}
        try:
            return {"tracks": [{"codec": t.codec, "handler": t.handler, "duration_s": t.duration / t.scale if t.scale else 0.0, "samples": t.samples(), "keyframes": [{"first": a, "last": b - 1} for a, b in t.keyframe_ranges()]} for t in tracks(bytes(data))], "error": None}
        except (ValueError, struct.error, IndexError) as e:
            return {"tracks": [], "error": str(e)}

    @F.pandas_udf(kind)
    def all_facts(files: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([facts(f) for f in files], columns=["tracks", "error"])

    return df.withColumn("f", all_facts(F.col(media))).withColumns({"media_tracks": F.col("f.tracks"), "media_error": F.col("f.error")}).drop("f")


def stored_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    Each text is written as a media file in one step and read back from that file's bytes in the next.
    Null text: empty, so 64 zeros. One row for each row of docs, no shuffle. Extra columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def run(batches):
        def found():
            for doc, n, media in rows(batches):
                payload = payload_of(media)
                yield doc, n, len(payload), sha256(payload).hexdigest(), crc32(payload[-64:]), len(media), sha256(media).hexdigest(), feature_of(media)

        return batches_of(found(), schema)

    n = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long")
    files = media_column(docs.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n_bytes"), F.col("text").cast("string").alias("text")))
    return files.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
