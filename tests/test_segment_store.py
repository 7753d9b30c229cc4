"""The segment store as a data source: pruning, headers by seeks, atomic writes."""

from __future__ import annotations

import os
import random
import struct

import pytest

from segline.functions import scalars as S
from segline.sources import segment_store as store
from segline.sources.boxes import box_facts

PLACE = "channel_id string, period_id string, media_type string, as_id string, rep_id string, seg_no bigint, ext string, content binary"


def box(kind, body=b"", wide=False, size=None):
    if wide:
        return struct.pack(">I4sQ", 1, kind, 16 + len(body) if size is None else size) + body
    return struct.pack(">I4s", 8 + len(body) if size is None else size, kind) + body


def tfdt(pts):
    return box(b"tfdt", struct.pack(">IQ", 1 << 24, pts))


def moof(pts):
    return box(b"moof", box(b"mfhd", bytes(8)) + box(b"traf", tfdt(pts)))


def mdhd(scale):
    return box(b"moov", box(b"trak", box(b"mdia", box(b"mdhd", bytes(12) + struct.pack(">I", scale) + bytes(8)))))


def by_seeks(data):
    read = store.Reads(type("F", (), {"read_at": staticmethod(lambda n, at: data[at : at + n])}), len(data))
    return store.header_facts(read, len(data)), read.total


def test_headers_by_seeks_say_what_whole_files_say():
    rng = random.Random(3)
    pieces = [moof(77), box(b"mdat", bytes(9000)), box(b"mdat", bytes(5000), wide=True), mdhd(48_000), box(b"free", bytes(200)), box(b"styp"), tfdt(5), box(b"mdat", b"x", size=0), box(b"free", b"12345678", wide=True, size=0xFFFFFFFFFFFFFFF8), box(b"free", wide=True, size=2), box(b"moof", box(b"traf", b"123")), box(b"moov", box(b"trak", size=99)), b"\0\0\0", struct.pack(">I4s", 1, b"free") + b"\0\0", box(b"moof", box(b"traf", tfdt(9)[:-2]), size=None)]
    for _ in range(2500):
        data = b"".join(rng.choice(pieces) for _ in range(rng.randrange(6)))
        data = data[: rng.randrange(len(data) + 1)] if rng.random() < 0.3 else data
        assert by_seeks(data)[0] == box_facts(data)


@pytest.mark.parametrize("wide", [False, True])
def test_media_is_not_read(wide):
    data = moof(123) + box(b"mdat", bytes(8 << 20), wide) + moof(456) + box(b"mdat", bytes(1 << 20), wide)
    facts, total = by_seeks(data)
    assert (facts["start_pts"], facts["error"], facts["has_mdat"]) == (123, None, True) and total < 65_536
    torn, total = by_seeks(data[: 5 << 20])
    assert torn["error"] == "box mdat is cut off" and torn["start_pts"] == 123 and total < 65_536
    assert by_seeks(box(b"moov", bytes(2 << 20)))[0]["error"] == "box moov is too large"


def test_ids_are_encoded_as_columns_are(spark):
    ids = ["a", "a/b", "..", "~x", "é ü", "p.r1", "", "a" * 50, "~"]
    df = spark.createDataFrame([(i,) for i in ids], "i string").select("i", S.encode_id("i").alias("e"))
    for r in df.collect():
        assert store.encoded(r["i"]) == r["e"] and store.decoded(r["e"]) == r["i"]
    assert store.decoded("legacy name") == "legacy name" and store.decoded("~?") == "~?"


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("store"))
    rows = [(c, p, "video", "0", r, n, "m4s", moof(100 * n) + box(b"mdat", bytes(9000))) for c in ("c1", "c2") for p in ("1", "2/x", "3") for r in ("v/1", "v2") for n in range(20)]
    rows += [(c, "3", "audio", "1", "a", None, "mp4", mdhd(44_100)) for c in ("c1", "c2")]
    store.write_segment_store(spark.createDataFrame(rows, PLACE), root)
    for name in ("c1/periods/1/video_0/v2/7.tmp", "c1/periods/1/video_0/v2/x.m4s", "c1/other/1.m4s", "c1/periods/1/odd/v/1.m4s"):
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        open(f"{root}/{name}", "wb").close()
    return root


def test_scan_gives_every_segment_and_its_headers(spark, root):
    df = store.scan_segment_store(spark, root, facts=True)
    rows = df.collect()
    assert len(rows) == 240 and {r["start_pts"] == 100 * r["seg_no"] and r["error"] is None and r["bytes_read"] == 4096 for r in rows} == {True}
    assert {(r["channel_id"], r["period_id"], r["rep_id"]) for r in rows} == {(c, p, r) for c in ("c1", "c2") for p in ("1", "2/x", "3") for r in ("v/1", "v2")}
    inits = store.scan_segment_store(spark, root, facts=True, inits=True).collect()
    assert [(r["seg_no"], r["rep_id"], r["timescale"], r["error"]) for r in inits] == [(None, "a", 44_100, None)] * 2
    assert not [f for _, _, names in os.walk(root) for f in names if f.endswith(".part")]


def test_chosen_directories_are_the_only_ones_listed(spark, root):
    scan = lambda **of: store.scan_segment_store(spark, root, facts=True, **of)
    got = scan(periods=["2/x"], channels=["c2", "c9"], numbers=(3, 5))
    assert sorted((r["channel_id"], r["rep_id"], r["seg_no"]) for r in got.collect()) == [("c2", r, n) for r in ("v/1", "v2") for n in (3, 4)]
    every = scan()  # one frame, filtered in two ways
    assert every.where("channel_id = 'c1'").union(every.where("seg_no = 4 and channel_id = 'c2'")).count() == 120 + 6
    assert [scan(**of).count() for of in ({"channels": ["../c1", None, "."]}, {"periods": [".."]}, {"channels": []}, {"numbers": (20, 9)})] == [0, 0, 0, 0]

    listed, opened_files = [], []
    reader = store.StoreReader({"path": root, "facts": "true", "parts": "1", "channels": '["c1"]', "periods": '["2/x"]', "least": "7", "most": "9"})
    below, real = reader._below, store.opened
    reader._below = lambda files, path: listed.append(path[len(root) :]) or below(files, path)
    (task,) = reader.partitions()
    assert listed == []  # neither the root nor the channel

    class Counted:
        def __init__(self, files):
            self.files = files

        def __getattr__(self, name):
            return getattr(self.files, name)

        def open_input_file(self, path):
            opened_files.append(path)
            return self.files.open_input_file(path)

    store.opened, keep = (lambda r: (Counted(real(r)[0]), real(r)[1])), store.opened
    try:
        assert len(list(reader.read(task))) == 4
    finally:
        store.opened = keep
    assert {p.split("/periods/")[1].split("/")[0] for p in listed} == {store.encoded("2/x")} and len(listed) == 4 and len(opened_files) == 4


def test_a_large_period_is_several_tasks(spark, root):
    reader = store.StoreReader({"path": root, "groups": "2", "parts": "3"})
    tasks = reader.partitions()
    sizes = [len(list(reader.read(t))) for t in tasks]
    assert len(tasks) == 6 and sum(sizes) == 240 and max(sizes) <= 48
    assert store.StoreReader({"path": root + "/none"}).partitions() == []
    assert store.scan_segment_store(spark, root + "/none").count() == 0


def test_a_file_written_again_is_replaced(spark, root):
    row = ("c1", "1", "video", "0", "v2", 3, "m4s", moof(1) + box(b"mdat"))
    store.write_segment_store(spark.createDataFrame([row], PLACE), root)
    got = store.scan_segment_store(spark, root, facts=True).where("channel_id = 'c1' and period_id = '1' and rep_id = 'v2' and seg_no = 3").collect()
    assert [(r["start_pts"], r["length"]) for r in got] == [(1, len(row[-1]))]
    store.write_segment_store(spark.createDataFrame([(*row[:7], moof(300) + box(b"mdat", bytes(9000)))], PLACE), root)
