"""Media files that this package did not write: packed sizes, fragments, torn tables; and op7's columns by hand."""

from __future__ import annotations

import struct
from hashlib import sha256

import pytest

from segline.llm import media


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def u32(*x):
    return struct.pack(f">{len(x)}I", *x)


def movie(stbl=b"", mvex=b""):
    """A video track with id 7 and a time scale of 600."""
    tkhd = box(b"tkhd", u32(0, 0, 0, 7, 0, 1200), bytes(60))
    mdhd = box(b"mdhd", u32(0, 0, 0, 600, 1200), bytes(4))
    stsd = box(b"stsd", u32(0, 1), box(b"avc1", bytes(78)))
    return box(b"moov", box(b"trak", tkhd, box(b"mdia", mdhd, box(b"hdlr", u32(0, 0), b"vide", bytes(13)), box(b"minf", box(b"stbl", stsd, stbl)))), mvex)


@pytest.mark.parametrize(("bits", "packed"), [(4, bytes([0x35, 0x70])), (8, bytes([3, 5, 7])), (16, struct.pack(">3H", 3, 5, 7))])
def test_packed_sizes_and_two_chunk_runs(bits, packed):
    stbl = box(b"stz2", u32(0, bits, 3), packed) + box(b"stsc", u32(0, 2, 1, 2, 1, 2, 1, 1)) + box(b"stco", u32(0, 2, 900, 1000)) + box(b"stss", u32(0, 2, 1, 3)) + box(b"stts", u32(0, 1, 3, 400))
    (t,) = media.tracks(movie(stbl))
    assert (t.codec, t.handler, t.scale, t.duration, t.samples()) == ("avc1", "vide", 600, 1200, 3)
    assert t.places() == [(900, 3), (903, 5), (1000, 7)]
    assert t.keyframe_ranges() == [(900, 903), (1000, 1007)]


def test_fragments():
    head = movie(mvex=box(b"mvex", box(b"trex", u32(0, 7, 1, 300, 11, 0x10000))))
    run_a = box(b"trun", u32(0x205, 2, 500, 0), u32(20, 30))  # offset, first flags (a sync sample), own sizes
    run_b = box(b"trun", u32(0x400, 2), u32(0x10000, 0))  # goes on after the first run, own flags, usual size
    first = box(b"moof", box(b"mfhd", u32(0, 1)), box(b"traf", box(b"tfhd", u32(0x20000, 7)), run_a))
    second = box(b"moof", box(b"mfhd", u32(0, 2)), box(b"traf", box(b"tfhd", u32(1, 7), struct.pack(">Q", 5000)), run_b))
    (t,) = media.tracks(head + first + second + box(b"mdat", bytes(8)))
    at = len(head) + 500
    assert t.places() == [(at, 20), (at + 20, 30), (5000, 11), (5011, 11)]
    assert t.keyframe_ranges() == [(at, at + 20), (5011, 5022)]
    assert (t.samples(), t.duration) == (4, 1200 + 4 * 300)


@pytest.mark.parametrize("stbl", [box(b"stsz", u32(0, 9, 4_000_000_000)), box(b"stsz", u32(0, 0, 50)), box(b"stts", u32(0, 1 << 31)), box(b"stss", u32(0, 7, 1)), box(b"stz2", u32(0, 8, 99), b"ab")])
def test_torn_tables_are_errors(spark, stbl):
    with pytest.raises(ValueError):
        media.tracks(movie(stbl))
    row = media.media_facts(spark.createDataFrame([(bytearray(movie(stbl)),)], "media binary")).first()
    assert row["media_tracks"] == [] and "beyond" in row["media_error"]


def test_stored_text_by_hand(spark):
    """18,000 bytes: 18 samples, keyframes at samples 1 and 17; the file read with a box walk of the test's own."""
    text = "x" * 17_999
    payload = text.encode() + bytes(64 - 17_999 % 64)
    got = media.stored_texts(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    stored = bytes(media.media_column(spark.createDataFrame([(text,)], "text string")).first()["media"])
    assert (got["media_bytes"], got["media_sha256"]) == (len(stored), sha256(stored).hexdigest())
    at, places = 0, {}
    while at < len(stored):
        size, kind = struct.unpack_from(">I4s", stored, at)
        places[kind] = (at + 8, at + size)
        at += size
    a, b = places[b"mdat"]
    assert list(places) == [b"ftyp", b"moov", b"mdat"] and stored[a:b] == payload
    n = len(payload)
    assert got["feature"] == f"raw|{n / 8000:.6f}|18|{a}-{a + 1023},{a + 16 * 1024}-{a + 17 * 1024 - 1}"


def test_a_block_of_a_token_file_is_read_alone(spark, tmp_path):
    import numpy as np
    import public_tokenizers

    from segline.llm import token_files

    rng = np.random.default_rng(5)
    ids = rng.integers(0, 50_000, 20 * token_files.BLOCK + 7, dtype=np.uint32)
    data = token_files.write_image([1, None, 3], [5, len(ids) - 5, 0], ids)
    (tmp_path / "x.ids").write_bytes(data)
    with token_files.Image.at(f"file://{tmp_path}/x.ids") as image:
        head = image.total
        got = image.read(7 * token_files.BLOCK + 3, 7 * token_files.BLOCK + 50)
        assert got.tolist() == ids[7 * token_files.BLOCK + 3 : 7 * token_files.BLOCK + 50].tolist()
        assert head < 2000 and image.total - head < len(data) / 18
        assert [(d, at, len(x), x[:3].tolist()) for d, at, x in image.documents()] == [(1, 0, 5, ids[:3].tolist()), (None, 5, len(ids) - 5, ids[5:8].tolist()), (3, len(ids), 0, [])]
    docs = spark.createDataFrame([(k, f"word{k} " * 400, "clash") for k in range(60)], "doc_id long, text string, file string")
    files = token_files.write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), f"file://{tmp_path}/ids").collect()
    assert sum(r["n_docs"] for r in files) == 60 and all([(tmp_path / "ids" / r["file"].rsplit("/", 1)[1]).stat().st_size for r in files])


def test_extra_columns_may_have_the_names_of_results(spark):
    import public_tokenizers

    from segline.llm import byte_bpe, chat_tree, kd_shards, media, repair, whitening

    names = ["n_tokens", "ids_sha256", "media", "n_bytes", "payload_bytes", "feature", "shard", "z", "s", "l", "t", "size", "slot", "law"]
    texts = ["a b", "a b", "é\n" * 50, None, ""]
    plain = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' as lang", "'x' as source")
    wide = plain.selectExpr("*", *(f"doc_id as {n}" for n in names))
    bpe = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    for f in (lambda d: byte_bpe.round_trip(d, bpe, public_tokenizers.PATTERN), media.stored_texts, lambda d: kd_shards.shard_documents(d, shards=3)):
        assert sorted(map(tuple, f(wide).collect()), key=str) == sorted(map(tuple, f(plain).collect()), key=str)
    convs = spark.createDataFrame([(1, 0, "user", "a."), (1, 1, "assistant", "b."), (2, 0, "user", "a.")], "conv_id long, turn long, role string, text string")
    clash = convs.selectExpr("*", *(f"turn as {n}" for n in ("conv_key", "place", "step", "edit", "cost", "conv", "owner", "node", "at", "start", "seg", "runs", "salt")))
    for f in (repair.audit_conversations, lambda d: chat_tree.digests(chat_tree.read_tree(*chat_tree.format_tree(d)))):
        assert sorted(map(tuple, f(clash).collect())) == sorted(map(tuple, f(convs).collect()))
    vectors = spark.createDataFrame([(k, [float(k), float(k * k)]) for k in range(5)], "vec_id long, embedding array<double>")
    rows = lambda d: sorted(map(tuple, whitening.whiten(d).drop("identity_error").collect()))
    assert rows(vectors.selectExpr("*", "vec_id as x", "vec_id as n", "vec_id as component")) == rows(vectors)
