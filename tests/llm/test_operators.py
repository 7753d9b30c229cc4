"""The corpus operators against brute force, libraries and round trips, on small tables."""

from __future__ import annotations

import base64
import bisect
import random
import zlib
from bisect import insort
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from segline.llm import ann, byte_bpe, kd_shards, license_scan, line_dedup, media, near_dedup, packing, quality_rules, token_files
from segline.llm.components import components
from segline.llm.storage import Workspace
from segline.llm.vocab import UnitEncoder

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n", "one", "a  b", " lead", "tail ", "a \n b", "It's 'fine', don't", "é ́a ² ½", "12345 678.9", "x\ty\x1cz", "<|endoftext|> x", "a<|startoftext|>b <|ENDOFTEXT|>", "日本 語。\nテ", "!!. ...", "ΣΑΣ Σ İ", "​ a ​ b", "word " * 3000, "z" * 5000, "a b c", "x--y--", "_a_ a'b's"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, n long, g string, length long, score double"


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def odd_docs(spark, extra=()):
    texts = [*ODD, *extra]
    rows = [(i, t, None, None, None, "r", 7, "g", 3, 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5], (None, "null id here", "en", "s", 1, "r", 7, "g", 3, 0.5), rows[13]], DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def jaccard_components(texts: dict, words: int):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset([tuple(w)] if 0 < len(w) < words else [tuple(w[i : i + words]) for i in range(len(w) - words + 1)] if w else [])

    sets = {d: shingles(t) for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize(("words", "small"), [(2, False), (5, False), (2, True)])
def test_near_duplicates_equal_brute_force(spark, real, words, small, monkeypatch):
    if small:  # every bucket that spans components is many blocks, and no join is a broadcast
        for name, value in {"BLOCK_ODD": 3, "BLOCK_TOKENS": 400, "BLOCK_ALL": 5, "FEW": 0}.items():
            monkeypatch.setattr(near_dedup, name, value)
    rng = random.Random(3)
    texts = {r["doc_id"]: r["text"] for r in real.select("doc_id", "text").collect()}
    base = [rng.choice(["ab", "cd", "ef", "gh", "ij", "kl"]) + str(rng.randrange(60)) for _ in range(120)]
    for k in range(60):  # one large group whose members drift apart, so its smallest member is not like all
        base = list(base)
        base[rng.randrange(len(base))] = f"new{k}"
        texts[10_000 + k] = " ".join(base)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df, words=words).collect()}
    assert got == jaccard_components(texts, words)


def test_near_duplicates_odd_rows(spark):
    rows = near_dedup.near_duplicates(odd_docs(spark), words=2).collect()
    assert len(rows) == len(ODD) + 3
    assert [(r["component_id"], r["kept"]) for r in rows if r["doc_id"] is None] == [(None, True)]
    assert all(r["component_id"] == r["doc_id"] for r in rows if r["n_shingles"] == 0 and r["doc_id"] is not None)
    assert near_dedup.near_duplicates(empty_docs(spark)).count() == 0
    shared = spark.createDataFrame([(5, "a b c d"), (5, "q r s t"), (3, "q r s t"), (9, "A B c d")], "doc_id long, text string")
    assert {r["component_id"] for r in near_dedup.near_duplicates(shared, words=2).collect()} == {3}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, k) for k in range(200, 260)] + [(260, 259), (5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long"), Workspace(spark, "t")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {k: 7 for k in [7, *range(200, 261)]}
    assert components(spark.createDataFrame([], "u long, v long"), Workspace(spark, "t")).count() == 0


def brute_nearest(vectors, k=20, every=20):
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids], np.float64)
    out = {}
    for i, q in zip(ids.tolist(), x, strict=True):
        if i % every == 0 and len(ids) > 1:
            s = np.add.accumulate(x * q, axis=1)[:, -1]
            best = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in best]
    return out


def found_by(df, **options):
    got = defaultdict(list)
    for r in sorted(ann.nearest(df, **options).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return dict(got)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_ann_finds_the_nearest_of_all(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    got, want = found_by(df), brute_nearest({r["vec_id"]: r["embedding"] for r in df.collect()})
    assert set(got) == set(want) and all([len(got[q]) == len(want[q]) for q in want])
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.98
    exact = {q: dict(found) for q, found in want.items()}
    assert all(exact[q].get(v, s) == s for q, found in got.items() for v, s in found)


def clustered(n, width=24, centres=12, seed=1):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((centres, width)) * 6
    return c[rng.integers(centres, size=n)] + rng.standard_normal((n, width)) * 0.5


@pytest.mark.parametrize("n", [1, 2, 20, 21, 22, 60])
def test_ann_gives_all_that_exist(spark, n):
    for x in (np.random.default_rng(n).standard_normal((n, 6)), clustered(n))[n in (21, 60) :]:
        df = spark.createDataFrame([(i, v.tolist(), 1, 2, 3, [4]) for i, v in enumerate(x)], "vec_id long, embedding array<double>, list int, bin int, v int, asked array<int>")
        got = found_by(df)
        assert {q: len(f) for q, f in got.items()} == {q: min(20, n - 1) for q in range(0, n, 20) if n > 1}
        if n in (22, 60):
            assert found_by(df, slack=float("inf")) == brute_nearest(dict(enumerate(x)))


def test_ann_on_clusters_large_lists_and_lots(spark, monkeypatch):
    monkeypatch.setattr(ann, "CHUNK", 50)
    monkeypatch.setattr(ann, "QUERY_CHUNK", 7)
    x = np.concatenate([clustered(2500), np.tile(clustered(1, seed=5), (900, 1))])  # one vector 900 times
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got, want = found_by(df), brute_nearest(dict(enumerate(x)))
    assert {q: len(f) for q, f in got.items()} == dict.fromkeys(want, 20)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.95 * 20 * len(want)
    assert [got[q] == want[q] for q in want if q >= 2500].count(False) == 0
    assert ann._bins(np.array([3, 60, 10, 45, 0, 120])) == [(0, 1), (1, 2), (3, 1), (4, 1), (4, 1), (5, 3)]


def test_ann_ties_odd_vectors_and_few_candidates(spark):
    inf = float("inf")
    rows = [(i, [1.0, 2.0]) for i in range(30)] + [(40, None), (60, [0.0, 0.0]), (80, [inf, 1.0]), (100, [None, 1.0]), (120, [1.0]), (None, [1.0, 1.0]), (3, [1.0, 2.0]), (140, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(df).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in got if r["query_id"] == 0] == list(range(1, 21))
    assert [r["vec_id"] for r in got if r["query_id"] == 20] == list(range(20))
    few = ann.nearest(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in few] == [(0, 1, 1, 2.0)]
    assert ann.nearest(df.limit(0)).count() == 0


def test_license_words_places_and_templates(spark):
    texts = ["Licensed under CC BY-NC 4.0.", "CC-BY cc by cc by! GENERAL PUBLIC license", "Released under the MIT License.", "Copyright (c) 2020 A. Person\nAll rights reserved", "licensed under the GNU Lesser General Public License as published by the Free Software Foundation, either version 3", "all rights", "licensed under the mit licence"]
    got = {r["doc_id"]: r for r in license_scan.scan(odd_docs(spark, texts)).collect()}
    n = len(ODD)
    pick = lambda i: (got[n + i]["n_base"], got[n + i]["first_word"], got[n + i]["last_word"], got[n + i]["base_labels"], got[n + i]["labels"])
    assert pick(0) == (1, 2, 2, "cc-by", "cc-by,cc-by-nc-4.0")
    assert pick(1) == (4, 0, 6, "cc-by,gpl", "cc-by,gpl")
    assert pick(2) == (0, None, None, "", "mit")
    assert pick(3) == (1, 5, 5, "reserved", "copyright-reserved,reserved")
    assert pick(4) == (1, 5, 5, "gpl", "gpl,gpl-3.0")
    assert pick(5) == pick(6) == (0, None, None, "", "")
    assert got[0]["score"] == 0 and got[n]["score"] == 1.0 and got[0]["n_words"] == 0
    assert license_scan.scan(empty_docs(spark)).count() == 0


def test_automaton_regions():
    a = license_scan.Automaton("grant <<opt>>all <<opt>>worldwide<</opt>> rights<</opt>> of <<var 1-2>> use")
    hit = lambda t: a.match(license_scan.words_of(t), 0)
    assert hit("grant of free use") == 4 and hit("grant all rights of free and use") == 7 and hit("grant all worldwide rights of x use") == 7
    assert hit("grant worldwide of x use") == hit("grant of use") == hit("grant of a b c use") == 0
    for bad in ("<<opt>>only<</opt>>", "a <<opt>>b", "<<var 1-2>> a"):
        with pytest.raises((ValueError, IndexError)):
            license_scan.Automaton(bad)


def ranks_of(path):
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}


def test_byte_bpe_equals_the_library(spark, real):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_of(path), special_tokens={})
    df = odd_docs(spark).select("doc_id", "text").unionByName(real.select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))
    texts = Counter((r["doc_id"], r["text"]) for r in df.collect())
    want = Counter()
    for (d, t), n in texts.items():
        ids = library.encode_ordinary(t or "")
        want[d, len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256((t or "").encode()).hexdigest()] += n
    assert Counter(map(tuple, byte_bpe.round_trip(df, path, public_tokenizers.PATTERN).collect())) == want
    back = byte_bpe.decode(byte_bpe.encode(df, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in back.collect())
    assert byte_bpe.round_trip(empty_docs(spark), path, public_tokenizers.PATTERN).count() == 0


def test_merge_piece_takes_the_leftmost_of_equal_ranks():
    ranks = {bytes([i]): i for i in range(256)} | {b"aa": 256, b"ab": 257, b"aaa": 258}
    assert byte_bpe.merge_piece(b"aaaaa", ranks) == [256, 256, 97] or byte_bpe.merge_piece(b"aaaaa", ranks) == [256, 258]
    rng, library = random.Random(5), tiktoken.Encoding("t", pat_str=r"[ab]+", mergeable_ranks=ranks, special_tokens={})
    for n in range(1, 40):
        piece = "".join(rng.choice("ab") for _ in range(n))
        assert byte_bpe.merge_piece(piece.encode(), ranks) == library.encode_ordinary(piece)


@pytest.mark.parametrize(("name", "keeps"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_unit_encoder_equals_the_library(real, name, keeps):
    library = Tokenizer.from_file(public_tokenizers.path(name))
    units = UnitEncoder(public_tokenizers.path(name), keeps, most=500)
    for t in [t or "" for t in ODD] + [r["text"] for r in real.collect()]:
        assert np.frombuffer(units.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t[:80]


@pytest.mark.parametrize("docs", ["odd", "real", "empty"])
def test_shards_hold_near_equal_bytes(spark, real, docs):
    df = {"odd": odd_docs(spark), "real": spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "empty": empty_docs(spark)}[docs]
    got = kd_shards.shard_documents(df).collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in df.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots, sizes = defaultdict(list), Counter()
    for r in got:
        assert 0 <= r["shard"] < 40 and r["law"] == "bytes" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if docs == "real":
        mean, most = sum(sizes.values()) / 40, max(r["size"] for r in got)
        assert all(abs(sizes[k] - mean) <= 1.5 * most for k in range(40))
        where, copies = defaultdict(set), Counter()
        for r in got:
            where[r["text_crc32"], r["size"]].add(r["shard"])
            copies[r["text_crc32"], r["size"]] += 1
        groups = [k for k, n in copies.items() if n > 1]
        assert len(groups) > 50 and sum(len(where[k]) > 1 for k in groups) <= 0.1 * len(groups)


def plain_tree(rows, shards):
    """The k-d tree by hand: rows of (key along each dimension, size); cut where the left side's bytes come nearest."""
    if shards == 1:
        return {k: 0 for k in range(len(rows))}
    out, todo, top = {}, [(list(range(len(rows))), 0, shards)], kd_shards.BITS - kd_shards.STEP
    while todo:
        part, first, k = todo.pop()
        if k == 1:
            out.update(dict.fromkeys(part, first))
            continue
        dim = max(range(3), key=lambda d: max((rows[i][0][d] >> top for i in part), default=0) - min((rows[i][0][d] >> top for i in part), default=0))
        part.sort(key=lambda i: rows[i][0][dim])
        want, sums = sum(rows[i][1] for i in part) * (k // 2) / k, [0]
        for i in part:
            sums.append(sums[-1] + rows[i][1])
        cut = min(range(len(sums)), key=lambda j: (abs(sums[j] - want), -j))
        todo += [(part[:cut], first, k // 2), (part[cut:], first + k // 2, k - k // 2)]
    return out


def test_shard_tree_equals_a_plain_one(spark):
    rng = random.Random(8)
    rows = [(tuple(rng.choice([rng.randrange(1 << 20), 5, 700_000]) << 42 | rng.randrange(1 << 42) for _ in range(3)), rng.randrange(17, 900)) for _ in range(700)]
    meta = spark.createDataFrame([(i, size, *keys) for i, (keys, size) in enumerate(rows)], "doc_id long, size long, by_size long, by_source long, by_lang long")
    for shards in (1, 2, 7, 40):
        got = {r["doc_id"]: r["shard"] for r in kd_shards.shard_tree(meta, shards).collect()}
        assert got == plain_tree(rows, shards), shards


def test_large_groups_of_copies_are_cut_and_small_ones_kept(spark):
    texts = ["hot copy " * 30] * 900 + [f"own text {i} " * (i % 40 + 1) for i in range(900)] + [f"pair {i // 3} " * 20 for i in range(300)]
    df = spark.createDataFrame([(i, t, f"s{i % 11}", "de" if i % 3 else "fr") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    got = kd_shards.shard_documents(df, 20).collect()
    sizes, where = Counter(), defaultdict(set)
    for r in got:
        sizes[r["shard"]] += r["size"]
        where[texts[r["doc_id"]]].add(r["shard"])
    mean = sum(sizes.values()) / 20
    assert max(sizes.values()) < 1.1 * mean and min(sizes.values()) > 0.9 * mean
    assert len(where[texts[0]]) >= 5 and sum(len(x) > 1 for t, x in where.items() if t != texts[0]) == 0


def test_line_dedup_equals_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(2)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage = [line(9) for _ in range(9)]
    extra = [(5000 + k, "\n".join([line(6), *passage, line(7)])) for k in range(4)]
    extra += [(6000, "\n".join(passage[:3])), (6001, "\n".join(["x y"] * 300)), (6002, None), (6003, ""), (6004, line(60)), (6005, line(20))]
    docs = sorted([(r["doc_id"], r["text"]) for r in df.collect()] + extra)
    all_docs = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_removed", F.lit("mine"))
    got = {r["doc_id"]: r for r in line_dedup.drop_repeated_runs(all_docs).collect()}
    want = dict(zip([d for d, _ in docs], rule_lines(docs), strict=True))
    assert {d: r["text"] for d, r in got.items()} == want
    assert got[5000]["n_removed"] == 0 and got[5001]["n_removed"] == 9 and got[6000]["text"] == "\n".join(passage[:3])
    assert got[6001]["text"].count("x y") < 60


def rule_lines(docs, run=50):
    """Every line in a run of whole lines of `run` words or more that stands earlier goes: docs are (order, text)
    in order. Runs are followed from each pair of equal lines, the definition and no more."""
    where, at = defaultdict(list), []
    for d, (_, text) in enumerate(docs):
        lines = [(n, x.strip(" \t\r")) for n, x in enumerate((text or "").split("\n"))]
        at.append([(n, x, len(x.split())) for n, x in lines if x])
        for k, (_, x, _) in enumerate(at[-1]):
            where[x].append((d, k))
    gone = defaultdict(set)
    for places in where.values():
        for m, (b, j) in enumerate(places):
            for a, i in places[:m]:
                if i and j and at[a][i - 1][1] == at[b][j - 1][1]:
                    continue  # the run begins earlier
                r = 0
                while i + r < len(at[a]) and j + r < len(at[b]) and at[a][i + r][1] == at[b][j + r][1]:
                    r += 1
                if sum(w for *_, w in at[b][j : j + r]) >= run:
                    gone[b] |= {n for n, *_ in at[b][j : j + r]}
    return [None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[d]) for d, (_, t) in enumerate(docs)]


def test_line_dedup_finds_runs_whatever_the_first_place_holds(spark):
    rng = random.Random(6)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    block = lambda words, most: [line(rng.randint(1, most)) for _ in range(words)]
    docs = []
    for _ in range(60):  # A = H + X, B = H + Y, C = H + Y
        h, x, y = (block(n, 9) for n in (6, 5, 5))
        docs += [[*h, *x], [*h, *y], [*h, *y]]
    for _ in range(60):  # the same in front, around and longer, with own lines and blank ones between
        h, x, y, z = (block(rng.randint(2, 14), rng.choice([3, 9, 20])) for _ in range(4))
        docs += [[*x, *h], [*y, *h, *z], [line(3), *y, "", *h, *z, line(4)], [*x, *h, *z], [*h, *h, *z]]
    docs += [[line(30), "x y", "x y", line(60)], ["x y"] * 90, [line(49), "one"], ["one", line(49)]]
    docs = [(k, "\n".join(x)) for k, x in enumerate(docs)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_runs(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [got[k] for k, _ in docs] == rule_lines(docs)
    h, x, y = (line(10) + "\n" + line(n - 10) for n in (30, 25, 25))
    three = spark.createDataFrame([(1, f"{h}\n{x}"), (2, f"{h}\n{y}"), (3, f"{h}\n{y}")], "doc_id long, text string")
    assert [r["n_removed"] for r in line_dedup.drop_repeated_runs(three).orderBy("doc_id").collect()] == [0, 0, 4]


def test_line_dedup_odd_rows(spark):
    df = odd_docs(spark)
    out = line_dedup.drop_repeated_runs(df)
    assert [c for c in out.columns if c not in ("n_lines", "n_removed")] == df.columns and out.count() == df.count()
    assert line_dedup.drop_repeated_runs(empty_docs(spark)).count() == 0


def test_media_round_trip_and_boxes(spark, real):
    rng = random.Random(1)
    for n in (64, 1024, 1088, 16 * 1024, 16 * 1024 + 64, 40_000):
        payload = rng.randbytes(n)
        data = media.write_container(payload)
        (track,) = media.tracks(data)
        assert media.payload_of(data) == payload
        assert (track.codec, track.scale, track.duration) == ("raw ", media.RATE, n)
        assert sum(a * b for a, b in track.times) == n and sum(c for c, _ in track.times) == len(track.sizes)
        assert [data[a:b] for a, b in track.keyframe_ranges()] == [payload[k : k + 1024] for k in range(0, n, 16 * 1024)]
    df = odd_docs(spark).select("doc_id", "text").unionByName(real.select("doc_id", "text"))
    want = Counter()
    for r in df.collect():
        raw = (r["text"] or "").encode()
        p = raw + bytes(-len(raw) % 64 if raw else 64)
        m = media.write_container(p)
        want[r["doc_id"], len(raw), len(p), sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), sha256(m).hexdigest(), media.feature_of(m)] += 1
    assert Counter(map(tuple, media.stored_texts(df).collect())) == want
    assert media.stored_texts(empty_docs(spark)).count() == 0
    torn = spark.createDataFrame([(bytearray(media.write_container(bytes(64))),), (bytearray(b"\0\0\0\x40moovxx"),), (None,)], "media binary")
    assert [(len(r["media_tracks"]), r["media_error"] is None) for r in media.media_facts(torn).collect()] == [(1, True), (0, False), (0, False)]


@pytest.mark.parametrize("bits", [1, 8])
def test_token_images_round_trip(bits):
    rng = np.random.default_rng(3)
    for n in (0, 1, token_files.BLOCK, token_files.BLOCK + 5):
        ids = rng.integers(0, 1 << 17, n).astype("<u4")
        image = token_files.Image.of(token_files.write_image([4, None], [n, 0], ids, bits))
        assert image.read(0, n).tolist() == ids.tolist() and image.doc_ids == [4, None]
        assert image.read(n // 2, n).tolist() == ids[n // 2 :].tolist()


def test_token_files_on_disk(spark, real):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    df = odd_docs(spark).where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text").unionByName(real.select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    want, at = [], 0
    for r in sorted(df.collect()):
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, token_files.tokens_on_disk(df, path).collect())) == want
    rows = token_files.tokens_on_disk(odd_docs(spark), path).orderBy("start").collect()
    assert rows[0]["doc_id"] is None and [r["start"] for r in rows[1:]] == np.cumsum([r["n_tokens"] for r in rows[:-1]]).tolist()
    assert token_files.tokens_on_disk(empty_docs(spark), path).count() == 0


def auc(scores, labels):
    pos, neg = [s for s, y in zip(scores, labels, strict=True) if y], [s for s, y in zip(scores, labels, strict=True) if not y]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = quality_rules.score_documents(docs, labels)
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert auc([r["score"] for r in rows], [r["quality"] for r in rows]) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert out.count() == docs.count()


def test_quality_odd_rows_and_labels(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(3, None, 0), (None, 1, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality_rules.score_documents(odd_docs(spark), labels).count() == len(ODD) + 3
    assert {r["score"] for r in quality_rules.score_documents(odd_docs(spark), labels.limit(0)).collect()} == {0.5}
    assert quality_rules.score_documents(empty_docs(spark), labels).count() == 0


def test_rules_follow_tree_paths():
    text = "Tree 0 (weight 1.0):\n    If (feature 3 <= 0.5)\n     If (feature 1 > 2.0)\n      Predict: 1.0\n     Else (feature 1 <= 2.0)\n      Predict: 0.0\n    Else (feature 3 > 0.5)\n     Predict: 1.0\n"
    a, b = quality_rules.STATISTICS[3], quality_rules.STATISTICS[1]
    want = {((a, True, 0.5),), ((a, False, 0.5),), tuple(sorted([(a, True, 0.5), (b, False, 2.0)])), tuple(sorted([(a, True, 0.5), (b, True, 2.0)]))}
    assert {r.tests for r in quality_rules.tree_rules(text)} == want


def best_fit_decreasing(counts, capacity):
    """Sequences that plain best fit takes, one piece after another, longest first."""
    free = []
    for size in sorted(Counter(counts).elements(), reverse=True):
        at = bisect.bisect_left(free, size)
        insort(free, (free.pop(at) if at < len(free) else capacity) - size)
    return len(free)


def test_plan_uses_every_piece_and_fills(spark):
    rng = random.Random(4)
    for kind in (lambda: rng.randint(1, 1024), lambda: rng.choice([600, 424, 300, 124, 1024]), lambda: rng.randint(400, 600), lambda: 700):
        counts = Counter(kind() for _ in range(5000))
        plan = packing.plan_lengths(counts, 1024)
        used = Counter()
        for parts, n in plan:
            assert sum(parts) <= 1024 and n > 0
            for p in parts:
                used[p] += n
        assert used == counts
        assert sum(n for _, n in plan) >= -(-sum(k * v for k, v in counts.items()) // 1024)
        plain = packing._plan(counts, 1024, 0)
        assert sum(n for _, n in plan) <= sum(n for _, n in plain)
    every = Counter({n: random.Random(n).randint(1, 40) for n in range(1, 1025)})
    assert sum(n for _, n in packing.plan_lengths(every, 1024)) <= best_fit_decreasing(every, 1024)
    assert packing.plan_lengths({600: 3, 424: 3}, 1024) == [((600, 424), 3)]
    assert packing.plan_lengths({}, 1024) == []


@pytest.mark.parametrize("docs", ["odd", "real", "empty"])
def test_packing(spark, real, docs):
    df = {"odd": odd_docs(spark), "real": real, "empty": empty_docs(spark)}[docs]
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = Counter()
    for r in df.collect():
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[r["doc_id"], k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    got = packing.pack_documents(df, path).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    rows = defaultdict(list)
    for r in got:
        rows[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in rows.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    total = sum(r["length"] for r in got)
    assert len(rows) <= -(-total // 1024) + 1 + 0.05 * len(rows)
