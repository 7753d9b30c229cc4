"""MinHash near-duplicate detection: universal hash minima, banding, signature check, exact check, components."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, star_rounds
from .storage import FEW, Workspace, shuffled, unless_few

HASHES, ROWS, WIDTH = 128, 4, 2  # a kept minimum's bytes: its low 16 bits tell unequal ones apart but for 1 in 65536
#: Of a block of pairs compared in place: unlike nodes and the tokens of their sets (8 MB), and others that pass by.
BLOCK_ODD, BLOCK_TOKENS, BLOCK_ALL = 4096, 1 << 20, 4096
#: Standard deviations of a signature's share by which a pair may fall short.
SLACK = 7
BANDS = HASHES // ROWS
_rng = np.random.default_rng(20240607)
_MUL = (_rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_CHUNK = 4096


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; words are runs of anything but space and \\t..\\r.

    A-Z are lower-cased. Fewer words than a shingle has: the whole sequence is one. No words: empty.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    width = min(words, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):  # a polynomial over word hashes, stirred after each word
        out = (out ^ h[i : len(h) - width + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """HASHES minima of a*x+b mod 2^32 (a odd, order led by the high bits) over the set, their low 16 bits."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), _CHUNK):
        part = np.multiply.outer(_MUL, x[at : at + _CHUNK])
        part += _ADD[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return low.astype("<u2")


def _rows(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        yield from zip(*(c for c in batch.columns), strict=True)


def _out(rows, schema: pa.Schema, most: int = 2000):
    """Record batches of at most so many rows."""
    held: list = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types, strict=True)], schema=schema)


def _sketch(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n (set size), same (128-bit hash of the set), sig; same and sig null for an empty set."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("same", pa.binary()), ("sig", pa.binary())])

    def run(batches):
        def rows():
            for doc, text in _rows(batches):
                s = shingle_set(text.as_py(), words)
                yield (doc.as_py(), len(s), *((blake2b(s.tobytes(), digest_size=16).digest(), signature(s).tobytes()) if len(s) else (None, None)))

        return _out(rows(), schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, "doc_id long, n long, same binary, sig binary")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    schema = pa.schema([("node", pa.int64()), ("items", pa.binary())])

    def run(batches):
        return _out(((doc.as_py(), shingle_set(text.as_py(), words).tobytes()) for doc, text in _rows(batches)), schema, 200)

    return docs.select("doc_id", "text").mapInArrow(run, "node long, items binary")


def _alike(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b, sig_a, sig_b) whose share of equal minima is at least so much, with it as near."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("near", pa.float64())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, HASHES) for i in (2, 3))
                near = (x == y).mean(axis=1)
                keep = pa.array(near >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(near).filter(keep)], schema=schema)

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long, near double")


def _linked_blocks(blocks: DataFrame, num: int, den: int) -> DataFrame:
    """Links (u, v) in each block (key, step, mb, xb): its unlike nodes (side 0) against its others (side 1), where
    roots differ, by the sizes of intersections of full sets.

    Rows come sorted by block and side. A block's unlike sets, about BLOCK_TOKENS at most, are held as one
    sorted run of (token, which); the others pass one at a time and look their tokens up. No pair becomes a
    row unless it is a link, and two components need one link in a block.
    """
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        def found():
            block, nodes, roots, sets, index, met = None, [], [], [], None, set()
            for key, size_step, mb, xb, side, node, root, items in _rows(batches):
                at = (key.as_py(), size_step.as_py(), mb.as_py(), xb.as_py())
                if at != block:
                    block, nodes, roots, sets, index, met = at, [], [], [], None, set()
                x = np.frombuffer(items.as_buffer(), np.uint64)
                if side.as_py() == 0:
                    nodes.append(node.as_py())
                    roots.append(root.as_py())
                    sets.append(x)
                    continue
                if not nodes:
                    continue
                if index is None:
                    tokens = np.concatenate(sets)
                    which = np.repeat(np.arange(len(sets)), [len(z) for z in sets])
                    order = np.argsort(tokens, kind="stable")
                    tokens, which = tokens[order], which[order]
                    starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
                    index = (tokens[starts], np.append(starts, len(tokens)), which, np.array([len(z) for z in sets]), np.array(roots))
                keys, starts, which, sizes, own = index
                place = np.searchsorted(keys, x)
                place[place == len(keys)] = 0
                place = place[keys[place] == x]
                a, n = starts[place], starts[place + 1] - starts[place]
                hits = which[np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())] if len(n) else which[:0]
                both = np.bincount(hits, minlength=len(sizes))
                linked = (den * both >= num * (sizes + len(x) - both)) & (own != root.as_py())
                for k in np.flatnonzero(linked):
                    if (pair := (root.as_py(), roots[k])) not in met:  # one link joins two components
                        met.add(pair)
                        yield node.as_py(), nodes[k]

        return _out(found(), schema)

    block = ["key", "step", "mb", "xb"]
    return blocks.repartition(*block).sortWithinPartitions(*block, "side").select(*block, "side", "node", "root", "items").mapInArrow(run, "u long, v long")


def _having(df: DataFrame, column: str, ids: DataFrame, most: int) -> DataFrame:
    """Rows of df whose column is in ids (node, distinct, `most` at most): by broadcast if that is few, else by a shuffle."""
    named = ids.select(F.col("node").alias(column))
    return df.join(F.broadcast(named) if most <= FEW else shuffled(named), column, "left_semi")


def _blocks(spread: DataFrame, most: int, sets: DataFrame, num: int, den: int, ws: Workspace) -> DataFrame:
    """Rows (key, step, mb, xb, side, node, root, items) of the blocks of spread's buckets, see _linked_blocks()."""
    # a linked pair's sizes differ by one step at most
    step = F.floor(F.log(F.col("n").cast("double")) / float(np.log(1.001 * den / num))).cast("int")
    dealt = unless_few(spread, most, FEW).join(_having(sets, "node", spread.select("node").distinct(), most), "node").withColumn("n", F.octet_length("items") / 8).withColumn("step", step)
    unlike = dealt.where("root <> main").withColumn("step", F.explode(F.array(*(F.col("step") + i for i in (-1, 0, 1)))))
    odd = unlike.groupBy("key", "step").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_ODD, F.sum("n") / BLOCK_TOKENS)).cast("int").alias("xbs"))
    counts, n = ws.measured(dealt.groupBy("key", "step").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ALL).cast("int").alias("mbs")).join(odd, ["key", "step"]), "blocks")
    lot = lambda c: F.pmod(F.xxhash64("node", F.lit(c)), F.col(c)).cast("int")
    all_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    near = lambda side: side.join(unless_few(counts, n["n"], FEW), ["key", "step"])
    one = near(unlike).withColumn("xb", lot("xbs")).withColumn("mb", all_of("mbs")).withColumn("side", F.lit(0))
    return one.unionByName(near(dealt).withColumn("mb", lot("mbs")).withColumn("xb", all_of("xbs")).withColumn("side", F.lit(1)))


def _linked(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b, items_a, items_b) with den * intersection >= num * union on the full sets."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        def rows():
            for a, b, x, y in _rows(batches):
                p, q = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                if den * both >= num * (len(p) + len(q) - both):
                    yield a.as_py(), b.as_py()

        return _out(rows(), schema)

    return pairs.select("a", "b", "items_a", "items_b").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, *, words: int = 5, similarity_percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs (doc_id, text; others are ignored).

    Two documents are linked if the Jaccard similarity of their shingle sets reaches similarity_percent;
    component_id is the smallest doc_id reachable, kept tells whether that is the row's own.

    1. One pass makes each text's set, a hash of it and HASHES minima. Equal sets form a class; only one
       node for each class (its smallest doc_id) goes on, so copies are never expanded.
    2. Bands of ROWS minima give buckets. At 0.8 a linked pair shares none with probability 5e-8.
       A bucket pairs one node, drawn anew for each band, with each other node: linear in the bucket, and a
       node of a large group meets up to BANDS different ones.
    3. A pair whose signatures agree by SLACK standard deviations less than asked is dropped, as a linked pair does
       with probability 4e-11 at 0.8. Of the others, each node's likeliest pair is confirmed first, on full sets; then
       those that two rounds of large-star and small-star over these links have not joined. A set is made anew for the
       nodes in shared buckets only.
    4. Components by large-star and small-star. In a bucket that still spans several components, the nodes
       outside the drawn one's component (no drawn partner was like them) are compared with the bucket on
       full sets: this is the exact way for the rest. A node meets only those whose set size allows a link
       (steps of size by the similarity, its own and the two beside it), in blocks of BLOCK_TOKENS tokens of
       unlike nodes and BLOCK_ALL others. Blocks are tasks' inner loops; only links leave them, and a large
       bucket is many blocks, so its sets are shipped once for every few thousand nodes they meet. Components are
       made again only if this finds links.

    Null or blank texts: set size 0, linked with nothing. A null doc_id: component_id null, kept true,
    linked with nothing. Rows that share a doc_id are one node: they reach one another. Repeated rows,
    extra columns and empty tables need no care.
    """
    ws = Workspace(docs.sparkSession, "near")
    num, den = similarity_percent, 100
    p = num / den
    floor = p - SLACK * (p * (1 - p) / HASHES) ** 0.5
    sketch = ws.save(_sketch(docs, words), "sketch")
    named = sketch.where("doc_id is not null and n > 0")
    least = named.groupBy("same").agg(F.min("doc_id").alias("doc_id"))
    heads = ws.save(named.join(least, ["same", "doc_id"]).select(F.col("doc_id").alias("node"), "n", "same", "sig").distinct(), "heads")
    classes = heads.select("same", "node")

    size = WIDTH * ROWS
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("i")
    buckets = heads.select("node", "sig", band).select(F.xxhash64("i", F.substring("sig", F.col("i") * size + 1, F.lit(size))).alias("key"), "node")
    drawn = F.min(F.struct(F.xxhash64("key", "node").alias("h"), "node"))
    full = buckets.groupBy("key").agg(drawn["node"].alias("pivot"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi")
    # a row of heads gives BANDS of buckets, which Spark sizes as one
    in_full, full_rows = ws.measured(shuffled(buckets).join(full.select("key", "pivot", "size"), "key").select("key", "node", "pivot", "size"), "buckets")
    shared, many = ws.measured(in_full.select("node").distinct(), "shared")
    sets = ws.save(_sets(_having(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", shared, many["n"]), words).distinct(), "sets")

    def likely(pairs: DataFrame) -> tuple[DataFrame, dict]:
        sigs = _having(heads.select("node", "sig"), "node", shared, many["n"])
        sig = lambda end: sigs.select(F.col("node").alias(end), F.col("sig").alias(f"sig_{end}"))
        return ws.measured(_alike(unless_few(pairs, full_rows["n"], FEW).join(sig("b"), "b").join(sig("a"), "a"), floor), "likely")

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs, n = ws.measured(pairs.select("a", "b").distinct(), "pairs")
        if not n["n"]:
            return pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
        held = _having(sets, "node", pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), 2 * n["n"])
        items = lambda end: held.select(F.col("node").alias(end), F.col("items").alias(f"items_{end}"))
        found = _linked(unless_few(pairs, n["n"], FEW).join(items("b"), "b").join(items("a"), "a"), num, den)
        return ws.save(found.select(F.col("a").alias("u"), F.col("b").alias("v")), "links")

    def rooted(pairs: DataFrame, roots: DataFrame, most: int) -> DataFrame:
        """Pairs whose ends have different roots, of which there are so many at most."""
        of = lambda end: unless_few(roots, most, FEW).select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
        return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))

    ends = [F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")]
    alike, some = likely(in_full.where("node <> pivot").select(*ends).distinct())
    both = alike.select(F.explode(F.array("a", "b")).alias("node"), F.struct("near", "a", "b").alias("p"))
    best = both.groupBy("node").agg(F.max("p").alias("p")).select("p.a", "p.b")
    # rows that share a doc_id but not a text hold together
    mark = F.xxhash64("same")
    reused = named.groupBy("doc_id").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi")).where("lo < hi").select("doc_id")
    member = named.select("doc_id", "same").join(reused, "doc_id").distinct().join(classes, "same").select("doc_id", "node")
    again = member.join(member.groupBy("doc_id").agg(F.min("node").alias("v")), "doc_id").where("node <> v").select(F.col("node").alias("u"), "v")
    links, _, joined = star_rounds(confirmed(best).unionByName(again), ws, 2)
    reached = links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    links = links.unionByName(confirmed(rooted(alike, reached, joined).join(unless_few(best, some["n"], FEW), ["a", "b"], "left_anti")))
    roots, rows = ws.measured(components(links, ws), "roots")

    sized = in_full.where("size > 2").join(unless_few(roots, rows["n"], FEW), "node", "left").select("key", "node", "pivot", F.coalesce("root", "node").alias("root"))
    mixed = sized.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max(F.when(F.col("node") == F.col("pivot"), F.col("root"))).alias("main")).where("lo < hi")
    spread, far = ws.measured(sized.join(mixed.select("key", "main"), "key").where("node <> pivot").select("key", "node", "root", "main"), "spread")
    if far["n"]:
        more, found = ws.measured(_linked_blocks(_blocks(spread, far["n"], sets, num, den, ws), num, den).distinct(), "links")
        if found["n"]:
            roots, rows = ws.measured(components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more), ws), "roots")

    return (
        sketch.select("doc_id", "n", "same")
        .join(classes, "same", "left")
        .join(unless_few(roots, rows["n"], FEW), "node", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "node", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
