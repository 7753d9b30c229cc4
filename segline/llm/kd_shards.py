"""Sharding by a k-d tree over document metadata: weighted medians by bytes, native column functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import Workspace

#: Bits of a coordinate, of the text's hash below it, of the row's hash below that, and of a histogram's bin.
COORD, TEXT, ROW, STEP = 20, 28, 14, 12
BITS = COORD + TEXT + ROW
DIMENSIONS = ["by_size", "by_source", "by_lang"]
#: Shares of a shard's bytes: a cut this exact is done, and a group of equal texts that it may be moved by to stay whole.
EXACT, WHOLE = 0.001, 0.1
_BEFORE = (Window.unboundedPreceding, -1)


def _ranks(base: DataFrame, columns: dict[str, str], ws: Workspace) -> DataFrame:
    """kind, value, rank of COORD bits: the share of all bytes that lies below a column's value, in its order.
    columns: kind -> a text column.

    Values are dealt by ranges and added up range by range, so their number is not bounded by a task.
    """
    each = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(c).alias("value")) for kind, c in columns.items())))
    summed = base.select("size", each.alias("x")).groupBy("x.kind", "x.value").agg(F.sum("size").alias("w"))
    values = ws.save(summed.repartitionByRange("kind", "value").withColumn("part", F.spark_partition_id()), "values")
    parts = values.groupBy("kind", "part").agg(F.sum("w").alias("w"))  # a row a range
    earlier = parts.select("kind", "part", F.coalesce(F.sum("w").over(Window.partitionBy("kind").orderBy("part").rowsBetween(*_BEFORE)), F.lit(0)).alias("_p"), F.sum("w").over(Window.partitionBy("kind")).alias("_all"))
    inside = F.coalesce(F.sum("w").over(Window.partitionBy("kind", "part").orderBy("value").rowsBetween(*_BEFORE)), F.lit(0))
    ranked = values.withColumn("_b", inside).join(earlier, ["kind", "part"])
    return ws.save(ranked.select("kind", "value", F.floor((F.col("_p") + F.col("_b")) / F.col("_all") * ((1 << COORD) - 1)).cast("long").alias("rank")), "ranks")


def _metadata(docs: DataFrame, ws: Workspace) -> DataFrame:
    """doc_id, size, text_crc32, row and the keys along the dimensions.

    A key is a coordinate, then a hash of the text, then of the row's number: equal values (a hot source) can be
    cut anywhere, copies of a text lie next to each other, and only a large group of copies is cut inside.
    Coordinates are ranks by bytes of the size (on a log scale), of source and of lang, so that spreads along
    them compare. A group of copies takes the least source and lang of its rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    has = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("")
    size = (F.octet_length(text) + 16).cast("long")
    base = ws.save(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("t"), F.monotonically_increasing_id().alias("row"),
        F.lpad(F.floor(F.log2(size.cast("double")) * 100).cast("string"), 8, "0").alias("z"), has("source").alias("s"), has("lang").alias("l"),
    ), "metadata")
    columns = {"z": "z", "s": "s", "l": "l"}
    ranks, ranked = _ranks(base, columns, ws), base
    for kind, c in columns.items():
        ranked = ranked.join(ranks.where(F.col("kind") == kind).select(F.col("value").alias(c), F.col("rank").alias(f"{c}_rank")), c)
    ranked = ranked.withColumn("pair", F.shiftleft("s_rank", COORD) + F.col("l_rank"))
    mixed = ws.save(ranked.groupBy("text_crc32", "t").agg(F.min("pair").alias("least"), F.max("pair").alias("most")).where("least < most").drop("most"), "mixed_groups")
    ranked = ranked.join(mixed, ["text_crc32", "t"], "left").withColumn("pair", F.coalesce("least", "pair"))
    coordinate = {"by_size": F.col("z_rank"), "by_source": F.shiftright("pair", COORD), "by_lang": F.col("pair").bitwiseAND(F.lit((1 << COORD) - 1))}
    tie = F.shiftleft(F.shiftrightunsigned(F.xxhash64("t", "text_crc32"), 64 - TEXT), ROW) + F.shiftrightunsigned(F.xxhash64("row"), 64 - ROW)
    return ws.save(ranked.select("doc_id", "size", "text_crc32", "row", *((F.shiftleft(coordinate[d], TEXT + ROW) + tie).alias(d) for d in DIMENSIONS)), "keys")


def _small(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A table of numbers, a row for each node, to broadcast: literals of the plan, so that no job makes it."""
    value = lambda x, kind: f"cast({'null' if x is None else repr(x)} as {kind})"
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    lines = ", ".join("(" + ", ".join(map(value, row, kinds)) + ")" for row in rows)
    return F.broadcast(df.sparkSession.sql(f"select * from values {lines} as t({', '.join(names)})"))


def _hits(bins: DataFrame, keys: list[str]):
    """Of each of keys: its first and last bin, its bytes, and the bin in which the bytes so far reach `want`."""
    upto = F.sum("w").over(Window.partitionBy(*keys).orderBy("bin"))  # at most 2^STEP rows
    all_of = F.sum("w").over(Window.partitionBy(*keys))
    seen = bins.withColumn("upto", upto).withColumn("bytes", all_of).withColumn("goal", F.coalesce("want", F.col("bytes") * F.col("part")))
    reached = F.when(F.col("upto") >= F.col("goal"), F.col("bin"))
    return seen.groupBy(*keys).agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"), F.max("bytes").alias("bytes"), F.min_by(F.struct("bin", "w", "c", "upto"), reached).alias("b")).collect()


def shard_tree(meta: DataFrame, shards: int) -> DataFrame:
    """meta with a shard from 0 to shards - 1 whose bytes are near equal. meta is read several times: a written table.

    A node that stands for k shards is cut along its widest dimension so that the left side holds floor(k/2)/k
    of its bytes. One histogram of 2^STEP bins along all dimensions gives a level's spreads and first bins; a
    bin is refined until the cut is exact to EXACT of a shard's bytes, or a single row. A group of equal texts
    on the cut goes whole to the nearer side if it has at most WHOLE of a shard's bytes, and is cut by rows
    else. Each step is one aggregation with partial sums over all nodes of a level, whatever the number or skew
    of keys; the driver sees a few numbers for each node. Rows find their node by broadcast joins with the cuts,
    a row for each node of the level above.
    """
    key = F.get(F.array(*DIMENSIONS), F.col("dim"))
    now = meta.withColumn("node", F.shiftright(DIMENSIONS[0], BITS))  # 0, but no literal: the joins stay equi-joins
    todo, share = {0: (0, shards)}, None  # node -> its first shard, and how many it stands for
    while any(k > 1 for _, k in todo.values()):
        live = [n for n, (_, k) in todo.items() if k > 1]
        parts = _small(meta, [(n, (todo[n][1] // 2) / todo[n][1], None) for n in live], "node long, part double, want double")
        every = now.join(parts, "node").select("node", "part", "want", "size", F.posexplode(F.array(*(F.shiftright(d, BITS - STEP) for d in DIMENSIONS))).alias("dim", "bin"))
        spans: dict[int, dict[int, object]] = {n: {} for n in live}
        for r in _hits(every.groupBy("node", "part", "want", "dim", "bin").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("c")), ["node", "dim"]):
            spans[r["node"]][r["dim"]] = r
        if share is None:
            share = max((r["bytes"] for r in spans[0].values()), default=0) / shards
        cut = {}
        for n in live:
            if spans[n]:
                dim = max(sorted(spans[n]), key=lambda d: spans[n][d]["hi"] - spans[n][d]["lo"])
                r = spans[n][dim]
                cut[n] = {"dim": dim, "bits": STEP, "prefix": r["b"]["bin"], "below": r["b"]["upto"] - r["b"]["w"], "last": r["b"]["w"], "rows": r["b"]["c"], "want": r["bytes"] * (todo[n][1] // 2) / todo[n][1]}

        def open_cuts(cut=cut) -> dict:
            return {n: c for n, c in cut.items() if c["bits"] < BITS and c["rows"] > 1 and c["last"] > EXACT * share and not (c["bits"] >= COORD + TEXT and c["last"] <= WHOLE * share)}

        while at := open_cuts():
            for c in at.values():  # few rows: their texts at once
                c["step"] = COORD + TEXT - c["bits"] if c["bits"] < COORD + TEXT and c["rows"] <= 1 << STEP else min(STEP, BITS - c["bits"])
            asked = _small(meta, [(n, c["dim"], c["prefix"], float(c["want"] - c["below"]), None, BITS - c["bits"], BITS - c["bits"] - c["step"]) for n, c in at.items()], "node long, dim int, prefix long, want double, part double, wide int, fine int")
            right = lambda by: F.call_function("shiftright", key, F.col(by))
            inside = now.join(asked, "node").where(right("wide") == F.col("prefix"))
            for r in _hits(inside.groupBy("node", "part", "want", right("fine").alias("bin")).agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("c")), ["node"]):
                c, b = at[r["node"]], r["b"]
                c.update(below=c["below"] + b["upto"] - b["w"], prefix=b["bin"], bits=c["bits"] + c["step"], last=b["w"], rows=b["c"])
        lasts, after = [], {n: v for n, v in todo.items() if v[1] <= 1}
        for n in live:
            at, k = todo[n]
            after[2 * n + 1], after[2 * n + 2] = (at, k // 2), (at + k // 2, k - k // 2)
            if n in cut:
                c = cut[n]
                low = c["prefix"] << (BITS - c["bits"])
                # the bin that the cut falls on goes to the side that it leaves nearer to its share
                takes = c["want"] - c["below"] >= c["last"] / 2
                lasts.append((n, c["dim"], low + (1 << (BITS - c["bits"])) - 1 if takes else low - 1))
        if lasts:
            side = F.when(F.col("last").isNull(), F.col("node")).otherwise(2 * F.col("node") + F.when(key <= F.col("last"), 1).otherwise(2))
            now = now.join(_small(meta, lasts, "node long, dim int, last long"), "node", "left").withColumn("node", side).drop("dim", "last")
        todo = after
    leaves = _small(meta, [(n, at) for n, (at, _) in todo.items()], "node long, shard int")
    return now.join(leaves, "node").drop("node")


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: law `bytes`, a row for each row of docs.

    Size is the text's UTF-8 bytes (null: none) plus 16. Equal texts are kept together where they fit: a cut
    splits at most the one group it falls on, and only if that has more than a tenth of a shard's bytes. Apart
    from that a cut is exact to a thousandth of a shard or to a document. slot is gapless from 0 in each
    shard: rows are numbered in small lots (shard and input partition), and lots are added up, so no task
    gathers a shard. grown_shard: null. Null source, lang or doc_id: like an empty value; without such columns
    all are alike. An empty table gives an empty one; repeated rows are copies; other columns are ignored.
    """
    ws = Workspace(docs.sparkSession, "shards")
    dealt = ws.save(shard_tree(_metadata(docs, ws), shards).select("doc_id", "size", "text_crc32", "shard", "row"), "dealt")
    lots = dealt.withColumn("lot", F.shiftright("row", 33))  # the input partition: bounded by its rows
    counts = lots.groupBy("shard", "lot").agg(F.count(F.lit(1)).alias("n"))
    first = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("lot").rowsBetween(*_BEFORE)), F.lit(0))
    nth = F.row_number().over(Window.partitionBy("shard", "lot").orderBy("row"))
    return (
        lots.withColumn("nth", nth).join(counts.select("shard", "lot", first.alias("first")), ["shard", "lot"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
