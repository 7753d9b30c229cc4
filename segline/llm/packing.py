"""Packing token sequences: exact complements by single, pair and triple sums, then best fit for what is left."""

from __future__ import annotations

from bisect import bisect_left, insort
from zlib import crc32

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import batches_of, rows
from .storage import Workspace
from .vocab import encoder

SLOT = "slot_length long, rank_from long, rank_to long, first_sequence long, offset long"


def plan_lengths(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """How often to use which combination of lengths: [(lengths of one sequence, how many such sequences)].

    counts: pieces of each length from 1 to capacity; what is planned depends on these counts alone, at
    most `capacity` numbers at any corpus size, and every piece is used. Exact complements of up to three
    parts can spend short pieces that best fit needs later, so plans with up to 3, 2, 1 and 0 parts are made
    and the one with the fewest sequences counts (of equals, that with the most parts).
    """
    plans = [_plan(counts, capacity, parts) for parts in (3, 2, 1, 0)]
    return min(plans, key=lambda plan: sum(n for _, n in plan))


def _plan(counts: dict[int, int], capacity: int, most_parts: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first, a length's gap is filled exactly by one, two or three (at most most_parts) shorter-or-equal
    lengths while counts last, the larger parts first, which leaves small lengths for other gaps; the rest goes
    by best fit, longest first."""
    left = {n: c for n, c in counts.items() if c > 0}
    plan: list[tuple[tuple[int, ...], int]] = []

    def use(parts: tuple[int, ...]) -> None:
        need = {p: parts.count(p) for p in parts}
        n = min(left.get(p, 0) // k for p, k in need.items())
        if n:
            plan.append((parts, n))
            for p, k in need.items():
                left[p] -= n * k
                if not left[p]:
                    del left[p]

    if capacity in left:
        use((capacity,))
    for size in sorted(left, reverse=True) if most_parts else ():
        gap = capacity - size
        if size in left and gap <= size:
            use((size, gap))
        have = sorted((x for x in left if x <= min(size, gap - 1)), reverse=True)
        for a in have if most_parts > 1 else ():  # pairs of the gap
            if size not in left:
                break
            if a in left and 0 < gap - a <= a and gap - a in left:
                use((size, a, gap - a))
        for i, a in enumerate(have if most_parts > 2 else ()):  # triples of it
            if size not in left:
                break
            rest = gap - a
            for b in have[i:] if a in left and 3 * a >= gap else ():
                if 2 * b < rest:
                    break
                if b < rest and rest - b in left and b in left:
                    use((size, a, b, rest - b))
                    if size not in left or a not in left:
                        break

    open_bins: dict[int, list[list]] = {}  # gap -> groups [lengths, how many]
    gaps: list[int] = []

    def put(gap: int, parts: tuple[int, ...], n: int) -> None:
        if gap not in open_bins:
            open_bins[gap] = []
            insort(gaps, gap)
        open_bins[gap].append([parts, n])

    for size in sorted(left, reverse=True):
        todo = left[size]
        while todo:
            at = bisect_left(gaps, size)
            if at == len(gaps):  # no open sequence has room: as many full stacks of this length as there are
                deep = min(capacity // size, todo)
                n = todo // deep
                put(capacity - deep * size, (size,) * deep, n)
                todo -= n * deep
                continue
            gap = gaps[at]
            group = open_bins[gap][-1]
            n = min(todo, group[1])
            group[1] -= n
            todo -= n
            if not group[1]:
                open_bins[gap].pop()
                if not open_bins[gap]:
                    del open_bins[gap]
                    gaps.remove(gap)
            put(gap - size, (*group[0], size), n)
    return plan + [(tuple(parts), n) for groups in open_bins.values() for parts, n in groups]


def slots_of(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, rank_from, rank_to, first_sequence, offset): which pieces of a length go where."""
    out, used, first = [], {}, 0
    for parts, n in plan:
        offset = 0
        for length in parts:
            at = used.get(length, 0)
            out.append((length, at, at + n, first, offset))
            used[length] = at + n
            offset += length
        first += n
    return out


def token_pieces(docs: DataFrame, path: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of each document's ids with end_id last: doc_id, piece, start, length, ids_crc32, part, nth.

    Only a document longer than capacity is cut; its first piece takes the odd rest. nth counts a task's
    pieces of equal length and part is the task, so that pieces of one length are numbered without
    gathering them; both hold once this table is written.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())])

    def run(batches):
        units, end, part, seen = encoder(path, True), end_id.to_bytes(4, "little"), TaskContext.get().partitionId(), {}

        def found():
            for doc, text in rows(batches):
                ids = units.encode(text or "") + end
                total = len(ids) // 4
                cuts = [0, *range(total % capacity or capacity, total + 1, capacity)]
                for k in range(len(cuts) - 1):
                    a, n = cuts[k], cuts[k + 1] - cuts[k]
                    nth = seen[n] = seen.get(n, -1) + 1
                    yield doc, k, a, n, crc32(memoryview(ids)[4 * a : 4 * (a + n)]), part, nth

        return batches_of(found(), schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces (length, part, nth and any others; (part, nth) numbers those of a length without repeats) with
    sequence_id and offset. The pieces table must be written, not lazy: it is read more than once.

    Only counts by length reach the driver (at most capacity numbers). The slots that come back are a few
    for each length, so broadcasting them is bounded by capacity, not by the corpus. A piece finds its
    rank as nth plus the pieces of its length in earlier parts: no window over a length's pieces.
    """
    spark = pieces.sparkSession
    by_part = pieces.groupBy("length", "part").agg(F.max("nth").alias("most"))
    before = F.sum(F.col("most") + 1).over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = by_part.select("length", "part", F.coalesce(before, F.lit(0)).alias("earlier"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = spark.createDataFrame(slots_of(plan_lengths(counts, capacity)), SLOT)
    ranked = pieces.join(offsets, ["length", "part"]).withColumn("rank", F.col("nth") + F.col("earlier"))
    where = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    return ranked.join(F.broadcast(slots), where).select(
        *(c for c in pieces.columns if c not in ("part", "nth")), (F.col("first_sequence") + F.col("rank") - F.col("rank_from")).alias("sequence_id"), "offset"
    )


def pack_documents(docs: DataFrame, path: str, *, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece of each row of docs.

    Null text: empty, one piece of one token. Null doc_id and repeated rows: packed like others.
    """
    ws = Workspace(docs.sparkSession, "pack")
    pieces = ws.save(token_pieces(docs, path, end_id, capacity), "pieces")
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
