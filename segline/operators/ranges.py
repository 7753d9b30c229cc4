"""Sets of segment numbers as ranges: union, intersection and difference by one sort, numbers made only at the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segline.operators.discovery import CAP, _c, live_count, static_count
from segline.schema import TRACK


def ranges_of(rows: DataFrame, keys=tuple(TRACK), seq="seg_no") -> DataFrame:
    """keys, lo, hi of the runs of consecutive numbers; repeated numbers count once.

    One sort and no aggregation: a run's last row is the next row that closes one, and rows within a run are dropped.
    """
    w = Window.partitionBy(*keys).orderBy(seq)
    opens, closes = F.coalesce(F.col(seq) > F.lag(seq).over(w) + 1, F.lit(True)), F.coalesce(F.lead(seq).over(w) > F.col(seq) + 1, F.lit(True))
    ends = rows.select(*keys, seq).where(F.col(seq).isNotNull()).withColumn("_o", opens).withColumn("_c", closes)
    return _runs(ends, keys, seq, F.col(seq))


def _runs(rows: DataFrame, keys, at: str, last: Column) -> DataFrame:
    """keys, lo, hi of runs whose first rows are marked _o and last ones _c (a row may be both); last: hi by the last row."""
    w = Window.partitionBy(*keys).orderBy(at)
    ends = rows.where("_o or _c").withColumn("_last", last)
    return ends.withColumn("_hi", F.when(F.col("_c"), F.col("_last")).otherwise(F.lead("_last").over(w))).where("_o").select(*keys, F.col(at).alias("lo"), F.col("_hi").alias("hi"))


def numbers_of(ranges: DataFrame, seq="seg_no") -> DataFrame:
    """One row for each number of the ranges, beside their other columns."""
    return ranges.where("lo <= hi").withColumn(seq, F.explode(F.sequence("lo", "hi"))).drop("lo", "hi")


def combine(sides: list[DataFrame], keep, keys=tuple(TRACK)) -> DataFrame:
    """keys, lo, hi: the ranges of numbers for which keep(how many ranges of each side hold it) is true, abutting ones joined.

    Each range is two events: it opens at lo, and it is over at hi + 1. One sort by place and running counts tell what
    holds between two places, at the last event of a place; nothing is aggregated, so a task holds no more than its
    sort. The work follows the number of ranges, however many numbers they hold. Empty ranges (lo > hi) hold nothing; a
    side's ranges may overlap.
    """
    every = None
    for k, side in enumerate(sides):
        one = side.select(*keys, "lo", "hi", F.lit(k).alias("_side"))
        every = one if every is None else every.unionByName(one)
    return _combined(every, len(sides), keep, keys)


def _combined(rows: DataFrame, n: int, keep, keys) -> DataFrame:
    """combine of rows keys, lo, hi, _side."""
    counts = [f"_c{k}" for k in range(n)]
    at = F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("d")), F.struct((F.col("hi") + 1).alias("at"), F.lit(-1).alias("d")))).alias("e")
    events = rows.where("lo <= hi").select(*keys, "_side", at).select(*keys, "e.at", *(F.when(F.col("_side") == k, F.col("e.d")).otherwise(0).alias(c) for k, c in enumerate(counts)))
    w = Window.partitionBy(*keys).orderBy("at")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = events.select(*keys, "at", *(F.sum(c).over(so_far).alias(c) for c in counts), F.lead("at").over(w).alias("_next"))
    held = held.where("_next is null or _next > at")
    marked = held.select(*keys, "at", "_next", (F.coalesce(keep(*(F.col(c) for c in counts)), F.lit(False)) & F.col("_next").isNotNull()).alias("_k"))
    before, after = (F.coalesce(f("_k").over(w), F.lit(False)) for f in (F.lag, F.lead))
    return _runs(marked.withColumn("_o", F.col("_k") & ~before).withColumn("_c", F.col("_k") & ~after), keys, "at", F.col("_next") - 1)


def union(*sides: DataFrame, keys=tuple(TRACK)) -> DataFrame:
    every = sides[0].select(*keys, "lo", "hi")
    for side in sides[1:]:
        every = every.unionByName(side.select(*keys, "lo", "hi"))
    return combine([every], lambda a: a > 0, keys)


def intersection(a: DataFrame, b: DataFrame, keys=tuple(TRACK)) -> DataFrame:
    return combine([a, b], lambda x, y: (x > 0) & (y > 0), keys)


def difference(a: DataFrame, b: DataFrame, keys=tuple(TRACK)) -> DataFrame:
    return combine([a, b], lambda x, y: (x > 0) & (y <= 0), keys)


def ranges_by_duration(reps: DataFrame, as_of: float | Column, cap: int = CAP) -> DataFrame:
    """D1, D5 as lo and hi, see enumerate_by_duration: one row a representation."""
    now = F.lit(float(as_of)) if not isinstance(as_of, Column) else as_of
    n = F.when(F.col("presentation") == "dynamic", live_count("d", "timescale", "ast", "period_start_s", "depth_s", now)).otherwise(static_count("period_duration_s", "d", "timescale"))
    rows = reps.withColumn("_n", n).where("_n > 0")
    return rows.withColumns({"truncated": F.col("_n") > cap, "lo": F.col("start_number").cast("bigint"), "hi": F.col("start_number") + F.least("_n", F.lit(cap)) - 1}).drop("_n")


def ranges_by_timeline(reps: DataFrame, as_of: float | Column, cap: int = CAP) -> DataFrame:
    """D2, D5 as lo, hi, time of lo and duration, one row for each run-length entry: the time of a number n is
    time + (n - lo) * seg_dur. A fold over a representation's own entries, without a window or a shuffle."""
    now = F.lit(float(as_of)) if not isinstance(as_of, Column) else as_of
    count = lambda x: F.when(x["r"] < 0, live_count(x["d"], _c("timescale"), _c("ast"), _c("period_start_s"), _c("depth_s"), now)).otherwise(F.coalesce(x["r"], F.lit(0)).cast("bigint") + 1)
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("t"), F.lit(False).alias("dead"), F.lit(0).cast("bigint").alias("i"), F.array().cast("array<struct<first:bigint,n:bigint,t:bigint,d:bigint>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        n, d = F.coalesce(count(x), F.lit(0)), F.coalesce(x["d"], F.lit(0)).cast("bigint")
        dead = a["dead"] | ((F.coalesce(x["r"], F.lit(0)) < 0) & ((n <= 0) | (d <= 0)))
        t = F.when((a["i"] == 0) | (F.coalesce(x["t"], F.lit(0)) != 0), F.coalesce(x["t"], F.lit(0)).cast("bigint")).otherwise(a["t"])
        one = F.array(F.struct(a["n"].alias("first"), n.cast("bigint").alias("n"), t.alias("t"), d.alias("d")))
        return F.struct(F.when(dead, a["n"]).otherwise(a["n"] + n).cast("bigint").alias("n"), F.when(dead, a["t"]).otherwise(t + n * d).cast("bigint").alias("t"), dead.alias("dead"), (a["i"] + 1).alias("i"), F.when(dead, a["out"]).otherwise(F.concat(a["out"], one)).alias("out"))

    rows = reps.withColumn("_a", F.aggregate("timeline", zero, step))
    rows = rows.withColumn("truncated", F.col("_a.n") > cap).withColumn("_x", F.explode("_a.out")).where((F.col("_x.first") < cap) & (F.col("_x.n") > 0))
    lo = F.col("start_number") + F.col("_x.first")
    return rows.withColumns({"lo": lo, "hi": lo + F.least(F.col("_x.n"), F.lit(cap) - F.col("_x.first")) - 1, "seg_time": F.col("_x.t"), "seg_dur": F.col("_x.d")}).drop("_a", "_x", "timeline")


def to_fetch_ranges(expected: DataFrame, high_water: DataFrame, stored: DataFrame, keys=tuple(TRACK)) -> DataFrame:
    """D7 on ranges: keys, lo, hi of what to fetch, see to_fetch. expected and stored: keys, lo, hi; expected may have a
    presentation. Only the part below the high-water marks meets the stored ranges."""
    static = F.coalesce(F.col("presentation") == "static", F.lit(False)) if "presentation" in expected.columns else F.lit(False)
    marks = high_water.select(*keys, F.coalesce("last_scheduled", F.lit(-1)).cast("bigint").alias("_last"), F.coalesce("max_stored", F.lit(-1)).cast("bigint").alias("_max"))
    rows = expected.join(marks, list(keys), "left").select(*keys, "lo", "hi", static.alias("_static"), F.coalesce("_last", F.lit(-1).cast("bigint")).alias("_last"), F.coalesce("_max", F.lit(-1).cast("bigint")).alias("_max"))
    # both parts of a range from one row, so that what is expected is read once
    part = lambda side, lo, hi: F.struct(F.lit(side).alias("_side"), lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"))
    fresh = part(0, F.when(F.col("_static"), F.col("lo")).otherwise(F.greatest("lo", F.col("_last") + 1)), F.col("hi"))
    low = part(1, F.col("lo"), F.when(~F.col("_static"), F.least("hi", "_last", "_max")))
    wanted = rows.select(*keys, F.explode(F.array(fresh, low)).alias("_p")).select(*keys, "_p.lo", "_p.hi", "_p._side")
    return _combined(wanted.unionByName(stored.select(*keys, "lo", "hi", F.lit(2).alias("_side"))), 3, lambda f, x, s: (f > 0) | ((x > 0) & (s <= 0)), keys)


def missing_ranges(expected: DataFrame, stored: DataFrame, keys=tuple(TRACK)) -> DataFrame:
    """U2 on ranges: what is listed and not stored."""
    return difference(expected, stored, keys)


def gaps(stored: DataFrame, keys=tuple(TRACK)) -> DataFrame:
    """T9 on ranges: gap_start, gap_end, missing between the first and the last number held. Ranges may overlap; a gap
    lies before a range that starts behind all ranges before it, so one sort by their starts finds all."""
    w = Window.partitionBy(*keys).orderBy("lo")
    highest = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = stored.where("lo <= hi").select(*keys, "lo", (highest + 1).alias("gap_start"), (F.col("lo") - 1).alias("gap_end")).where("gap_start <= gap_end")
    return rows.select(*keys, "gap_start", "gap_end", (F.col("lo") - F.col("gap_start")).alias("missing"))
