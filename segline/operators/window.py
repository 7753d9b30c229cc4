"""Windows, limits and set operations over segment rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segline.functions.scalars import pts_seconds
from segline.schema import PERIOD, TRACK


def project_live_window(segs: DataFrame, depth: float, safe: float, keys=tuple(TRACK), end="end_pts", timescale="timescale") -> DataFrame:
    """Rows that end within (edge - safe - depth, edge - safe] of each track's live edge.

    A depth of 0 or less, or a lower bound below 0, does not bind, and a safe of 0 or less is not subtracted; a
    safe edge of 0 or less, or an empty window, keeps the whole track.
    """
    w = Window.partitionBy(*keys)
    rows = segs.withColumn("_end", pts_seconds(end, timescale))
    rows = rows.withColumn("_edge", F.max("_end").over(w) - F.lit(float(max(safe, 0))))
    low = F.col("_edge") - F.lit(float(depth)) if depth > 0 else F.lit(-1.0)
    rows = rows.withColumn("_in", (F.col("_end") <= F.col("_edge")) & ((low < 0) | (F.col("_end") > low)))
    rows = rows.withColumn("_n", F.count_if("_in").over(w))
    return rows.where((F.col("_edge") <= 0) | (F.col("_n") == 0) | F.col("_in")).drop("_end", "_edge", "_in", "_n")


def expire(segs: DataFrame, depth: float, safe: float, keep_all: Column | bool = False, keys=tuple(PERIOD), end="end_pts", timescale="timescale") -> DataFrame:
    """Rows with `expires`: published ones that end strictly below the period's live edge less depth and
    safe, where that cutoff is positive and nothing is kept for good. A depth of 0 or less expires nothing."""
    if depth <= 0:
        return segs.withColumn("expires", F.lit(False))
    keep = F.lit(keep_all) if isinstance(keep_all, bool) else keep_all
    published = F.col("status") == "published" if "status" in segs.columns else F.lit(True)
    ends = pts_seconds(end, timescale)
    # an aggregate joined back, not a window: a period with a third of all rows never meets in one task
    cuts = segs.groupBy(*keys).agg((F.max(F.when(published, ends)) - F.lit(float(depth + safe))).alias("_cut"))
    rows = segs.join(cuts, list(keys), "left")
    return rows.select(*segs.columns, F.coalesce(published & ~keep & (F.col("_cut") > 0) & (ends < F.col("_cut")), F.lit(False)).alias("expires"))


def keep_newest(df: DataFrame, n: int | None = 120, keys=tuple(TRACK), seq="seg_no", commit="commit_ord") -> DataFrame:
    """L1: the newest n numbers of each track by first commit, each in its last state. n None: all.

    row_number <= n is pruned before the shuffle's sort is done (window group limit), so a hot track is cut to
    n rows a task before it meets in one."""
    of_number = Window.partitionBy(*keys, seq)
    # the order by commits first: the other window takes it as it is, so both share one sort
    state = df.withColumn("_k", F.row_number().over(of_number.orderBy(F.col(commit).desc()))).withColumn("_first", F.min(commit).over(of_number)).where("_k = 1")
    if n is not None:
        w = Window.partitionBy(*keys).orderBy(F.col("_first").desc(), F.col(seq).desc())
        state = state.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    return state.select(*keys, seq, *(c for c in df.columns if c not in (*keys, seq)))


def window_size(depth: Column, target: Column) -> Column:
    """Segments in a playlist: max(3, ceil(depth / target)); 0 means no cap."""
    return F.when((depth <= 0) | (target <= 0), F.lit(0)).otherwise(F.greatest(F.lit(3), F.ceil(depth / target).cast("int")))


def playlist_window(run: DataFrame, size: int | Column, keys=tuple(TRACK), seq="seg_no") -> DataFrame:
    """L2: the newest `size` rows of each track; 0: all."""
    size = F.lit(size) if isinstance(size, int) else size
    w = Window.partitionBy(*keys).orderBy(F.col(seq).desc())
    return run.withColumn("_n", F.row_number().over(w)).where((size == 0) | (F.col("_n") <= size)).drop("_n")


def presentation_order(tasks: DataFrame, priority="priority", doc_pos="doc_pos") -> DataFrame:
    """L3: one feed over all representations, by priority, then document position (a distributed range sort)."""
    return tasks.orderBy(priority, doc_pos)


def sticky_target(reloads: DataFrame, keys=tuple(TRACK), order=("reload",), longest="longest_s") -> DataFrame:
    """Ceil of the longest duration at each reload, never shrinking."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return reloads.withColumn("target", F.max(F.ceil(longest).cast("int")).over(w))


def union_expected(*dfs: DataFrame, keys=(*TRACK, "seg_no"), doc_pos="doc_pos") -> DataFrame:
    """All discovery schemes in one task table, the first listed of each key."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    rest = [c for c in out.columns if c not in keys]
    return out.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(doc_pos)).alias("_r")).select(*keys, *(F.col("_r")[c].alias(c) for c in rest))


def missing_segments(expected: DataFrame, stored: DataFrame, keys=(*TRACK, "seg_no")) -> DataFrame:
    """What is listed and not stored."""
    return expected.join(stored.select(*keys).distinct(), list(keys), "left_anti")


def known_and_stored(known: DataFrame, stored: DataFrame, keys=("channel_id", "rep_id")) -> DataFrame:
    """Known representations that have stored rows."""
    return known.join(stored.select(*keys).distinct(), list(keys), "left_semi")
