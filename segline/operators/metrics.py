"""Counts, edges, progress, throughput, retries and delivery metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segline.functions.scalars import clean_message, pts_seconds
from segline.operators.bitmaps import count_levels, number_words
from segline.schema import CHANNEL, PERIOD, SET, TRACK

#: What names a segment that is fetched.
ATTEMPT = (*TRACK, "seg_no")
STATUSES = ["pending", "committed", "published", "expired"]
#: Upper bounds of the write-latency histogram, in seconds.
LATENCY_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]


def status_counts(segs: DataFrame, level="rep", dims: DataFrame | None = None) -> DataFrame:
    """A1: segments by status at level channel, period, set or rep; rows of dims without segments are zeros."""
    keys = {"channel": CHANNEL, "period": PERIOD, "set": SET, "rep": TRACK}[level]
    counts = segs.groupBy(*keys).agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATUSES), F.count(F.lit(1)).alias("total"))
    if dims is None:
        return counts
    return dims.select(*keys).distinct().join(counts, keys, "left").na.fill(0, [*STATUSES, "total"])


def status_rollup(segs: DataFrame) -> DataFrame:
    """A1 at all levels at once; grouped columns are null above their level, which level_no tells (0 = rep)."""
    return segs.rollup(*TRACK).agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATUSES), F.count(F.lit(1)).alias("total"), F.grouping_id().alias("level_no"))


def health_struct(counts: DataFrame) -> DataFrame:
    """A2: one row a channel: map period -> map set -> map rep -> counts."""
    nest = lambda key, value: F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(key), value))))
    entries = lambda key, value: F.map_from_entries(F.collect_list(F.struct(F.col(key), F.col(value))))
    reps = counts.groupBy(*SET).agg(nest("rep_id", F.struct(*STATUSES, "total")).alias("reps"))
    sets = reps.groupBy(*PERIOD).agg(entries("as_id", "reps").alias("sets"))
    return sets.groupBy(*CHANNEL).agg(entries("period_id", "sets").alias("periods"))


def live_edge(segs: DataFrame) -> DataFrame:
    """A3: latest end second of each period's published segments."""
    return segs.where("status = 'published'").groupBy(*PERIOD).agg(F.max(pts_seconds("end_pts", "timescale")).alias("edge_s"))


def max_numbers(segs: DataFrame, keys=tuple(TRACK)) -> DataFrame:
    """A3: highest number of each representation."""
    return segs.groupBy(*keys).agg(F.max("seg_no").alias("highest"))


def lifetime_ranges(segs: DataFrame, keys=("channel_id", "period_id", "rep_id")) -> DataFrame:
    """A4: first and last number and discontinuities of everything ever published, expired or not; what is committed only
    does not count. A rep id in two sets merges under the lowest set id. Without a status all rows count."""
    segs = segs.where("status in ('published', 'expired')") if "status" in segs.columns else segs
    marks = F.array_sort(F.collect_set(F.when(F.col("discontinuity"), F.col("seg_no"))))
    return segs.groupBy(*keys).agg(F.min("as_id").alias("as_id"), F.min("seg_no").alias("first_no"), F.max("seg_no").alias("last_no"), marks.alias("discontinuities"))


def content_duration(segs: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """A5, of published segments (of all, without a status): per timescale (latest end - earliest start) / timescale, the longest of a channel; rows without
    timescale or end do not count; the declared duration stands where nothing else does."""
    segs = segs.where("status = 'published'") if "status" in segs.columns else segs
    spans = segs.where("timescale > 0 and end_pts > 0").groupBy("channel_id", "timescale").agg(((F.max("end_pts") - F.min("start_pts")) / F.col("timescale")).alias("_s"))
    out = spans.groupBy("channel_id").agg(F.max("_s").alias("duration_s"))
    if declared is None:
        return out
    return declared.join(out, "channel_id", "left").select("channel_id", F.coalesce(F.when(F.col("duration_s") > 0, F.col("duration_s")), F.col("declared_s")).alias("duration_s"))


def expected_totals(polls: DataFrame, totals: DataFrame) -> DataFrame:
    """Expected, known, capped of each channel. totals: channel, total, capped: the largest counts, 0 does
    not. A playlist channel's total holds only if every rendition was finished on its first poll."""
    first = polls.groupBy("channel_id", "rep_id").agg(F.min_by("end_list", F.struct("poll_at", "event_id")).alias("_f"))
    done = first.groupBy("channel_id").agg((F.count_if("_f") == F.count(F.lit(1))).alias("finished"))
    best = totals.where("total > 0").groupBy("channel_id").agg(F.max("total").alias("expected"), F.bool_or("capped").alias("capped"))
    out = done.join(best, "channel_id", "left")
    return out.select("channel_id", F.when(F.col("finished"), F.col("expected")).alias("expected"), (F.col("finished") & F.col("expected").isNotNull()).alias("known"), F.coalesce("capped", F.lit(False)).alias("capped"))


def final_total(progress: DataFrame) -> DataFrame:
    """A completed channel of unknown total takes what it stored."""
    done = F.col("completed") & ~F.col("known")
    return progress.withColumn("expected", F.when(done, F.col("stored")).otherwise(F.col("expected"))).withColumn("known", F.col("known") | F.col("completed"))


def end_progress(polls: DataFrame) -> DataFrame:
    """Playlists polled and ended."""
    return polls.groupBy("channel_id").agg(F.count_distinct(F.when(F.col("end_list"), F.col("rep_id"))).alias("ended"), F.count_distinct("rep_id").alias("polled"))


def upstream_type(manifests: DataFrame) -> DataFrame:
    """The type of the last manifest."""
    return manifests.groupBy("channel_id").agg(F.max_by("type", "fetched_at").alias("upstream_type"))


def progress_counters(attempts: DataFrame, keys=ATTEMPT, order=("attempt_at", "event_id")) -> DataFrame:
    """A8 of each channel: stored (a segment, that is a number of a representation, counts once), failed attempts, dropped,
    bytes of what counted, first and last time. keys: what names a segment, the channel first."""
    ok = F.col("outcome") == "ok"
    per = attempts.groupBy(*keys).agg(
        F.bool_or(ok).cast("int").alias("stored"), F.count_if(~ok).alias("failed"), F.count_if(F.col("outcome") == "gone").alias("dropped"),
        F.min_by(F.when(ok, F.col("bytes")), F.when(ok, F.struct(*order))).alias("bytes"), F.min("attempt_at").alias("first_at"), F.max("attempt_at").alias("last_at"),
    )
    return per.groupBy(keys[0]).agg(F.sum("stored").alias("stored"), F.sum("failed").alias("failed"), F.sum("dropped").alias("dropped"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))


def progress_levels(attempts: DataFrame, keys=tuple(TRACK)) -> DataFrame:
    """A8 at every level of keys at once, without bytes: stored, failed, dropped, first and last time, and level_no as
    grouping_id. What is shuffled is a row for 64 numbers of a representation (`bitmaps`), not one for each number."""
    bad = F.col("outcome") != "ok"
    sums = {"failed": F.count_if(bad), "dropped": F.count_if(F.col("outcome") == "gone"), "first_at": F.min("attempt_at"), "last_at": F.max("attempt_at")}
    words = number_words(attempts, {"stored": F.col("outcome") == "ok"}, sums, keys)
    return count_levels(words, ["stored"], {"failed": F.sum("failed"), "dropped": F.sum("dropped"), "first_at": F.min("first_at"), "last_at": F.max("last_at")}, keys)


def error_state(attempts: DataFrame, polls: DataFrame) -> DataFrame:
    """The last failed attempt stays; a source error shows only while the latest poll failed."""
    bad = attempts.where("outcome <> 'ok'").groupBy("channel_id").agg(F.max_by(F.struct("seg_no", "outcome", F.col("attempt_at").alias("at")), F.struct("attempt_at", "event_id")).alias("segment_error"))
    last = polls.groupBy("channel_id").agg(F.max_by(F.struct("ok", "rep_id", F.col("poll_at").alias("at")), F.struct("poll_at", "event_id")).alias("_p"))
    out = last.join(bad, "channel_id", "full")
    return out.select("channel_id", "segment_error", F.when(~F.col("_p.ok"), F.struct("_p.rep_id", "_p.at")).alias("source_error"))


def delivery_counts(attempts: DataFrame) -> DataFrame:
    """A10: attempts by channel and outcome."""
    return attempts.groupBy("channel_id", "outcome").agg(F.count(F.lit(1)).alias("attempts"))


def published_counts(segs: DataFrame) -> DataFrame:
    """A10: published segments by channel and media type."""
    return segs.where("status = 'published'").groupBy("channel_id", "media_type").agg(F.count(F.lit(1)).alias("published"))


def latency_histogram(attempts: DataFrame, duration="duration_s", bounds=tuple(LATENCY_BOUNDS)) -> DataFrame:
    """A10: cumulative buckets (le), the last one unbounded, with count and sum; one aggregation, no join."""
    tops = [*bounds, float("inf")]
    one = attempts.groupBy("channel_id").agg(F.count(duration).alias("count"), F.sum(duration).alias("sum_s"), F.array(*(F.count_if(F.col(duration) <= b) for b in tops)).alias("_n"))
    return one.select("channel_id", "count", "sum_s", F.explode(F.arrays_zip(F.array(*(F.lit(float(b)) for b in tops)).alias("le"), F.col("_n").alias("n"))).alias("_z")).select("channel_id", F.col("_z.le").alias("le"), F.col("_z.n").alias("bucket_count"), "count", "sum_s")


def eta(progress: DataFrame) -> DataFrame:
    """Seconds left at the rate; null if the total is unknown or capped, all is there, or nothing moves."""
    left = F.col("expected") - F.col("stored")
    ok = F.col("known") & ~F.col("capped") & (F.col("rate") > 0) & (left > 0)
    return progress.withColumn("eta_s", F.when(ok, left / F.col("rate")))


def shortfall(progress: DataFrame) -> DataFrame:
    """A finished static ingest that stored less than expected or dropped any; not judged without a total."""
    judged = F.col("known") & ~F.col("capped") & (F.col("expected") > 0)
    return progress.withColumn("short", judged & ((F.col("stored") < F.col("expected")) | (F.col("dropped") > 0)))


def required_keys(segs: DataFrame) -> DataFrame:
    """Distinct key URIs of each channel, sorted."""
    return segs.where("key_uri is not null and key_uri <> ''").groupBy("channel_id").agg(F.array_sort(F.collect_set("key_uri")).alias("keys"))


def throughput(attempts: DataFrame, window_s: float = 30, at="attempt_at", units=("bytes",)) -> DataFrame:
    """Over (now - window, now] at each row: units since the oldest sample, that sample's own left out,
    divided by the time since it; 0 while there is no more than one instant. Every row is a sample.

    Rows are dealt by channel and stretch of time as long as the window; each row also goes to the next
    stretch, only to be counted there. So a channel with a third of all attempts is spread over time.
    """
    wide = int(window_s * 1_000_000)
    rows = attempts.withColumn("_us", F.unix_micros(F.col(at).cast("timestamp")))
    own = F.floor(F.col("_us") / wide)
    rows = rows.withColumn("_own", own).withColumn("_cut", F.explode(F.array(own, own + 1)))
    w = Window.partitionBy("channel_id", "_cut").orderBy("_us").rangeBetween(-wide + 1, Window.currentRow)
    out = rows.withColumn("_span", (F.col("_us") - F.min("_us").over(w)) / 1_000_000).withColumn("samples", F.count(F.lit(1)).over(w))
    for u in units:
        since = F.sum(u).over(w) - F.min_by(u, "_us").over(w)
        out = out.withColumn(f"{u}_per_s", F.when(F.col("_span") > 0, since / F.col("_span")).otherwise(0.0))
    return out.where("_cut = _own").drop("_us", "_own", "_cut", "_span")


def retry_schedule(attempts: DataFrame, max_retries: int = 5, keys=ATTEMPT, order=("attempt_at", "event_id"), base: Column | None = None, deadline: str | None = None) -> DataFrame:
    """Retries so far, wait = base * 2^(retries - 1) and when it ends; dropped past max_retries (0: no
    limit) or if the deadline has passed at the attempt. Failed rows only; base defaults to 2 s for fetches and 1 s for writes."""
    w = Window.partitionBy(*keys).orderBy(*order)
    base = base if base is not None else F.when(F.col("http_status") == 425, 0.5).when(F.col("outcome") == "write_error", 1.0).otherwise(2.0)
    rows = attempts.where("outcome <> 'ok'").withColumn("retries", F.row_number().over(w)).withColumn("wait_s", base * F.pow(F.lit(2.0), F.col("retries") - 1))
    rows = rows.withColumn("next_at", F.timestamp_micros(F.unix_micros(F.col("attempt_at").cast("timestamp")) + (F.col("wait_s") * 1_000_000).cast("bigint")))
    late = F.col("retries") > max_retries if max_retries else F.lit(False)
    gone = F.coalesce(F.col("outcome") == "gone", F.lit(False))
    past = F.coalesce(F.col(deadline) < F.col("attempt_at"), F.lit(False)) if deadline else F.lit(False)
    return rows.withColumn("dropped", late | past | gone)


def cdn_rotation(attempts: DataFrame, fallbacks: Column | int = 2, keys=ATTEMPT, order=("attempt_at", "event_id")) -> DataFrame:
    """url_index each attempt used: fetch failures before it (425 and write errors do not count), modulo
    the number of URLs."""
    n = F.lit(fallbacks) if isinstance(fallbacks, int) else fallbacks
    rotates = ((F.col("outcome") == "error") & (F.col("http_status") != 425)).cast("int")
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return attempts.withColumn("url_index", (F.coalesce(F.sum(rotates).over(w), F.lit(0)) % (n + 1)).cast("int"))


def split_late(df: DataFrame, at="attempt_at", deadline="deadline") -> tuple[DataFrame, DataFrame]:
    """X8 on a batch: (on time, dropped); no deadline, never late."""
    late = F.coalesce(F.col(at) > F.col(deadline), F.lit(False))
    return df.where(~late), df.where(late)


def last_messages(df: DataFrame, key="channel_id", at="at", message="message") -> DataFrame:
    """The latest message of each key, cleaned."""
    return df.groupBy(key).agg(clean_message(F.max_by(message, at)).alias("message"))
