"""Key coverage: which sets a channel's keys open, what is missing, what to try again, what to warn of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segline.schema import SET, TRACK

#: Protection schemes that can be decrypted.
SCHEMES = ["cenc", "cbcs"]


def divide(required: DataFrame, held: DataFrame, keys=("as_id",), member="kid") -> DataFrame:
    """Relational division: keys, needed, missing (sorted members not held), covered. Two hash aggregations."""
    h = held.select(*keys, member).distinct().withColumn("_h", F.lit(True))
    rows = required.select(*keys, member).distinct().join(h, [*keys, member], "left")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("needed"), F.array_sort(F.collect_set(F.when(F.col("_h").isNull(), F.col(member)))).alias("missing"), F.bool_and(F.col("_h").isNotNull()).alias("covered"))


def _judged(protection: DataFrame, keys: DataFrame) -> DataFrame:
    """One row a set: reason (first failing), detail, missing. Clear sets have no row with a KID and no reason."""
    clear = F.col("n_tracks") == 0
    reason = F.when(clear, None).when(F.col("n_tracks") > 1, "malformed").when(~F.col("scheme").isin(*SCHEMES), "unsupported_scheme").when(F.coalesce(F.size("kids"), F.lit(0)) <= 0, "malformed")
    by_rep = protection.withColumn("_reason", reason).withColumn("_clear", clear)
    first = by_rep.groupBy(*SET).agg(F.min_by("_reason", F.when(F.col("_reason").isNotNull(), F.col("rep_id"))).alias("reason"), F.bool_and("_clear").alias("clear"))
    need = by_rep.where(~F.col("_clear")).select(*SET, F.explode("kids").alias("kid")).distinct()
    held = keys.select("channel_id", "kid").distinct().withColumn("_h", F.lit(True))
    lacking = need.join(held, ["channel_id", "kid"], "left").groupBy(*SET).agg(F.array_sort(F.collect_set(F.when(F.col("_h").isNull(), F.col("kid")))).alias("missing"))
    return first.join(lacking, SET, "left").withColumn("missing", F.coalesce("missing", F.array().cast("array<string>")))


def decryptable_sets(protection: DataFrame, keys: DataFrame) -> DataFrame:
    """K1: sets whose representations are each clear or one encrypted track of a known scheme with all keys held."""
    return _judged(protection, keys).select(*SET, (F.col("reason").isNull() & (F.size("missing") == 0)).alias("decryptable"))


def missing_kids(protection: DataFrame, keys: DataFrame) -> DataFrame:
    """K2: reason and missing KIDs of sets that do not open; another reason comes before missing keys."""
    rows = _judged(protection, keys).withColumn("reason", F.coalesce("reason", F.when(F.size("missing") > 0, "missing_key"))).where("reason is not null")
    return rows.select(*SET, "reason", F.when(F.col("reason") == "missing_key", F.col("missing")).otherwise(F.array().cast("array<string>")).alias("missing"))


def unmatched_keys(keys: DataFrame, seen: DataFrame) -> DataFrame:
    """K3: held keys that no KID seen uses, of channels where any KID was seen."""
    known = seen.select("channel_id").distinct()
    return keys.select("channel_id", "kid").distinct().join(known, "channel_id", "left_semi").join(seen.select("channel_id", "kid").distinct(), ["channel_id", "kid"], "left_anti")


def convertible_sets(stored: DataFrame, listed: DataFrame, protection: DataFrame, keys: DataFrame) -> DataFrame:
    """K4: undecided sets that have not failed, whose listed representations all have a stored init, and that K1 opens.
    stored: TRACK, has_init, decided, failed. listed: TRACK."""
    whole = listed.select(*TRACK).distinct().join(stored.where("has_init").select(*TRACK).distinct().withColumn("_s", F.lit(True)), TRACK, "left").groupBy(*SET).agg(F.bool_and(F.col("_s").isNotNull()).alias("_all")).where("_all")
    open_ = stored.groupBy(*SET).agg(F.bool_or(F.col("decided") | F.col("failed")).alias("_done")).where("not _done")
    good = decryptable_sets(protection, keys).where("decryptable")
    return open_.select(*SET).join(whole, SET, "left_semi").join(good, SET, "left_semi")


def retriable_reps(state: DataFrame, added: DataFrame) -> DataFrame:
    """K5: refused or withheld representations whose KIDs meet the added ones, or refused without KIDs recorded."""
    new = added.groupBy("channel_id").agg(F.collect_set("kid").alias("_new"))
    rows = state.where("refused or withheld").join(new, "channel_id")
    bare = F.col("refused") & (F.coalesce(F.size("kids"), F.lit(0)) <= 0)
    return rows.where(bare | F.coalesce(F.arrays_overlap("kids", "_new"), F.lit(False))).select(*TRACK)


def decrypt_warnings(protection: DataFrame, keys: DataFrame, state: DataFrame, failed: DataFrame, closed: DataFrame) -> DataFrame:
    """K6: channel_id, kind, period_id, as_id, detail (array), ordered. state: TRACK, refused, withheld;
    failed: SET of failed conversions; closed: channel_id whose playlists stay shut."""
    reps = state.where("refused or withheld").groupBy(*SET).agg(F.array_sort(F.collect_set("rep_id")).alias("reps"))
    sets = missing_kids(protection, keys).join(reps, SET, "left").select("channel_id", F.col("reason").alias("kind"), "period_id", "as_id", F.concat("missing", F.coalesce("reps", F.array().cast("array<string>"))).alias("detail"))
    seen = protection.select("channel_id", F.explode("kids").alias("kid"))
    blank = lambda c: F.lit(None).cast("string").alias(c)
    spare = unmatched_keys(keys, seen).groupBy("channel_id").agg(F.array_sort(F.collect_set("kid")).alias("detail")).select("channel_id", F.lit("key_unmatched").alias("kind"), blank("period_id"), blank("as_id"), "detail")
    none = F.array().cast("array<string>").alias("detail")
    bad = failed.select("channel_id", F.lit("conversion_failed").alias("kind"), "period_id", "as_id", none)
    shut = closed.select("channel_id", F.lit("hls_closed").alias("kind"), blank("period_id"), blank("as_id"), none)
    return sets.unionByName(spare).unionByName(bad).unionByName(shut).orderBy("channel_id", "kind", "period_id", "as_id")


def served_view(rows: DataFrame, state: DataFrame) -> DataFrame:
    """K7: manifest rows as served: decrypted sets lose protection and refused representations; a set left
    empty is gone with its last row. state: TRACK, decrypted, refused."""
    out = rows.join(state.select(*TRACK, "decrypted", "refused").dropDuplicates(TRACK), TRACK, "left")
    clear = F.coalesce("decrypted", F.lit(False))
    kept = out.where(~(clear & F.coalesce("refused", F.lit(False))))
    return kept.withColumn("protected", F.col("protected") & ~clear).drop("decrypted", "refused")


def offerings(channels: DataFrame, tracks: DataFrame) -> DataFrame:
    """K8: native and alternate output of each channel, fmp4, clear and tracks_ready.
    tracks: channel_id, media_type, ext, protected."""
    seen = tracks.groupBy("channel_id").agg(F.bool_and(~F.col("ext").isin("ts", "vtt")).alias("_fmp4"), F.bool_and(~F.col("protected")).alias("_clear"), F.lit(True).alias("_any"))
    hls = F.col("source_type") == "hls"
    rows = channels.join(seen, "channel_id", "left").withColumn("fmp4", F.coalesce("_fmp4", F.lit(False))).withColumn("clear", F.coalesce("_clear", F.lit(False))).withColumn("tracks_ready", F.coalesce("_any", F.lit(False)))
    alternate = F.when(hls & F.col("fmp4"), "dash").when(~hls & F.col("clear") & F.col("tracks_ready"), "hls")
    return rows.select("channel_id", F.when(hls, "hls").otherwise("dash").alias("native"), alternate.alias("alternate"), "fmp4", "clear", "tracks_ready")
