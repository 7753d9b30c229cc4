"""Line dedup by winnowing: window minima as guaranteed fingerprints, windows around them compared, later runs deleted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import Workspace, shuffled

#: Words of a gram, and words of a run that is found for certain and deleted (nothing shorter is).
GRAM, RUN = 25, 50
_BLANK = " \t\r"
#: White space of any kind, and whether a line holds any but single spaces.
_WHITE = r"[ \t\x0B\f\r\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
_UNEVEN = "  |" + _WHITE.replace("[ ", "[")


def _lines(base: DataFrame, run: int) -> DataFrame:
    """rid, doc_id, n (place among all lines), h (60 bits of md5), k (64 bits of xxhash), w (words, at most `run`), of lines not blank."""
    line = base.where(F.col("text").isNotNull()).select("rid", "doc_id", F.posexplode(F.split("text", "\n")).alias("n", "raw"))
    line = line.select("rid", "doc_id", "n", F.btrim("raw", F.lit(_BLANK)).alias("l")).where("l <> ''")
    spaced = F.length("l") - F.length(F.replace("l", F.lit(" "), F.lit(""))) + 1
    words = F.when(F.col("l").rlike(_UNEVEN), F.greatest(F.lit(1), F.size(F.array_remove(F.split("l", _WHITE + "+"), "")))).otherwise(spaced)
    return line.select("rid", "doc_id", "n", F.conv(F.substring(F.md5("l"), 1, 15), 16, 10).cast("long").alias("h"), F.xxhash64("l").alias("k"), F.least(words, F.lit(run)).cast("long").alias("w"))


def _hash(numbers):
    """60 bits of the md5 of an array of numbers."""
    return F.conv(F.substring(F.md5(F.array_join(numbers, ",")), 1, 15), 16, 10).cast("long")


def fingerprints(base: DataFrame, gram: int, run: int) -> DataFrame:
    """rid, doc_id, g, at, windows (wh, wk, ns): the selected grams of each document, and the windows that select each.

    s counts the words before a line, e those up to its end. A gram is a line and those after it up to `gram`
    words, g its hash. A window is the same up to `run` words, or the shortest run of `run` words that ends with a
    line; wh and wk hash its lines' h and k (124 bits in all, so unlike windows do not meet), ns are its lines. Of each window the least g of the grams that lie in it surely is selected
    (the first on ties; of the second kind, that of the window its first line opens, which lies in it). All this
    depends on the window's own lines only, so equal windows have equal g and wh. Each line opens one window at
    most and closes one. A run of at least `run` words is the union of the windows in it: a line with less than
    `run` words from it to the run's end and from the run's start to it lies in the window that the start opens.
    """
    order = Window.partitionBy("rid").orderBy("n")
    placed = _lines(base, run).withColumn("s", F.sum("w").over(order) - F.col("w")).withColumn("e", F.col("s") + F.col("w"))
    near = Window.partitionBy("rid").orderBy("s")
    grams = placed.select(
        "*",
        F.collect_list("h").over(near.rangeBetween(0, gram - 1)).alias("gram"),
        (F.sum("w").over(near.rangeBetween(0, gram - 1)) >= gram).alias("whole"),
        (F.sum("w").over(near.rangeBetween(0, run - 1)) >= run).alias("opens"),
        F.collect_list(F.struct("n", "h", "k")).over(near.rangeBetween(0, run - 1)).alias("opened"),
    )
    hashed = grams.withColumn("g", F.when(F.col("whole"), _hash("gram"))).drop("gram")
    least = hashed.withColumn("least", F.when(F.col("opens"), F.min(F.when(F.col("g").isNotNull(), F.struct("g", "s"))).over(near.rangeBetween(0, run - gram))))
    back = Window.partitionBy("rid").orderBy("e").rangeBetween(1 - run, 0)
    both = least.select(
        "rid", "doc_id", "s", "opens", "opened", "least",
        F.collect_list(F.struct("n", "h", "k")).over(back).alias("closed"), F.first("s").over(back).alias("since"), F.first("least").over(back).alias("first_least"),
    )

    def window(lines: str, by: str):
        return F.struct(F.col(by)["g"].alias("g"), F.col(by)["s"].alias("at"), _hash(F.col(lines)["h"]).alias("wh"), F.xxhash64(F.col(lines)["k"]).alias("wk"), F.col(lines)["n"].alias("ns"))

    # a window closed by a line that its first line's window ends with is that window
    closes = F.col("s") - F.col("since") >= run
    windows = both.select("rid", "doc_id", F.explode(F.array_compact(F.array(F.when(F.col("opens"), window("opened", "least")), F.when(closes, window("closed", "first_least"))))).alias("x"))
    return windows.select("rid", "doc_id", "x.*").groupBy("rid", "doc_id", "g", "at").agg(F.collect_list(F.struct("wh", "wk", "ns")).alias("windows"))


def repeated_lines(base: DataFrame, ws: Workspace, gram: int, run: int) -> DataFrame:
    """rid, n of the lines to delete. base: rid (unique), doc_id, text; documents are ordered by doc_id, rid.

    Grams at several places are the candidates. The source of each of their windows is the first place of that
    gram and window; the lines of every other place go. So each run of `run` words that stands anywhere before
    goes whole, whatever stands around the first place of its gram. A match is extended both ways by the windows
    that its grams lie in: they cover a run from end to end, however long it is. The work is linear in the lines, and a line
    that goes always has an earlier equal one, the first of which stays.
    """
    found = ws.save(fingerprints(base, gram, run), "fingerprints")
    common = ws.save(found.groupBy("g").agg(F.count(F.lit(1)).alias("places")).where("places > 1").select("g"), "grams")
    shared = ws.save(found.join(common, "g", "left_semi").select("rid", "doc_id", "g", F.explode("windows").alias("x")).select("rid", "doc_id", "g", "x.*"), "shared")
    ws.drop(found, common)
    place = F.struct(F.col("doc_id").alias("d"), F.col("rid").alias("r"), F.get("ns", F.lit(0)).alias("n"))
    first = ws.save(shared.groupBy("g", "wh", "wk").agg(F.min(place).alias("source"), F.count(F.lit(1)).alias("places")).where("places > 1").drop("places"), "first")
    later = shared.join(first, ["g", "wh", "wk"]).where(~place.eqNullSafe(F.col("source")))
    return later.select("rid", F.explode("ns").alias("n")).distinct()


def drop_repeated_runs(docs: DataFrame, *, gram: int = GRAM, run: int = RUN) -> DataFrame:
    """docs with `text` cut down, and n_lines, n_removed: later repeats of runs of `run` words or more are deleted.

    A run is made of whole lines, compared after trimming blanks; a line's words are what white space of any
    kind and number parts; a run that starts and ends inside lines is not seen. Blank lines neither match nor break a run, and stay. The first place of a run, by doc_id and place
    in the text, stays. Rows with equal or null doc_id are ordered by their place in the input (null first);
    so a repeated row loses its text like any later copy. Null text stays null, with no lines. All columns
    of docs stay, in order; columns named rid, n_lines or n_removed in docs do no harm to the work but the
    latter two are replaced. Lines deleted whole may leave an empty text.
    """
    ws = Workspace(docs.sparkSession, "lines")
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    base = ws.save(docs.select(F.struct(*kept).alias("doc"), F.monotonically_increasing_id().alias("rid")), "base")
    gone = repeated_lines(base.select("rid", F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").cast("string").alias("text")), ws, gram, run)
    # one mark a line, up to the last that goes
    sorted_n = gone.groupBy("rid").agg(F.array_sort(F.collect_list("n")).alias("ns"))
    gap = lambda x, i: x - F.when(i > 0, F.get("ns", i - 1)).otherwise(F.lit(-1)) - 1
    marks = sorted_n.select("rid", F.split(F.array_join(F.transform("ns", lambda x, i: F.concat(F.repeat(F.lit("0"), gap(x, i)), F.lit("1"))), ""), "").alias("marks"), F.size("ns").alias("removed"))
    lines = F.split("doc.text", "\n")
    cut = F.array_join(F.filter(lines, lambda x, i: F.coalesce(F.get("marks", i), F.lit("0")) == "0"), "\n")
    text = F.when(F.col("marks").isNull(), F.col("doc.text")).otherwise(cut)
    return base.join(shuffled(marks), "rid", "left").select(  # marks are strings by line, which Spark sizes as one
        *(text.alias(c) if c == "text" else F.col("doc")[c].alias(c) for c in kept),
        F.when(F.col("doc.text").isNull(), 0).otherwise(F.size(lines)).alias("n_lines"),
        F.coalesce("removed", F.lit(0)).alias("n_removed"),
    )
