"""Exact numbers of distinct segments at every level, from words of 64 numbers: rows are or-ed into words before a shuffle.

A word is a long with a bit for each number, so words go through hash aggregation in generated code; the built-in bitmaps
of 4 KB are binary buffers, for which Spark sorts the rows first, and are mostly empty for a representation of a period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segline.schema import SET, TRACK


def number_words(rows: DataFrame, sets: dict[str, Column | None], sums: dict[str, Column] | None = None, keys=tuple(TRACK), seq="seg_no") -> DataFrame:
    """keys, word, a bit set for each of `sets` (the numbers of rows for which its condition holds; None: of all rows) and
    aggregates `sums` of the rows behind. Number n is bit n % 64 of word floor(n / 64); negative numbers too. Rows without
    a number are in a null word, in no set, and count in sums. One shuffle, of one row a word and task."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col(seq).bitwiseAND(F.lit(63).cast("bigint")).cast("int"))
    word = F.shiftright(F.col(seq).cast("bigint"), 6).alias("word")
    aggs = [F.coalesce(F.bit_or(bit if when is None else F.when(when, bit)), F.lit(0).cast("bigint")).alias(name) for name, when in sets.items()]
    return rows.groupBy(*keys, word).agg(*aggs, *(c.alias(name) for name, c in (sums or {}).items()))


def count_levels(words: DataFrame, sets: list[str], sums: dict[str, Column] | None = None, keys=tuple(TRACK)) -> DataFrame:
    """Numbers in each set for each prefix of keys, by rollup: keys (null above their level), level_no (0: all keys; as
    grouping_id), one count a set, and aggregates `sums` of the words' own columns. A number of two representations counts twice."""
    counts = [F.sum(F.bit_count(F.col(s))).cast("bigint").alias(s) for s in sets]
    return words.rollup(*keys).agg(*counts, *(c.alias(name) for name, c in (sums or {}).items()), F.grouping_id().alias("level_no"))


def shared_numbers(words: DataFrame, name: str, within=tuple(SET), member="rep_id") -> DataFrame:
    """within, members, in_any, in_all: how many numbers any member of a set holds, and how many each of them does (what a
    player can switch at). A member without a word holds none of its numbers; members without any number do not count."""
    w = Window.partitionBy(*within, member).orderBy("word")
    held = words.where(F.col(name) != 0).withColumn("_new", (F.row_number().over(w) == 1).cast("int"))
    by_word = held.groupBy(*within, "word").agg(F.bit_or(name).alias("_any"), F.bit_and(name).alias("_all"), F.count(F.lit(1)).alias("_n"), F.sum("_new").alias("_new"))
    by_n = by_word.groupBy(*within, "_n").agg(F.sum(F.bit_count("_any")).alias("_any"), F.sum(F.bit_count("_all")).alias("_all"), F.sum("_new").alias("_new"))
    members = F.sum("_new")
    every = F.when(F.max("_n") == members, F.max_by("_all", "_n")).otherwise(0)
    return by_n.groupBy(*within).agg(members.alias("members"), F.sum("_any").alias("in_any"), every.cast("bigint").alias("in_all"))
