"""Dropping few rows of a wide table without shuffling it.

What may go is told by a table of flags, whose size is bounded, for hashes of the ids that lose a row: rows that it lets
pass stay where they are, and only the others are compared exactly. The table has FLAGS_PER_KEY flags for each such id up to
MOST_FLAGS; with more ids than that it lets fewer rows pass, but the result is the same. A row of it holds BLOCK_WORDS words
of flags: the driver, which builds the broadcast, never holds a row for each word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

FLAGS_PER_KEY, LEAST_FLAGS, MOST_FLAGS = 64, 1 << 16, 1 << 26
#: Words of 64 flags in a row of the table, a power of two.
BLOCK_WORDS = 64


def flag_count(n: int) -> int:
    """A power of two, FLAGS_PER_KEY for each of n keys or more, within the bounds."""
    return min(MOST_FLAGS, max(LEAST_FLAGS, 1 << (FLAGS_PER_KEY * max(1, n) - 1).bit_length()))


def flag_table(keys: DataFrame, key: str, flags: int) -> DataFrame:
    """block, words (array of BLOCK_WORDS): at most flags / 64 / BLOCK_WORDS rows."""
    low = F.pmod(F.xxhash64(key), F.lit(flags))
    words = keys.groupBy(F.shiftright(low, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{key}`), {flags}L) & 63 as int))")).alias("bits"))
    held = words.groupBy(F.expr(f"word div {BLOCK_WORDS}").alias("block")).agg(F.map_from_entries(F.collect_list(F.struct(F.pmod("word", F.lit(BLOCK_WORDS)).cast("int").alias("at"), "bits"))).alias("held"))
    return held.select("block", F.expr(f"transform(sequence(0, {BLOCK_WORDS - 1}), i -> coalesce(held[i], 0L))").alias("words"))


def parted(docs: DataFrame, key: str, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` that may have a key of ``gone``, and those that certainly don't."""
    flags = flag_count(gone.count())
    named = [f"`{c}`" for c in docs.columns]
    bits = F.broadcast(flag_table(gone, key, flags).toDF("__block", "__words"))
    place = F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(flags))
    told = docs.join(bits, F.shiftright(place, 6 + BLOCK_WORDS.bit_length() - 1) == F.col("__block"), "left")
    hit: Column = F.coalesce(F.expr(f"shiftrightunsigned(__words[cast(shiftright(pmod(xxhash64(`{key}`), {flags}L), 6) % {BLOCK_WORDS} as int)], cast(pmod(xxhash64(`{key}`), {flags}L) & 63 as int)) & 1L"), F.lit(0)) == 1
    return told.where(hit).select(*named), told.where(~hit).select(*named)


def one_of_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key, nulls being equal; combined before anything is shuffled, so copies of a row don't meet in a task."""
    others = [c for c in rows.columns if c not in keys]
    if not others:
        return rows.distinct()
    grouped = rows.groupBy(*(F.col(f"`{k}`") for k in keys)).agg(F.first(F.struct(*(F.col(f"`{c}`") for c in others))).alias("__row"))
    return grouped.select(*(F.col(f"`{c}`") if c in keys else F.col("__row").getField(c).alias(c) for c in rows.columns))
