"""Exact order statistics of groups, by rounds of bucket counts over the bits of the values.

A round counts the rows of each group by the next bits of their values and keeps the bucket that holds the wanted rank, so
that no task ever holds a group: only its counts, of which there are at most 2^BITS. Where a bucket has few
rows left, the rest of the bits are counted at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumage import scratch

#: Bits of a round; rows of a bucket whose remaining bits are counted at once; groups whose table is broadcast.
BITS, AT_ONCE, SMALL = 12, 1 << 14, 1 << 16

_LAST = (1 << 63) - 1


def ordered_bits(x: Column) -> Column:
    """A whole number that orders as the double x does, NaN last; zeros of either sign are alike."""
    raw = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), x.cast("double") + F.lit(0.0)).cast("long")
    return F.when(x.isNotNull(), F.when(raw < 0, raw.bitwiseXOR(F.lit(_LAST))).otherwise(raw))


def from_bits(key: Column) -> Column:
    raw = F.when(key < 0, key.bitwiseXOR(F.lit(_LAST))).otherwise(key)
    return F.java_method(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), raw).cast("double")


def order_statistics(rows: DataFrame, by: list[str], key: Column, ranks: Column, bits: int = 64, at_once: int = AT_ONCE, small: int = SMALL) -> DataFrame:
    """(by..., n, rank, key, before, same), written: for each group of n rows and each of its ranks (array<long> over n, from 0; those
    beyond n - 1 are left out), the key in that place, and how many rows of that key stand before the place and are there
    in all. key: whole numbers of so many bits, signed if 64, else not negative. Rows with a null key don't count."""
    rows = rows.select(*by, key.alias("_key")).where("_key is not null")
    shift = max(0, bits - BITS)
    counts = rows.groupBy(*by, F.shiftright("_key", shift).alias("_bucket")).agg(F.count("*").alias("same"))
    wants = F.transform(F.filter(F.array_distinct(ranks), lambda k: k < F.col("n")), lambda k: F.struct(k.cast("long").alias("rank"), k.cast("long").alias("want")))
    state = _kept(counts.withColumn("n", F.sum("same").over(Window.partitionBy(*by))).withColumn("wants", wants), by, by)
    while shift:
        most, groups = state.agg(F.max("same"), F.count("*")).first()
        then = 0 if (most or 0) <= at_once else max(0, shift - BITS)
        hit = rows.select(*by, F.shiftright("_key", shift).alias("_prefix"), F.shiftright("_key", then).alias("_bucket"))
        hit = _join(hit, state.select(*by, "_prefix"), [*by, "_prefix"], groups <= small)
        counts = hit.groupBy(*by, "_prefix", "_bucket").agg(F.count("*").alias("same"))
        state = _kept(_join(counts, state.select(*by, "n", "_prefix", "wants"), [*by, "_prefix"], groups <= small), by, [*by, "_prefix"])
        shift = then
    return state.select(*by, "n", F.explode("wants").alias("w"), F.col("_prefix").alias("key"), "same").select(*by, "n", "w.rank", "key", F.col("w.want").alias("before"), "same")


def _kept(counts: DataFrame, by: list[str], within: list[str]) -> DataFrame:
    """Of the counts by bucket, those that hold a wanted place, with the place within them; written. The window runs over the
    buckets of one prefix, not over rows."""
    upto = F.sum("same").over(Window.partitionBy(*within).orderBy("_bucket"))
    inside = F.filter("wants", lambda w: (w["want"] < F.col("_upto")) & (w["want"] >= F.col("_upto") - F.col("same")))
    moved = F.transform(inside, lambda w: F.struct(w["rank"].alias("rank"), (w["want"] - F.col("_upto") + F.col("same")).alias("want")))
    placed = counts.withColumn("_upto", upto).select(*by, "n", F.col("_bucket").alias("_prefix"), moved.alias("wants"), "same")
    return scratch.written(placed.where(F.size("wants") > 0))


def _join(left: DataFrame, right: DataFrame, on: list[str], small: bool) -> DataFrame:
    """Inner join with nulls alike, the right side by broadcast where it is known to be small."""
    right = right.select(*[F.col(c).alias(f"_r{c}" if c in on else c) for c in right.columns])
    same = None
    for c in on:
        one = F.col(c).eqNullSafe(F.col(f"_r{c}"))
        same = one if same is None else same & one
    return left.join(F.broadcast(right) if small else right, same).drop(*[f"_r{c}" for c in on])


def medians(rows: DataFrame, by: list[str], x: Column, bounded: bool = False, at_once: int = AT_ONCE) -> DataFrame:
    """(by..., median): the middle value of each group, or half way between the two. bounded: the caller knows that no group has
    more than AT_ONCE rows, so that one task may hold one."""
    if bounded:
        return rows.groupBy(*by).agg(F.median(x).alias("median"))
    middle = F.array(F.expr("(n - 1) div 2"), F.expr("n div 2"))
    found = order_statistics(rows, by, ordered_bits(x), middle, at_once=at_once).withColumn("x", from_bits(F.col("key")))
    return found.groupBy(*by).agg((F.min("x") / 2 + F.max("x") / 2).alias("median"))
