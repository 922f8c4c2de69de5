"""Exact samples and counts by batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumage import scratch
from plumage.operators import selection


def integer_hash(key: Column, seed: int = 42) -> Column:
    """A spread of whole numbers that any SQL engine can repeat."""
    prime = F.lit(2147483647).cast("long")  # keys are reduced first, as large ones times a factor leave 64 bits
    mixed = F.pmod(F.pmod(key.cast("long"), prime) * 1103515245 + seed * 12345, prime)
    return F.pmod(mixed * 48271 + seed, prime)


def exact_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows without replacement, or all if there are no more: those of the least hashes, ties by key, a missing key first; of
    rows with one key any. The n-th hash is found by counts (see selection) and the rest is a filter, so no task gets
    n rows however large n is."""
    if n < 1:
        return df.limit(0)
    h = F.coalesce(integer_hash(F.col(key), seed), F.lit(0).cast("long"))
    cut = selection.order_statistics(df, [], h, F.array(F.lit(n - 1)), bits=31).first()  # one row
    if cut is None:
        return df
    if cut["before"] + 1 == cut["same"]:
        return df.where(h <= cut["key"])
    return df.where(h < cut["key"]).unionByName(_first(scratch.written(df.where(h == cut["key"])), cut["before"] + 1, key))


def _first(tied: DataFrame, n: int, key: str) -> DataFrame:
    """n rows of a written table of one hash, by key: whole keys, then as many rows of the next key as are left, by files and
    their places in them."""
    w = Window.orderBy(key)  # a row for each key of one hash
    keys = tied.groupBy(key).agg(F.count("*").alias("_n")).withColumn("_left", F.lit(n) - F.sum("_n").over(w) + F.col("_n")).where("_left > 0")
    keys = scratch.written(keys.select(F.col(key).alias("_k"), "_n", "_left"))
    whole = tied.join(F.broadcast(keys.where("_left >= _n").select("_k")), F.col(key).eqNullSafe(F.col("_k")), "left_semi")
    place = tied.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    part = place.join(F.broadcast(keys.where("_left < _n").select("_k", "_left")), F.col(key).eqNullSafe(F.col("_k")))  # one key at most
    files = part.groupBy("_file").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_file")) - F.col("_n"))  # a row a file
    turn = F.row_number().over(Window.partitionBy("_file").orderBy("_at"))
    part = part.join(F.broadcast(files.select("_file", "_before")), "_file").where(F.col("_before") < F.col("_left"))
    return whole.unionByName(part.withColumn("_turn", turn + F.col("_before")).where(F.col("_turn") <= F.col("_left")).select(tied.columns))


def patches_per_batch(df: DataFrame, batch: str, valid: str) -> DataFrame:
    """(batch, n): valid patches of each batch that has any."""
    n = F.sum(F.size(F.filter(valid, lambda x: x)))
    return df.groupBy(batch).agg(n.cast("long").alias("n")).where("n > 0")


def batch_ranges(counts: DataFrame, batch: str) -> DataFrame:
    """(batch, start, stop): the range of row numbers of each batch, from a table of one row per batch."""
    w = Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn("stop", F.sum("n").over(w)).select(batch, (F.col("stop") - F.col("n")).alias("start"), "stop")


def rows_in_ranges(rows: DataFrame, ranges: DataFrame, index: str, width: int = 1 << 16) -> DataFrame:
    """rows with the range that holds their index, by an equality join on buckets of `width` numbers; a range is a row in
    every bucket it touches."""
    bucket = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("stop") - 1) / width)))
    ranges = ranges.where("stop > start").withColumn("_bucket", bucket)
    held = (F.col(index) >= F.col("start")) & (F.col(index) < F.col("stop"))
    return rows.withColumn("_bucket", F.floor(F.col(index) / width)).join(ranges, "_bucket").where(held).drop("_bucket")


def digest(df: DataFrame, key: str, bits: int = 16) -> DataFrame:
    """One row: digest, the first eight letters of a digest over the digests of ranges, over those of ranges of ranges and so on:
    as many levels as take 64 bits, each over 2^bits keys or digests at most, so that no task holds more than that. Keys
    are different whole numbers of 0 or more."""
    step = lambda rows, at: rows.groupBy(F.shiftright(at, bits).alias("r")).agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), "v"))).alias("v")).select("r", F.md5(F.array_join(F.col("v.v"), "")).alias("v"))
    rows = step(df.select(F.col(key).cast("long").alias("at"), F.col(key).cast("string").alias("v")), F.col("at"))
    for _ in range(-(-64 // bits) - 1):
        rows = step(rows, F.col("r"))
    return rows.agg(F.substring(F.max("v"), 1, 8).alias("digest"))  # of the one range that is left, or null


def at_least_two(df: DataFrame, identity: str) -> DataFrame:
    """Rows whose identity occurs twice or more: a semi join with summed counts, so a common identity is no one task."""
    many = df.groupBy(identity).agg(F.count("*").alias("_n")).where("_n >= 2").select(identity)
    return df.join(many, identity, "left_semi")


def recognisable(df: DataFrame, identity: str, viewpoint: str, coarse: Column) -> DataFrame:
    """Rows fit for re-identification: identity seen twice, viewpoint known and mapped to a side."""
    known = F.col(identity).isNotNull() & F.col(viewpoint).isNotNull() & ~F.col(viewpoint).isin("ignore", "unknown")
    return at_least_two(df.where(F.col(identity).isNotNull()), identity).where(known & coarse.isNotNull())


def unprocessed(candidates: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    return candidates.join(processed.select(key).distinct(), key, "left_anti")
