"""Re-identification tables derived from the driver's tables, as Spark DataFrames and as SQL for the oracle."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, vec (64), identity, image (three rows each)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").alias("identity"), F.expr("cast(floor(vec_id / 3.0) as bigint)").alias("image"))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, p, valid, x (4): 16 patches of each vector; every seventh patch is not valid."""
    v = vectors(spark, sf_dir)
    cut = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda p: F.struct(p.alias("p"), F.slice("vec", p * 4 + 1, F.lit(4)).alias("x")))
    return v.select("id", F.explode(cut).alias("c")).select("id", "c.p", ((F.col("id") + F.col("c.p")) % 7 != 0).alias("valid"), "c.x")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, p, s (4), t (4): semantic patches from the first half of the vector, textural ones from the second."""
    v = vectors(spark, sf_dir)
    cut = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda p: F.struct(p.alias("p"), F.slice("vec", p * 4 + 1, F.lit(4)).alias("s"), F.slice("vec", p * 4 + 33, F.lit(4)).alias("t")))
    return v.select("id", F.explode(cut).alias("c")).select("id", "c.p", "c.s", "c.t")


def model(spark: SparkSession, sf_dir: str) -> dict:
    """Four components from rows 0 to 3; read by id, at most four rows."""
    rows = table(spark, sf_dir, "embeddings").where("vec_id < 4").orderBy("vec_id").select("embedding").collect()
    e = np.array([r.embedding for r in rows], np.float64)
    k = len(e)
    return {
        "weight": np.full(k, 0.25), "mean": e[:, :4], "var": np.full((k, 4), 0.02), "mean_s": e[:, :4], "var_s": np.full((k, 4), 0.02), "mean_t": e[:, 24:28],
        "a": e[:, 4:20].reshape(k, 4, 4), "b": e[:, 20:24], "var_r": np.full((k, 4), 0.03), "global_a": e[0, 4:20].reshape(4, 4), "global_b": e[0, 20:24],
        "mean_r": e[:, 28:32], "var_rr": np.full((k, 4), 0.03),
    }


#: SQL views that the oracles build on; x, s, t are rows by dimension.
SQL_VECTORS = """v as (select vec_id as id, cast(embedding as double[]) as vec, label as identity, cast(floor(vec_id / 3.0) as bigint) as image from embeddings)"""
SQL_DIMS = SQL_VECTORS + """, dims as (select id, identity, unnest(generate_series(1, 64)) as d, unnest(vec) as x from v)"""
SQL_PATCH = SQL_DIMS + """, patch as (select id, cast((d - 1) // 4 as int) as p, cast((d - 1) % 4 + 1 as int) as d, x, (id + (d - 1) // 4) % 7 <> 0 as valid from dims)"""
SQL_MODEL = """, comp as (select id as k, d, x as m, cast(0.02 as double) as v, cast(0.25 as double) as w from dims where id < 4 and d <= 4)"""
SQL_PAIRS = SQL_DIMS + """, sdim as (select id, cast((d - 1) // 4 as int) as p, cast((d - 1) % 4 + 1 as int) as d, x from dims where d <= 32),
    tdim as (select id, cast((d - 33) // 4 as int) as p, cast((d - 33) % 4 + 1 as int) as d, x from dims where d > 32)"""
SQL_MLR = SQL_MODEL + """, mt as (select id as k, d - 24 as d, x as m from dims where id < 4 and d between 25 and 28),
    amat as (select id as k, cast((d - 5) // 4 + 1 as int) as i, cast((d - 5) % 4 + 1 as int) as j, x as a from dims where id < 4 and d between 5 and 20),
    bvec as (select id as k, d - 20 as d, x as b from dims where id < 4 and d between 21 and 24),
    mr as (select id as k, d - 28 as d, x as m from dims where id < 4 and d between 29 and 32)"""
