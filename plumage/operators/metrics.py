"""Class separation, pooled descriptors, circular and robust statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumage import scratch
from plumage.functions import labels as L
from plumage.functions import vec as V
from plumage.operators import blocks as B
from plumage.operators import ranking as R
from plumage.operators import selection as S


def dimensions(df: DataFrame, vec_col: str, *keep: str) -> DataFrame:
    """(keep..., d, x): a row for each component, d from 1."""
    return df.select(*keep, F.posexplode(F.col(vec_col).cast("array<double>")).alias("d", "x")).withColumn("d", F.col("d") + 1)


def fisher_ratio(long: DataFrame, label: str, by: list[str]) -> DataFrame:
    """(by..., ratio): between-class over within-class sum of squares of x, within at least 1e-20. Classes of one row
    are left out, but the overall mean is of all rows."""
    c = long.groupBy(*by, label).agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    mean = long.groupBy(*by).agg(F.avg("x").alias("mean"))
    both = c.where("n >= 2").join(mean, by)
    return both.groupBy(*by).agg((F.sum(F.expr("n * (m - mean) * (m - mean)")) / F.greatest(F.sum(F.expr("n * v")), F.lit(1e-20))).alias("ratio"))


def auc(scored: DataFrame, score: str, positive: str) -> DataFrame:
    """One row, auc: chance that a positive row scores above another, ties half; 0.5 if there is one class only."""
    return auc_of_counts(scored.withColumn("_n", F.lit(1)), score, positive, "_n")


def same_class_auc(df: DataFrame, id_col: str, vec_col: str, label: str, decimals: int = 4) -> DataFrame:
    """AUC of minus the distance for telling pairs of one class from others, over all pairs of df, which the caller has
    sampled (see sampling.exact_sample). Distances are compared at so many decimals, and blocks hand on counts by
    distance, so pairs are never rows."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), F.col(label).alias("label"))

    def count(q, c):
        a, b = B.codes(q["label"], c["label"])
        by_q, by_c = np.argsort(q["id"], kind="stable"), np.argsort(c["id"], kind="stable")
        x, y, a, b, ids, others = q["vec"][by_q], c["vec"][by_c], a[by_q], b[by_c], q["id"][by_q], c["id"][by_c]
        keys, counts = [], []
        for i in B.tiles(len(ids), B.TILE[0]):
            for j in B.tiles(len(others), B.TILE[1]):
                if not others[j][-1] > ids[i][0]:
                    continue
                key = R.steps(x[i], y[j], 10**decimals) * 2 + (a[i][:, None] == b[j][None, :])
                key = key.ravel() if others[j][0] > ids[i][-1] else key[ids[i][:, None] < others[j][None, :]]
                if not len(key):
                    continue
                if key.max() < 8 * B.TILE[1] * B.TILE[0]:
                    n = np.bincount(key)
                    key = np.flatnonzero(n)
                    n = n[key]
                else:
                    key, n = np.unique(key, return_counts=True)
                keys.append(key)
                counts.append(n)
        if not keys:
            return None
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.zeros(len(key), np.int64)
        np.add.at(n, at, np.concatenate(counts))
        return {"s": -(key // 2) / 10**decimals + 0.0, "same": key % 2 == 1, "n": n}

    h = B.compare(rows, rows, count, "s double, same boolean, n long").groupBy("s", "same").agg(F.sum("n").alias("n"))
    return auc_of_counts(h, "s", "same", "n")


def auc_of_counts(h: DataFrame, score: str, positive: str, n: str) -> DataFrame:
    """auc() of rows that stand for n rows each. Rows are summed by score first and sorted into ranges of about equal numbers of
    scores, one a partition; the running count starts in each from the sum of those before it, so that no task gets them all."""
    wide = h.groupBy(F.col(score).alias("s")).agg(
        F.sum(F.when(F.col(positive), F.col(n)).otherwise(0)).alias("p"), F.sum(F.when(F.col(positive), 0).otherwise(F.col(n))).alias("q")
    )
    wide = scratch.written(wide.repartitionByRange("s").withColumn("b", F.spark_partition_id()))  # written, as ranges are drawn from a sample
    parts = wide.groupBy("b").agg(F.sum("q").alias("q"))
    below = parts.select("b", F.coalesce(F.sum("q").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a partition
    inside = F.coalesce(F.sum("q").over(Window.partitionBy("b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = wide.join(F.broadcast(below), "b").select("p", "q", (F.col("before") + inside).alias("lower"))
    wins = F.sum(F.col("p") * (F.col("lower") + F.col("q") / 2))
    return ranked.agg(F.coalesce(F.try_divide(wins, F.sum("p").cast("double") * F.sum("q")), F.lit(0.5)).alias("auc"))


def pooled(patches: DataFrame, detection: str, valid: str, vec_col: str) -> DataFrame:
    """(detection, vec): mean of the valid patches, at unit length if it has any; zeros if no patch is valid. Batches are
    summed within tasks, so a detection shuffles one row for each batch that holds some of its patches."""
    key = patches.schema[detection].dataType.simpleString()

    def sums(batches):
        for batch in batches:
            x, ok = B.column(batch.column(2)), batch.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            ids, at = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
            total, n = np.zeros((len(ids), x.shape[1])), np.bincount(at, ok, len(ids))
            np.add.at(total, at[ok], x[ok])
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(list(total)), pa.array(n)], names=["detection", "s", "n"])

    rows = patches.select(F.col(detection).alias("detection"), F.col(valid).alias("ok"), F.col(vec_col).cast("array<double>").alias("v"))
    part = rows.where("detection is not null and v is not null").mapInArrow(sums, f"detection {key}, s array<double>, n double")
    parts = part.groupBy("detection").agg(F.collect_list("s").alias("s"), F.sum("n").alias("n"))  # as many as batches hold its patches
    add = F.aggregate("s", F.transform(F.get("s", F.lit(0)), lambda x: F.lit(0.0)), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    mean = V.bound(F.greatest(F.col("n"), F.lit(1.0)), lambda n: F.transform(add, lambda x: x / n))
    return parts.select("detection", V.unit(mean, 0.0).alias("vec"))


def texture_separation(df: DataFrame, neighbours: int = 50, skip: int = 0, min_same: int = 1) -> DataFrame:
    """One row: auc, n_same, n_diff, mean_same, mean_diff, std_same, std_diff, verdict. df: id, semantic, textural,
    identity, one row per query. For each row, the rows ranked skip + 1 .. skip + neighbours by semantic similarity
    (poses alike); queries with fewer than min_same rows of their identity among them are left out."""
    near = R.top_k(df, df, skip + neighbours, "id", "semantic").where(F.col("rank") > skip)
    side = df.select("id", "textural", "identity")
    pairs = near.join(side.toDF("query", "qt", "qi"), "query").join(side.toDF("candidate", "ct", "ci"), "candidate")
    pairs = scratch.written(pairs.select("query", (F.col("qi") == F.col("ci")).alias("same"), F.round(V.dot("qt", "ct") / ((V.norm("qt") + 1e-8) * (V.norm("ct") + 1e-8)), 9).alias("s")))
    enough = pairs.groupBy("query").agg(F.count_if("same").alias("n")).where(F.col("n") >= min_same).select("query")
    pairs = pairs.join(enough, "query")
    of = lambda same, agg: agg(F.when(F.col("same") == same, F.col("s")))
    stats = pairs.agg(
        F.count_if("same").alias("n_same"), F.count_if(~F.col("same")).alias("n_diff"), of(True, F.avg).alias("mean_same"), of(False, F.avg).alias("mean_diff"),
        of(True, F.stddev_pop).alias("std_same"), of(False, F.stddev_pop).alias("std_diff"),
    )
    out = auc(pairs, "s", "same").crossJoin(stats)  # one row each
    verdict = F.when(F.col("auc") > 0.7, "strong").when(F.col("auc") > 0.55, "weak").otherwise("none")
    return out.withColumn("verdict", verdict)


def health(long: DataFrame, by: str, threshold: float = 20.0, at_once: int = S.AT_ONCE) -> DataFrame:
    """(by, median, mad, max_z, n_outliers, least, greatest, asymmetry, bottleneck) of x per group; rows without x don't count.
    Both medians are exact; where a group has more than at_once rows they come from counts (see selection), so that a
    group of any size is no task of its own."""
    long = long.where("x is not null")
    sizes = long.groupBy(by).agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("greatest"))
    most, groups = sizes.agg(F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
    near = lambda df: F.broadcast(df) if groups <= S.SMALL else df  # noqa: E731  a row for each group
    med = S.medians(long, [by], F.col("x"), most <= at_once, at_once)
    dev = long.join(near(med), by)
    mad = S.medians(dev, [by], F.abs(F.col("x") - F.col("median")), most <= at_once, at_once).select(by, (F.col("median") + 1e-12).alias("mad"))
    both = med.join(near(mad), by)
    far = long.join(near(both), by).groupBy(by).agg(F.count_if(F.abs(F.col("x") - F.col("median")) / F.col("mad") > threshold).alias("n_outliers"))
    up, down = F.col("greatest") - F.col("median"), F.col("median") - F.col("least")
    out = sizes.join(near(both), by).join(near(far), by).select(by, "median", "mad", (F.greatest(up, down) / F.col("mad")).alias("max_z"), "n_outliers", "least", "greatest")
    asym = F.greatest(up, down) / F.greatest(F.least(up, down), F.lit(1e-12))
    return out.withColumn("asymmetry", asym).withColumn("bottleneck", ((F.col("n_outliers") > 0) & (F.col("max_z") > 2 * threshold)) | (F.col("asymmetry") > 20))


def circular(df: DataFrame, angle: str, by: str) -> DataFrame:
    return df.groupBy(by).agg(L.circular_mean(angle).alias("mean"), L.circular_std(angle).alias("std"), F.count("*").alias("n"))
