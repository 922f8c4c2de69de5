"""Tables on storage: detections, descriptors, matches and models."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from plumage import files, scratch

#: A file of a table without rows is no larger than this, in bytes.
EMPTY_TABLE = 1 << 20
#: The listing's columns and the number of the folder.
BINARY = "path string, modificationTime timestamp, length long, content binary, batch int"


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at path, or None if there is none; a damaged table raises."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


class Detections:
    """Detections in folders by batch: a batch is replaced as a whole, so writing it again changes nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(self.path)

    def read(self) -> DataFrame | None:
        return read_or_none(self.spark, self.path)

    def upsert(self, rows: DataFrame, batch: int, key: str = "detection_id") -> None:
        """Rows as a batch; of rows that share a key one is kept, and older rows of their keys go. All batches that change are
        written beside the store first, and then replaced by one job; a batch left without rows is deleted last."""
        rows = scratch.written(rows.dropDuplicates([key]))
        old, new = self.read(), rows.withColumn("batch", F.lit(batch))
        if old is None:
            return self.write(rows, batch)
        touched = scratch.written(old.join(rows.select(key), key, "left_semi").select("batch").union(self.spark.range(1).select(F.lit(batch))).distinct())
        kept = old.join(touched, "batch", "left_semi").join(rows.select(key), key, "left_anti")
        held = scratch.written(kept.unionByName(new))
        held.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(self.path)
        for r in touched.join(held.select("batch").distinct(), "batch", "left_anti").collect():  # numbers of batches
            self.drop(r.batch)

    def drop(self, batch: int) -> None:
        files.remove(self.spark, f"{self.path}/batch={batch}")

    def file_sizes(self) -> DataFrame:
        """(batch, name, bytes) of every file that has any bytes, readable or not; reads the listing only."""
        listed = self.spark.read.format("binaryFile").schema(BINARY).option("pathGlobFilter", "*.parquet").load(self.path)
        return listed.select("batch", F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("bytes"))

    def content(self, features: str, mask: str) -> DataFrame:
        """(batch, detections, least_dim, most_dim, dtype, features_mb, patch_mask_kb, files, mb): what a batch holds; sizes in memory are those
        of one detection (the largest), as its array's length times the width of its kind; mb is that of the files."""
        kind = dict(self.read().select(features).dtypes)[features].removeprefix("array<").removesuffix(">")
        width = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4}.get(kind, 8)
        held = self.read().groupBy("batch").agg(
            F.count("*").alias("detections"), F.min(F.size(features)).alias("least_dim"), F.max(F.size(features)).alias("most_dim"), F.lit(kind).alias("dtype"),
            (F.max(F.size(features)) * width / 2**20).alias("features_mb"), (F.max(F.size(mask)) / 1024).alias("patch_mask_kb"),
        )
        return held.join(self.file_sizes().groupBy("batch").agg(F.count("*").alias("files"), (F.sum("bytes") / 2**20).alias("mb")), "batch")

    def damaged(self, index: DataFrame | None = None, key: str = "image_path", deep: bool = False) -> DataFrame:
        """(batch, reason) of batches that cannot be trusted, once each: "no content" (a folder without any byte), "unreadable" (a file that gives no rows
        and does not end as a table without rows does), "rows" (an image of the index with another number of detections, also where one
        of several files has lost its bytes, as Spark never lists those).
        index: (key, batch, n). deep reads every column, else only the footers and the keys are read."""
        read = self.spark.read.option("ignoreCorruptFiles", "true").option("mergeSchema", "true")
        listed, folders = self.file_sizes(), files.folders(self.spark, self.path, "batch=")
        held = {r.batch for r in listed.select("batch").distinct().collect()}  # numbers of batches
        bare = [(int(f), "no content") for f in folders if int(f) not in held]
        reasons = [self.spark.createDataFrame(bare, "batch int, reason string")]
        try:
            rows = read.parquet(self.path) if held else None
        except AnalysisException as e:
            if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
                raise
            rows = None
        if rows is None:  # not one footer can be read
            reasons.append(listed.select("batch", F.lit("unreadable").alias("reason")))
            if index is not None:
                reasons.append(index.where("n > 0").select("batch", F.lit("rows").alias("reason")))
        else:
            every = F.count(F.xxhash64(*[c for c in rows.columns if c != "batch"])) if deep else F.count("*")
            good = rows.groupBy("batch", F.col("_metadata.file_name").alias("name")).agg(every.alias("rows"))
            suspect = listed.join(good, ["batch", "name"], "left_anti")
            tail = self.spark.read.format("binaryFile").schema(BINARY).option("pathGlobFilter", "*.parquet").load(self.path).where(F.col("length") <= EMPTY_TABLE)
            whole = tail.where(F.expr("substring(content, -4, 4) = X'50415231'")).select("batch", F.substring_index("path", "/", -1).alias("name"))
            reasons.append(suspect.join(whole, ["batch", "name"], "left_anti").select("batch", F.lit("unreadable").alias("reason")))
            if index is not None:
                found = rows.groupBy("batch", key).agg(F.count("*").alias("found"))
                off = index.select("batch", key, "n").join(found, ["batch", key], "full").where(F.coalesce("n", F.lit(0)) != F.coalesce("found", F.lit(0)))
                reasons.append(off.select("batch", F.lit("rows").alias("reason")))
        every = reasons[0]
        for more in reasons[1:]:
            every = every.union(more)
        return every.groupBy("batch").agg(F.min("reason").alias("reason"))

    def one(self, detection_id: str) -> DataFrame:
        return self.read().where(F.col("detection_id") == detection_id)

    def of_image(self, image_path: str) -> DataFrame:
        return self.read().where(F.col("image_path") == image_path)

    def counts(self) -> DataFrame:
        """detections, batches and images, each counted once."""
        return self.read().agg(*[F.countDistinct(c).alias(n) for c, n in (("detection_id", "detections"), ("batch", "batches"), ("image_path", "images"))])

    def images_of_batch(self, batch: int) -> DataFrame:
        return self.read().where(F.col("batch") == batch).select("image_path").distinct()

    def without_batch(self, batch: int) -> DataFrame:
        return self.read().where(F.col("batch") != batch)


def write_vectors(df: DataFrame, path: str, batch: int, layout: str, variant: str) -> None:
    """(detection_id, vec) into one batch of a descriptor store; the layout stays with each row."""
    rows = df.select("detection_id", F.col("vec").cast("array<float>").alias("vec"), F.size("vec").alias("dim"), F.lit(layout).alias("layout"), F.lit(variant).alias("variant"))
    rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def write_matches(matches: DataFrame, path: str, params: dict) -> None:
    matches.withColumn("params", F.lit(json.dumps(params, sort_keys=True))).withColumn("version", F.lit(2)).write.mode("overwrite").parquet(path)


def read_matches(spark: SparkSession, path: str, params: dict | None = None) -> DataFrame | None:
    """The matches at path if they are of this version and, where given, these parameters; else None."""
    found = read_or_none(spark, path)
    if found is None or not {"params", "version"} <= set(found.columns):
        return None
    head = found.select("params", "version").first()
    if head is None or head.version != 2 or (params is not None and json.loads(head.params) != json.loads(json.dumps(params))):
        return None
    return found.drop("params", "version")


def cached_matches(spark: SparkSession, path: str, params: dict, compute) -> DataFrame:
    found = read_matches(spark, path, params)
    if found is None:
        write_matches(compute(), path, params)
        found = read_matches(spark, path, params)
    return found


def write_model(spark: SparkSession, model: dict, path: str) -> None:
    """A model's arrays, one row each: name, shape, values."""
    rows = [(k, list(np.shape(v)), np.asarray(v, float).ravel().tolist()) for k, v in model.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, values array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def read_model(spark: SparkSession, path: str) -> dict:
    return {r.name: np.array(r["values"]).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}  # as many rows as arrays


def mlr_from_npz(path: str) -> dict:
    """A mixture of regressions from a numpy archive."""
    z = np.load(path)
    names = {"weight": "weights", "mean_s": "mu_s", "var_s": "sigma2_s", "mean_t": "mu_t", "a": "A", "var_r": "sigma2_t"}
    return {k: z[v].astype(float) for k, v in names.items()}
