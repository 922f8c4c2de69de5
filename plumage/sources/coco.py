"""COCO-like annotation files as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumage import scratch

SCHEMA = """
    categories array<struct<id: int, species: string, name: string>>,
    images array<struct<uuid: string, image_path: string, width: int, height: int, latitude: double, longitude: double, datetime: string>>,
    annotations array<struct<uuid: string, image_uuid: string, bbox: array<double>, bbox_x: double, bbox_y: double, bbox_w: double, bbox_h: double,
        individual_id: string, name_uuid: string, viewpoint: string, category_id: int, annot_census: boolean, annot_census_region: boolean, annot_manual: boolean>>
"""


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """categories, images and annotations; the schema is given, so nothing is inferred and unused fields aren't parsed. The
    document is parsed once, in one task for each file as JSON over lines can't be split, and written; each table reads its
    column of that."""
    raw = scratch.written(spark.read.schema(SCHEMA).json(path, multiLine=True, primitivesAsString=False))
    rows = lambda name: raw.select(F.explode(name).alias("r")).select("r.*")
    categories = rows("categories").select("id", F.coalesce("species", "name").alias("species"))
    return {"categories": categories, "images": rows("images"), "annotations": annotations(rows("annotations"), categories)}


def box(bbox: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """bbox is x1, y1, x2, y2; else x, y, width and height are converted; else all zero."""
    corner = lambda i: F.try_element_at(bbox, F.lit(i))
    given, sized = F.size(bbox) >= 4, x.isNotNull() & y.isNotNull() & w.isNotNull() & h.isNotNull()
    pick = lambda i, v: F.when(given, corner(i)).when(sized, v).otherwise(F.lit(0.0))
    return F.struct(pick(1, x).alias("x1"), pick(2, y).alias("y1"), pick(3, x + w).alias("x2"), pick(4, y + h).alias("y2"))


def annotations(raw: DataFrame, categories: DataFrame) -> DataFrame:
    c = F.col
    out = raw.select(
        "uuid", "image_uuid", box(c("bbox"), c("bbox_x"), c("bbox_y"), c("bbox_w"), c("bbox_h")).alias("bbox"),
        F.coalesce("individual_id", "name_uuid", F.lit("")).alias("individual_id"), F.coalesce("viewpoint", F.lit("unknown")).alias("viewpoint"), "category_id",
        *[F.coalesce(x, F.lit(False)).alias(x) for x in ("annot_census", "annot_census_region", "annot_manual")],
    )
    named = categories.select(c("id").alias("category_id"), c("species").alias("category"))
    return out.join(F.broadcast(named), "category_id", "left")  # one row a category


def image_path(path: Column, root: str | None) -> Column:
    """An absolute path as it is, else under root."""
    return F.when(path.startswith("/") | F.lit(root is None), path).otherwise(F.concat_ws("/", F.lit((root or "").rstrip("/")), path))


def with_image(annots: DataFrame, images: DataFrame, root: str | None = None) -> DataFrame:
    at = images.select(F.col("uuid").alias("image_uuid"), image_path(F.col("image_path"), root).alias("path"))
    return annots.join(at, "image_uuid")


def image_bytes(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Encoded images for a decoding function to take (see functions.extractors)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)


def image_paths(images: DataFrame) -> DataFrame:
    return images.select("image_path").distinct().orderBy("image_path")


def weight_urls(spark: SparkSession, path: str) -> DataFrame:
    """(model, url) of a text file that names download addresses of weights; the last one of a model counts."""
    text = spark.read.text(path, wholetext=True)
    found = text.select(F.posexplode(F.regexp_extract_all("value", F.lit(r"(https?://[^\s'\"<>]+\.pth[^\s'\"<>]*)"), 1)).alias("n", "url"))
    named = found.select("n", "url", F.regexp_extract("url", r"/([A-Za-z0-9]+_[A-Za-z0-9]+)[^/]*\.pth", 1).alias("model")).where("model <> ''")
    return named.groupBy("model").agg(F.max_by("url", "n").alias("url"))
