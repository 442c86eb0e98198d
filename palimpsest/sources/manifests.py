"""Page-image plans from image-service manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The manifest fields that are read, and the full-size image request.
MANIFEST_SCHEMA = (
    "sequences array<struct<canvases: array<struct<images: array<struct<"
    "resource: struct<service: struct<`@id`: string>>>>>>>>"
)
IMAGE_REQUEST = "/full/pct:100/0/default.jpg"
MANIFEST_HEAD, MANIFEST_TAIL = "/iiif/info/", "/manifest.json"


def manifest_url(base_url: str, collection: str, item: Column) -> Column:
    head = f"{base_url.rstrip('/')}{MANIFEST_HEAD}{collection}/"
    return F.concat(F.lit(head), item.cast("bigint").cast("string"), F.lit(MANIFEST_TAIL))


def plan_page_images(
    manifests: DataFrame, base_dir: str, key: str = "item_id", json: str = "manifest"
) -> DataFrame:
    """One row per canvas of the first sequence: item, page from 1, image URL, file path."""
    parsed = manifests.select(F.col(key), F.from_json(json, MANIFEST_SCHEMA).alias("m"))
    pages = parsed.select(
        key,
        F.posexplode(F.get(F.col("m.sequences"), F.lit(0))["canvases"]).alias("pos", "canvas"),
    )
    service = F.get(F.col("canvas.images"), F.lit(0))["resource"]["service"]["@id"]
    page = F.col("pos") + 1
    item = F.col(key).cast("string")
    return pages.select(
        key,
        page.alias("page"),
        F.concat(service, F.lit(IMAGE_REQUEST)).alias("img_url"),
        F.concat(
            F.lit(base_dir.rstrip("/") + "/"), item, F.lit("/"), item, F.lit("_page"),
            page.cast("string"), F.lit(".jpg"),
        ).alias("path"),
    )


def existing_files(spark: SparkSession, folder: str, pattern: str = "*.jpg") -> DataFrame:
    """Paths of files under ``folder``; only the listing is read, never the content."""
    return (
        spark.read.format("binaryFile")
        .options(recursiveFileLookup=True, pathGlobFilter=pattern)
        .load(folder)
        .select("path")
    )


def pending_pages(plan: DataFrame, existing: DataFrame, path: str = "path") -> DataFrame:
    """Planned pages whose file does not exist yet."""
    return plan.join(existing.select(path).distinct(), path, "left_anti")
