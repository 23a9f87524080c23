"""Landed media files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Registered image types by file extension, and the refusal.
IMAGE_TYPES = {
    "avif": "image/avif",
    "bmp": "image/bmp",
    "gif": "image/gif",
    "heic": "image/heic",
    "ico": "image/vnd.microsoft.icon",
    "jfif": "image/jpeg",
    "jp2": "image/jp2",
    "jpeg": "image/jpeg",
    "jpg": "image/jpeg",
    "png": "image/png",
    "svg": "image/svg+xml",
    "tif": "image/tiff",
    "tiff": "image/tiff",
    "webp": "image/webp",
}
NOT_AN_IMAGE = "File must be an image"


def media_manifest(
    spark: SparkSession,
    path: str,
    landed_at: Column | None = None,
    with_content: bool = False,
) -> DataFrame:
    """One row per file: ``path, name, content_type, stored_name, reject_reason``.

    The stored name carries the landing time (by default the file's own), as
    ``yyyyMMdd_HHmmss_<name>``. Unless asked for, file contents are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    landed = F.col("modificationTime") if landed_at is None else landed_at
    pairs = [F.lit(part) for pair in IMAGE_TYPES.items() for part in pair]
    extension = F.lower(F.regexp_extract("name", r"\.([^.]+)\z", 1))
    columns = ["path", "name", "content_type", "stored_name", "reject_reason"]
    return (
        files.withColumn("name", F.url_decode(F.regexp_extract("path", r"([^/]+)\z", 1)))
        .withColumn("content_type", F.try_element_at(F.create_map(*pairs), extension))
        .withColumn(
            "stored_name", F.concat_ws("_", F.date_format(landed, "yyyyMMdd_HHmmss"), "name")
        )
        .withColumn("reject_reason", F.when(F.col("content_type").isNull(), NOT_AN_IMAGE))
        .select(*columns, *(["content"] if with_content else []))
    )
