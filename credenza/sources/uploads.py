"""Sources: uploaded files, camera data URLs, JSON request bodies, tokens. Pixel kernels stay behind the
feature tables of credenza.sources.features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Accepted endings and size limits in bytes.
DOCUMENT_ENDINGS = (".jpg", ".jpeg", ".png", ".pdf")
SCREENING_ENDINGS = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tif", ".tiff")
DOCUMENT_BYTES, CAPTURE_BYTES = 8 << 20, 5 << 20


def accepted(path: Column, length: Column, endings: tuple[str, ...], most: int | None) -> Column:
    ending = F.lower(F.regexp_extract(path, r"\.[^.]+$", 0))
    return ending.isin(*endings) & (length >= 1) & ((length <= most) if most else F.lit(True))


def uploads(spark: SparkSession, folder: str, endings: tuple[str, ...] = DOCUMENT_ENDINGS, most: int | None = DOCUMENT_BYTES) -> DataFrame:
    """path, length, modificationTime and content of the accepted files; content is read only where it is selected."""
    return spark.read.format("binaryFile").load(folder).filter(accepted(F.col("path"), F.col("length"), endings, most))


def newest_named(files: DataFrame, name: str) -> DataFrame:
    """The newest file with this exact name, or one that ends in _name."""
    last = F.regexp_extract("path", r"[^/]+$", 0)
    return files.filter((last == name) | F.endswith(last, F.lit(f"_{name}"))).agg(F.max_by("path", "modificationTime").alias("path"))


def data_url_bytes(url: Column) -> Column:
    """Bytes of a base64 JPEG data URL of 1 byte to 5 MiB; else null."""
    body = F.try_to_binary(F.substring_index(url, ",", -1), F.lit("base64"))
    good = F.rlike(url, F.lit(r"^data:image/jpe?g;base64,[A-Za-z0-9+/]+={0,2}$")) & F.octet_length(body).between(1, CAPTURE_BYTES)
    return F.when(good, body)


def body(json: Column, schema: str) -> Column:
    """A request body by schema; bad JSON gives nulls."""
    return F.from_json(json, schema, {"mode": "PERMISSIVE"})
