"""Image and media collections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheaf.functions import media as M

from .rules import near_white

EXTENSIONS = ("png", "jpg", "jpeg", "gif")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modificationTime) of all files below a path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", "modificationTime")


def scan_media_files(files: DataFrame, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """Files of the extensions that carry no skip mark, each path once."""
    f = files.withColumn("ext", M.extension(F.col("path")))
    return distinct_paths(f.filter(F.col("ext").isin(*extensions) & ~M.has_skip_mark(F.col("path"))))


def distinct_paths(files: DataFrame) -> DataFrame:
    return files.dropDuplicates(["path"])


def scan_tag_folders(files: DataFrame) -> DataFrame:
    """(tag): first [tag] of the first folder below the root of each path."""
    folder = F.regexp_extract("path", r"^/[^/]+/([^/]*)/", 1)
    return files.select(F.regexp_extract(folder, r"\[([^\]]+)\]", 1).alias("tag")).filter("tag <> ''").distinct()


def already_converted(files: DataFrame, existing: DataFrame) -> DataFrame:
    """files with `done`: whether existing (path) has the sibling .webp."""
    have = existing.select(F.col("path").alias("_have")).distinct()
    f = files.join(have, M.webp_path(F.col("path")) == F.col("_have"), "left")
    return f.withColumn("done", F.col("_have").isNotNull()).drop("_have")


def output_paths(files: DataFrame, existing: DataFrame, stamp: str) -> DataFrame:
    """Adds output_path (.webp) and skip_path; each one with the stamp if existing has that path."""
    have = existing.select(F.col("path").alias("_have")).distinct()
    f = files
    for name, out in (("output_path", M.webp_path(F.col("path"))), ("skip_path", M.skip_path(F.col("path")))):
        f = f.join(have, out == F.col("_have"), "left").withColumn(name, F.when(F.col("_have").isNull(), out).otherwise(M.clash_path(out, stamp))).drop("_have")
    return f


def savings_report(files: DataFrame) -> DataFrame:
    """Per extension: files kept as WebP because they shrink, marked to skip, and MB saved (rounded to 2 decimals per file, then summed in hundredths)."""
    smaller = F.col("encoded_length") < F.col("length")
    cents = F.when(smaller, F.floor((F.col("length") - F.col("encoded_length")) * 100 / 1048576 + 0.5)).otherwise(0)
    g = files.groupBy(M.extension(F.col("path")).alias("ext")).agg(F.count("*").alias("files"), F.count_if(smaller).alias("converted"), F.count_if(~smaller).alias("skipped"), F.sum(cents).alias("c"))
    return g.select("ext", "files", "converted", "skipped", (F.col("c") / 100).alias("saved_mb"))


def near_white_share(pixels: DataFrame, region: Column | None = None, least: int = 100) -> DataFrame:
    """Per image: near-white pixels in the region (a condition on x and y), their share, and whether they are at least `least`."""
    p = pixels if region is None else pixels.filter(region)
    white = near_white(F.col("r"), F.col("g"), F.col("b"))
    g = p.groupBy("image_id").agg(F.count_if(white).alias("masked"), F.count("*").alias("pixels"))
    return _share(g, least)


def _share(counts: DataFrame, least: int) -> DataFrame:
    return counts.withColumns({"share": F.round(F.col("masked") / F.col("pixels"), 6), "marked": F.col("masked") >= least})


def decoded_images(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, width, height, channels, data) of the images under a path; the bytes are in the order blue, green, red."""
    images = spark.read.format("image").option("recursiveFileLookup", True).load(path)
    return images.select(F.col("image.origin").alias("image_id"), "image.width", "image.height", F.col("image.nChannels").alias("channels"), "image.data")


def white_pixels(data: bytes, width: int, channels: int, left: int, right: int) -> tuple[int, int]:
    """Near-white and all pixels between two columns of whole rows of an image; one channel is grey, a fourth one is not looked at."""
    x = np.frombuffer(data, np.uint8).reshape(-1, width, channels)[:, left:right, :3].astype(np.int32)
    b, g, r = (x[:, :, min(k, x.shape[2] - 1)] for k in range(3))
    return int(near_white(r, g, b, np.maximum, np.minimum).sum()), b.size


def near_white_of_images(images: DataFrame, region: tuple[Column, Column, Column, Column] | None = None, least: int = 100) -> DataFrame:
    """near_white_share of images (image_id, width, height, channels, data): (image_id, masked, pixels, share, marked).

    region is (left, top, right, bottom) as expressions of width and height, the last two exclusive, cut to the image. Its rows are cut from the bytes before these
    go to Python, where an image is one array.
    """
    left, top, right, bottom = region or (F.lit(0), F.lit(0), F.col("width"), F.col("height"))

    def within(x: Column, most: str) -> Column:
        return F.greatest(F.lit(0), F.least(x, F.col(most))).cast("int")

    row = F.col("width") * F.col("channels")
    rows = images.select("image_id", "width", "channels", "data", within(left, "width").alias("left"), within(right, "width").alias("right"), within(top, "height").alias("top"), within(bottom, "height").alias("bottom"))
    rows = rows.filter("data IS NOT NULL AND width > 0 AND left < right AND top < bottom")
    rows = rows.select("image_id", "width", "channels", F.substring("data", F.col("top") * row + 1, (F.col("bottom") - F.col("top")) * row).alias("data"), "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [white_pixels(d, w, c, x, y) for w, c, d, x, y in zip(*(b.column(k).to_pylist() for k in range(1, 6)), strict=True)]
            counts = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts[:, 0]), pa.array(counts[:, 1])], ["image_id", "masked", "pixels"])

    kind = images.schema["image_id"].dataType.simpleString()
    return _share(rows.mapInArrow(run, f"image_id {kind}, masked long, pixels long"), least)
