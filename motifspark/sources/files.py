"""Folders of images, split tables and delimited files as DataFrames; listing never reads a file's content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import UNLABELED

#: File endings of images. Fixed values.
IMAGE_ENDINGS = ["jpg", "jpeg", "png", "webp", "bmp", "gif"]


def listing(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(path) of every image file under ``roots``, once, however roots overlap."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.filter(ending.isin(IMAGE_ENDINGS)).select("path").distinct()


def labelled_folder(spark: SparkSession, root: str, source: str) -> DataFrame:
    """(image_path, template, source) of the files one folder under ``root``; that folder is the template."""
    below = F.split(F.substring_index("path", root.rstrip("/") + "/", -1), "/")
    return listing(spark, [root]).filter(F.size(below) == 2).select(F.col("path").alias("image_path"), F.element_at(F.split("path", "/"), -2).alias("template"), F.lit(source).alias("source"))


def corpus(spark: SparkSession, roots: list[str], label: str = UNLABELED, source: str = "social_media") -> DataFrame:
    """(image_path, template, source) of all files under ``roots``, under one label."""
    return listing(spark, roots).select(F.col("path").alias("image_path"), F.lit(label).alias("template"), F.lit(source).alias("source"))


def images(spark: SparkSession, root: str) -> DataFrame:
    """(path, image) of the files under ``root`` that decode; the others are left out."""
    read = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(root)
    return read.select(F.col("image.origin").alias("path"), "image")


def split_table(spark: SparkSession, path: str, source: str = "imgflip") -> DataFrame:
    """(image_path, template, source) of a split in either of its two shapes; another shape or no rows raise."""
    table = spark.read.parquet(path)
    for image, template in (("image_path", "template"), ("path", "template_name")):
        if {image, template} <= set(table.columns):
            own = F.col("source") if "source" in table.columns else F.lit(source)
            out = table.select(F.col(image).cast("string").alias("image_path"), F.col(template).cast("string").alias("template"), own.cast("string").alias("source"))
            if out.isEmpty():
                raise ValueError(f"no rows in {path}")
            return out
    raise ValueError(f"{path} has columns {table.columns}")


def split_pair(spark: SparkSession, train: str, test: str) -> DataFrame:
    """Rows of both splits, tagged by the split they are from."""
    tagged = [split_table(spark, p).withColumn("source", F.lit(tag)) for p, tag in ((train, "imgflip_train"), (test, "imgflip_test"))]
    return tagged[0].unionByName(tagged[1])


def delimited(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A CSV with a header as strings, quotes doubled inside quotes, line breaks allowed there; a byte order mark is no part of a name."""
    table = spark.read.option("header", "true").option("multiLine", "true").option("quote", '"').option("escape", '"').csv(path)
    return table.toDF(*[c.lstrip("\ufeff") for c in table.columns])


def runs(spark: SparkSession, root: str, file: str = "open_set_predictions.csv") -> DataFrame:
    """Rows of all files of that name under ``root``, with method: the first folder under root; empty for a file in root itself."""
    table = spark.read.option("header", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", file).option("escape", '"').csv(root)
    parts = F.split(F.substring_index(F.col("_metadata.file_path"), root.rstrip("/") + "/", -1), "/")
    table = table.select("*", F.when(F.size(parts) > 1, F.element_at(parts, 1)).otherwise("").alias("method"))
    return table.toDF(*[c.lstrip("\ufeff") for c in table.columns])


def write_delimited(rows: DataFrame, path: str) -> None:
    """As ``delimited`` reads it."""
    rows.write.mode("overwrite").option("header", "true").option("quote", '"').option("escape", '"').csv(path)


def put(rows: DataFrame, path: str, form: str = "parquet") -> None:
    """rows as parquet, json (a line a row) or csv with a header, in place of what was there."""
    if form == "csv":
        return write_delimited(rows, path)
    if form not in ("parquet", "json"):
        raise ValueError(f"no sink {form}")
    rows.write.mode("overwrite").format(form).save(path)
