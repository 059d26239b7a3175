"""Files as rows: documents, images, form data; and sinks for results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioframe.functions.text import extension, file_name


def documents(spark: SparkSession, *paths: str, suffix: str = "pdf", recursive: bool = True) -> DataFrame:
    """(path, name, size, modified, content) of files with a suffix, whatever its case. Content is read only if used."""
    glob = "*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(list(paths))
    return f.select("path", file_name("path").alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def images(spark: SparkSession, *paths: str) -> DataFrame:
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    f = f.withColumn("kind", extension("path")).where(F.col("kind").isin("png", "jpg", "jpeg", "gif", "bmp"))
    return f.select("path", file_name("path").alias("name"), "kind", F.col("length").alias("size"), "content")


def form_data(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, name, value) of JSON objects, one file each; values as strings."""
    t = spark.read.option("wholetext", "true").text(list(paths)).select(F.input_file_name().alias("path"), F.from_json("value", "map<string,string>").alias("m"))
    return t.select("path", F.explode("m").alias("name", "value"))


def settings(spark: SparkSession, path: str) -> DataFrame:
    """(key, value): the last value of each key of a log of settings."""
    s = spark.read.parquet(path)
    return s.groupBy("key").agg(F.max_by("value", "at").alias("value"))


def new_files(found: DataFrame, listed: DataFrame) -> DataFrame:
    return found.join(listed.select("path"), "path", "left_anti").dropDuplicates(["path"])


# ---- sinks


def save(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("overwrite").format(fmt).save(path)


def save_by_page(df: DataFrame, path: str) -> None:
    """One folder for each page."""
    df.write.mode("overwrite").partitionBy("page_id").parquet(path)


def save_versioned(df: DataFrame, path: str, version: str) -> None:
    """JSON of results under their version."""
    df.write.mode("overwrite").json(f"{path}/version={version}")


def output_names(files: DataFrame, policy: str = "rename") -> DataFrame:
    """Names of outputs by the policy on collisions: skip, overwrite or rename ("stem (n).ext").

    files: path, name. Rows with equal names collide in the order of their paths.
    """
    n = F.row_number().over(Window.partitionBy("name").orderBy("path")) - 1
    stem, ext = F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 2)
    named = files.withColumn("n", n)
    if policy == "skip":
        return named.withColumn("status", F.when(F.col("n") > 0, "skipped").otherwise("converted")).withColumn("output", F.when(F.col("n") == 0, F.col("name"))).drop("n")
    if policy == "overwrite":
        return named.withColumn("status", F.lit("converted")).withColumn("output", F.col("name")).drop("n")
    return named.withColumn("status", F.lit("converted")).withColumn("output", F.when(F.col("n") == 0, F.col("name")).otherwise(F.concat(stem, F.lit(" ("), F.col("n").cast("string"), F.lit(")"), ext))).drop("n")
