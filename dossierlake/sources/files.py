"""Evidence files as DataFrames."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 1_000_000_000
#: Bytes from either end of a file that the scan text holds.
WINDOW = 1_000_000


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, modificationTime, length, content of all PDF files below a folder, by name."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)


def empty_files(files: DataFrame) -> DataFrame:
    """path, content (null) of the files of a binaryFile table that hold nothing: the source passes them over when it reads, but lists them.
    The list of names is on the driver already, as the source's index."""
    spark = files.sparkSession
    plain = lambda p: re.sub(r"^file:/+", "file:/", unquote(p))
    listed = spark.createDataFrame([(plain(p),) for p in files.inputFiles()], "path string")
    return listed.join(files.select("path"), "path", "left_anti").select("path", F.lit(None).cast("binary").alias("content"))


def readable(files: DataFrame, most: int = MAX_BYTES) -> DataFrame:
    """Files within the size limit; the filter reaches the source, so larger ones are never opened."""
    return files.where(F.col("length") <= most)


def too_large(files: DataFrame, most: int = MAX_BYTES) -> DataFrame:
    """Error rows of the others: path, status, error_type."""
    return files.where(F.col("length") > most).select("path", F.lit("error").alias("status"), F.lit("file_too_large").alias("error_type"))


def inventory(files: DataFrame) -> DataFrame:
    """path, length, md5, sha256."""
    return files.select("path", "length", F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))


def raw_windows(files: DataFrame) -> DataFrame:
    """path, text: the first and, of larger files, the last million bytes, one character a byte."""
    head, tail = F.expr(f"substring(content, 1, {WINDOW})"), F.expr(f"right(content, {WINDOW})")
    latin = lambda b: F.decode(b, "ISO-8859-1")
    return files.select("path", F.when(F.octet_length("content") > WINDOW, F.concat_ws("\n", latin(head), latin(F.substring(F.col("content"), -WINDOW, WINDOW)))).otherwise(latin(head)).alias("text"))
