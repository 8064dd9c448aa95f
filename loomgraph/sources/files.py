"""Source trees and logs as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def source_files(spark: SparkSession, root: str, pattern: str = "*.java") -> DataFrame:
    """path, modified, size and text of all files below ``root`` whose names fit the pattern; a folder that doesn't exist gives nothing.

    The files are listed by Spark and read in the tasks, several small ones in each.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "path string, modified timestamp, size bigint, text string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), F.col("content").cast("string").alias("text"))


def with_header(name: Column, text: Column) -> Column:
    """A log with its name above it: ``=== name ===`` and the text; null and empty texts give null."""
    return F.when(text != "", F.concat(F.lit("=== "), F.coalesce(name, F.lit("unknown")), F.lit(" ===\n"), text))
