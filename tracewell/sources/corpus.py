"""SQL files of checked-out repositories, and the writers of exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_sql_files(spark: SparkSession, root: str, folder: str | None = None) -> DataFrame:
    """path, repo (first folder below root), content of every .sql file below root; with folder only those below a folder of that name."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.sql").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    if folder:
        files = files.where(F.contains("path", F.lit(f"/{folder}/")))
    base = root.rstrip("/").rsplit("/", 1)[-1]
    return files.select("path", F.regexp_extract("path", f"/{base}/([^/]+)/", 1).alias("repo"), "content")


def decoded(content: str = "content"):
    """Base64 content, as repository services send it, to text."""
    return F.decode(F.unbase64(F.regexp_replace(content, r"\s+", "")), "UTF-8")


def write_edge_csv(export: DataFrame, path: str, quoted: bool = False) -> None:
    """The columns under their titles. Values stand as they are, commas and all; quoted writes CSV that can be read back."""
    if quoted:
        export.write.mode("overwrite").option("header", True).csv(path)
        return
    lines = export.select(F.concat_ws(",", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in export.columns)).alias(",".join(export.columns)))
    lines.write.mode("overwrite").option("header", True).option("quote", "\u0000").option("escapeQuotes", False).option("sep", "\u0001").csv(path)


def check_folder(spark: SparkSession, root: str, folder: str) -> DataFrame:
    """repo, n: the repositories below root that have .sql files in a folder of that name, and how many."""
    return read_sql_files(spark, root, folder).groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
