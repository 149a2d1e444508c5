"""An object store's verbs over any Hadoop file system, as tables where they can be many."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """key, size, modified of the files under a folder, without reading them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return files.select(F.col("path").alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def page(keys: DataFrame, prefix: str, after: str, limit: int) -> tuple[list[str], str | None]:
    """One page of keys in order, and where to go on if there are more."""
    rows = [r["key"] for r in keys.where(F.col("key").startswith(prefix) & (F.col("key") > after)).select("key").orderBy("key").limit(limit + 1).collect()]
    return rows[:limit], rows[limit - 1] if len(rows) > limit else None


def create_if_absent(df: DataFrame, path: str) -> str:
    """'created' or 'exists'; a table that is there is not touched."""
    from pyspark.errors import AnalysisException

    try:
        df.write.mode("errorifexists").parquet(path)
        return "created"
    except AnalysisException as e:
        if "PATH_ALREADY_EXISTS" not in str(e):
            raise
        return "exists"


def read_bounded(spark: SparkSession, path: str, most: int) -> DataFrame:
    """A table whose files are at most so many bytes each."""
    df = spark.read.parquet(path)
    over = df.select(F.col("_metadata.file_size").alias("n")).where(F.col("n") > most)
    if not over.isEmpty():
        raise ValueError(f"a file of {path} is larger than {most} bytes")
    return df
