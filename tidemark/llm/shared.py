"""What several operators of this subpackage need."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset (tests, one machine) a folder made here."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read again from a table in the shared folder: nothing before it runs twice or is lost with an executor."""
    return _write(df, f"{shared_dir(df.sparkSession)}/tidemark-{name}-{uuid.uuid4().hex}")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """written() into a folder of its own, which goes when the block ends: what leaves the block must be written elsewhere."""
    folder, count = f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}", iter(range(1 << 30))
    try:
        yield lambda df, table: _write(df, f"{folder}/{next(count)}-{table}")
    finally:
        remove(spark, folder)


def drop_tables(spark: SparkSession) -> None:
    """Removes all tables that this subpackage left in the shared folder: call it when the results have been read."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        return
    base = spark._jvm.org.apache.hadoop.fs.Path(found)
    files = base.getFileSystem(spark._jsc.hadoopConfiguration())
    for x in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(base, "tidemark-*")) or []:
        files.delete(x.getPath(), True)
    if found.startswith(tempfile.gettempdir() + "/tidemark-"):
        shutil.rmtree(found, ignore_errors=True)
        spark.conf.unset("spark.checkpoint.dir")


def grouped(df: DataFrame, by: list[str], of_group: Callable[[pa.Table], pa.Table | None], schema: str) -> DataFrame:
    """of_group for each group of the bigint columns ``by``, none of them null.

    The rows are dealt and sorted by ``by`` and cut in Python, so that small
    groups cost no Arrow stream each; a worker holds one group and one batch.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last: tuple | None = None

        def done() -> Iterator[pa.RecordBatch]:
            if held and (out := of_group(pa.Table.from_batches(held).combine_chunks())) is not None:
                yield from out.to_batches()

        for b in parts:
            if not len(b):
                continue
            keys = np.stack([b.column(c).to_numpy() for c in by])
            starts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), len(b)]
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                key = tuple(keys[:, lo].tolist())
                if key != last:
                    yield from done()
                    held, last = [], key
                # taken, not sliced: a slice would keep its whole batch in memory
                held.append(b if hi - lo == len(b) else b.take(pa.array(np.arange(lo, hi))))
        yield from done()

    return df.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, schema)


#: Cut points of one level, at most: they are literals of a plan, or a row of a small table.
MOST_CUTS = 512


def ranged(df: DataFrame, key: str, tie: str, parts: int, name: str) -> tuple[DataFrame, bool]:
    """df and ``name``, a bigint that ascends with (key, tie), null keys first, with about ``parts`` values; and whether a key was cut by tie.

    key and tie are numbers.  The first level cuts at quantiles of key; a key that
    holds several quantiles, and null, is a range of its own.  The second level cuts
    ranges that are still too large at their own quantiles: those of tie where all
    keys are equal, else those of key.  Rows that are equal in both stay together.
    """
    if parts < 2:
        return df.withColumn(name, F.lit(0).cast("bigint")), False
    n = min(parts, MOST_CUTS)
    quantiles = lambda c, n: F.percentile_approx(c, [k / n for k in range(1, n)], 10 * n)
    seen = Counter(df.select(quantiles(key, n).alias("q")).first()["q"] or [])
    hot = [c for c, times in seen.items() if times > 1]
    below = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(seen)]), lambda c: c < F.col(key))) if seen else F.lit(0)
    own = F.col(key).isin(*hot) if hot else F.lit(False)
    level = F.when(F.col(key).isNull(), 0).otherwise(1 + 2 * below + own.cast("int"))
    cut = df.withColumn("_level", level.cast("bigint")).withColumn("_by", F.when(F.col(key).isNull() | own, F.col(tie)).otherwise(F.col(key)))
    # at most 2 * MOST_CUTS + 1 rows here and in the next table
    sizes = {r["_level"]: r["n"] for r in cut.groupBy("_level").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    need = {k: min(MOST_CUTS, x) for k, v in sizes.items() if (x := v * parts // total) > 1}
    place = F.lit(0).cast("bigint")
    if need:
        most = max(need.values())
        rows = cut.where(F.col("_level").isin(*need)).groupBy("_level").agg(quantiles("_by", most).alias("q")).collect()
        cuts = [(r["_level"], sorted({r["q"][j * most // need[r["_level"]] - 1] for j in range(1, need[r["_level"]])})) for r in rows]
        cut = cut.join(F.broadcast(df.sparkSession.createDataFrame(cuts, "_level bigint, _cuts array<bigint>")), "_level", "left")
        place = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_by"))), F.lit(0)).cast("bigint")
        place = F.when(F.col("_cuts").isNull(), 0).otherwise(place)
    split = any(k == 0 or (k - 1) % 2 for k in need)
    return cut.withColumn(name, F.shiftleft("_level", 20) + place).drop("_level", "_by", "_cuts"), split


def bound(value: F.Column, use: Callable[[F.Column], F.Column]) -> F.Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def bucket_count(df: DataFrame, column: str, target_bytes: int, least: int = 1) -> int:
    """So many buckets hold about target_bytes of a column each. One pass over that column alone."""
    total = df.select(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0
    return max(least, -(-int(total) // target_bytes))
