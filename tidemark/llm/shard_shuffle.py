"""Sharding with a two-pass external shuffle.

Pass one scatters the rows by seeded hashes: the shard is the one whose hash
with the key is largest (so one more shard takes rows only into itself), and
within a shard a second hash deals rows over buckets of about ``bucket_bytes``.
Pass two takes one bucket at a time into memory, puts it into a canonical
order, shuffles it by Fisher-Yates with a generator seeded by the bucket's
number, and writes it.  A row's slot is its bucket's first slot plus its place,
worked out from the counts of the written buckets.

The files (Parquet, a folder for each shard) are in the shared folder; a
retried task writes the same rows.  All hashes are of a row's own values and, for
equal rows of many bytes, the number of the copy, so such rows spread over the
buckets of their shard, and the result does not depend on how the input lies.

Null keys go to one shard like any other key; a null text has size 8 and an empty
one too.  Texts of any length are taken whole; one longer than ``bucket_bytes``
makes its bucket larger.  Equal rows are separate records.  An empty table gives
empty files.  Columns other than the key and the text are not read, whatever
their names.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import bucket_count, shared_dir, written


def shard_of(key: str, shards: int, seed: int) -> F.Column:
    """Highest random weight: argmax over shards of a seeded hash."""
    weights = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), s, F.lit(seed)).alias("w"), s.alias("s")))
    return F.array_max(weights)["s"]


def shuffle_shards(docs: DataFrame, shards: int, seed: int = 1, bucket_bytes: int = 16 << 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text, size, text_crc32, shard, slot, grown_shard of every row, read from the files written."""
    table = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).withColumn("hash", F.xxhash64("text"))
    per_shard = -(-bucket_count(table, "text", bucket_bytes) // shards)
    # equal rows of more than a bucket's share are counted and numbered, so that their copies spread
    weight = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8)
    many = table.groupBy("key", "hash").agg(F.count("*").alias("copies"), weight.alias("weight")).where((F.col("weight") > bucket_bytes // 4) & (F.col("copies") > 1)).drop("weight")
    table = table.withColumn("copy", F.lit(0).cast("bigint"))
    if per_shard > 1 and not many.isEmpty():
        many = written(many, "copies")
        same = F.col("key").eqNullSafe(F.col("k")) & (F.col("hash") == F.col("h"))
        of = many.select(F.col("key").alias("k"), F.col("hash").alias("h"))
        one = table.join(of, same, "left_semi").groupBy("key", "hash").agg(F.first("text").alias("text")).join(many.select(F.col("key").alias("k"), F.col("hash").alias("h"), "copies"), same)
        spread = one.select("key", "text", "hash", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"))
        table = table.join(of, same, "left_anti").unionByName(spread)
    dealt = table.select(
        "key",
        "text",
        shard_of("key", shards, seed).alias("shard"),
        shard_of("key", shards + 1, seed).alias("grown_shard"),
        F.pmod(F.xxhash64("key", "hash", "copy", F.lit(seed)), F.lit(per_shard)).cast("int").alias("bucket"),
    )
    if per_shard > 1:
        dealt = dealt.repartition(per_shard * shards, "shard", "bucket")

    def one_bucket(b: pa.Table) -> pa.Table:
        raw = b.column("text").cast(pa.large_binary()).to_pylist()
        crc = np.array([zlib.crc32(t or b"") for t in raw], np.int64)
        size = np.array([len(t or b"") + 8 for t in raw], np.int64)
        b = b.append_column("size", pa.array(size)).append_column("text_crc32", pa.array(crc))
        b = b.take(pc.sort_indices(b, sort_keys=[("key", "ascending"), ("text_crc32", "ascending"), ("size", "ascending"), ("text", "ascending")]))
        rng = np.random.default_rng([seed, b.column("shard")[0].as_py(), b.column("bucket")[0].as_py()])
        order = np.arange(len(b))
        for i, j in zip(range(len(b) - 1, 0, -1), rng.integers(0, np.arange(len(b), 1, -1)).tolist(), strict=True):
            order[i], order[j] = order[j], order[i]
        return b.take(pa.array(order)).append_column("place", pa.array(np.arange(len(b), dtype=np.int64)))

    kind = dict(table.dtypes)["key"]
    rows = dealt.groupBy("shard", "bucket").applyInArrow(one_bucket, f"key {kind}, text string, shard int, grown_shard int, bucket int, size bigint, text_crc32 bigint, place bigint")
    path = f"{shared_dir(docs.sparkSession)}/tidemark-shards-{uuid.uuid4().hex}"
    rows.write.partitionBy("shard").parquet(path)
    files = docs.sparkSession.read.schema(rows.schema).parquet(path)
    # one row for each bucket
    order = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = files.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("first"))
    return files.join(first, ["shard", "bucket"]).select(F.col("key").alias(key), F.col("text").alias(text), "size", "text_crc32", "shard", (F.col("first") + F.col("place")).alias("slot"), "grown_shard")
