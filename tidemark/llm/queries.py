"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann_srs, best_fit, bpe, labelled, minhash_oph, quality_nbsvm, repair_tokens, shard_shuffle, syncmers, toxic_zstd, warc_revisit

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ann_srs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_srs.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_shard_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = shard_shuffle.shuffle_shards(table(spark, sf_dir, "documents"), 24)
    return files.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def captures(pages: DataFrame) -> DataFrame:
    """A crawl log of all pages: each page's response, then a not-modified revisit of another spelling of its URL.

    Every fifth revisit carries an entity tag that the response does not have.
    """
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit("")).cast("binary")), F.lit('"'))
    pages = pages.select("page_id", "url", tag.alias("tag"))
    none = F.lit(None).cast("string")
    headers = lambda *pairs: F.map_from_arrays(F.array(*[F.lit(k) for k, _ in pairs]), F.array(*[v for _, v in pairs]))
    day = F.concat(F.lit("day "), F.col("page_id").cast("string"))
    full = pages.select((2 * F.col("page_id")).alias("record_id"), (2 * F.col("page_id")).alias("ts"), "url", F.lit("response").alias("kind"), F.col("tag").alias("etag"), none.alias("last_modified"), none.alias("digest"), headers(("Content-Type", F.lit("text/html")), ("Date", day)).alias("headers"))
    other = F.when(F.col("page_id") % 5 == 0, F.lit('W/"other"')).otherwise(F.concat(F.lit("W/"), F.col("tag")))
    again = pages.select((2 * F.col("page_id") + 1).alias("record_id"), (2 * F.col("page_id") + 1).alias("ts"), F.concat("url", F.lit("#top")).alias("url"), F.lit("revisit").alias("kind"), other.alias("etag"), none.alias("last_modified"), none.alias("digest"), headers(("Content-Type", F.lit("none")), ("Date", F.concat(day, F.lit(" again")))).alias("headers"))
    return full.unionByName(again)


def op3_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc_revisit.resolve(captures(table(spark, sf_dir, "pages")))
    return out.select("record_id", "kind", "refers_to", "status", F.coalesce(F.element_at("headers", F.lit("date")), F.element_at("headers", F.lit("Date"))).alias("date"), F.coalesce(F.element_at("headers", F.lit("content-type")), F.element_at("headers", F.lit("Content-Type"))).alias("content_type"))


def op4_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(table(spark, sf_dir, "documents"), WORD_BPE)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op5_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held = labelled.fold("doc_id", 3) == 1
    model = quality_nbsvm.fit(docs, labels, ~held)
    return quality_nbsvm.score(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")


def op6_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(table(spark, sf_dir, "documents"), WORD_BPE, with_ids=False).drop("ids")


def op7_minhash_oph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_oph.near_duplicates(table(spark, sf_dir, "documents"))


def op8_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    blobs = repair_tokens.write_files(table(spark, sf_dir, "documents"), WORD_BPE)
    return repair_tokens.read_files(blobs, with_ids=False).drop("ids")


def op9_toxic_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held = labelled.fold("doc_id", 5) == 0
    model = toxic_zstd.fit(docs, labels, ~held)
    return toxic_zstd.score(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")


def op10_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = syncmers.with_next(table(spark, sf_dir, "documents"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("n_chars", n.cast("bigint")).withColumn("edited", edited)
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "found", "next_found", syncmers.anchors(F.col("edited")).alias("edited_found"))
    return rows.select("doc_id", "n_chars", "edited_sha256", syncmers.fingerprint(F.col("found")).alias("fingerprint"), syncmers.fingerprint(F.col("edited_found")).alias("edited_fingerprint"), syncmers.likeness(F.col("found"), F.col("edited_found")).alias("near_edited"), syncmers.likeness(F.col("found"), F.col("next_found")).alias("near_next"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_ann_srs, op2_shard_shuffle, op3_warc_revisit, op4_bpe_automaton, op5_quality_nbsvm, op6_best_fit, op7_minhash_oph, op8_repair_tokens, op9_toxic_zstd, op10_syncmers)
}
#: Only op3 has SQL: the others hash, fit models, shuffle or use a tokenizer, and are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_warc_revisit": r"""WITH p AS (SELECT page_id, url, '"' || md5(coalesce(html, '')) || '"' AS tag FROM pages),
rec AS (SELECT 2 * page_id AS record_id, url, 'response' AS kind, tag AS etag, 'day ' || page_id AS date, 'text/html' AS content_type FROM p
  UNION ALL SELECT 2 * page_id + 1, url || '#top', 'revisit', CASE WHEN page_id % 5 = 0 THEN 'W/"other"' ELSE 'W/' || tag END, 'day ' || page_id || ' again', 'none' FROM p),
cut AS (SELECT *, regexp_replace(trim(url), '#.*$', '') AS u FROM rec),
parts AS (SELECT *, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, lower(regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1), '^.*@', '')) AS host,
  regexp_replace(regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', ''), '[?]$', '') AS rest FROM cut),
canon AS (SELECT *, CASE WHEN scheme = '' THEN u ELSE scheme || '://' || CASE scheme WHEN 'http' THEN regexp_replace(host, ':(80)?$', '') WHEN 'https' THEN regexp_replace(host, ':(443)?$', '') ELSE host END
  || CASE WHEN starts_with(rest, '/') THEN rest ELSE '/' || rest END END AS canonical FROM parts),
carried AS (SELECT *, last_value(CASE WHEN kind = 'response' THEN record_id END IGNORE NULLS) OVER (PARTITION BY canonical ORDER BY record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS source FROM canon),
found AS (SELECT a.*, r.content_type AS r_type, CASE WHEN a.kind = 'response' THEN 'response' WHEN a.source IS NULL THEN 'unresolved' WHEN regexp_replace(a.etag, '^W/', '') = regexp_replace(r.etag, '^W/', '') THEN 'resolved' ELSE 'mismatch' END AS status
  FROM carried a LEFT JOIN rec r ON r.record_id = a.source)
SELECT record_id, kind, CASE WHEN status = 'resolved' THEN source END AS refers_to, status, date, CASE WHEN status = 'resolved' THEN r_type ELSE content_type END AS content_type FROM found""",
}
