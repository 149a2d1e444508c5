"""A corpus pipeline: four stages over documents, each one operator of tidemark.llm.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; all but the last return the columns of documents.  run() writes
each stage's result to the shared folder and reads it again for the next.

For all stages: every row is a document, also rows that are equal or share a
doc_id.  Columns other than doc_id and text are handed on unread, whatever their
names ("score", "predicted" and "key" among them).  Texts of any length are taken
whole.  An empty table gives an empty table with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import best_fit, minhash_oph, quality_nbsvm, toxic_zstd
from tidemark.llm.queries import WORD_BPE, table
from tidemark.llm.shared import written

#: Near-duplicates: words of a shingle, percent of likeness, and bands and rows that find such a pair but for one in 10 million.
SHINGLE, PERCENT, BANDS, ROWS = 5, 80, 40, 5


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _own(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not call toxic.

    Null and empty texts have no windows: they get the score of a text without
    gains and stay unless most labels are toxic.  Null doc_ids never train and are
    scored like others; equal rows and equal scores (ties) are decided alike, a
    score of exactly 0.5 is toxic.
    """
    model = toxic_zstd.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    into = _free(docs, "toxic_score"), _free(docs, "toxic_predicted")
    return toxic_zstd.score(docs, model, into=into).where(F.col(into[1]) == 0).select(_own(docs))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model accepts.

    Null and empty texts have no features and get the score of margin 0.  Null
    doc_ids never train and are scored like others; equal rows and equal scores
    (ties) are decided alike, a score of exactly 0.5 is accepted.
    """
    model = quality_nbsvm.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    into = _free(docs, "quality_score"), _free(docs, "quality_predicted")
    return quality_nbsvm.score(docs, model, into=into).where(F.col(into[1]) == 1).select(_own(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest doc_id (null: last), of equal ones any one.

    Rows are told apart by numbers of their own, so texts of one doc_id that are
    not near-duplicates all stay, and rows without a doc_id are compared
    like others.  Null and empty texts are near nothing and stay.
    """
    row = _free(docs, "row_number_of_stage")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    groups = minhash_oph.near_duplicates(numbered, shingle=SHINGLE, percent=PERCENT, bands=BANDS, rows=ROWS, key=row)
    groups = groups.select(F.col(row).alias("row"), F.col("component_id").alias("of"), (F.col("n_shingles") > 0).alias("full"))
    ids = numbered.select(F.col(row).alias("row"), F.col("doc_id").alias("id"))
    group = [F.when(F.col("full") | F.col("id").isNull(), F.col("of")).alias("of"), F.when(~F.col("full"), F.col("id")).alias("of_empty")]
    first = groups.join(ids, "row").groupBy(*group).agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"))
    return numbered.join(first.select(F.col("first.row").alias(row)), row, "left_semi").select(_own(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All ids of all documents in sequences of at most 2048.

    A null or empty text is the end id alone; null doc_ids are packed under a null
    key; equal rows are packed as often as they occur; ties between open bins go to
    the one touched last.
    """
    return best_fit.pack(docs, WORD_BPE)


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_dedup", near_dedup), ("packing", packing)]

#: Fitted models and hashed sketches have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
