"""Training samples and the calibration that the two classifiers share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of each class that a classifier is fitted on, and bytes of their texts, at most.
PER_CLASS, CLASS_BYTES = 1500, 64 << 20


def fold(key: str, n: int) -> F.Column:
    """crc32 of the key as text, modulo n."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(n))


def sample(docs: DataFrame, labels: DataFrame, label: str, trainable: F.Column, key: str = "doc_id", text: str = "text") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts, labels (0 or 1) and a second hash of the keys: PER_CLASS rows of each class in the order of the keys' hash.

    The driver holds at most CLASS_BYTES of text of each class: rows are taken in
    that order, whole, as long as they fit.  Of rows of one key the text with the
    smallest hash is taken, so the sample is the same in every run.
    """
    picked = None
    for y in (0, 1):
        of = labels.where(trainable & (F.col(label) == y) & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.lit(y).alias("y"), F.xxhash64(F.col(key), F.lit(7)).alias("order")).distinct()
        of = of.orderBy("order", "k").limit(PER_CLASS)
        picked = of if picked is None else picked.unionByName(of)
    given = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).where("t is not null")
    # at most 2 * PER_CLASS rows of a few numbers, here and in the next join
    sized = given.join(F.broadcast(picked), "k").groupBy("k", "y", "order").agg(F.min(F.struct(F.xxhash64("t").alias("h"), F.octet_length("t").alias("size"))).alias("one"))
    chosen, room = [], {0: CLASS_BYTES, 1: CLASS_BYTES}
    for r in sorted(sized.select("k", "y", "order", "one.h", "one.size").collect(), key=lambda r: (r["order"], r["k"])):
        if r["size"] <= room[r["y"]]:
            room[r["y"]] -= r["size"]
            chosen.append((r["k"], r["y"], r["h"]))
    if not chosen:
        return [], np.empty(0, np.int64), np.empty(0, np.int64)
    kind = dict(given.dtypes)["k"]
    wanted = docs.sparkSession.createDataFrame(chosen, f"k {kind}, y int, h bigint")
    found = given.join(F.broadcast(wanted), "k").where(F.xxhash64("t") == F.col("h")).groupBy("k", "y").agg(F.first("t").alias("t"))
    rows = sorted(found.select("k", "y", "t", F.xxhash64("k", F.lit(8)).alias("h")).collect(), key=lambda r: (r["k"], r["y"]))
    return [r["t"] for r in rows], np.array([r["y"] for r in rows], np.int64), np.array([r["h"] for r in rows], np.int64)


def shift(labels: DataFrame, label: str, trainable: F.Column, y: np.ndarray) -> float:
    """What to add to a curve fitted on the sample, whose classes are nearer to equal than those of all training labels."""
    n = {r["y"]: r["n"] for r in labels.where(trainable & F.col(label).isin(0, 1)).groupBy(F.col(label).alias("y")).agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1) or not 0 < y.sum() < len(y):
        return 0.0
    return float(np.log(n[1] / n[0]) - np.log(y.sum() / (len(y) - y.sum())))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights (the last one is the constant) by Newton's method."""
    z = np.c_[x, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(y) + ridge * np.eye(len(w)), z.T @ (p - y) / len(y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w
