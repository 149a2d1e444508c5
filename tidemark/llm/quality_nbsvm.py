"""Quality by naive Bayes support vectors.

A text's features are indicators of its byte n-grams (1 to 3 bytes, hashed to
``2 ** BITS`` places) and of three classes of its word sequence: how many words
(by powers of two), which share of them is distinct, which share repeats the
word before it (an n-gram that no fixed list of words holds).  Each is scaled by its class log-count ratio, the vector
is scaled to length 1, and a linear model with hinge loss is fitted by dual
coordinate descent.  A logistic curve, fitted on a third of the sample that the
model has not seen, turns the margin into a score.

Fitted on at most ``labelled.PER_CLASS`` rows of each class; applied to every
whole text where it lies, with no shuffle.  Null and empty texts have no
features and get the score of margin 0.  Without training rows of both classes
the score is the share of label 1, or 0.5 if there are none.  Repeated rows
are scored alike; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import labelled
from tidemark.llm.token_text import batches

BITS = 18
PLACES = (1 << BITS) + 48


def features(text: bytes, scratch: np.ndarray) -> np.ndarray:
    """Places of the n-grams of a text, ascending; scratch: PLACES times False, left so."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    for n in (1, 2, 3):
        if len(b) < n:
            break
        h = np.full(len(b) - n + 1, n, np.uint32)
        for j in range(n):
            h = h * np.uint32(257) + b[j : len(b) - n + 1 + j]
        scratch[(h * np.uint32(2654435761)) >> np.uint32(32 - BITS)] = True
    words = text.split()
    if n := len(words):
        again = sum(map(eq, words, words[1:]))
        scratch[(1 << BITS) + min(15, n.bit_length())] = True
        scratch[(1 << BITS) + 16 + 8 * len(set(words)) // n] = True
        scratch[(1 << BITS) + 32 + (min(7, 1 + 16 * again // n) if again else 0)] = True
    found = np.flatnonzero(scratch)
    scratch[found] = False
    return found


class Model:
    def __init__(self, texts: list[str], y: np.ndarray, h: np.ndarray, passes: int = 20, cost: float = 1.0) -> None:
        self.weights = np.zeros(PLACES, np.float32)  # of an indicator before the text's scaling
        self.ratio = np.zeros(PLACES, np.float32)
        share = float(y.mean()) if len(y) else 0.5
        self.curve = np.array([0.0, np.log(max(share, 1e-3) / max(1 - share, 1e-3))])
        seen = h % 3 != 0
        if not len(y) or min(y[seen].sum(), (1 - y[seen]).sum(), y[~seen].sum(), (1 - y[~seen]).sum()) < 1:
            return
        scratch = np.zeros(PLACES, bool)
        rows = [features(t.encode(), scratch) for t in texts]
        counts = np.ones((2, PLACES))
        for k in np.flatnonzero(seen):
            counts[y[k], rows[k]] += 1
        ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
        self.ratio = ratio.astype(np.float32)
        w, bias = np.zeros(PLACES), 0.0
        train = np.flatnonzero(seen)
        norm = [np.sqrt((ratio[r] ** 2).sum()) or 1.0 for r in rows]
        x = {k: ratio[rows[k]] / norm[k] for k in train}
        sign = np.where(y == 1, 1.0, -1.0)
        # each class counts alike
        most = {k: cost * len(train) / (2 * (y[train] == y[k]).sum()) for k in train}
        alpha = np.zeros(len(rows))
        order = np.random.default_rng(5)
        for _ in range(passes):
            moved = 0.0
            for k in order.permutation(train):
                r, v = rows[k], x[k]
                gradient = sign[k] * (w[r] @ v + bias) - 1
                new = min(max(alpha[k] - gradient / 2, 0.0), most[k])  # |x|^2 = 1, and 1 for the constant
                step = (new - alpha[k]) * sign[k]
                if step:
                    w[r] += step * v
                    bias += step
                    alpha[k] = new
                    moved = max(moved, abs(step))
            if moved < 1e-3:
                break
        self.weights, self.bias = (w * ratio).astype(np.float32), bias
        held = np.flatnonzero(~seen)
        margin = np.array([self.margin(rows[k]) for k in held])
        self.curve = labelled.logistic(margin[:, None], y[held])

    bias = 0.0

    def margin(self, found: np.ndarray) -> float:
        if not len(found):
            return self.bias
        norm = float(np.sqrt((self.ratio[found].astype(np.float64) ** 2).sum())) or 1.0
        return float(self.weights[found].sum(dtype=np.float64)) / norm + self.bias

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.curve[0] * self.margin(found) + self.curve[1], -30, 30))))


def score(docs: DataFrame, model: Model, text: str = "text", into: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Every row's columns and, named by ``into``, the score (double) and 1 if it is >= 0.5, else 0 (int). Columns that docs has of these names are replaced: name others to keep them."""
    return scored(docs, lambda: _scorer(model), text, into)


def _scorer(model: Model):
    scratch = np.zeros(PLACES, bool)
    return lambda t: model.score(features(t, scratch))


def scored(docs: DataFrame, make, text: str, into: tuple[str, str]) -> DataFrame:
    """docs with two columns more; ``make()`` gives, in a worker, the function from a text's bytes to its score."""
    docs = docs.drop(*into).withColumn(text, F.col(text).cast("string"))
    names = [f"c{k}" for k in range(len(docs.columns))]  # whatever the columns are called
    at = names[docs.columns.index(text)]
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema, strict=True))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for b in batches(parts, at, 4 << 20):
            values = pa.array([one(t or b"") for t in b.column(at).cast(pa.large_binary()).to_pylist()], pa.float64())
            hit = pa.array((values.to_numpy() >= 0.5).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, values, hit], [*names, "score", "predicted"])

    return docs.toDF(*names).mapInArrow(run, f"{schema}, score double, predicted int").toDF(*docs.columns, *into)


def fit(docs: DataFrame, labels: DataFrame, trainable: F.Column, label: str = "quality", key: str = "doc_id", text: str = "text") -> Model:
    texts, y, h = labelled.sample(docs, labels, label, trainable, key, text)
    model = Model(texts, y, h)
    model.curve[-1] += labelled.shift(labels, label, trainable, y)
    return model
