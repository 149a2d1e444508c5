"""Toxicity by compression distance: two zstandard dictionaries.

Both are trained by zstandard, one on windows of ordinary texts, one on windows
of toxic texts, and compared by how long the windows of a text become with
either.  Toxic texts are ordinary for the most part, and a dictionary trained on
all their windows learns that part (the README has figures), so it is trained on
the windows that set them apart: windows of one word that too many of their
texts are toxic for, by an exact test of each word, so that rare words and small
languages count.  What it holds is laid behind the ordinary one, so that what
both know cancels out.  Each window of a text (whole words, about ``WINDOW``
bytes) is compressed with either; one that is shorter by the toxic dictionary
speaks for toxicity.  The largest gains, their sum and their share of the windows
go through a logistic curve, fitted on a third of the sample that the
dictionaries have not seen, whose value 0.5 is the threshold.

Fitted on at most ``labelled.PER_CLASS`` rows and ``labelled.CLASS_BYTES`` bytes
of each class, all windows of them; applied to every whole text, of any length,
where it lies, with no shuffle.  Null and empty texts have no windows and gain
nothing.  Null keys never train.  Without training rows of both classes the score
is the share of label 1, or 0.5 if there are none.  Repeated rows are scored
alike, and so are ties; a score of exactly 0.5 is predicted 1.  An empty table
gives an empty table.  Other columns are handed on unread; see ``score`` for
names that clash.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import labelled
from tidemark.llm.quality_nbsvm import scored

WINDOW = 24
LEVEL = 3
LEAST_GAIN = 3
#: What the trainer builds the toxic dictionary from: segments of so many bytes, scored by runs of so many.
SEGMENT, RUN = 16, 8
_CUT = re.compile(rb"\S.{%d,}?(?=\s)|\S.*" % (WINDOW - 2), re.S)
_WORD = re.compile(r"[^\W\d_]+")


def windows(text: bytes) -> list[bytes]:
    """Windows of whole words, with a blank at either end. A longer word is a window of its own."""
    flat = b" ".join(text.decode("utf-8", "replace").lower().encode().split())
    return [b" " + w.strip() + b" " for w in _CUT.findall(flat + b" ")]


def content(samples: list[bytes], size: int, **how: int) -> bytes:
    """What a dictionary trained on the samples holds, without the trainer's tables; few samples are the dictionary themselves."""
    try:
        return zstandard.train_dictionary(size + 1024, samples, **how).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def telling(text: str, words: set[str]) -> bytes:
    """The windows of one word, of a text in lower case, that hold one of the words; the trainer takes them as one sample."""
    return b"".join(f" {w} ".encode() for w in text.lower().split() if not words.isdisjoint(_WORD.findall(w)))


def distinct_words(text: str) -> set[str]:
    return {*_WORD.findall(text.lower())}


def tail(n: int, of: int, p: float) -> float:
    """The chance of n or more of ``of`` when each comes with chance p."""
    k = np.arange(n, of + 1)
    log = np.cumsum(np.log(np.r_[1.0, np.arange(1, of + 1)]))
    return float(min(1.0, np.exp(log[of] - log[k] - log[of - k] + k * np.log(p) + (of - k) * np.log1p(-p)).sum()))


def overrepresented(plain: list[set[str]], bad: list[set[str]], level: float) -> list[str]:
    """Words that too many of their texts are toxic for, the most certain last.

    An exact test of each against the toxic share of all texts, at a false
    discovery rate of ``level``.  It counts only texts that hold the word, so
    words of a small language need no share of all toxic texts.
    """
    p = len(bad) / (len(bad) + len(plain))
    toxic = {w: n for w, n in Counter(w for words in bad for w in words).items() if n >= 2}
    usual = Counter(w for words in plain for w in words if w in toxic)
    chance = sorted((tail(n, n + usual[w], p), w) for w, n in toxic.items() if n * len(plain) > 3 * usual[w] * len(bad))
    last = max((i for i, (c, _) in enumerate(chance, 1) if c <= level * i / len(toxic)), default=0)
    return [w for _, w in reversed(chance[:last])]


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(dictionary or b"        ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


class Model:
    """ordinary, toxic: the dictionaries; the rest is the curve."""

    def __init__(self, texts: list[str], y: np.ndarray, h: np.ndarray, size: int = 31744, toxic_size: int = 8192, level: float = 0.05) -> None:
        share = float(y.mean()) if len(y) else 0.5
        self.ordinary = self.toxic = b""
        self.curve = np.zeros(9)
        self.curve[-1] = np.log(max(share, 1e-3) / max(1 - share, 1e-3))
        self.center, self.scale = np.zeros(8), np.ones(8)
        seen = h % 3 != 0
        if not len(y) or min(y[seen].sum(), (1 - y[seen]).sum(), y[~seen].sum(), (1 - y[~seen]).sum()) < 1:
            return
        plain = [t for t, a, b in zip(texts, y, seen, strict=True) if b and not a]
        bad = [t for t, a, b in zip(texts, y, seen, strict=True) if b and a]
        self.ordinary = content([w for t in plain for w in windows(t.encode())], size)
        words = {*overrepresented([distinct_words(t) for t in plain], [distinct_words(t) for t in bad], level)}
        self.toxic = self.ordinary + content([w for t in bad if (w := telling(t, words))], toxic_size, k=SEGMENT, d=RUN)
        calibrate = np.flatnonzero(~seen)
        gains = self.gains()
        x = np.array([gains(texts[k].encode()) for k in calibrate])
        self.center, self.scale = x.mean(0), x.std(0) + 1e-9
        self.curve = labelled.logistic((x - self.center) / self.scale, y[calibrate])

    def gains(self):
        """In a worker: the function from a text's bytes to its features."""
        one, other = compressor(self.ordinary), compressor(self.toxic)

        def of(text: bytes) -> list[float]:
            ws = windows(text)
            gain = sorted([len(one.compress(w)) - len(other.compress(w)) for w in ws], reverse=True) or [0]
            good = [g for g in gain if g >= LEAST_GAIN]
            n, total = len(gain), float(sum(good))
            return [gain[0], sum(gain[:2]), sum(gain[:3]), np.log1p(total), total / (10 + n), total / (40 + n), len(good) / (10 + n), np.log1p(n)]

        return of

    def scorer(self):
        gains, w = self.gains(), self.curve / np.append(self.scale, 1.0)
        constant = self.curve[-1] - float(w[:-1] @ self.center)
        w = w[:-1]
        return lambda text: float(1 / (1 + np.exp(-np.clip(w @ gains(text) + constant, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, trainable: F.Column, label: str = "toxic", key: str = "doc_id", text: str = "text") -> Model:
    texts, y, h = labelled.sample(docs, labels, label, trainable, key, text)
    model = Model(texts, y, h)
    model.curve[-1] += labelled.shift(labels, label, trainable, y)
    return model


def score(docs: DataFrame, model: Model, text: str = "text", into: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Every row's columns and, named by ``into``, the score (double) and 1 if it is >= 0.5, else 0 (int). Columns that docs has of these names are replaced: name others to keep them."""
    return scored(docs, model.scorer, text, into)
