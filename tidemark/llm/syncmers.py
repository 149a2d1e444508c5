"""Document fingerprints from closed syncmers, with DataFrame functions only.

A text is a sequence of words: runs of up to 32 characters that are not white
space; a Han, Hiragana, Katakana or Thai character is a word of its own.  Of
all runs of ``K`` words those are kept (closed syncmers) whose smallest run of
``S`` words, by hash, is the first or the last one in it.  That depends on the
K words alone, so an edit elsewhere moves no anchor.  A text with fewer than K
words, or where no run is kept, has one anchor, all of it; a text without words
has none.

The fingerprint is the anchors in the order of the text, each as 8 hexadecimal
digits (the first 32 bits of its hash), "+", and how many words it lies behind
the anchor before it (the first one: behind the start).  Two anchors match if
both are equal: the same words at the same place beside what comes before them,
wherever in the text that is.  Likeness of two fingerprints: twice the common
distinct entries over both counts; 1 if both have none.  It can be worked out
from the two strings.

Null texts count as empty.  Texts of any length are taken whole.  Repeated rows
have equal fingerprints, and so have equal texts.  An empty table gives an empty
table.  Columns other than the key and the text are not read, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import bound, bucket_count, ranged

K, S = 5, 2
_OWN = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}"
WORDS = rf"[{_OWN}]|[^\s{_OWN}]{{1,32}}"
#: An anchor is one number: the first 32 bits of its hash, then its distance in so many bits. Anchors are kept for every S + 1 runs at least, so distances are small but for the first.
DISTANCE = 20


def anchors(text: F.Column) -> F.Column:
    """The anchors, array<bigint>, in the order of the text: hash and distance."""
    entry = lambda h, far: F.shiftleft(F.shiftrightunsigned(h, 32), DISTANCE) + F.least(far, F.lit((1 << DISTANCE) - 1))

    def of_runs(s: F.Column) -> F.Column:
        at = lambda i, j: F.get(s, i + j)
        w = K - S
        inner = [lambda i, j=j: at(i, j) for j in range(1, w)]
        here = F.filter(F.sequence(F.lit(0), F.size(s) - F.lit(w + 1)), lambda i: F.least(at(i, 0), at(i, w)) <= F.least(*[f(i) for f in inner]))
        whole = lambda i: F.xxhash64(*[at(i, j) for j in sorted({*range(0, w, S), w})])
        return bound(here, lambda p: F.transform(p, lambda i, k: entry(whole(i), i - F.coalesce(F.get(p, k - 1), F.lit(0)))))

    def of_words(h: F.Column) -> F.Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(h) - F.lit(S)), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(S)]))
        whole = F.array(entry(F.xxhash64(h), F.lit(0)))
        kept = bound(bound(runs, of_runs), lambda a: F.when(F.size(a) > 0, a).otherwise(whole))
        return F.when(F.size(h) >= K, kept).when(F.size(h) > 0, whole).otherwise(F.array().cast("array<bigint>"))

    return bound(F.transform(F.regexp_extract_all(text, F.lit(WORDS), F.lit(0)), lambda w: F.xxhash64(w)), of_words)


def fingerprint(found: F.Column) -> F.Column:
    one = lambda x: F.concat(F.lpad(F.lower(F.hex(F.shiftrightunsigned(x, DISTANCE))), 8, "0"), F.lit("+"), x.bitwiseAND(F.lit((1 << DISTANCE) - 1)).cast("string"))
    return F.array_join(F.transform(found, one), " ")


def likeness(a: F.Column, b: F.Column) -> F.Column:
    both = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint of every row, where it lies. Null text: empty."""
    return docs.select(F.col(key), fingerprint(anchors(F.coalesce(F.col(text).cast("string"), F.lit("")))).alias("fingerprint"))


def with_next(docs: DataFrame, range_bytes: int = 4 << 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text, found (anchors), next_text, next_found of every row.

    The next document is by ascending key (a number; null keys first, ties by the
    text's hash); the first one follows the last.  Ranges of (key, hash) are sorted
    apart; a range's last row takes the first row of the next range.  Where a key
    (or null) has the rows of several ranges, its equal texts are counted first: all
    but the last of them are followed by the same text.
    """
    table = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows, split = ranged(table, "key", "tie", bucket_count(table, "text", range_bytes), "range")
    rows = rows.withColumn("copies", F.lit(1).cast("bigint"))
    if split:
        level = F.shiftright("range", 20)
        alone = F.col("key").isNull() | (level % 2 == 0)
        counted = rows.where(alone).groupBy("range", "key", "tie").agg(F.first("text").alias("text"), F.sum("copies").alias("copies"))
        rows = rows.where(~alone).unionByName(counted)
    # one row for each range
    order = Window.orderBy("range")
    heads = rows.select("range").distinct()
    parts = heads.count()
    heads = heads.select("range", F.coalesce(F.lead("range").over(order), F.first("range").over(order)).alias("after"))
    dealt = rows.repartition(max(1, parts), "range")
    inside = Window.partitionBy("range").orderBy("key", "tie")
    row = dealt.withColumn("found", anchors(F.col("text"))).select("key", "range", "tie", "copies", F.struct("text", "found").alias("doc"))
    led = row.withColumn("next", F.lead("doc").over(inside))
    firsts = dealt.withColumn("at", F.row_number().over(inside)).where("at = 1").select(F.col("range").alias("after"), F.struct("text", anchors(F.col("text")).alias("found")).alias("first"))
    follow = heads.join(firsts, "after").select("range", "first")
    both = led.join(follow, "range").withColumn("next", F.coalesce("next", "first"))
    if split:
        both = both.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).withColumn("next", F.when(F.col("copy") < F.col("copies"), F.col("doc")).otherwise(F.col("next")))
    return both.select(F.col("key").alias(key), F.col("doc.text").alias("text"), F.col("doc.found").alias("found"), F.col("next.text").alias("next_text"), F.col("next.found").alias("next_found"))
