"""Near-duplicates by one-permutation MinHash with optimal densification.

1. One pass over the texts gives each row its number of distinct shingles, a
   128-bit digest of the set, and a sketch: one hash of every shingle, the range
   of the hash cut into bins, the smallest in each bin; an empty bin takes the
   value of the first full one in its own fixed random order of the bins.
2. Rows with equal sets are one class (partial aggregation first, so a class of
   any number of copies is cheap); only classes go on.  A class is known by its
   smallest key and the hash of that row's text.
3. Bands of a sketch are bucket keys.  Each bucket has one center, the member
   that comes first in one order of all classes (most seats in its buckets), and
   every other member gets an edge to it: edges are stars, and as buckets of one
   group agree on their center, a member has few different ones.  The edges are
   confirmed on full sets, computed again from the texts.
4. Links are joined into components by smallest label with pointer jumping.
5. Buckets that still hold several components are finished exactly: every pair
   of members of different components, but for those with the center, is compared
   by sketches in cells of two blocks, in the first bucket that the pair shares
   (the margin is six standard deviations); texts go only to cells where a pair
   is left, and the pair is confirmed there on full sets, unless its components
   were joined before it.  A cell gives links, at most one for each component but
   one, never its pairs.  So each pair that shares a bucket is tested, or its
   ends are in one component already, and no number of rounds limits that.

No step puts a bucket, class or component into one task: buckets are only
aggregated, joined and cut into cells, and a cell and the partners of a center
are bounded in rows and bytes.  Among the members outside a bucket's largest
component the comparisons of sketches (not the rows) grow with the square of
their number: there is no cap.

Words are runs of characters other than ASCII white space, A-Z lower-cased.
Shingles are compared by 64-bit hashes.  A text with fewer words than a shingle
is one shingle; a null or empty text has none, is linked with nothing and is
kept.  A text of any length is taken whole; one longer than a block's bytes is a
block of its own.  Rows with a null key take no part (component null, kept).
All rows of a repeated key get one component: what one of them is linked with,
all are.  An empty table gives an empty table.  Columns other than the key and
the text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import grouped, scratch, written
from tidemark.llm.token_text import batches

#: Members, and bytes of their texts, of a block; a task holds two blocks at a time.
BLOCK, BLOCK_BYTES = 1024, 16 << 20
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    h = (h ^ (h >> np.uint64(30))) * _MIX[1]
    h = (h ^ (h >> np.uint64(27))) * _MIX[2]
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    texts = pc.ascii_lower(pc.fill_null(texts, "").take(pa.array(np.arange(len(texts)))).cast(pa.large_string()))
    words = pc.ascii_split_whitespace(texts)
    offsets = words.offsets.to_numpy()
    codes = words.flatten().dictionary_encode()
    distinct = codes.dictionary.cast(pa.large_binary()).to_pylist()
    of_word = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
    code = codes.indices.to_numpy()
    full = pc.greater(pc.binary_length(codes.dictionary), 0).to_numpy(zero_copy_only=False)[code] if len(distinct) else np.empty(0, bool)
    at = np.concatenate([[0], np.cumsum(full)])[offsets - offsets[0]]  # empty words are cut at the ends of a text
    h = of_word[code[full]] if len(distinct) else np.empty(0, np.uint64)
    n = max(0, len(h) - k + 1)
    s = np.zeros(n, np.uint64)
    for j in range(k):
        s = mix(s * _MIX[0] + h[j : j + n])
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if hi - lo >= k:
            yield np.unique(s[lo : hi - k + 1])
        elif hi > lo:
            one = np.uint64(hi - lo)
            for x in h[lo:hi]:
                one = mix(np.array([one * _MIX[1] + x], np.uint64))[0]
            yield np.array([one], np.uint64)
        else:
            yield np.empty(0, np.uint64)


class Sketcher:
    def __init__(self, bands: int, rows: int, seed: int = 11) -> None:
        self.bands, self.rows = bands, rows
        n = self.n = bands * rows
        self.edges = np.array([(i << 64) // n for i in range(n)], np.uint64)
        rng = np.random.default_rng(seed)
        self.order = np.argsort(rng.random((n, n)), axis=1).astype(np.int16)  # of the bins, for each empty bin
        self.factor = rng.integers(1, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = mix(np.arange(1, bands + 1, dtype=np.uint64) * _MIX[0])

    def sketch(self, u: np.ndarray) -> np.ndarray:
        """u: sorted distinct hashes, not empty."""
        first = np.searchsorted(u, self.edges)
        value = u[np.minimum(first, len(u) - 1)]
        full = np.append(first[1:], len(u)) > first
        if not full.all():
            empty = np.flatnonzero(~full)
            order = self.order[empty]
            value[empty] = value[order[np.arange(len(empty)), full[order].argmax(axis=1)]]
        return value

    def buckets(self, value: np.ndarray) -> np.ndarray:
        return mix((value.reshape(self.bands, self.rows) * self.factor).sum(axis=1, dtype=np.uint64) + self.salt).view(np.int64)


def _sketches(table: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Sketcher(bands, rows)
        for b in batches(parts, "text", 4 << 20):
            n, hi, lo, keys, small = [], [], [], [], []
            with np.errstate(over="ignore"):
                for u in shingle_sets(b.column("text"), k):
                    n.append(len(u))
                    if not len(u):
                        hi.append(0), lo.append(0), keys.append(None), small.append(None)
                        continue
                    d = xxhash.xxh3_128_intdigest(u.tobytes())
                    hi.append((d >> 64) - (1 << 63)), lo.append((d & ((1 << 64) - 1)) - (1 << 63))
                    value = one.sketch(u)
                    keys.append(one.buckets(value))
                    small.append((value & np.uint64(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("hash"), b.column("bytes"), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(small, pa.binary())], ["key", "hash", "bytes", "n", "hi", "lo", "buckets", "sketch"])

    given = table.select("key", "hash", F.octet_length("text").cast("bigint").alias("bytes"), "text")
    return given.mapInArrow(run, "key bigint, hash bigint, bytes bigint, n bigint, hi bigint, lo bigint, buckets array<bigint>, sketch binary")


def components(links: DataFrame, save: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """node, label of all nodes of links (a, b): the smallest node reachable. Each round is a written table."""
    both = save(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
    labels = save(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        at = labels.select(F.col("node").alias("b"), F.col("label").alias("other"))
        best = both.join(at, "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("m"))
        hooked = save(labels.join(best, "node").select("node", "label", F.least("label", "m").alias("new")), "hooked")
        jump = hooked.select(F.col("node").alias("new"), F.col("new").alias("far"))
        labels = save(hooked.join(jump, "new").select("node", F.col("far").alias("label"), (F.col("far") != F.col("label")).alias("moved")), "labels")
        if labels.where("moved").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")


class Sets:
    """The shingle sets of some texts, and which of them are like one of them."""

    def __init__(self, texts: pa.Array, k: int, percent: int) -> None:
        with np.errstate(over="ignore"):
            sets = list(shingle_sets(texts, k))
        self.n, self.percent = np.array([len(u) for u in sets], np.int64), percent
        self.ends = np.cumsum(self.n)
        distinct, self.codes = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_inverse=True)
        self.mark = np.zeros(len(distinct), bool)

    def like(self, p: int, q: np.ndarray) -> np.ndarray:
        """For each of q, none of them an empty set: is it linked with p?"""
        if not len(q):
            return np.empty(0, bool)
        own = self.codes[self.ends[p] - self.n[p] : self.ends[p]]
        self.mark[own] = True
        size = self.n[q]
        stops = np.cumsum(size)
        at = np.arange(int(stops[-1]), dtype=np.int64) + np.repeat(self.ends[q] - stops, size)
        both = np.add.reduceat(self.mark[self.codes[at]], stops - size, dtype=np.int64)
        self.mark[own] = False
        return 100 * both >= self.percent * (self.n[p] + size - both)


def _texts(ends: DataFrame, table: DataFrame) -> DataFrame:
    """key, hash, text of the rows whose (key, hash) is in ends, and of few others."""
    # a bitmap of the keys needed, of fixed size whatever their number, spares the shuffle most other texts
    bits = 1 << 23
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    bitmap = ends.select(bit("key").alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("set"))
    return table.withColumn("word", F.shiftright(bit("key"), 6)).join(F.broadcast(bitmap), "word").where(F.expr(f"getbit(`set`, cast(pmod(xxhash64(key), {bits}) & 63 as int)) = 1")).select("key", "hash", "text")


def _confirm(edges: DataFrame, table: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b: the edges (a, a_hash: the center; block; b, b_hash) whose full sets are similar enough."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("key"))
    texts = _texts(ends, table)
    by = ["a", "a_hash", "block"]
    partners = edges.join(texts.withColumnsRenamed({"key": "b", "hash": "b_hash"}), ["b", "b_hash"]).select(*by, "b", "text")
    centers = edges.select(*by).distinct().join(texts.withColumnsRenamed({"key": "a", "hash": "a_hash"}), ["a", "a_hash"]).select(*by, F.lit(None).cast("bigint").alias("b"), "text")

    def check(group: pa.Table) -> pa.Table | None:
        b = group.column("b")
        mine = b.combine_chunks().is_null().to_numpy(zero_copy_only=False)
        first = np.flatnonzero(mine)[:1]
        others = np.flatnonzero(~mine)
        if not len(first) or not len(others):
            return None
        rows = pa.array(np.concatenate([first, others]))
        sets = Sets(group.column("text").take(rows).combine_chunks(), k, percent)
        found = b.take(pa.array(others[sets.like(0, np.arange(1, len(rows)))]))
        return pa.table({"a": pa.array([group.column("a")[0].as_py()] * len(found), pa.int64()), "b": found})

    return grouped(partners.unionByName(centers), by, check, "a bigint, b bigint").distinct()


def _margin(n: np.ndarray, j: float) -> np.ndarray:
    return 6 * np.sqrt(max(j * (1 - j), 0.01) / np.minimum(n, 192))


class Cell:
    """The members of two blocks of a bucket, and the pairs among them that sketches leave."""

    COLUMNS = "bucket bigint, i bigint, j bigint, place bigint, rep bigint, hash bigint, label bigint, n bigint, sketch binary, buckets array<bigint>"

    def __init__(self, x: pa.Table, percent: int) -> None:
        self.least = percent / 100
        self.bucket, self.i, self.j = (x.column(c)[0].as_py() for c in ("bucket", "i", "j"))
        self.place, self.rep, self.label, self.n = (x.column(c).to_numpy() for c in ("place", "rep", "label", "n"))
        self.sketch = np.frombuffer(b"".join(x.column("sketch").to_pylist()), np.uint8).reshape(len(x), -1)
        self.buckets = x.column("buckets").combine_chunks().flatten().to_numpy().reshape(len(x), -1)
        self.band = int(np.argmax(self.buckets[0] == self.bucket))

    def pairs(self) -> Iterator[tuple[int, np.ndarray]]:
        """Rows p, and rows q of other labels that may be like p: each pair in the first bucket that it shares."""
        one, other = np.flatnonzero(self.place == self.i), np.flatnonzero(self.place == self.j)
        for k, p in enumerate(one):
            q = other[k + 1 :] if self.i == self.j else other
            n = np.minimum(self.n[q], self.n[p])
            q = q[(self.label[q] != self.label[p]) & (n >= self.least * np.maximum(self.n[q], self.n[p]) - 1e-6)]
            if len(q):
                same = (self.sketch[q] == self.sketch[p]).mean(axis=1)
                q = q[same >= self.least - _margin(np.minimum(self.n[q], self.n[p]), self.least)]
            if len(q) and self.band:
                q = q[~(self.buckets[q, : self.band] == self.buckets[p, : self.band]).any(axis=1)]
            if len(q):
                yield int(p), q


def _cells(seats: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of all cells. seats: bucket, rep, hash, bytes, label; nodes: rep, hash, n, sketch, buckets."""
    counts = seats.groupBy("bucket", "label").agg(F.count("*").alias("m"), F.sum("bytes").alias("w"))
    of_bucket = counts.groupBy("bucket").agg(F.max(F.struct("m", "w", "label")).alias("top"), F.sum("m").alias("size"), F.sum("w").alias("weight"), F.count("*").alias("labels")).where("labels > 1")
    blocks = lambda m, w: F.greatest(F.ceil(m / BLOCK), F.ceil(w / BLOCK_BYTES), F.lit(1))
    # the members outside the largest component are blocks 0 to few - 1 and meet all blocks; its own meet only those
    few, own = blocks(F.col("size") - F.col("top.m"), F.col("weight") - F.col("top.w")), blocks(F.col("top.m"), F.col("top.w"))
    dealt = seats.join(of_bucket.select("bucket", F.col("top.label").alias("top"), few.alias("few"), own.alias("own")), "bucket")
    inner, spread = F.col("label") == F.col("top"), F.xxhash64("rep", "hash")
    place = F.when(inner, F.col("few") + F.pmod(spread, F.col("own"))).otherwise(F.pmod(spread, F.col("few")))
    meets = F.sequence(F.lit(0).cast("bigint"), F.when(inner, F.col("few")).otherwise(F.col("few") + F.col("own")) - 1)
    seated = dealt.withColumn("place", place).select("bucket", "rep", "hash", "label", "place", F.explode(meets).alias("other"))
    seated = seated.select("bucket", F.least("place", "other").alias("i"), F.greatest("place", "other").alias("j"), "place", "rep", "hash", "label")
    return seated.join(nodes, ["rep", "hash"]).select("bucket", "i", "j", "place", "rep", "hash", "label", "n", "sketch", "buckets")


def _left(cells: DataFrame, percent: int) -> DataFrame:
    """The rows of cells that are in a pair which the sketches leave."""

    def run(x: pa.Table) -> pa.Table | None:
        needed = np.zeros(len(x), bool)
        for p, q in Cell(x, percent).pairs():
            needed[p], needed[q] = True, True
        return x.filter(pa.array(needed)) if needed.any() else None

    return grouped(cells, ["bucket", "i", "j"], run, Cell.COLUMNS)


def _finish(cells: DataFrame, table: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b: labels that links within the cells join."""
    texts = _texts(cells.select(F.col("rep").alias("key")), table).withColumnRenamed("key", "rep")

    def run(x: pa.Table) -> pa.Table | None:
        seen: set = set()
        rows = [r for r, at in enumerate(zip(x.column("rep").to_pylist(), x.column("hash").to_pylist(), strict=True)) if not (at in seen or seen.add(at))]
        x = x.take(pa.array(rows))
        cell, sets = Cell(x, percent), Sets(x.column("text").combine_chunks(), k, percent)
        _, label = np.unique(cell.label, return_inverse=True)  # joined as pairs are found
        found: list[tuple[int, int]] = []
        for p, q in cell.pairs():
            q = q[label[q] != label[p]]
            for r in q[sets.like(p, q)]:
                if label[r] != label[p]:
                    found.append((int(cell.label[p]), int(cell.label[r])))
                    label[label == label[r]] = label[p]
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())}) if found else None

    return grouped(cells.join(texts, ["rep", "hash"]), ["bucket", "i", "j"], run, "a bigint, b bigint")


def _of_keys(real: DataFrame, classes: DataFrame, save: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Links a, b between a key whose rows are in several classes and the smallest keys of those."""
    span = [f(c).alias(f"{f.__name__}_{c}") for c in ("hi", "lo") for f in (F.min, F.max)]
    several = save(real.groupBy("key").agg(*span).where("min_hi != max_hi or min_lo != max_lo").select("key"), "several")
    if several.isEmpty():
        return several.select(F.col("key").alias("a"), F.col("key").alias("b"))
    of = real.select("key", "hi", "lo").distinct().join(several, "key").join(classes.select("hi", "lo", "rep"), ["hi", "lo"])
    return of.where("key != rep").select(F.col("key").alias("a"), F.col("rep").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, percent: int = 85, bands: int = 32, rows: int = 6, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id (smallest key reachable by links), kept (it is the row's own key), for every row."""
    table = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text")).withColumn("hash", F.xxhash64("text"))
    with scratch(docs.sparkSession, "minhash") as save:
        sketches = save(_sketches(table, shingle, bands, rows), "sketches")
        real = sketches.where("n > 0 and key is not null")
        # all rows of a class have the same sketch; one row of it, the first by (key, hash), stands for its text
        classes = real.groupBy("hi", "lo").agg(F.min(F.struct("key", "hash", "bytes")).alias("one"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("buckets").alias("buckets"))
        classes = save(classes.select("hi", "lo", F.col("one.key").alias("rep"), F.col("one.hash").alias("hash"), F.col("one.bytes").alias("bytes"), "n", "sketch", "buckets"), "classes")
        spread = classes.select(F.explode("buckets").alias("bucket"), "rep", "hash", "bytes")
        shared = spread.groupBy("bucket").agg(F.count("*").alias("size"), F.sum("bytes").alias("weight")).where("size > 1")
        members = save(spread.join(shared, "bucket"), "members")
        degree = members.groupBy("rep", "hash").agg(F.sum("size").alias("degree"), F.sum("weight").alias("load"))
        seats = save(members.drop("size", "weight").join(degree, ["rep", "hash"]), "seats")
        centers = save(seats.groupBy("bucket").agg(F.max(F.struct("degree", "rep", "hash", "load")).alias("c")), "centers")
        seated = seats.join(centers, "bucket").where("rep != c.rep or hash != c.hash")
        # a center's partners go in blocks: its degree and load are at least their number and bytes
        blocks = F.greatest(F.ceil(F.col("c.degree") / (8 * BLOCK)), F.ceil(F.col("c.load") / BLOCK_BYTES))
        edges = seated.where("rep != c.rep").select(F.col("c.rep").alias("a"), F.col("c.hash").alias("a_hash"), F.pmod(F.xxhash64("rep", "hash"), blocks).alias("block"), F.col("rep").alias("b"), F.col("hash").alias("b_hash")).distinct()
        links = save(_confirm(save(edges, "edges"), table, shingle, percent).union(_of_keys(real, classes, save)), "links")
        labels = components(links, save)
        label = F.coalesce("label", "rep").alias("label")
        open_seats = seated.select("bucket", "rep", "hash", "bytes").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", "hash", "bytes", label)
        cells = save(_left(_cells(save(open_seats, "open"), classes.select("rep", "hash", "n", "sketch", "buckets")), percent), "cells")
        of_class = classes.select("hi", "lo", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("hi", "lo", label)
        if not cells.isEmpty():
            joined = save(_finish(cells, table, shingle, percent), "joined")
            if not joined.isEmpty():
                far = components(joined, save).select(F.col("node").alias("label"), F.col("label").alias("far"))
                of_class = of_class.join(far, "label", "left").select("hi", "lo", F.coalesce("far", "label").alias("label"))
        found = real.select("key", "n", "hi", "lo").join(of_class, ["hi", "lo"]).select("key", "n", F.col("label").alias("component"))
        alone = sketches.where("n = 0 or key is null").select("key", "n", F.col("key").alias("component"))
        of_key = found.union(alone)
        return written(of_key.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("key") == F.col("component"), F.lit(True)).alias("kept")), "components")
