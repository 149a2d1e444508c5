"""Token files compressed by grammars (Re-Pair), with random access.

Rows are range-partitioned and sorted by key, so the files hold the documents
in ascending order.  A file part ("blob") holds up to ``BLOB_IDS`` ids of
consecutive documents.  In a blob the frequent pairs of neighbouring symbols,
which no document end separates, are replaced by new symbols, round after round,
until no pair is frequent or a round hardly shortens the sequence; pairs of one
round that overlap are settled by their rank and the rest is left to the next
round.  Stored are the rules, the length that each symbol expands to, the
sequence, and where each document begins in it, so one document is decoded
without the others.

Null and empty texts are the end id alone.  A text of any length is taken whole;
one of more than ``BLOB_IDS`` ids is a blob of its own.  Repeated rows are
separate documents; rows of one key lie in the order of their texts' hash, null
keys first.  An empty table gives no files and no documents.  Columns other than
the key and the text are not read, whatever their names.

The blobs are written as Parquet in the shared folder (any file system that
Spark reaches; a task that is retried leaves one copy) and all results are read
from there.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import bucket_count, written
from tidemark.llm.token_text import batches, encoder, give_back

BLOB_IDS = 1 << 20


def compress(seq: np.ndarray, stops: np.ndarray, first_symbol: int, min_count: int = 32, least_gain: float = 0.01) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules m x 2, sequence, n + 1 places of the documents in it). stops: n + 1 places in seq; no document is empty.

    Every pair that occurs min_count times or more is replaced in a round; the
    rounds end when there is none, or when a round shortened the sequence by less
    than the share least_gain.
    """
    seq = seq.astype(np.int32)
    last = np.zeros(len(seq), bool)
    last[stops[1:] - 1] = True
    rules: list[np.ndarray] = []
    symbol = first_symbol
    length = np.inf
    while 1 < len(seq) <= length * (1 - least_gain):
        length = len(seq)
        # a pair cannot be more frequent than its hash is: most pairs need no sorting
        h = (seq[:-1].astype(np.uint32) * np.uint32(0x9E3779B1) + seq[1:].astype(np.uint32) * np.uint32(0x85EBCA77)) >> np.uint32(14)
        counts = np.bincount(h, minlength=1 << 18)
        maybe = np.flatnonzero((counts >= min_count)[h] & ~last[:-1])
        key = seq[maybe].astype(np.int64) << 32 | seq[maybe + 1]
        pairs, where, n = np.unique(key, return_inverse=True, return_counts=True)
        often = np.flatnonzero(n >= min_count)
        best = often[np.argsort(-n[often], kind="stable")]
        if not len(best):
            break
        rank_of = np.full(len(pairs), len(best), np.int32)
        rank_of[best] = np.arange(len(best), dtype=np.int32)
        none = np.int32(len(best))
        rank = np.full(len(seq) + 1, none, np.int32)  # shifted by one: rank[i + 1] is of the pair at i
        rank[maybe + 1] = rank_of[where]
        here, before, after = rank[1:], rank[:-1], np.append(rank[2:], none)
        take = np.flatnonzero((here < none) & (here < before) & (here <= after))
        seq[take] = symbol + here[take]
        keep = np.ones(len(seq), bool)
        keep[take + 1] = False
        last[take] = last[take + 1]
        seq, last = seq[keep], last[keep]
        chosen = pairs[best]
        rules.append(np.stack([chosen >> 32, chosen & 0xFFFFFFFF], 1).astype(np.int32))
        symbol += len(best)
    ends = np.flatnonzero(last) + 1
    return np.concatenate(rules) if rules else np.empty((0, 2), np.int32), seq, np.concatenate([[0], ends])


def expansion_lengths(rules: np.ndarray, first_symbol: int) -> np.ndarray:
    """Of rule symbols, in order; a rule only names earlier symbols."""
    size = np.ones(len(rules), np.int64)
    done = np.zeros(len(rules), bool)
    while not done.all():  # one step for each round of compress
        left, right = rules[:, 0] - first_symbol, rules[:, 1] - first_symbol
        ready = ~done & ((left < 0) | done[np.maximum(left, 0)]) & ((right < 0) | done[np.maximum(right, 0)])
        part = lambda x: np.where(x < 0, 1, size[np.maximum(x, 0)])
        size[ready] = (part(left) + part(right))[ready]
        done |= ready
    return size


def expand(seq: np.ndarray, rules: np.ndarray, first_symbol: int) -> np.ndarray:
    """The ids of a sequence or of any part of it."""
    used = seq >= first_symbol
    if not used.any():
        return seq
    # what each rule stands for, one after another: those of a step are made of those of the steps before
    size = expansion_lengths(rules, first_symbol)
    first = np.cumsum(size) - size
    pool = np.empty(int(size.sum()), np.int32)
    done = np.zeros(len(rules), bool)
    while not done.all():
        inner = rules - first_symbol
        ready = np.flatnonzero(~done & ((inner < 0) | done[np.maximum(inner, 0)]).all(axis=1))
        at = first[ready].copy()
        for part in (0, 1):
            child = inner[ready, part]
            plain = child < 0
            pool[at[plain]] = rules[ready[plain], part]
            made, n = child[~plain], size[np.maximum(child, 0)] * ~plain
            pool[_spread(at[~plain], size[made])] = pool[_spread(first[made], size[made])]
            at += np.maximum(n, 1)
        done[ready] = True
    length = np.ones(len(seq), np.int64)
    length[used] = size[seq[used] - first_symbol]
    at = np.cumsum(length) - length
    out = np.empty(int(length.sum()), np.int32)
    out[at[~used]] = seq[~used]
    made = seq[used] - first_symbol
    out[_spread(at[used], size[made])] = pool[_spread(first[made], size[made])]
    return out


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... size[i] of them, for all i."""
    stops = np.cumsum(size)
    return np.arange(int(stops[-1]) if len(stops) else 0) + np.repeat(first - (stops - size), size)


def write_files(docs: DataFrame, path: str, end_id: int = 2, key: str = "doc_id", text: str = "text", partition_bytes: int = 16 << 20) -> DataFrame:
    """Encodes every row (null text: empty), appends end_id, compresses, writes; the table of blobs, read again.

    Order: key ascending, null keys first, ties by the text's hash.
    """
    table = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))
    n = bucket_count(table, "text", partition_bytes)
    ordered = table.withColumn("tie", F.xxhash64("text")).repartitionByRange(n, "key", "tie").sortWithinPartitions("key", "tie")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, one = TaskContext.get().partitionId(), encoder(path, True)
        first_symbol = one.split.size
        keys: list = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        count, number = 0, 0

        def blob() -> pa.RecordBatch:
            give_back()
            seq, stops = np.concatenate(held), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            rules, packed, places = compress(seq, stops, first_symbol)
            lengths = expansion_lengths(rules, first_symbol)
            doc_keys = pa.array(keys, pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([len(keys)], pa.int64()), pa.array([len(seq)], pa.int64()), pa.array([first_symbol], pa.int64()), pa.array([doc_keys.to_pylist()], pa.list_(pa.int64())), pa.array([places.astype("<i8").tobytes()]), pa.array([rules.astype("<u4").tobytes()]), pa.array([lengths.astype("<u4").tobytes()]), pa.array([packed.astype("<u4").tobytes()])],
                ["part", "number", "n_docs", "n_ids", "first_symbol", "keys", "places", "rules", "lengths", "sequence"],
            )

        for b in batches(parts, "text"):
            ids, stops = one.encode(b.column("text"))
            size = np.diff(stops) + 1
            full = np.empty(len(ids) + len(size), np.int32)
            ends = np.cumsum(size) - 1
            keep = np.ones(len(full), bool)
            keep[ends] = False
            full[keep], full[ends] = ids, end_id
            doc_keys = b.column("key").to_pylist()
            edges = np.concatenate([[0], np.cumsum(size)])
            at = 0
            while at < len(size):  # whole documents up to BLOB_IDS
                to = max(at + 1, int(np.searchsorted(edges, edges[at] + BLOB_IDS - count, "right")) - 1)
                if count and edges[to] - edges[at] + count > BLOB_IDS:
                    yield blob()
                    keys, held, sizes, count, number = [], [], [], 0, number + 1
                    continue
                keys += doc_keys[at:to]
                held.append(full[edges[at] : edges[to]])
                sizes.append(size[at:to])
                count += int(edges[to] - edges[at])
                at = to
                if count >= BLOB_IDS:
                    yield blob()
                    keys, held, sizes, count, number = [], [], [], 0, number + 1
        if keys:
            yield blob()

    return written(ordered.select("key", "text").mapInArrow(run, "part bigint, number bigint, n_docs bigint, n_ids bigint, first_symbol bigint, keys array<bigint>, places binary, rules binary, lengths binary, sequence binary"), "repair")


def read_files(blobs: DataFrame, key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """All documents of the files: key, start, n_tokens, ids_crc32, ids (binary, little-endian unsigned 32-bit; null if not with_ids)."""
    # the blobs before one in its part, and the parts before that: one small row for each part in one task
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blobs.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    base = blobs.select("part", "number", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("base")).join(parts, "part").select("part", "number", (F.col("first") + F.col("base")).alias("base"))

    def run(batch: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batch:
            for x in b.to_pylist():
                rules = np.frombuffer(x["rules"], "<u4").astype(np.int32).reshape(-1, 2)
                lengths = np.frombuffer(x["lengths"], "<u4").astype(np.int64)
                seq, places = np.frombuffer(x["sequence"], "<u4").astype(np.int32), np.frombuffer(x["places"], "<i8")
                big = seq >= x["first_symbol"]
                size = np.ones(len(seq), np.int64)
                size[big] = lengths[seq[big] - x["first_symbol"]]
                edges = np.concatenate([[0], np.cumsum(size)])[places]
                raw = memoryview(expand(seq, rules, x["first_symbol"]).astype("<u4")).cast("B")
                cuts = (4 * edges).tolist()
                docs = [raw[lo:hi] for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
                n = len(docs)
                ids = pa.array([bytes(d) for d in docs], pa.binary()) if with_ids else pa.nulls(n, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x["keys"], pa.int64()), pa.array([x["part"]] * n, pa.int64()), pa.array([x["number"]] * n, pa.int64()), pa.array(edges[:-1], pa.int64()), pa.array(np.diff(edges), pa.int64()), pa.array([zlib.crc32(d) for d in docs], pa.int64()), ids],
                    ["key", "part", "number", "at", "n_tokens", "ids_crc32", "ids"],
                )

    rows = blobs.mapInArrow(run, "key bigint, part bigint, number bigint, at bigint, n_tokens bigint, ids_crc32 bigint, ids binary")
    return rows.join(base, ["part", "number"]).select(F.col("key").alias(key), (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "ids")


def document(blob: dict, k: int) -> np.ndarray:
    """Ids of the k-th document of one blob row, without expanding the others."""
    places = np.frombuffer(blob["places"], "<i8")
    seq = np.frombuffer(blob["sequence"], "<u4")[places[k] : places[k + 1]].astype(np.int32)
    return expand(seq, np.frombuffer(blob["rules"], "<u4").astype(np.int32).reshape(-1, 2), blob["first_symbol"])
