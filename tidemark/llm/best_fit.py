"""Bounded-space online best-fit packing of token sequences.

A packer keeps at most ``open_bins`` bins open.  Their free spaces are a bitset
(bit f set: some open bin has f places free), so the best fit for n ids is the
lowest set bit from n up.  A bin with no space left closes; if too many are
open the fullest closes first.  Pieces are packed where they are encoded, in
the order of the rows, and a piece is handed on when its bin closes.  The bins
that a partition leaves open are then items of a second round of the same
packer, over groups of partitions, so that partial bins of different partitions
meet; only those pieces are shuffled.

Only documents longer than ``size`` ids are cut, into pieces of ``size`` ids;
the last one may be shorter.  A null or empty text is one piece, the end id
alone.  Equal rows are separate documents (their key is repeated).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import written
from tidemark.llm.token_text import batches, encoder


class Packer:
    """Bins of one capacity; ``closed`` gets (bin, its items) as bins close."""

    def __init__(self, size: int, open_bins: int) -> None:
        self.size, self.most = size, open_bins
        self.bits, self.open = 0, 0
        self.by_free: dict[int, list[list]] = {}
        self.made = 0

    def _put(self, free: int, items: list) -> None:
        self.by_free.setdefault(free, []).append(items)
        self.bits |= 1 << free
        self.open += 1

    def _take(self, free: int) -> list:
        stack = self.by_free[free]
        items = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.open -= 1
        return items

    def add(self, n: int, item: object) -> list[list]:
        """Packs an item of n places; the bins that close now. A bin is [number, filled, (offset, item)...]."""
        fit = self.bits >> n
        if fit:
            free = n + (fit & -fit).bit_length() - 1
            items = self._take(free)
        else:
            free, items = self.size, [self.made, 0]
            self.made += 1
        items.append((items[1], item))
        items[1] += n
        closed = []
        if free == n:
            return [items]
        if self.open >= self.most:
            fullest = (self.bits & -self.bits).bit_length() - 1
            if free - n <= fullest:
                return [items]
            closed.append(self._take(fullest))
        self._put(free - n, items)
        return closed

    def rest(self) -> list[list]:
        return [items for free in sorted(self.by_free) for items in self.by_free[free]]


PIECES = "key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary, part bigint, bin bigint, offset bigint, open boolean"


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, open_bins: int = 1024, together: int = 64, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """Packs all rows. key, piece, start, length, ids_crc32, ids (little-endian unsigned 32-bit; null if not with_ids), sequence_id, offset.

    sequence_id: long, one for each sequence, not gapless. offset: place in the
    sequence, gapless from 0. ``together``: so many partitions' open bins meet.
    """
    table = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = dict(table.dtypes)["key"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        one, packer = encoder(path, True), Packer(size, open_bins)

        def rows(bins: list[list], left: bool) -> pa.RecordBatch:
            flat = [(x, b[0], at) for b in bins for at, x in b[2:]]
            cols = list(zip(*[x for x, _, _ in flat], strict=True)) or [[]] * 6
            n = len(flat)
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], key_type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.binary()), pa.array([part] * n, pa.int64()), pa.array([b for _, b, _ in flat], pa.int64()), pa.array([at for _, _, at in flat], pa.int64()), pa.array([left] * n, pa.bool_())],
                ["key", "piece", "start", "length", "ids_crc32", "ids", "part", "bin", "offset", "open"],
            )

        key_type = pa.int64()
        for b in batches(parts, "text", (4 if with_ids else 8) << 20):
            key_type = b.schema.field("key").type
            ids, stops = one.encode(b.column("text"))
            raw = memoryview(ids.astype("<u4").tobytes())
            end = int(end_id).to_bytes(4, "little")
            closed: list[list] = []
            for k, (lo, hi) in zip(b.column("key").to_pylist(), zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True), strict=True):
                n = hi - lo + 1
                for piece, start in enumerate(range(0, n, size)):
                    m = min(size, n - start)
                    body = bytes(raw[4 * (lo + start) : 4 * min(hi, lo + start + m)]) + (end if start + m == n else b"")
                    closed += packer.add(m, (k, piece, start, m, zlib.crc32(body), body if with_ids else None))
            if closed:
                yield rows(closed, False)
        if left := packer.rest():
            yield rows(left, True)

    pieces = written(table.mapInArrow(run, PIECES.format(kind=kind)), "pieces")
    still = pieces.where("open")
    bins = still.groupBy("part", "bin").agg(F.sum("length").alias("filled")).withColumn("team", F.expr(f"part div {together}"))

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["part", "bin"])
        packer, out = Packer(size, open_bins), []
        for x in zip(group["part"].tolist(), group["bin"].tolist(), group["filled"].tolist(), group["team"].tolist(), strict=True):
            out += packer.add(x[2], x)
        return pd.DataFrame([(x[0], x[1], x[3], b[0], at) for b in out + packer.rest() for at, x in b[2:]], columns=["part", "bin", "team", "joined", "base"])

    met = bins.groupBy("team").applyInPandas(meet, "part bigint, bin bigint, team bigint, joined bigint, base bigint")
    # team and bin numbers below 2^31; closed bins are even, met ones odd
    number = lambda a, b, odd: F.shiftleft(F.shiftleft(F.col(a).cast("bigint"), 31) + F.col(b), 1) + odd
    out = ["key", "piece", "start", "length", "ids_crc32", "ids"]
    first = pieces.where("not open").select(*out, number("part", "bin", 0).alias("sequence_id"), "offset")
    second = still.join(met, ["part", "bin"]).select(*out, number("team", "joined", 1).alias("sequence_id"), (F.col("offset") + F.col("base")).alias("offset"))
    return first.unionByName(second).withColumnRenamed("key", key)
