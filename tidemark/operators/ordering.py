"""Global ranks and running sums without a window over one partition.

An order is cut into ranges at approximate quantiles; a window runs inside each
range (of each group) and the ranges' totals give what lies before them, so
neither the whole order nor a group of any size meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one range holds, about, and ranges at most (their cut points are literals of the plan).
RANGE_ROWS, MOST_RANGES = 500_000, 256


def _cuts(df: DataFrame, by: str) -> list:
    """One pass over one column."""
    found = df.agg(F.count("*").alias("n"), F.percentile_approx(by, [k / MOST_RANGES for k in range(1, MOST_RANGES)], 10 * MOST_RANGES).alias("q")).first()
    parts = min(MOST_RANGES, found["n"] // RANGE_ROWS)
    return sorted({found["q"][k * MOST_RANGES // parts - 1] for k in range(1, parts)}) if parts > 1 else []


def scan(df: DataFrame, by: str, ties: Sequence[str], sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None, group: Sequence[str] = (), like: DataFrame | None = None, before: bool = False) -> DataFrame:
    """df and, for each row, sums and maxima over the rows of its group up to it (before: without it), in the order of by and ties.

    like: rows whose column ``by`` is spread as df's, from which the cut points are
    taken instead; any cut points give the same rows.  A sum over no rows is 0, a
    maximum null.
    """
    sums, maxima = sums or {}, maxima or {}
    cuts = _cuts(df if like is None else like, by)
    place = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(by))) if cuts else F.lit(0)
    each = {f"_of_{k}": c for k, c in {**sums, **maxima}.items()}
    ranged = df.withColumn("_range", place).withColumns(each)
    inside = Window.partitionBy(*group, "_range").orderBy(by, *ties).rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
    out = ranged.withColumns({k: F.coalesce(F.sum(f"_of_{k}").over(inside), F.lit(0)) for k in sums} | {k: F.max(f"_of_{k}").over(inside) for k in maxima})
    if cuts:
        # one row for each range of a group
        earlier = (Window.partitionBy(*group) if group else Window).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        total = ranged.groupBy(*group, "_range").agg(*[F.sum(f"_of_{k}").alias(f"_t_{k}") for k in sums], *[F.max(f"_of_{k}").alias(f"_t_{k}") for k in maxima])
        base = total.select(*group, "_range", *[F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)).alias(f"_b_{k}") for k in sums], *[F.max(f"_t_{k}").over(earlier).alias(f"_b_{k}") for k in maxima])
        out = out.join(base, [*group, "_range"]).withColumns({k: F.col(k) + F.col(f"_b_{k}") for k in sums} | {k: F.greatest(k, f"_b_{k}") for k in maxima}).drop(*[f"_b_{k}" for k in (*sums, *maxima)])
    return out.drop("_range", *each)


def running(df: DataFrame, by: str, ties: list[str], amount: Column, name: str, group: Sequence[str] = (), like: DataFrame | None = None) -> DataFrame:
    """df and ``name``: the sum of amount over all rows (of the group) up to this one, in the order of by and ties (unique together)."""
    return scan(df, by, ties, {name: amount}, group=group, like=like)


def ranked(df: DataFrame, by: str, ties: list[str], name: str, group: Sequence[str] = (), like: DataFrame | None = None) -> DataFrame:
    """df and ``name``: 1, 2, 3 ... in the order of by and ties."""
    return running(df, by, ties, F.lit(1).cast("bigint"), name, group, like)


def by_text(df: DataFrame, text: str, name: str) -> DataFrame:
    """df and ``name``: 1, 2, 3 ... in the byte order of a text column (its values are all different).

    The cut points are texts: quantiles of a sample of the rows by hash.
    """
    n = df.count()
    parts = min(MOST_RANGES, n // RANGE_ROWS)
    cuts: list[str] = []
    if parts > 1:
        some = 40 * parts  # about so many rows on the driver
        rows = sorted(r[0] for r in df.where(F.pmod(F.xxhash64(text), F.lit(max(1, n // some))) == 0).select(text).collect())
        cuts = sorted({rows[k * len(rows) // parts] for k in range(1, parts)}) if rows else []
    place = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(text))) if cuts else F.lit(0)
    ranged = df.withColumn("_range", place)
    inside = ranged.withColumn(name, F.row_number().over(Window.partitionBy("_range").orderBy(text)).cast("bigint"))
    if not cuts:
        return inside.drop("_range")
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    base = ranged.groupBy("_range").agg(F.count("*").alias("n")).select("_range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_base"))
    return inside.join(base, "_range").withColumn(name, F.col(name) + F.col("_base")).drop("_range", "_base")
