"""What a writer learns of its creates, and what follows for claims, checkpoints and collection.

attempts: id bigint (order of arrival, unique), partition, coordinate bigint,
body, arrived boolean (it reached the store), replied boolean (the writer got an
answer).  The store keeps the first body that arrived at a coordinate.  Objects
are met by aggregates on (partition, coordinate) and joins, so no task holds all
attempts of one coordinate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["partition", "coordinate"]
#: Coordinates that a log's suffix may span, and the span from which a checkpoint is due.
SUFFIX_MOST, SUFFIX_DUE = 1024, 512


def stored(attempts: DataFrame) -> DataFrame:
    """partition, coordinate, first (the id that created the object), held (its body)."""
    return attempts.where("arrived").groupBy(*KEY).agg(F.min("id").alias("first"), F.min_by("body", "id").alias("held"))


def evidence(attempts: DataFrame) -> DataFrame:
    """attempts, evidence of the create (Direct, DurableMatch, NotOurs, Unresolved) and found: Match, Foreign or Absent to a read just after it."""
    seen = attempts.join(stored(attempts), KEY, "left")
    there = F.col("first") <= F.col("id")
    same = F.col("body").eqNullSafe(F.col("held"))
    found = F.when(there & same, "Match").when(there, "Foreign").otherwise("Absent")
    learnt = F.when(~(F.col("replied") & F.col("arrived")), "Unresolved").when(F.col("first") == F.col("id"), "Direct").when(same, "DurableMatch").otherwise("NotOurs")
    return seen.withColumn("evidence", learnt).withColumn("found", found).drop("first", "held")


def _reconciled(match: str, foreign: str, absent: str) -> Column:
    """Evidence by name; an unresolved create is settled by one read."""
    read = F.when(F.col("found") == "Match", match).when(F.col("found") == "Foreign", foreign).otherwise(absent)
    return F.when(F.col("evidence").isin("Direct", "DurableMatch"), match).when(F.col("evidence") == "NotOurs", foreign).otherwise(read)


def wal_outcome() -> Column:
    return _reconciled("Durable", "Occupied", "UnresolvedAbsent")


def table_outcome() -> Column:
    return _reconciled("Established", "Contradiction", "Abandoned")


def seal_outcome() -> Column:
    """The first generation accepts equal bytes; a later one has authority only by its own create."""
    e = F.col("evidence")
    genesis = F.when(e.isin("Direct", "DurableMatch"), "Established").when(e == "NotOurs", "LostRace").otherwise("Unresolved")
    claim = F.when(e == "Direct", "Authored").when(e == "Unresolved", "Unresolved").otherwise("NoAuthority")
    return F.when(F.col("coordinate") == 1, genesis).otherwise(claim)


def checkpoint_action(table: Column, seal: Column) -> Column:
    """What the writer does when its checkpoint's table, then its seal, came out so."""
    after = F.when(seal.isin("Authored", "Established"), "Install").when(seal == "Unresolved", "Poisoned").otherwise("Fenced")
    return F.when(table == "Abandoned", "Clear").when(table == "Contradiction", "Exit").otherwise(after)


def refreshed(claims: DataFrame, heads: DataFrame, at_head: str) -> DataFrame:
    """claims(partition, generation, ...) and verdict; heads(partition, head): the newest seal of each, read again.

    A newer head fences the claim, its own generation gives ``at_head`` (Complete at
    the end of a recovery, Contradiction for an anomaly), a lower or missing one is a
    Contradiction.
    """
    head, own = F.col("head"), F.col("generation")
    return claims.join(heads, "partition", "left").withColumn("verdict", F.when(head > own, "Fenced").when(head == own, at_head).otherwise("Contradiction")).drop("head")


def collected(objects: DataFrame, cuts: DataFrame) -> DataFrame:
    """partition, coordinate and ruling for every coordinate in (old_cut, new_cut] of cuts(partition, old_cut, new_cut).

    objects: partition, coordinate, kind (RUN, FENCE; other: unreadable).  A RUN is
    deleted, a FENCE kept, an absent one skipped; the first unreadable one stops its
    partition.  A suffix has SUFFIX_MOST coordinates at most, so the list of them is
    bounded.
    """
    due = cuts.where("new_cut > old_cut").select("partition", F.explode(F.sequence(F.col("old_cut") + 1, F.col("new_cut"))).alias("coordinate"))
    met = due.join(objects, KEY, "left")
    bad = F.col("kind").isNotNull() & ~F.col("kind").isin("RUN", "FENCE")
    stops = met.where(bad).groupBy("partition").agg(F.min("coordinate").alias("stop"))
    ruling = (
        F.when(F.col("coordinate") > F.col("stop"), "unreached")
        .when(F.col("kind").isNull(), "skip")
        .when(F.col("kind") == "RUN", "delete")
        .when(F.col("kind") == "FENCE", "keep")
        .otherwise("stop")
    )
    return met.join(stops, "partition", "left").select("partition", "coordinate", ruling.alias("ruling"))


def takeover_room(cut: Column, run: Column, most: int = SUFFIX_MOST) -> Column:
    """Whether a RUN at this coordinate leaves room for the fence of a successor behind it."""
    return (run + 1 - cut > 1) & (run + 1 - cut <= most)


def checkpoint_due(cut: Column, head: Column, attempted: Column, due: int = SUFFIX_DUE) -> Column:
    """Whether the suffix is long enough and no checkpoint of this head was attempted before."""
    return (head - cut >= due) & (attempted.isNull() | (attempted < head))


def hard_full(facts: Column, size: Column, most_facts: int = 4096, most_bytes: int = 4_194_304, headroom: int = 896) -> Column:
    """Whether pending facts fill an object, or one more fact might not fit."""
    return (facts >= most_facts) | (size + headroom > most_bytes)


def flush_reason(facts: Column, closing: Column, full: Column, size: Column, budget: int, waited: Column, spacing: int) -> Column:
    """Why pending work is taken now, or 'arm' where it waits for the spacing; waited is null before the first flush."""
    return (
        F.when(facts == 0, "idempotent")
        .when(closing, "closing")
        .when(full, "full")
        .when(size >= budget, "budget")
        .when(waited.isNull() | (waited >= spacing), "spacing")
        .otherwise("arm")
    )
