"""Commands on streams decided, folded and laid down as versions.

commands: seq bigint, path, cmd ('create', 'close', 'delete'), content_type,
expiry, lifecycle ('open', 'closed').  A path goes absent -> live (open, then
closed) -> tombstone and never back, so a decision needs only the sequence
numbers of the path's first create, the close and the delete that took effect:
one aggregate for each and joins on the path, no sequential loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordering import ranked

CAPACITY = 10_000_000
RUN_FACTS = 64


def effective(commands: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Each path ever created: uid (0: refused for lack of room), tc, tx, td and the create's settings."""
    create = commands.where("cmd = 'create'").groupBy("path").agg(F.min("seq").alias("tc"), F.min_by(F.struct("content_type", "expiry", "lifecycle"), "seq").alias("made"))
    paths = ranked(create, "tc", [], "uid", like=commands.select(F.col("seq").alias("tc"))).withColumn("uid", F.when(F.col("uid") <= capacity, F.col("uid")).otherwise(0))
    later = commands.where("cmd != 'create'").join(paths.select("path", "tc"), "path").where("seq > tc")
    ends = later.groupBy("path").agg(F.min(F.when(F.col("cmd") == "delete", F.col("seq"))).alias("td"), F.min(F.when(F.col("cmd") == "close", F.col("seq"))).alias("close"))
    with_ends = paths.join(ends, "path", "left")
    close = F.when(F.col("td").isNull() | (F.col("close") < F.col("td")), F.col("close"))
    tx = F.when(F.col("made.lifecycle") == "closed", F.col("tc")).otherwise(close)
    return with_ends.select("path", "uid", "tc", tx.alias("tx"), "td", F.col("made.content_type").alias("made_type"), F.col("made.expiry").alias("made_expiry"))


def decide(commands: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Every command with outcome and uid (null where refused)."""
    c = commands.join(effective(commands, capacity), "path", "left")
    seq, tc, tx, td = (F.col(x) for x in ("seq", "tc", "tx", "td"))
    refused = F.col("uid") == 0
    gone = td.isNotNull() & (seq > td)
    state = F.when(tx.isNotNull() & (seq > tx), "closed").otherwise("open")
    same = F.col("content_type").eqNullSafe(F.col("made_type")) & F.col("expiry").eqNullSafe(F.col("made_expiry")) & (F.col("lifecycle") == state)
    create = F.when(refused, "CapacityExhausted").when(seq == tc, "Created").when(gone, "Occupied").when(same, "AlreadyExists").otherwise("Occupied")
    missing = tc.isNull() | refused | (seq < tc) | gone
    close = F.when(missing, "NotLive").when(seq == tx, "Closed").otherwise("AlreadyClosed")
    delete = F.when(missing, "NotLive").when(seq == td, "Deleted").otherwise("NotLive")
    outcome = F.when(F.col("cmd") == "create", create).when(F.col("cmd") == "close", close).otherwise(delete)
    return c.select("seq", "path", "cmd", "content_type", "expiry", "lifecycle", outcome.alias("outcome"), F.when(outcome.isin("Created", "AlreadyExists", "Closed", "AlreadyClosed", "Deleted"), F.col("uid")).alias("uid"))


def facts(decided: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """What took effect: fact_no 1, 2 ..., batch (RUN_FACTS facts each), kind, path, uid and settings. like: the commands' seq, where that is at hand."""
    kinds = {"Created": "StreamCreated", "Closed": "StreamClosed", "Deleted": "StreamDeleted"}
    kind = F.create_map(*[F.lit(x) for k in kinds.items() for x in k])[F.col("outcome")]
    took = decided.where(F.col("outcome").isin(*kinds)).select("seq", "path", "uid", kind.alias("kind"), "content_type", "expiry", "lifecycle")
    return ranked(took, "seq", [], "fact_no", like=decided.select("seq") if like is None else like).withColumn("batch", F.floor((F.col("fact_no") - 1) / RUN_FACTS) + 1)


def fold(fact_rows: DataFrame, upto: int | None = None) -> DataFrame:
    """Directory and ledger as one row for each path: uid, state, and of a live path its record."""
    if upto is not None:
        fact_rows = fact_rows.where(F.col("batch") <= upto)
    is_ = lambda k: F.col("kind") == k
    folded = fact_rows.groupBy("path").agg(
        F.max("uid").alias("uid"),
        F.max(is_("StreamDeleted")).alias("deleted"),
        F.max(is_("StreamClosed") | (is_("StreamCreated") & (F.col("lifecycle") == "closed"))).alias("closed"),
        F.max(F.when(is_("StreamCreated"), F.col("content_type"))).alias("content_type"),
        F.max(F.when(is_("StreamCreated"), F.col("expiry"))).alias("expiry"),
        F.max(F.when(is_("StreamCreated"), F.col("fact_no"))).alias("created_at"),
    )
    live = ~F.col("deleted")
    return folded.select("path", "uid", F.when(live, "Live").otherwise("Tombstone").alias("state"), *[F.when(live, F.col(c)).alias(c) for c in ("content_type", "expiry", "created_at")], F.when(live, F.when(F.col("closed"), "closed").otherwise("open")).alias("lifecycle"))


def directory(folded: DataFrame) -> DataFrame:
    return folded.select("path", "state", "uid")


def ledger(folded: DataFrame) -> DataFrame:
    return folded.where("state = 'Live'").select("uid", "content_type", "expiry", "lifecycle", "created_at")


def status(paths: DataFrame, folded: DataFrame) -> DataFrame:
    """Missing, Deleted or Live with the record's settings, of each path asked."""
    found = paths.join(directory(folded), "path", "left").join(ledger(folded), "uid", "left")
    return found.select("path", F.when(F.col("state").isNull(), "Missing").when(F.col("state") == "Tombstone", "Deleted").otherwise("Live").alias("status"), "content_type", "lifecycle")


def integrity(dir_rows: DataFrame, led_rows: DataFrame) -> DataFrame:
    """One row for each contradiction between the two stores: error, uid."""
    n = dir_rows.agg(F.count("*").alias("n"))
    out_of_range = dir_rows.crossJoin(n).where("uid < 1 or uid > n").select(F.when(F.col("uid") < 1, "UidGap").otherwise("CountMismatch").alias("error"), "uid")  # n is one row
    twice = dir_rows.groupBy("uid").count().where("count > 1").select(F.lit("UidGap").alias("error"), "uid")
    both = dir_rows.join(led_rows.select(F.col("uid").alias("l_uid")), F.col("uid") == F.col("l_uid"), "full_outer")
    error = F.when(F.col("uid").isNull(), "RecordWithoutLive").when((F.col("state") == "Live") & F.col("l_uid").isNull(), "LiveWithoutRecord").when((F.col("state") == "Tombstone") & F.col("l_uid").isNotNull(), "TombstoneWithRecord")
    crossed = both.select(error.alias("error"), F.coalesce("uid", "l_uid").alias("uid")).where("error is not null")
    return out_of_range.unionByName(twice).unionByName(crossed)


def contradictions(fact_rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The strict fold over decided facts: each fact with the rule that it breaks, or null.

    Rules look at the state that the facts before it leave, if none of them is bad.
    """
    order = Window.partitionBy("path").orderBy("fact_no").rowsBetween(Window.unboundedPreceding, -1)
    seen = lambda k: F.coalesce(F.max(F.col("kind") == k).over(order), F.lit(False))
    was = fact_rows.withColumn("had", seen("StreamCreated")).withColumn("dead", seen("StreamDeleted"))
    was = was.withColumn("owner", F.max(F.when(F.col("kind") == "StreamCreated", F.col("uid"))).over(order))
    was = was.withColumn("shut", F.coalesce(F.max((F.col("kind") == "StreamClosed") | ((F.col("kind") == "StreamCreated") & (F.col("lifecycle") == "closed"))).over(order), F.lit(False)))
    creates = ranked(fact_rows.where("kind = 'StreamCreated'").select("fact_no"), "fact_no", [], "expected")
    was = was.join(creates, "fact_no", "left")
    create = F.when(F.col("had"), "PathOccupied").when(F.col("expected") > capacity, "PathCapacityExhausted").when(F.col("uid") != F.col("expected"), "UidNotDenseSuccessor")
    live = F.col("had") & ~F.col("dead")
    other = F.when(~live, "PathNotLive").when(F.col("uid") != F.col("owner"), "PathUidMismatch")
    close = other.when(F.col("shut"), "StreamAlreadyClosed")
    error = F.when(F.col("kind") == "StreamCreated", create).when(F.col("kind") == "StreamClosed", close).otherwise(other)
    return was.select("fact_no", "kind", "path", error.alias("error"))


def newest_wins(runs: DataFrame, key: str, run: str = "run", drop: Column | None = None) -> DataFrame:
    """Sorted runs merged: of each key the row of the newest run (the smallest number), without those that ``drop`` marks."""
    value = F.struct(*[c for c in runs.columns if c not in (key, run)])
    merged = runs.groupBy(key).agg(F.min_by(value, run).alias("v")).select(key, "v.*")
    return merged if drop is None else merged.where(~drop)


def difference(old: DataFrame, new: DataFrame, key: str, values: list[str]) -> DataFrame:
    """key, change ('Add', 'Update', 'Remove') between two versions; equal rows are left out."""
    o, n = old.select(key, F.struct(*values).alias("_old")), new.select(key, F.struct(*values).alias("_new"))
    change = F.when(F.col("_old").isNull(), "Add").when(F.col("_new").isNull(), "Remove").when(~F.col("_old").eqNullSafe(F.col("_new")), "Update")
    return o.join(n, key, "full_outer").select(key, change.alias("change")).where("change is not null")
