"""Reads and appends of streams: offsets, budgets, forks, producers, subscriptions, expiry."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.parsing import glob_regex
from tidemark.operators.ordering import scan

UNBOUNDED = (Window.unboundedPreceding, Window.currentRow)


def catch_up(messages: DataFrame, offset: str) -> DataFrame:
    """Messages after an offset ('-1': all), per stream: their number, the next offset and whether that is the tail."""
    tails = messages.groupBy("stream").agg(F.max("off").alias("tail"))
    after = messages if offset == "-1" else messages.where(F.col("off") > offset)
    got = after.groupBy("stream").agg(F.count("*").alias("n"), F.max("off").alias("last"))
    return tails.join(got, "stream", "left").select("stream", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("last", F.greatest(F.lit(offset), F.col("tail"))).alias("next_offset"), (F.coalesce("last", "tail") == F.col("tail")).alias("up_to_date"))


def _at(off: Column) -> Column:
    """A number that ascends with an offset's spelling, for cutting ranges only."""
    return F.substring_index(off, "_", 1).cast("double") * 1e16 + F.substring_index(off, "_", -1).cast("double")


def budget_read(messages: DataFrame, budget: int, limit: int | None = None, oversized_first: bool = True) -> DataFrame:
    """Of each stream the first messages within a budget of bytes; the first one comes also if it is larger."""
    m = scan(messages.withColumn("_at", _at(F.col("off"))), "_at", ["off"], {"_i": F.lit(1), "_sum": F.octet_length("data")}, group=["stream"])
    fits = F.col("_sum") <= budget
    keep = fits | (F.col("_i") == 1) if oversized_first else fits
    if limit is not None:
        keep = keep & (F.col("_i") <= limit)
    return m.where(keep).drop("_i", "_sum", "_at")


def lineage(forks: DataFrame) -> DataFrame:
    """forks(child, parent, at): each stream with all its ancestors and the offset up to which it sees them. One step up at a time, until none is left."""
    step = forks.select(F.col("child").alias("stream"), F.col("parent").alias("ancestor"), F.col("at").alias("cap"))
    found = step
    up = forks.select(F.col("child").alias("ancestor"), F.col("parent").alias("next"), "at")
    while True:
        step = step.join(up, "ancestor").select("stream", F.col("next").alias("ancestor"), F.least("cap", "at").alias("cap"))
        if step.isEmpty():
            return found
        found = found.unionByName(step)


def retained(streams: DataFrame) -> DataFrame:
    """streams(stream, parent, deleted): stream, state and status of a read.

    'live'; 'soft' (deleted, its data kept for a fork that lives or is itself kept);
    'gone' (deleted, and so is all that forked from it, at any depth).  A step goes
    from kept streams to their deleted parents, each met once, until none is new, so
    the steps are as many as deleted streams follow one another in a lineage.
    """
    deleted = streams.where("deleted").select("stream", "parent")
    step = streams.where(~F.col("deleted")).select("parent").distinct().join(deleted.withColumnRenamed("parent", "next"), F.col("parent") == F.col("stream")).select("stream", "next")
    kept = step
    while not step.isEmpty():
        step = step.select(F.col("next").alias("parent")).distinct().join(deleted.withColumnRenamed("parent", "next"), F.col("parent") == F.col("stream")).select("stream", "next").join(kept.select("stream"), "stream", "left_anti")
        kept = kept.unionByName(step)
    out = streams.join(kept.select("stream", F.lit(True).alias("kept")), "stream", "left")
    state = F.when(~F.col("deleted"), "live").when(F.col("kept"), "soft").otherwise("gone")
    return out.select("stream", state.alias("state"), F.when(state == "live", 200).when(state == "soft", 410).otherwise(404).alias("status"))


def txid_barrier(waits: DataFrame, changes: DataFrame, per_batch: int) -> DataFrame:
    """waits(txid): txid, seen (first offset that carries it) and resolved (last offset of the batch that commits it); null: a timeout."""
    batch = F.floor(F.col("off") / per_batch)
    first = changes.groupBy("txid").agg(F.min("off").alias("seen")).withColumn("batch", F.floor(F.col("seen") / per_batch))
    commits = changes.groupBy(batch.alias("batch")).agg(F.max("off").alias("resolved"))
    return waits.join(first.join(commits, "batch"), "txid", "left").select("txid", "seen", "resolved")


def stitched(messages: DataFrame, forks: DataFrame) -> DataFrame:
    """Each stream's own messages after those that it inherits."""
    inherited = lineage(forks).join(messages.withColumnRenamed("stream", "ancestor"), "ancestor").where(F.col("off") <= F.col("cap"))
    return messages.select("stream", "off", "data").unionByName(inherited.select("stream", "off", "data"))


def judge_producers(log: DataFrame) -> DataFrame:
    """log(stream, producer, arrival, epoch, seq): each request with status and the seq expected.

    The last accepted seq depends on every earlier verdict, so requests of one
    producer are judged in the order of arrival, a producer at a time.
    """

    def judge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("arrival")
        epoch, last, status, expected = None, -1, [], []
        for e, s in zip(group["epoch"].tolist(), group["seq"].tolist(), strict=True):
            want = 0
            if epoch is None:
                verdict = "accepted" if s == 0 else "sequence_gap"
            elif e < epoch:
                verdict = "stale_epoch"
            elif e > epoch:
                verdict = "accepted" if s == 0 else "invalid_epoch_seq"
            else:
                want = last + 1
                verdict = "duplicate" if s <= last else "accepted" if s == want else "sequence_gap"
            if verdict == "accepted":
                epoch, last = e, s
            status.append(verdict)
            expected.append(want)
        return group.assign(status=status, expected=expected)

    return log.groupBy("stream", "producer").applyInPandas(judge, "stream string, producer bigint, arrival bigint, epoch bigint, seq bigint, status string, expected bigint")


def increasing(log: DataFrame) -> DataFrame:
    """log(stream, arrival, token): a token is accepted if it is larger than all before it."""
    seen = scan(log, "arrival", [], maxima={"_most": F.col("token")}, group=["stream"], before=True)
    return seen.withColumn("accepted", F.col("token") > F.coalesce("_most", F.lit(""))).drop("_most")


def match_patterns(patterns: DataFrame, paths: DataFrame) -> DataFrame:
    """(sub, pattern) x (path) where the glob matches. Patterns with a literal first segment meet only its paths."""
    first = lambda c: F.substring_index(c, "/", 1)
    p = patterns.withColumn("_re", glob_regex(F.col("pattern"))).withColumn("_first", first("pattern"))
    q = paths.withColumn("_head", first("path"))
    fits = F.expr("rlike(concat('/', path), _re)")
    fixed = p.where("_first not in ('*', '**') and instr(_first, '%') = 0").join(q, (F.col("_first") == F.col("_head")) & fits)
    loose = p.where("_first in ('*', '**') or instr(_first, '%') > 0").join(q, fits)
    return fixed.unionByName(loose).drop("_re", "_first", "_head")


def links(matched: DataFrame, explicit: DataFrame) -> DataFrame:
    """sub, path, link_type: an explicit link comes before a glob one."""
    both = matched.select("sub", "path", F.lit("glob").alias("link_type")).unionByName(explicit.select("sub", "path", F.lit("explicit").alias("link_type")))
    return both.groupBy("sub", "path").agg(F.min("link_type").alias("link_type"))  # 'explicit' < 'glob'


def materialize(changes: DataFrame, reset: bool = False) -> DataFrame:
    """type, key, value after all changes: insert, update and upsert put, delete removes; with reset, a reset empties all."""
    rows = changes.where("control is null")
    if reset:
        last = changes.where("control = 'reset'").agg(F.coalesce(F.max("off"), F.lit(-1)).alias("last"))
        rows = rows.crossJoin(F.broadcast(last)).where("off > last")  # last is one row
    newest = rows.groupBy("type", "key").agg(F.max_by(F.struct("op", "value"), "off").alias("v"))
    return newest.where("v.op != 'delete'").select("type", "key", F.col("v.value").alias("value"))


def expired(now: Column, kind: Column, at: Column, touched: Column, ttl: Column) -> Column:
    return F.when(kind == "AbsoluteExpiry", F.coalesce(now >= at, F.lit(True))).when(kind == "SlidingTtl", now >= touched + ttl).otherwise(F.lit(False))


def judge_appends(requests: DataFrame) -> DataFrame:
    """requests(stream, arrival, kind, content_type, made_type): the status of each append, in the order of the checks.

    A stream is missing until its create, and closed after its close.
    """
    r = scan(requests, "arrival", [], maxima={"_made": F.col("kind") == "create", "_closed": F.col("kind") == "close"}, group=["stream"], before=True)
    r = r.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("_made", "_closed")})
    status = F.when(~F.col("_made"), 404).when(F.col("_closed"), 409).when(F.col("content_type") != F.col("made_type"), 415).otherwise(204)
    return r.where("kind = 'append'").select("stream", "arrival", status.alias("status"))


def stateful_producers(stream: DataFrame) -> DataFrame:
    """judge_producers for a streaming DataFrame: state is each producer's epoch and last accepted seq."""
    from pyspark.sql.streaming.state import GroupState

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        epoch, last = state.get if state.exists else (None, -1)
        # a producer's rows of a micro-batch come in several chunks, in any order
        part = pd.concat(list(parts)).sort_values("arrival")
        status = []
        for e, s in zip(part["epoch"].tolist(), part["seq"].tolist(), strict=True):
            if epoch is None or e > epoch:
                verdict = "accepted" if s == 0 else "sequence_gap" if epoch is None else "invalid_epoch_seq"
            elif e < epoch:
                verdict = "stale_epoch"
            else:
                verdict = "duplicate" if s <= last else "accepted" if s == last + 1 else "sequence_gap"
            if verdict == "accepted":
                epoch, last = e, s
            status.append(verdict)
        if epoch is not None:
            state.update((epoch, last))
        yield part.assign(status=status)

    return stream.groupBy("stream", "producer").applyInPandasWithState(step, "stream string, producer bigint, arrival bigint, epoch bigint, seq bigint, status string", "epoch bigint, last bigint", "append", "NoTimeout")
