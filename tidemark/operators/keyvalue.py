"""Versioned key-value rows and ledger transfers as relations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordering import scan


def latest(kv: DataFrame, snapshot: int | None = None) -> DataFrame:
    """The newest visible version of each key (seq below the snapshot); a tombstone hides it."""
    seen = kv if snapshot is None else kv.where(F.col("seq") < snapshot)
    newest = seen.groupBy("key").agg(F.max_by(F.struct("seq", "kind", "value"), "seq").alias("v"))
    return newest.where("v.kind != 'Tombstone'").select("key", "v.seq", "v.value")


def merged(kv: DataFrame) -> DataFrame:
    """Merge operands added to the newest value below them; a tombstone starts from nothing."""
    base = kv.where("kind != 'Merge'").groupBy("key").agg(F.max("seq").alias("base_seq"), F.max_by(F.struct("kind", "value"), "seq").alias("base"))
    operands = kv.where("kind = 'Merge'").join(base.select("key", "base_seq"), "key", "left").where("base_seq is null or seq > base_seq").groupBy("key").agg(F.sum("value").alias("added"))
    both = base.join(operands, "key", "full_outer")
    start = F.when(F.col("base.kind") == "Value", F.col("base.value"))
    return both.where(start.isNotNull() | F.col("added").isNotNull()).select("key", (F.coalesce(start, F.lit(0)) + F.coalesce("added", F.lit(0))).alias("value"))


def retain(kv: DataFrame, now: int, keep_seq: int) -> DataFrame:
    """Versions that stay: all at or above keep_seq and the newest below it; an expired value is a tombstone, an expired operand goes."""
    below = F.row_number().over(Window.partitionBy("key", F.col("seq") >= keep_seq).orderBy(F.col("seq").desc()))
    dead = F.col("expires").isNotNull() & (F.col("expires") <= now)
    rows = kv.withColumn("_n", below).where((F.col("seq") >= keep_seq) | (F.col("_n") == 1))
    return rows.where(~(dead & (F.col("kind") == "Merge"))).select("key", "seq", F.when(dead, "Tombstone").otherwise(F.col("kind")).alias("kind"), F.when(~dead, F.col("value")).alias("value"))


def compact(kv: DataFrame, floor: int) -> DataFrame:
    """Versions left by a compaction into the last level: all at or above the floor, one below it unless that is a tombstone."""
    n = F.row_number().over(Window.partitionBy("key", F.col("seq") >= floor).orderBy(F.col("seq").desc()))
    return kv.withColumn("_n", n).where((F.col("seq") >= floor) | ((F.col("_n") == 1) & (F.col("kind") != "Tombstone"))).drop("_n")


def conflicts(reads: DataFrame, writes: DataFrame, span: int = 15) -> DataFrame:
    """Transactions whose read keys another one wrote after their snapshot and before their commit.

    Time is cut into spans and a read looks only into those that it lasts for,
    so a key's history is not joined with itself. Any span gives the same rows.
    """
    at = lambda c: F.floor(F.col(c) / span)
    r = reads.where("snapshot < committed").withColumn("span", F.explode(F.sequence(at("snapshot"), at("committed")))).alias("r")
    w = writes.select("key", "committed", at("committed").alias("span")).distinct().alias("w")
    clash = (F.col("r.key") == F.col("w.key")) & (F.col("w.committed") > F.col("r.snapshot")) & (F.col("w.committed") < F.col("r.committed"))
    return r.join(w, clash & (F.col("r.span") == F.col("w.span")), "left_semi").select("txn").distinct()


def balances(transfers: DataFrame) -> DataFrame:
    """account, debits, credits, from one pass over both sides."""
    sides = transfers.select(F.col("debit").alias("account"), F.col("amount").alias("d"), F.lit(0).cast("bigint").alias("c")).unionByName(transfers.select(F.col("credit").alias("account"), F.lit(0).cast("bigint").alias("d"), F.col("amount").alias("c")))
    return sides.groupBy("account").agg(F.sum("d").alias("debits"), F.sum("c").alias("credits"))


def sides(transfers: DataFrame) -> DataFrame:
    """account, id, ts, delta, side of both accounts of each transfer."""
    of = lambda account, sign, side: transfers.select(F.col(account).alias("account"), "id", "ts", (sign * F.col("amount")).alias("delta"), F.lit(side).alias("side"))
    return of("debit", -1, "d").unionByName(of("credit", 1, "c"))


def running_balance(transfers: DataFrame) -> DataFrame:
    """account, id, ts, delta, side, balance (credits - debits) after each transfer that touches the account."""
    return scan(sides(transfers), "ts", ["delta", "id", "side"], {"balance": F.col("delta")}, group=["account"])


def equals_or_any(column: str, value: int) -> Column:
    """Zero stands for any value."""
    return F.lit(True) if value == 0 else F.col(column) == value


def between_or_any(column: str, low: int, high: int) -> Column:
    """Both ends count; a zero end is open."""
    return (F.lit(low == 0) | (F.col(column) >= low)) & (F.lit(high == 0) | (F.col(column) <= high))


def limits(transfers: DataFrame, debit_flag: Callable[[Column], Column], credit_flag: Callable[[Column], Column]) -> DataFrame:
    """transfers(id, debit, credit, amount, ts, pending): id and verdict against the limits of both accounts.

    An account flagged by debit_flag must not owe more than its posted credits, one
    flagged by credit_flag the reverse; pending amounts count against a limit, not
    for it.  Balances are those of all transfers with an earlier ts (unique), whatever
    their own verdicts.  A transfer onto its own account is refused first and moves
    nothing.
    """
    apart = transfers.where("debit != credit")
    zero = F.lit(0).cast("bigint")
    sides = apart.select("id", "ts", "amount", "pending", F.explode(F.array(F.struct(F.col("debit").alias("account"), F.lit(True).alias("owes")), F.struct(F.col("credit").alias("account"), F.lit(False).alias("owes")))).alias("side")).select("id", "ts", "amount", "pending", "side.*")
    own = F.when(F.col("owes"), F.col("amount")).otherwise(zero)
    other = F.when(F.col("owes"), zero).otherwise(F.col("amount"))
    posted = lambda c: F.when(F.col("pending"), zero).otherwise(c)
    at = scan(sides, "ts", [], {"debits": own, "credits": other, "debits_posted": posted(own), "credits_posted": posted(other)}, group=["account"], like=apart.select("ts"), before=True)
    over = F.when(F.col("owes"), debit_flag(F.col("account")) & (F.col("debits") + F.col("amount") > F.col("credits_posted"))).otherwise(credit_flag(F.col("account")) & (F.col("credits") + F.col("amount") > F.col("debits_posted")))
    judged = at.groupBy("id").agg(F.max(F.col("owes") & over).alias("debit_over"), F.max(~F.col("owes") & over).alias("credit_over"))
    verdict = F.when(F.col("debit_over"), "exceeds_credits").when(F.col("credit_over"), "exceeds_debits").otherwise("ok")
    return judged.select("id", verdict.alias("verdict")).unionByName(transfers.where("debit = credit").select("id", F.lit("accounts_must_be_different").alias("verdict")))
