"""Subscriptions: configurations confirmed by hash, leases, safe webhook addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import scan

#: Bounds of a lease and its length if none is asked for, in milliseconds.
LEASE_LEAST, LEASE_MOST, LEASE = 1_000, 600_000, 30_000


def config_hash(kind: Column, pattern: Column, streams: Column, target: Column, lease_ms: Column, description: Column) -> Column:
    """SHA-256 of the normalized configuration: streams sorted and distinct, the default lease filled in."""
    listed = F.array_join(F.array_sort(F.array_distinct(F.coalesce(streams, F.array().cast("array<string>")))), ",")
    parts = [kind, pattern, listed, target, F.coalesce(lease_ms, F.lit(LEASE)).cast("string"), description]
    return F.sha2(F.concat_ws("\n", *[F.coalesce(p, F.lit("")) for p in parts]).cast("binary"), 256)


def confirmed(puts: DataFrame) -> DataFrame:
    """puts(seq, sub, kind, pattern, streams, target, lease_ms, description): seq, sub, status.

    Refused as malformed (400): neither pattern nor streams, an unknown kind, no
    target, a lease out of bounds.  The first good one of a subscription creates it
    (201); later ones with an equal hash confirm it (200), others conflict (409).
    """
    lease = F.coalesce("lease_ms", F.lit(LEASE))
    some = F.col("pattern").isNotNull() | (F.coalesce(F.size("streams"), F.lit(0)) > 0)
    good = some & F.coalesce(F.col("kind").isin("webhook", "pull-wake"), F.lit(False)) & F.col("target").isNotNull() & lease.between(LEASE_LEAST, LEASE_MOST)
    h = config_hash(*[F.col(c) for c in ("kind", "pattern", "streams", "target", "lease_ms", "description")])
    hashed = puts.select("seq", "sub", good.alias("good"), h.alias("hash"))
    first = hashed.where("good").groupBy("sub").agg(F.min("seq").alias("made"), F.min_by("hash", "seq").alias("kept"))
    status = F.when(~F.col("good"), 400).when(F.col("seq") == F.col("made"), 201).when(F.col("hash") == F.col("kept"), 200).otherwise(409)
    return hashed.join(first, "sub", "left").select("seq", "sub", status.alias("status"))


def leases(log: DataFrame, ttl_us: int) -> DataFrame:
    """log(seq, sub, at in microseconds, never falling with seq; act: 'ack', 'done' or 'append'): seq, sub, verdict, wake_at.

    For each 'ack' and 'done': 'claims' where no lease was held, 'holds' within one,
    'expired' where the lease before had run out, its holder and token cleared (an
    'ack' that finds it so takes a new lease).
    wake_at: when an expired lease scheduled a wake, which it does if messages had
    come since the last act of its holder and before it ran out; later messages wake
    by themselves.
    """
    act = F.col("act")
    holder = act.isin("ack", "done")
    stand = F.when(holder, F.struct("seq", "at", (act == "ack").alias("leased")))
    before = scan(log, "seq", [], maxima={"last": stand}, group=["sub"], before=True)
    ends = F.col("last.at") + ttl_us
    # the first message after each act of a holder: acts number the spans of the log
    span = F.coalesce(F.col("last.seq"), F.lit(-1))
    came = before.where(act == "append").groupBy("sub", span.alias("span")).agg(F.min("at").alias("came"))
    judged = before.where(holder).withColumn("span", span).join(came, ["sub", "span"], "left")
    leased = F.coalesce(F.col("last.leased"), F.lit(False))
    expired = leased & (F.col("at") >= ends)
    return judged.select("seq", "sub", F.when(expired, "expired").when(leased, "holds").otherwise("claims").alias("verdict"), F.when(expired & (F.col("came") < ends), ends).alias("wake_at"))


def webhook_safe(url: Column) -> Column:
    """https to a host that is not local; http only to localhost and 127.0.0.0/8.  No IPv6 addresses; null: not safe."""
    parts = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]+)"
    scheme, host = F.lower(F.regexp_extract(url, parts, 1)), F.lower(F.regexp_extract(url, parts, 2))
    numeric = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    n = [F.try_element_at(F.split(host, r"\."), F.lit(i)).try_cast("int") for i in (1, 2)]
    near = n[0].isin(0, 10, 127) | ((n[0] == 172) & n[1].between(16, 31)) | ((n[0] == 192) & (n[1] == 168)) | ((n[0] == 169) & (n[1] == 254))
    local = (host == "localhost") | (numeric & (n[0] == 127))
    inside = (host == "localhost") | host.startswith("[") | (numeric & near)
    return F.coalesce(F.when(scheme == "http", local).when((scheme == "https") & (host != ""), ~inside), F.lit(False))
