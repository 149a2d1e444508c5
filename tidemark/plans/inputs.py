"""Inputs of the stream operators derived from the driver's tables; the SQL twins are common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import lifecycle
from tidemark.session import table


def commands(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    cmd = F.when(F.col("event_type").isin("signup", "click", "view"), "create").when(F.col("event_type") == "purchase", "close").otherwise("delete")
    ct = F.when(k % 3 == 0, "application/octet-stream").when(k % 3 == 1, "application/json").otherwise("text/plain; charset=utf-8")
    return table(spark, sf, "events").select((F.col("event_id") + 1).alias("seq"), F.concat(F.lit("users/"), F.col("user_id"), F.lit("/k"), k % 5).alias("path"), cmd.alias("cmd"), ct.alias("content_type"), F.lit(None).cast("string").alias("expiry"), F.when(F.col("value") > 250, "closed").otherwise("open").alias("lifecycle"))


COMMANDS = """commands AS (SELECT event_id + 1 AS seq, 'users/' || user_id || '/k' || (k % 5) AS path,
  CASE WHEN event_type IN ('signup','click','view') THEN 'create' WHEN event_type = 'purchase' THEN 'close' ELSE 'delete' END AS cmd,
  CASE k % 3 WHEN 0 THEN 'application/octet-stream' WHEN 1 THEN 'application/json' ELSE 'text/plain; charset=utf-8' END AS content_type,
  CASE WHEN value > 250 THEN 'closed' ELSE 'open' END AS lifecycle
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events))"""


def decided_sql(capacity: int = lifecycle.CAPACITY, source: str = COMMANDS) -> str:
    return f"""{source},
tc AS (SELECT path, min(seq) AS tc, arg_min(content_type, seq) AS ct, arg_min(lifecycle, seq) AS lc FROM commands WHERE cmd = 'create' GROUP BY path),
rk AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY tc) <= {capacity} THEN row_number() OVER (ORDER BY tc) ELSE 0 END AS uid FROM tc),
td AS (SELECT path, min(seq) AS td FROM commands JOIN tc USING (path) WHERE cmd = 'delete' AND seq > tc GROUP BY path),
cl AS (SELECT path, min(seq) AS tcl FROM commands JOIN tc USING (path) WHERE cmd = 'close' AND seq > tc GROUP BY path),
eff AS (SELECT rk.*, td, CASE WHEN lc = 'closed' THEN tc WHEN td IS NULL OR tcl < td THEN tcl END AS tx FROM rk LEFT JOIN td USING (path) LEFT JOIN cl USING (path)),
judged AS (SELECT c.*, e.uid AS u, CASE
   WHEN cmd = 'create' THEN CASE WHEN e.uid = 0 THEN 'CapacityExhausted' WHEN seq = tc THEN 'Created' WHEN seq > td THEN 'Occupied'
     WHEN c.content_type = e.ct AND c.lifecycle = (CASE WHEN seq > tx THEN 'closed' ELSE 'open' END) THEN 'AlreadyExists' ELSE 'Occupied' END
   WHEN tc IS NULL OR e.uid = 0 OR seq < tc OR seq > td THEN 'NotLive'
   WHEN cmd = 'close' THEN CASE WHEN seq = tx THEN 'Closed' ELSE 'AlreadyClosed' END
   ELSE CASE WHEN seq = td THEN 'Deleted' ELSE 'NotLive' END END AS outcome
   FROM commands c LEFT JOIN eff e USING (path)),
decided AS (SELECT seq, path, cmd, content_type, lifecycle, outcome, CASE WHEN outcome IN ('Created','AlreadyExists','Closed','AlreadyClosed','Deleted') THEN u END AS uid FROM judged),
numbered AS (SELECT *, row_number() OVER (ORDER BY seq) AS fact_no FROM decided WHERE outcome IN ('Created','Closed','Deleted')),
facts AS (SELECT fact_no, 1 + (fact_no - 1) // 64 AS batch, CASE outcome WHEN 'Created' THEN 'StreamCreated' WHEN 'Closed' THEN 'StreamClosed' ELSE 'StreamDeleted' END AS kind, path, uid, content_type, lifecycle, seq FROM numbered)"""


FACTS = decided_sql()


def folded_sql(name: str = "folded", upto: str = "1e18") -> str:
    return f"""{name} AS (SELECT path, max(uid) AS uid, CASE WHEN bool_or(kind = 'StreamDeleted') THEN 'Tombstone' ELSE 'Live' END AS state,
  CASE WHEN bool_or(kind = 'StreamDeleted') THEN NULL ELSE max(CASE WHEN kind = 'StreamCreated' THEN content_type END) END AS content_type,
  CASE WHEN bool_or(kind = 'StreamDeleted') THEN NULL WHEN bool_or(kind = 'StreamClosed' OR (kind = 'StreamCreated' AND lifecycle = 'closed')) THEN 'closed' ELSE 'open' END AS lifecycle,
  CASE WHEN bool_or(kind = 'StreamDeleted') THEN NULL ELSE max(CASE WHEN kind = 'StreamCreated' THEN fact_no END) END AS created_at
  FROM facts WHERE batch <= {upto} GROUP BY path)"""


def facts(spark: SparkSession, sf: str) -> DataFrame:
    c = commands(spark, sf)
    return lifecycle.facts(lifecycle.decide(c), like=c.select("seq"))


def folded(spark: SparkSession, sf: str, upto: int | None = None) -> DataFrame:
    return lifecycle.fold(facts(spark, sf), upto)


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """stream, n (place), data, off (the end of the message), ts."""
    from tidemark.functions.parsing import offset_text
    from tidemark.operators.ordering import scan

    data = F.concat(F.lit('{"id":'), F.col("event_id"), F.lit(',"u":'), F.col("user_id"), F.lit("}"))
    rows = table(spark, sf, "events").select(F.concat(F.lit("events/"), F.col("event_type")).alias("stream"), "event_id", data.alias("data"), "ts")
    placed = scan(rows, "event_id", [], {"n": F.lit(1).cast("bigint"), "size": F.octet_length("data") + 5}, group=["stream"])
    return placed.select("stream", "n", "data", offset_text(F.lit(0), F.col("size")).alias("off"), "ts", "event_id")


MESSAGES = """messages AS (SELECT 'events/' || event_type AS stream, row_number() OVER w AS n, data, '0000000000000000_' || lpad(CAST(sum(strlen(data) + 5) OVER w AS VARCHAR), 16, '0') AS off, ts, event_id
  FROM (SELECT *, '{"id":' || event_id || ',"u":' || user_id || '}' AS data FROM events) WINDOW w AS (PARTITION BY event_type ORDER BY event_id))"""


def changes(spark: SparkSession, sf: str) -> DataFrame:
    """type, key, op, value, off, control of change events; every 400th is a reset."""
    o = table(spark, sf, "orders")
    op = F.when(F.col("o_orderstatus") == "F", "insert").when(F.col("o_orderstatus") == "P", "delete").when(F.col("o_orderkey") % 2 == 0, "update").otherwise("upsert")
    return o.select(F.col("o_orderpriority").alias("type"), (F.col("o_orderkey") % 500).alias("key"), op.alias("op"), F.col("o_custkey").alias("value"), F.col("o_orderkey").alias("off"), F.when(F.col("o_orderkey") % 997 == 0, "reset").alias("control"))


CHANGES = """changes AS (SELECT o_orderpriority AS type, o_orderkey % 500 AS key, CASE WHEN o_orderstatus = 'F' THEN 'insert' WHEN o_orderstatus = 'P' THEN 'delete' WHEN o_orderkey % 2 = 0 THEN 'update' ELSE 'upsert' END AS op,
  o_custkey AS value, o_orderkey AS off, CASE WHEN o_orderkey % 997 = 0 THEN 'reset' END AS control FROM orders)"""


def transfers(spark: SparkSession, sf: str) -> DataFrame:
    l, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("debit"), F.col("o_custkey").alias("credit"), F.round("l_quantity").cast("bigint").alias("amount"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ts"), (F.col("l_linenumber") % 3).cast("bigint").alias("code"))


TRANSFERS = """transfers AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS debit, o_custkey AS credit, CAST(round(l_quantity) AS BIGINT) AS amount, l_orderkey * 10 + l_linenumber AS ts, CAST(l_linenumber % 3 AS BIGINT) AS code
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def kv(spark: SparkSession, sf: str) -> DataFrame:
    """key, seq, kind, value, created, expires of a store with many versions of each key."""
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "error", "Tombstone").when(F.col("event_type") == "view", "Merge").otherwise("Value")
    created = F.col("event_id") * 10
    return e.select(F.concat(F.lit("user/"), F.lpad((F.col("user_id") % 97).cast("string"), 4, "0"), F.lit("/"), F.col("event_id") % 7).alias("key"), F.col("event_id").alias("seq"), kind.alias("kind"), F.floor("value").cast("bigint").alias("value"), created.alias("created"), F.when(F.col("event_id") % 4 == 0, created + 5000).alias("expires"))


KV = """kv AS (SELECT 'user/' || lpad(CAST(user_id % 97 AS VARCHAR), 4, '0') || '/' || (event_id % 7) AS key, event_id AS seq, CASE event_type WHEN 'error' THEN 'Tombstone' WHEN 'view' THEN 'Merge' ELSE 'Value' END AS kind,
  CAST(floor(value) AS BIGINT) AS value, event_id * 10 AS created, CASE WHEN event_id % 4 = 0 THEN event_id * 10 + 5000 END AS expires FROM events)"""


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Tables of two versions of a store: gen, tree, run_ord, table_ord, table_id, bytes, lo, hi, birth."""
    p = table(spark, sf, "part")
    row = p.select((F.col("p_partkey") % 2).alias("gen"), F.when(F.col("p_size") % 2 == 0, "directory").otherwise("ledger").alias("tree"), (F.col("p_partkey") % 16).alias("run_ord"), F.col("p_partkey").alias("table_ord"), F.floor(F.col("p_partkey") / 3).alias("table_id"), (F.col("p_size") * 1000).cast("bigint").alias("bytes"), (F.col("p_partkey") * 10).alias("lo"), (F.col("p_partkey") * 10 + F.col("p_size") * 7).alias("hi"), (F.col("p_partkey") % 5).alias("birth"))
    return row


MANIFEST = """manifest AS (SELECT p_partkey % 2 AS gen, CASE WHEN p_size % 2 = 0 THEN 'directory' ELSE 'ledger' END AS tree, p_partkey % 16 AS run_ord, p_partkey AS table_ord, p_partkey // 3 AS table_id,
  CAST(p_size * 1000 AS BIGINT) AS bytes, p_partkey * 10 AS lo, p_partkey * 10 + p_size * 7 AS hi, p_partkey % 5 AS birth FROM part)"""

