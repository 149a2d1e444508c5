"""The remaining rows of the inventory that have a result of their own."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import lifecycle as L
from tidemark.operators.ordering import by_text, scan
from tidemark.operators.requests import http_statuses
from tidemark.plans.inputs import CHANGES, COMMANDS, FACTS, KV, MANIFEST, changes, commands, decided_sql, facts, folded, folded_sql, kv, manifest
from tidemark.plans.registry import query
from tidemark.session import table


@query(f"WITH {FACTS}, {folded_sql()} SELECT count(*) AS paths, count(*) FILTER (state = 'Live') AS live, max(uid) AS top FROM folded")
def s1_open(spark, sf):
    return folded(spark, sf).agg(F.count("*").alias("paths"), F.count(F.when(F.col("state") == "Live", 1)).alias("live"), F.max("uid").alias("top"))


@query(f"WITH {FACTS}, {folded_sql()} SELECT uid, uid - lag(uid) OVER (ORDER BY uid) AS step FROM folded WHERE state = 'Live'")
def s9_ledger_scan(spark, sf):
    return scan(L.ledger(folded(spark, sf)).select("uid"), "uid", [], maxima={"last": F.col("uid")}, like=facts(spark, sf).select("uid"), before=True).select("uid", (F.col("uid") - F.col("last")).alias("step"))


@query(f"WITH {FACTS}, {folded_sql()} SELECT path, uid, CASE WHEN strlen(path) > 512 THEN 'OverBound' ELSE 'Row' END AS row_kind FROM folded")
def s10_sst_rows(spark, sf):
    return L.directory(folded(spark, sf)).sortWithinPartitions("path").select("path", "uid", F.when(F.octet_length("path") > 512, "OverBound").otherwise("Row").alias("row_kind"))


@query(f"WITH {FACTS} SELECT batch, count(*) AS n, count(*) BETWEEN 1 AND 4096 AS bounded, min(fact_no) = 64 * (batch - 1) + 1 AS starts_right FROM facts GROUP BY batch")
def s11_wal_check(spark, sf):
    return facts(spark, sf).groupBy("batch").agg(F.count("*").alias("n"), F.count("*").between(1, 4096).alias("bounded"), (F.min("fact_no") == 64 * (F.col("batch") - 1) + 1).alias("starts_right"))


_REQUESTS = """requests AS (SELECT event_id + 1 AS seq, CASE user_id WHEN 7 THEN '__ds/users/7' WHEN 11 THEN 'users//k' ELSE 'users/' || user_id || '/k' || (k % 5) END AS path,
  CASE event_type WHEN 'view' THEN 'HEAD' WHEN 'purchase' THEN 'POST' WHEN 'error' THEN 'DELETE' WHEN 'signup' THEN CASE WHEN value > 400 THEN 'GET' ELSE 'PUT' END ELSE 'PUT' END AS verb,
  value > 300 AS body, CASE WHEN value > 100 THEN 'closed' ELSE 'open' END AS lifecycle, CASE k % 2 WHEN 0 THEN 'application/json' ELSE 'text/plain' END AS content_type
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)),
valid AS (SELECT * FROM requests WHERE path NOT LIKE '\\_\\_ds/%' ESCAPE '\\' AND NOT contains(path, '//')),
commands AS (SELECT seq, path, CASE verb WHEN 'PUT' THEN 'create' WHEN 'POST' THEN 'close' ELSE 'delete' END AS cmd, content_type, lifecycle FROM valid WHERE verb = 'DELETE' OR (verb = 'PUT' AND NOT body) OR (verb = 'POST' AND NOT body AND lifecycle = 'closed'))"""


def _requests(spark, sf):
    """HTTP requests of the event log: seq, path, verb, body (there is one), lifecycle (of the header) and content type."""
    k, user, t, value = F.get_json_object("props", "$.k").cast("bigint"), F.col("user_id"), F.col("event_type"), F.col("value")
    path = F.when(user == 7, "__ds/users/7").when(user == 11, "users//k").otherwise(F.concat(F.lit("users/"), user, F.lit("/k"), k % 5))
    verb = F.when(t == "view", "HEAD").when(t == "purchase", "POST").when(t == "error", "DELETE").when((t == "signup") & (value > 400), "GET").otherwise("PUT")
    return table(spark, sf, "events").select((F.col("event_id") + 1).alias("seq"), path.alias("path"), verb.alias("verb"), (value > 300).alias("body"), F.when(value > 100, "closed").otherwise("open").alias("lifecycle"), F.when(k % 2 == 0, "application/json").otherwise("text/plain").alias("content_type"))


@query(f"""WITH {decided_sql(source=_REQUESTS)}, r AS (SELECT r.*, d.outcome, e.tc, e.td FROM requests r LEFT JOIN decided d USING (seq) LEFT JOIN eff e ON e.path = r.path)
SELECT seq, CASE WHEN path LIKE '\\_\\_ds/%' ESCAPE '\\' THEN 404 WHEN contains(path, '//') THEN 400 WHEN verb = 'GET' THEN 501
  WHEN verb = 'HEAD' THEN CASE WHEN tc IS NULL OR seq < tc THEN 404 WHEN seq > td THEN 410 ELSE 200 END
  WHEN verb = 'PUT' AND body THEN 400 WHEN verb = 'POST' AND body THEN 501 WHEN verb = 'POST' AND lifecycle = 'open' THEN 400
  ELSE CASE outcome WHEN 'Created' THEN 201 WHEN 'AlreadyExists' THEN 200 WHEN 'Occupied' THEN 409 WHEN 'CapacityExhausted' THEN 429 WHEN 'NotLive' THEN CASE WHEN tc IS NULL OR seq < tc THEN 404 ELSE 410 END ELSE 204 END END AS status FROM r""")
def s16_http_verbs(spark, sf):
    return http_statuses(_requests(spark, sf))


@query(f"WITH {KV} SELECT key, seq, value FROM kv WHERE kind = 'Value' UNION ALL SELECT key || '+', seq, value FROM kv WHERE kind = 'Value' AND seq % 10 = 0")
def s22_bulk_ingest(spark, sf):
    rows = kv(spark, sf).where("kind = 'Value'").select("key", "seq", "value")
    return rows.unionByName(rows.where("seq % 10 = 0").withColumn("key", F.concat("key", F.lit("+"))))


@query(f"WITH {CHANGES} SELECT off, type || ':' || key || ':' || op AS message FROM changes")
def s23_change_publisher(spark, sf):
    return changes(spark, sf).select("off", F.concat_ws(":", "type", F.col("key").cast("string"), "op").alias("message"))


@query("SELECT conv_id, turn, text FROM conversations WHERE role = 'user'")
def s30_read_surface(spark, sf):
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", "text")


@query(f"WITH {COMMANDS}, first AS (SELECT path, arg_min(content_type, seq) AS ct, arg_min(lifecycle, seq) AS lc FROM commands WHERE cmd = 'create' GROUP BY path) SELECT seq, split_part(content_type, ';', 1) = split_part(ct, ';', 1) AND lifecycle = lc AS matches FROM commands JOIN first USING (path) WHERE cmd = 'create'")
def j18_contract_match(spark, sf):
    c = commands(spark, sf).where("cmd = 'create'")
    first = c.groupBy("path").agg(F.min_by(F.struct("content_type", "lifecycle"), "seq").alias("first"))
    loose = lambda x: F.substring_index(x, ";", 1)
    return c.join(first, "path").select("seq", (loose(F.col("content_type")).eqNullSafe(loose(F.col("first.content_type"))) & F.col("lifecycle").eqNullSafe(F.col("first.lifecycle"))).alias("matches"))


@query(f"WITH {KV} SELECT key, seq, lag(value) OVER (PARTITION BY key ORDER BY seq) AS taken, CAST(value + coalesce(lag(value) OVER (PARTITION BY key ORDER BY seq), 0) AS BIGINT) AS updated FROM kv")
def a33_read_modify_write(spark, sf):
    before = F.lag("value").over(Window.partitionBy("key").orderBy("seq"))
    return kv(spark, sf).select("key", "seq", before.alias("taken"), (F.col("value") + F.coalesce(before, F.lit(0))).alias("updated"))


@query(f"WITH {FACTS}, {folded_sql()} SELECT path, row_number() OVER (ORDER BY path) AS place FROM folded")
def o1_ordered_map(spark, sf):
    return by_text(L.directory(folded(spark, sf)).select("path"), "path", "place")


@query(f"WITH {FACTS} SELECT batch, path FROM facts ORDER BY fact_no DESC LIMIT 1")
def o2_newest(spark, sf):
    return facts(spark, sf).orderBy(F.desc("fact_no")).limit(1).select("batch", "path")


@query(f"WITH {KV} SELECT key, seq FROM kv WHERE key > 'user/0002/3' ORDER BY key, seq LIMIT 40")
def o3_next_page(spark, sf):
    return kv(spark, sf).where("key > 'user/0002/3'").select("key", "seq").orderBy("key", "seq").limit(40)


@query(f"WITH {MANIFEST} SELECT tree, run_ord, lo FROM manifest")
def o5_k_way_merge(spark, sf):
    m = manifest(spark, sf).select("tree", "run_ord", "lo")
    return m.where("tree = 'directory'").unionByName(m.where("tree = 'ledger'")).orderBy("lo")


@query(f"WITH {KV} SELECT key, count(*) AS n FROM kv WHERE key IN ('user/0003/1', 'user/0004/2', 'user/none') GROUP BY key")
def p18_might_match(spark, sf):
    return kv(spark, sf).where(F.col("key").isin("user/0003/1", "user/0004/2", "user/none")).groupBy("key").agg(F.count("*").alias("n"))


@query(f"WITH {FACTS} SELECT seq, batch AS visible_from FROM facts")
def x7_publish_before_reply(spark, sf):
    return facts(spark, sf).select("seq", F.col("batch").alias("visible_from"))


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type")
def x27_live_query(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("SELECT l_suppkey AS producer, CAST(floor((row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1) / 16) AS BIGINT) AS batch, l_orderkey FROM lineitem")
def x45_batching_producer(spark, sf):
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("producer"), F.floor((F.row_number().over(order) - 1) / 16).alias("batch"), "l_orderkey")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def ext_tumbling_window(spark, sf):
    """An extension: the reference has no event-time windows."""
    w = F.window(F.col("ts").cast("timestamp"), "1 day")
    return table(spark, sf, "events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n")
