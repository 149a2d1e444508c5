"""Queries over key-value rows, ledger transfers, live-query tables and object listings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import parsing as P
from tidemark.operators import keyvalue as K
from tidemark.operators.ordering import scan
from tidemark.plans.inputs import CHANGES, KV, MANIFEST, TRANSFERS, changes, kv, manifest, transfers
from tidemark.plans.registry import query
from tidemark.session import table


@query(f"WITH {KV} SELECT key, arg_max(seq, seq) AS seq, arg_max(value, seq) AS value FROM kv GROUP BY key HAVING arg_max(kind, seq) <> 'Tombstone'")
def a26_latest_version(spark, sf):
    return K.latest(kv(spark, sf))


@query(f"WITH {KV} SELECT key, max(seq) AS seq, arg_max(value, seq) AS value FROM kv WHERE seq < 500 GROUP BY key HAVING arg_max(kind, seq) <> 'Tombstone'")
def x32_snapshot_read(spark, sf):
    return K.latest(kv(spark, sf), 500)


@query(f"WITH {KV} SELECT count(*) AS n FROM kv WHERE seq < 300")
def p16_visibility(spark, sf):
    return kv(spark, sf).where("seq < 300").agg(F.count("*").alias("n"))


@query(f"WITH {KV} SELECT key, seq, value FROM kv WHERE key >= 'user/0002' AND key < 'user/0005'")
def s24_range_scan(spark, sf):
    return kv(spark, sf).where("key >= 'user/0002' and key < 'user/0005'").select("key", "seq", "value")


@query(f"WITH {KV} SELECT key, seq FROM kv WHERE key LIKE 'user/0003/%'")
def s24_prefix_scan(spark, sf):
    return kv(spark, sf).where(F.col("key").startswith("user/0003/")).select("key", "seq")


@query(f"WITH {KV} SELECT key, seq FROM kv WHERE key LIKE 'user/0001/%' ORDER BY key, seq LIMIT 20")
def s29_scan_limit(spark, sf):
    return kv(spark, sf).where(F.col("key").startswith("user/0001/")).select("key", "seq").orderBy("key", "seq").limit(20)


@query(f"WITH {KV}, b AS (SELECT key, max(seq) AS s, arg_max(kind, seq) AS k, arg_max(value, seq) AS v FROM kv WHERE kind <> 'Merge' GROUP BY key), m AS (SELECT key, sum(value) AS added FROM kv LEFT JOIN b USING (key) WHERE kind = 'Merge' AND (s IS NULL OR seq > s) GROUP BY key) SELECT key, CAST(coalesce(CASE WHEN k = 'Value' THEN v END, 0) + coalesce(added, 0) AS BIGINT) AS value FROM b FULL JOIN m USING (key) WHERE k = 'Value' OR added IS NOT NULL")
def a25_merge_operator(spark, sf):
    return K.merged(kv(spark, sf))


@query(f"WITH {KV} SELECT count(*) AS len, count(DISTINCT key) AS keys, count(*) FILTER (kind = 'Tombstone') AS tombstones, count(*) = 0 AS empty, bool_or(key = 'user/0003/1') AS contains FROM kv")
def a27_counts(spark, sf):
    return kv(spark, sf).agg(F.count("*").alias("len"), F.countDistinct("key").alias("keys"), F.count(F.when(F.col("kind") == "Tombstone", 1)).alias("tombstones"), (F.count("*") == 0).alias("empty"), F.max(F.col("key") == "user/0003/1").alias("contains"))


@query(f"WITH {KV} SELECT kind, min(key) AS lo, max(key) AS hi FROM kv GROUP BY kind")
def a30_key_range(spark, sf):
    return kv(spark, sf).groupBy("kind").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))


@query(f"WITH {KV} SELECT min(key) AS first_key, arg_min(value, key || lpad(CAST(seq AS VARCHAR), 12, '0')) AS first_value, max(key) AS last_key, arg_max(value, key || lpad(CAST(seq AS VARCHAR), 12, '0')) AS last_value FROM kv")
def o9_first_last(spark, sf):
    at = F.struct("key", "seq")
    return kv(spark, sf).agg(F.min("key").alias("first_key"), F.min_by("value", at).alias("first_value"), F.max("key").alias("last_key"), F.max_by("value", at).alias("last_value"))


@query(f"WITH {KV} SELECT key, seq, expires IS NOT NULL AND expires <= 6000 AS gone FROM kv")
def x30_kv_ttl(spark, sf):
    return kv(spark, sf).select("key", "seq", (F.col("expires").isNotNull() & (F.col("expires") <= 6000)).alias("gone"))


@query(f"WITH {KV}, r AS (SELECT *, row_number() OVER (PARTITION BY key, seq >= 600 ORDER BY seq DESC) AS n, expires IS NOT NULL AND expires <= 9000 AS dead FROM kv) SELECT key, seq, CASE WHEN dead THEN 'Tombstone' ELSE kind END AS kind, CASE WHEN NOT dead THEN value END AS value FROM r WHERE (seq >= 600 OR n = 1) AND NOT (dead AND kind = 'Merge')")
def x31_retention(spark, sf):
    return K.retain(kv(spark, sf), now=9000, keep_seq=600)


@query(f"WITH {KV}, r AS (SELECT *, row_number() OVER (PARTITION BY key, seq >= 700 ORDER BY seq DESC) AS n FROM kv) SELECT key, seq, kind, value FROM r WHERE seq >= 700 OR (n = 1 AND kind <> 'Tombstone')")
def x34_compaction(spark, sf):
    return K.compact(kv(spark, sf), 700).select("key", "seq", "kind", "value")


@query(f"WITH {KV}, t AS (SELECT key, seq % 200 AS txn, seq AS snapshot, seq + 15 AS committed FROM kv) SELECT DISTINCT r.txn FROM t r WHERE EXISTS (SELECT 1 FROM t w WHERE w.key = r.key AND w.committed > r.snapshot AND w.committed < r.committed)")
def x32_conflicts(spark, sf):
    t = kv(spark, sf).select("key", (F.col("seq") % 200).alias("txn"), F.col("seq").alias("snapshot"), (F.col("seq") + 15).alias("committed"))
    return K.conflicts(t, t)


@query(f"WITH {KV} SELECT key, seq, CASE WHEN value > 300 THEN 'Drop' WHEN value > 200 THEN 'Modify' ELSE 'Keep' END AS ruling, CASE WHEN value > 200 THEN 200 ELSE value END AS value FROM kv WHERE value <= 300")
def e4_compaction_filter(spark, sf):
    v = F.col("value")
    return kv(spark, sf).where(v <= 300).select("key", "seq", F.when(v > 300, "Drop").when(v > 200, "Modify").otherwise("Keep").alias("ruling"), F.when(v > 200, 200).otherwise(v).alias("value"))


@query(f"WITH {KV} SELECT split_part(key, '/', 1) || '/' || split_part(key, '/', 2) AS prefix, count(*) AS n FROM kv GROUP BY 1")
def e5_prefix_extractor(spark, sf):
    return kv(spark, sf).groupBy(F.substring_index("key", "/", 2).alias("prefix")).agg(F.count("*").alias("n"))


@query(f"WITH {KV} SELECT key, CAST(sum(value) AS BIGINT) AS value FROM kv WHERE kind = 'Merge' GROUP BY key")
def e3_aggregate(spark, sf):
    return kv(spark, sf).where("kind = 'Merge'").groupBy("key").agg(F.sum("value").alias("value"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) IS NULL AS bad FROM events")
def e7_schema_validator(spark, sf):
    parsed = F.from_json("props", "k bigint, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return table(spark, sf, "events").select("event_id", parsed.alias("p")).select("event_id", F.col("p.k").alias("k"), (F.col("p._bad").isNotNull() | F.col("p.k").isNull()).alias("bad"))


@query(f"WITH {TRANSFERS}, s AS (SELECT debit AS account, amount AS d, 0 AS c FROM transfers UNION ALL SELECT credit, 0, amount FROM transfers) SELECT account, CAST(sum(d) AS BIGINT) AS debits, CAST(sum(c) AS BIGINT) AS credits FROM s GROUP BY account")
def a28_balances(spark, sf):
    return K.balances(transfers(spark, sf))


_RUNNING = f"{TRANSFERS}, s AS (SELECT debit AS account, id, ts, -amount AS delta, 'd' AS side FROM transfers UNION ALL SELECT credit, id, ts, amount, 'c' FROM transfers), b AS (SELECT *, CAST(sum(delta) OVER (PARTITION BY account ORDER BY ts, delta, id, side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS balance FROM s)"


@query(f"WITH {_RUNNING} SELECT account, ts, delta, balance FROM b")
def a28_running_balance(spark, sf):
    return K.running_balance(transfers(spark, sf)).select("account", "ts", "delta", "balance")


@query(f"WITH {_RUNNING} SELECT id, max(balance) FILTER (side = 'd') AS debit_balance, max(balance) FILTER (side = 'c') AS credit_balance FROM b GROUP BY id")
def j16_change_events(spark, sf):
    """Both accounts' balances after each transfer."""
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("balance")))
    return K.running_balance(transfers(spark, sf)).groupBy("id").agg(of("d").alias("debit_balance"), of("c").alias("credit_balance"))


@query(f"WITH {TRANSFERS} SELECT id, amount FROM transfers WHERE code = 1 AND debit = 3")
def p11_zero_is_any(spark, sf):
    t = transfers(spark, sf)
    return t.where(K.equals_or_any("code", 1) & K.equals_or_any("credit", 0) & K.equals_or_any("debit", 3)).select("id", "amount")


@query(f"WITH {TRANSFERS} SELECT id FROM transfers WHERE ts >= 1000 AND ts <= 3000")
def p12_time_range(spark, sf):
    return transfers(spark, sf).where(K.between_or_any("ts", 1000, 3000)).select("id")


@query(f"WITH {TRANSFERS}, r AS (SELECT *, sum(CASE WHEN amount >= 49 THEN 1 ELSE 0 END) OVER (PARTITION BY debit ORDER BY ts) AS stopped FROM transfers) SELECT id FROM r WHERE stopped = 0")
def p13_scan_stop(spark, sf):
    return scan(transfers(spark, sf), "ts", ["id"], {"stopped": F.when(F.col("amount") >= 49, 1).otherwise(0)}, group=["debit"]).where("stopped = 0").select("id")


@query(f"WITH {TRANSFERS} SELECT id, ts FROM transfers WHERE code = 2 AND ts >= 500 ORDER BY ts DESC LIMIT 25")
def p20_query_transfers(spark, sf):
    return transfers(spark, sf).where(K.equals_or_any("code", 2) & K.between_or_any("ts", 500, 0)).orderBy(F.desc("ts")).limit(25).select("id", "ts")


@query(f"WITH {TRANSFERS} SELECT id, amount FROM transfers WHERE id IN (SELECT l_orderkey * 10 + 1 FROM lineitem WHERE l_orderkey % 5 = 0)")
def p21_lookup(spark, sf):
    ids = table(spark, sf, "lineitem").where("l_orderkey % 5 = 0").select((F.col("l_orderkey") * 10 + 1).alias("id"))
    return transfers(spark, sf).join(ids, "id", "left_semi").select("id", "amount")


@query(f"WITH {TRANSFERS} SELECT id FROM transfers WHERE code = 1 UNION SELECT id FROM transfers WHERE amount > 40")
def u3_union(spark, sf):
    t = transfers(spark, sf)
    return t.where("code = 1").select("id").union(t.where("amount > 40").select("id")).distinct()


@query(f"WITH {TRANSFERS} SELECT id FROM transfers WHERE code = 1 INTERSECT SELECT id FROM transfers WHERE amount > 40")
def u4_intersection(spark, sf):
    t = transfers(spark, sf)
    return t.where("code = 1").select("id").intersect(t.where("amount > 40").select("id"))


@query(f"WITH {TRANSFERS} SELECT id FROM transfers WHERE code = 1 EXCEPT SELECT id FROM transfers WHERE amount > 40")
def u5_difference(spark, sf):
    t = transfers(spark, sf)
    return t.where("code = 1").select("id").subtract(t.where("amount > 40").select("id"))


@query(f"WITH {TRANSFERS} SELECT id FROM transfers WHERE debit = 5 OR credit = 5")
def u7_either_side(spark, sf):
    return transfers(spark, sf).where("debit = 5 or credit = 5").select("id")


@query(f"WITH {TRANSFERS} SELECT debit FROM transfers WHERE code = 0 INTERSECT SELECT debit FROM transfers WHERE amount = 7 INTERSECT SELECT debit FROM transfers WHERE credit < 90")
def j11_zig_zag(spark, sf):
    t = transfers(spark, sf)
    side = lambda c: t.where(c).select("debit").distinct()
    return side("code = 0").join(side("amount = 7"), "debit", "left_semi").join(side("credit < 90"), "debit", "left_semi")


@query(f"WITH {TRANSFERS} SELECT t.id, s_name FROM transfers t JOIN supplier ON s_suppkey = debit WHERE amount = 10")
def j12_scan_lookup(spark, sf):
    return transfers(spark, sf).where("amount = 10").join(table(spark, sf, "supplier"), F.col("debit") == F.col("s_suppkey")).select("id", "s_name")


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def j13_live_join(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name")


@query("SELECT p_brand, p_partkey, p_name FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size = 10)")
def j14_index_lookup(spark, sf):
    p = table(spark, sf, "part")
    index = p.where("p_size = 10").select("p_brand").distinct()
    return p.join(index, "p_brand", "left_semi").select("p_brand", "p_partkey", "p_name")


@query("SELECT DISTINCT o_custkey AS subject, l_partkey AS object FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P'")
def j15_triple_match(spark, sf):
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    return o.where("o_orderstatus = 'P'").join(l, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("subject"), F.col("l_partkey").alias("object")).distinct()


@query("SELECT c_mktsegment, count(*) AS n, CAST(sum(c_nationkey) AS BIGINT) AS total, min(c_custkey) AS least, max(c_custkey) AS most, avg(c_nationkey) AS mean FROM customer GROUP BY c_mktsegment")
def a22_aggregates(spark, sf):
    return table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum("c_nationkey").alias("total"), F.min("c_custkey").alias("least"), F.max("c_custkey").alias("most"), F.avg("c_nationkey").alias("mean"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def a23_group_count(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT * FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) ORDER BY n DESC, user_id LIMIT 5")
def a24_nested(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(5)


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 100")
def o8_order_limit(spark, sf):
    return table(spark, sf, "events").select("event_id", "event_type").orderBy(F.desc("event_id")).limit(100)


@query("SELECT event_type, quantile_disc(event_id, 0.5) AS p50, quantile_disc(event_id, 0.99) AS p99 FROM events GROUP BY event_type")
def a29_percentiles(spark, sf):
    e = table(spark, sf, "events").groupBy("event_type")
    at = lambda p: F.expr(f"percentile_disc({p}) within group (order by event_id)")
    return e.agg(at(0.5).cast("bigint").alias("p50"), at(0.99).cast("bigint").alias("p99"))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 0 OR c_name LIKE '%7' OR lower(c_name) LIKE '%00001%' OR c_nationkey IN (1, 2) AND NOT (c_acctbal IS NULL)")
def p14_live_predicates(spark, sf):
    c = F.col
    return table(spark, sf, "customer").where((c("c_mktsegment") == "BUILDING") & (c("c_acctbal") >= 0) | c("c_name").like("%7") | c("c_name").ilike("%00001%") | c("c_nationkey").isin(1, 2) & ~c("c_acctbal").isNull()).select("c_custkey")


@query("SELECT n_nationkey, n_name || '/' || r_name AS label, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN n_name END, 'odd') AS named FROM nation JOIN region ON n_regionkey = r_regionkey")
def p15_projection(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("n_nationkey", F.concat("n_name", F.lit("/"), "r_name").alias("label"), F.coalesce(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")), F.lit("odd")).alias("named"))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def p15_to_array(spark, sf):
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))


_OBJECTS = "objects AS (SELECT 'table/' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS key, p_size AS size, p_brand AS body FROM part)"


def _objects(spark, sf):
    return table(spark, sf, "part").select(F.concat(F.lit("table/"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("key"), F.col("p_size").alias("size"), F.col("p_brand").alias("body"))


@query(f"WITH {_OBJECTS}, p AS (SELECT key FROM objects WHERE key LIKE 'table/%' AND key > 'table/00000050' ORDER BY key LIMIT 21) SELECT key, row_number() OVER (ORDER BY key) <= 20 AS on_page FROM p")
def s3_page(spark, sf):
    page = _objects(spark, sf).where(F.col("key").startswith("table/") & (F.col("key") > "table/00000050")).select("key").orderBy("key").limit(21)
    order = Window.partitionBy("one").orderBy("key")  # a page
    return page.withColumn("one", F.lit(1)).select("key", (F.row_number().over(order) <= 20).alias("on_page"))


@query(f"WITH {_OBJECTS} SELECT key, size, CASE WHEN size > 40 THEN 'Contradiction' ELSE 'Found' END AS outcome FROM objects WHERE key IN ('table/00000007', 'table/00000031', 'table/none')")
def s2_point_read(spark, sf):
    return _objects(spark, sf).where(F.col("key").isin("table/00000007", "table/00000031", "table/none")).select("key", "size", F.when(F.col("size") > 40, "Contradiction").otherwise("Found").alias("outcome"))


@query(f"WITH {_OBJECTS} SELECT min('seal/v1/' || lpad(CAST(18446744073709551615 - p_partkey AS VARCHAR), 20, '0')) AS head FROM part")
def s4_head(spark, sf):
    return table(spark, sf, "part").agg(F.min(P.reverse_key("seal", F.col("p_partkey"))).alias("head"))


@query(f"WITH {_OBJECTS}, n AS (SELECT 'table/' || lpad(CAST(p_partkey * 2 AS VARCHAR), 8, '0') AS key, CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE p_brand END AS mine FROM part) SELECT n.key, CASE WHEN o.key IS NULL THEN 'Direct' WHEN mine = body THEN 'DurableMatch' ELSE 'NotOurs' END AS evidence FROM n LEFT JOIN objects o USING (key)")
def s6_create_evidence(spark, sf):
    mine = table(spark, sf, "part").select(F.concat(F.lit("table/"), F.lpad((F.col("p_partkey") * 2).cast("string"), 8, "0")).alias("key"), F.when(F.col("p_partkey") % 3 == 0, "x").otherwise(F.col("p_brand")).alias("mine"))
    there = _objects(spark, sf).select("key", "body")
    return mine.join(there, "key", "left").select("key", F.when(F.col("body").isNull(), "Direct").when(F.col("mine") == F.col("body"), "DurableMatch").otherwise("NotOurs").alias("evidence"))


@query(f"WITH {_OBJECTS} SELECT key FROM objects WHERE key NOT IN (SELECT key FROM objects WHERE size < 10)")
def s7_idempotent_delete(spark, sf):
    o = _objects(spark, sf)
    return o.join(o.where("size < 10").select("key"), "key", "left_anti").select("key")


@query(f"WITH {_OBJECTS} SELECT key FROM objects WHERE NOT (key >= 'table/00000020' AND key < 'table/00000120')")
def s32_range_drop(spark, sf):
    return _objects(spark, sf).where("not (key >= 'table/00000020' and key < 'table/00000120')").select("key")


@query(f"WITH {MANIFEST}, g AS (SELECT gen, tree, run_ord, table_ord, lo, lag(lo) OVER (PARTITION BY gen, tree, run_ord ORDER BY table_ord) AS before FROM manifest) SELECT gen, tree, count(*) FILTER (lo <= before) AS unordered FROM g GROUP BY gen, tree")
def s8_ascending_keys(spark, sf):
    before = F.lag("lo").over(Window.partitionBy("gen", "tree", "run_ord").orderBy("table_ord"))
    return manifest(spark, sf).withColumn("before", before).groupBy("gen", "tree").agg(F.count(F.when(F.col("lo") <= F.col("before"), 1)).alias("unordered"))


@query(f"WITH {MANIFEST} SELECT gen, tree, run_ord, count(*) AS tables, min(lo) AS lo, max(hi) AS hi FROM manifest GROUP BY gen, tree, run_ord")
def s12_seal_rows(spark, sf):
    return manifest(spark, sf).groupBy("gen", "tree", "run_ord").agg(F.count("*").alias("tables"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


@query(f"WITH {MANIFEST} SELECT 99 AS gen, table_id, table_ord FROM manifest WHERE gen = 1 AND lo BETWEEN 100 AND 900")
def s31_clone(spark, sf):
    return manifest(spark, sf).where("gen = 1 and lo between 100 and 900").select(F.lit(99).alias("gen"), "table_id", "table_ord")


@query(f"WITH {CHANGES} SELECT off, type, op FROM changes WHERE off > 300")
def s21_change_reader(spark, sf):
    return changes(spark, sf).where("off > 300").select("off", "type", "op")


@query(f"WITH {KV} SELECT key, seq FROM kv WHERE kind = 'Value' UNION ALL SELECT key, seq FROM kv WHERE kind = 'Merge'")
def o4_merge_runs(spark, sf):
    rows = kv(spark, sf)
    return rows.where("kind = 'Value'").select("key", "seq").union(rows.where("kind = 'Merge'").select("key", "seq")).orderBy("key", "seq")


@query(f"WITH {KV} SELECT key, seq FROM kv ORDER BY key DESC, seq DESC LIMIT 50")
def o6_descending(spark, sf):
    return kv(spark, sf).select("key", "seq").orderBy(F.desc("key"), F.desc("seq")).limit(50)


@query(f"WITH {TRANSFERS} SELECT id FROM transfers ORDER BY ts LIMIT 30")
def o7_limit(spark, sf):
    return transfers(spark, sf).orderBy("ts").limit(30).select("id")


@query(f"WITH {TRANSFERS} SELECT id, CASE WHEN debit = credit THEN 'accounts_must_be_different' WHEN amount = 0 THEN 'amount_must_not_be_zero' WHEN code = 0 THEN 'code_must_not_be_zero' WHEN s_suppkey IS NULL THEN 'debit_account_not_found' ELSE 'created' END AS status FROM transfers LEFT JOIN supplier ON s_suppkey = debit AND s_suppkey % 9 <> 0")
def x46_create_transfers(spark, sf):
    known = table(spark, sf, "supplier").where("s_suppkey % 9 != 0").select("s_suppkey")
    t = transfers(spark, sf).join(known, F.col("debit") == F.col("s_suppkey"), "left")
    return t.select("id", F.when(F.col("debit") == F.col("credit"), "accounts_must_be_different").when(F.col("amount") == 0, "amount_must_not_be_zero").when(F.col("code") == 0, "code_must_not_be_zero").when(F.col("s_suppkey").isNull(), "debit_account_not_found").otherwise("created").alias("status"))


@query(f"WITH {TRANSFERS}, p AS (SELECT id, amount, ts + 25 AS due FROM transfers WHERE code = 1), e AS (SELECT id - 1 AS id, code, ts FROM transfers WHERE code = 2) SELECT p.id, CASE WHEN e.id IS NULL THEN 'expired' WHEN e.ts > due THEN 'expired' ELSE 'posted' END AS state FROM p LEFT JOIN e USING (id)")
def x33_two_phase(spark, sf):
    t = transfers(spark, sf)
    p = t.where("code = 1").select("id", (F.col("ts") + 25).alias("due"))
    e = t.where("code = 2").select((F.col("id") - 1).alias("id"), F.col("ts").alias("done"))
    return p.join(e, "id", "left").select("id", F.when(F.col("done").isNull() | (F.col("done") > F.col("due")), "expired").otherwise("posted").alias("state"))


# scalar functions -----------------------------------------------------------

_SEGMENTS = ["logs", "", "..", ".", "__ds", "__dsa", "b c", "x" * 300]


def _values(spark, rows, column="input"):
    return spark.createDataFrame([(r,) for r in rows], f"{column} string")


def _in(rows):
    return "v(input) AS (VALUES " + ", ".join(f"({'NULL' if r is None else chr(39) + r.replace(chr(39), chr(39) * 2) + chr(39)})" for r in rows) + ")"


def _list(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pick(values, n):
    """One of some fixed values by a number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


@query(f"""WITH g AS (SELECT {_list(_SEGMENTS)} AS g), u AS (SELECT DISTINCT g[1 + p_partkey % 8] || '/' || g[1 + p_size % 8] || '/' || lower(p_brand) AS input FROM part, g UNION SELECT regexp_replace(url, '^https?://', '') FROM pages), s AS (SELECT input, string_split(input, '/') AS p FROM u)
SELECT input, CASE WHEN strlen(input) > 512 THEN 'OverMaxBytes' WHEN p[1] = '__ds' THEN 'ReservedRootSegment' ELSE (SELECT CASE WHEN x = '' THEN 'EmptySegment' ELSE 'RelativeSegment' END FROM (SELECT unnest(p) AS x, generate_subscripts(p, 1) AS i) WHERE x IN ('', '.', '..') ORDER BY i LIMIT 1) END AS error FROM s""")
def f1_path(spark, sf):
    made = table(spark, sf, "part").select(F.concat_ws("/", _pick(_SEGMENTS, F.col("p_partkey")), _pick(_SEGMENTS, F.col("p_size")), F.lower("p_brand")).alias("input"))
    urls = table(spark, sf, "pages").select(F.regexp_replace("url", "^https?://", "").alias("input"))
    return made.union(urls).distinct().select("input", P.path_error(F.col("input")).alias("error"))


_HEADS = ["text/plain", "Text/HTML", "application/json", "a b/c", "text", "/x", "image/", "x/y/z", "  audio/ogg "]
_PARAMS = ["", ";charset=utf-8", "; charset=UTF-8", "; Charset = latin1", "; q=1", "; charset", '; charset="utf-8"', "; charset=a; charset=b", ";", "; charset=", "; charset=c; q=1"]
_TYPED = f"v AS (SELECT p_partkey, h[1 + p_partkey % 9] || p[1 + p_partkey % 11] || CASE WHEN p_size = 13 THEN repeat('x', 250) ELSE '' END AS input FROM part, (SELECT {_list(_HEADS)} AS h, {_list(_PARAMS)} AS p))"
_TOKEN = "[!#$%&''*+.^_`|~0-9A-Za-z-]+"


def _typed(spark, sf):
    n = F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", F.concat(_pick(_HEADS, n), _pick(_PARAMS, n), F.when(F.col("p_size") == 13, "x" * 250).otherwise("")).alias("input"))


@query(f"""WITH {_TYPED}, s AS (SELECT *, trim(string_split(input, ';')[1]) AS e, list_transform(string_split(input, ';')[2:], lambda x: trim(x)) AS ps FROM v),
w AS (SELECT *, list_filter(list_transform(range(1, len(ps) + 1), lambda i: CASE WHEN NOT contains(ps[i], '=') THEN 'Malformed' WHEN lower(trim(split_part(ps[i], '=', 1))) <> 'charset' THEN 'UnsupportedParameter' WHEN i > 1 OR NOT regexp_full_match(trim(substr(ps[i], instr(ps[i], '=') + 1)), '{_TOKEN}') THEN 'Malformed' END), lambda e: e IS NOT NULL)[1] AS bad,
  lower(e || CASE WHEN len(ps) > 0 THEN '; charset=' || trim(substr(ps[1], instr(ps[1], '=') + 1)) ELSE '' END) AS spelt FROM s),
r AS (SELECT *, CASE WHEN strlen(input) > 256 THEN 'OverMaxBytes' WHEN NOT regexp_full_match(e, '{_TOKEN}/{_TOKEN}') THEN 'Malformed' WHEN bad IS NOT NULL THEN bad WHEN strlen(spelt) > 256 THEN 'OverMaxBytes' END AS error FROM w)
SELECT p_partkey, input, CASE WHEN error IS NULL THEN spelt END AS canonical, error FROM r""")
def f2_content_type(spark, sf):
    return _typed(spark, sf).select("p_partkey", "input", P.content_type(F.col("input")).alias("r")).select("p_partkey", "input", "r.canonical", "r.error")


@query(f"""WITH {_TYPED}, s AS (SELECT *, instr(input, '; charset=') AS pos FROM v), t AS (SELECT *, CASE WHEN pos > 0 THEN left(input, pos - 1) ELSE input END AS e, CASE WHEN pos > 0 THEN substr(input, pos + 10) END AS c FROM s)
SELECT p_partkey, input, CASE WHEN strlen(input) > 256 THEN 'OverMaxBytes' WHEN contains(e, ';') OR coalesce(contains(c, ';'), false) OR NOT contains(e, '/') THEN 'Malformed'
  WHEN NOT regexp_full_match(e, '{_TOKEN}/{_TOKEN}') OR e <> lower(e) OR NOT coalesce(regexp_full_match(c, '{_TOKEN}') AND c = lower(c), true) THEN 'NonCanonical' END AS error FROM t""")
def f3_content_type_canonical(spark, sf):
    return _typed(spark, sf).select("p_partkey", "input", P.canonical_content_type_error(F.col("input")).alias("error"))


@query("SELECT event_id, event_id % 3 = 1 AS json, event_id % 3 = 2 AS text FROM events")
def f4_modes(spark, sf):
    m = F.col("event_id") % 3
    ct = F.when(m == 0, "application/octet-stream").when(m == 1, "application/json").otherwise("text/plain; charset=utf-8")
    return table(spark, sf, "events").select("event_id", P.is_json(ct).alias("json"), P.is_text(ct).alias("text"))


_TAILS = ["", "", "s", " ", ""]
_LEADS = ["", "", "", "0", "-", "+"]


@query(f"""WITH v AS (SELECT p_partkey, CASE WHEN p_size = 7 THEN '0' WHEN p_size = 8 THEN '' ELSE l[1 + p_size % 6] || repeat(CAST(p_partkey AS VARCHAR), 1 + p_size % 12) || t[1 + p_partkey % 5] END AS input FROM part, (SELECT {_list(_LEADS)} AS l, {_list(_TAILS)} AS t)),
d AS (SELECT *, regexp_extract(input, '^[0-9]*') AS d FROM v), e AS (SELECT *, CASE WHEN input = '' OR (length(input) > 1 AND input[1] = '0') THEN 'Malformed' WHEN d <> '' AND coalesce(TRY_CAST(d AS HUGEINT) > 18446744073709551615, true) THEN 'OverMax' WHEN d <> input THEN 'Malformed' WHEN input = '0' THEN 'Zero' END AS error FROM d)
SELECT p_partkey, input, CASE WHEN error IS NULL THEN input END AS seconds, error FROM e""")
def f5_ttl(spark, sf):
    size, key = F.col("p_size"), F.col("p_partkey")
    made = F.concat(_pick(_LEADS, size), F.expr("repeat(cast(p_partkey as string), cast(1 + p_size % 12 as int))"), _pick(_TAILS, key))
    v = table(spark, sf, "part").select("p_partkey", F.when(size == 7, "0").when(size == 8, "").otherwise(made).alias("input"))
    return v.select("p_partkey", "input", P.ttl(F.col("input")).alias("r")).select("p_partkey", "input", F.col("r.seconds").cast("string").alias("seconds"), "r.error")


_quoted = lambda x: "NULL" if x is None else f"'{x}'"
_TIMES = {"2030-01-01T00:00:00Z": "1893456000000000000", "2030-01-01T01:00:00.5+01:00": "1893456000500000000", "1969-12-31T23:59:59.999999999Z": "-1", "2030-13-01T00:00:00Z": None, "2030-01-01": None, "2030-01-01T00:00:00Z[UTC]": None}


@query("SELECT * FROM (VALUES " + ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in _TIMES.items()) + ") t(input, ns)")
def f6_expires(spark, sf):
    return _values(spark, list(_TIMES)).select("input", P.instant_ns(F.col("input")).cast("string").alias("ns"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 'Conflict' WHEN event_id % 4 = 1 THEN 'SlidingTtl' WHEN event_id % 4 = 2 THEN 'AbsoluteExpiry' ELSE 'None' END AS policy FROM events")
def f7_policy(spark, sf):
    m = F.col("event_id") % 4
    return table(spark, sf, "events").select("event_id", P.policy(F.when(m.isin(1, 3), "5"), F.when(m.isin(2, 3), "2030-01-01T00:00:00Z")).alias("policy"))


@query("SELECT * FROM (VALUES ('true', 'closed'), ('TRUE', 'closed'), ('false', 'open'), ('1', 'open'), (' true', 'open')) t(input, lifecycle)")
def f8_lifecycle(spark, sf):
    return _values(spark, ["true", "TRUE", "false", "1", " true"]).select("input", F.when(F.lower("input") == "true", "closed").otherwise("open").alias("lifecycle"))


@query("SELECT event_id, bool_or(event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY event_id) AS closed FROM events")
def f9_close_monotone(spark, sf):
    order = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, sf, "events").select("event_id", F.max(F.col("event_type") == "purchase").over(order).alias("closed"))


@query("SELECT * FROM (VALUES ('00112233-4455-6677-8899-AABBCCDDEEFF', '00112233-4455-6677-8899-aabbccddeeff'), ('00000000-0000-0000-0000-000000000000', NULL), ('0011', NULL)) t(input, canonical)")
def f10_uuid(spark, sf):
    return _values(spark, ["00112233-4455-6677-8899-AABBCCDDEEFF", "00000000-0000-0000-0000-000000000000", "0011"]).select("input", P.uuid(F.col("input")).alias("canonical"))


@query("SELECT p_partkey, 'wal/v1/' || lpad(CAST(18446744073709551615 - p_partkey AS VARCHAR), 20, '0') AS key, p_partkey AS back FROM part")
def f11_reverse_key(spark, sf):
    key = P.reverse_key("wal", F.col("p_partkey"))
    return table(spark, sf, "part").select("p_partkey", key.alias("key"), P.reverse_number(key).cast("bigint").alias("back"))


@query("SELECT p_partkey, 'table/v1/directory/' || lpad(CAST(p_size AS VARCHAR), 20, '0') || '/' || lpad('1', 20, '0') || '-' || lpad(CAST(p_partkey AS VARCHAR), 20, '0') || '/' || lpad('7', 10, '0') AS key FROM part")
def f12_table_key(spark, sf):
    return table(spark, sf, "part").select("p_partkey", P.table_key(F.lit("directory"), F.col("p_size"), F.lit(1), F.col("p_partkey"), F.lit(7)).alias("key"))


@query("SELECT page_id, regexp_matches(url, '^[A-Za-z0-9._-]+(/[A-Za-z0-9._-]+)*$') AND strlen(url) <= 1024 AS ok FROM pages")
def f13_object_key(spark, sf):
    return table(spark, sf, "pages").select("page_id", P.object_key_ok(F.col("url")).alias("ok"))


@query("SELECT event_id, CASE WHEN event_id >= 1 THEN event_id + 1 END AS next FROM events")
def f14_successor(spark, sf):
    return table(spark, sf, "events").select("event_id", P.successor(F.col("event_id")).alias("next"))


@query("SELECT p_partkey, CAST(list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), list_transform(string_split(p_name, ''), lambda c: CAST(ascii(c) AS HUGEINT))), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616) AS VARCHAR) AS hash FROM part")
def f15_fnv1a(spark, sf):
    return table(spark, sf, "part").select("p_partkey", P.fnv1a_64(F.col("p_name")).cast("string").alias("hash"))


@query("SELECT * FROM (VALUES ('Text/HTML; charset=x', 'text/html'), ('a/b', 'a/b')) t(input, essence)")
def f19_essence(spark, sf):
    return _values(spark, ["Text/HTML; charset=x", "a/b"]).select("input", P.essence(F.col("input")).alias("essence"))


@query("SELECT event_id, event_id BETWEEN 1 AND 4194304 AS ok FROM events")
def f28_options(spark, sf):
    return table(spark, sf, "events").select("event_id", F.col("event_id").between(1, 4194304).alias("ok"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'PathOccupied' WHEN 1 THEN 'CapacityExhausted' WHEN 2 THEN 'Unavailable' ELSE 'Indeterminate' END AS error, CASE event_id % 4 WHEN 0 THEN 409 WHEN 1 THEN 429 WHEN 2 THEN 503 ELSE 500 END AS status FROM events")
def f29_error_mapping(spark, sf):
    mapping = spark.createDataFrame([(0, "PathOccupied", 409), (1, "CapacityExhausted", 429), (2, "Unavailable", 503), (3, "Indeterminate", 500)], "m bigint, error string, status int")
    return table(spark, sf, "events").select("event_id", (F.col("event_id") % 4).alias("m")).join(F.broadcast(mapping), "m").select("event_id", "error", "status")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'no-store' ELSE 'max-age=60' END AS cache_control FROM events")
def f33_cache_control(spark, sf):
    return table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, "no-store").otherwise("max-age=60").alias("cache_control"))
