"""Queries over racing creates, claims, suffixes and subscriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import lifecycle as L
from tidemark.operators import recovery as R
from tidemark.operators import streams
from tidemark.operators import subscriptions as S
from tidemark.operators.keyvalue import limits
from tidemark.operators.ordering import scan
from tidemark.plans.inputs import CHANGES, FACTS, TRANSFERS, changes, commands, facts, transfers
from tidemark.plans.registry import query
from tidemark.session import table


def _attempts(spark, sf):
    """Three creates race for each of a partition's ten coordinates; some replies, some requests are lost."""
    place = F.floor(F.col("event_id") / 3)
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.floor(place / 10).alias("partition"), (1 + place % 10).alias("coordinate"), F.col("event_type").alias("body"), (F.col("value") < 60).alias("arrived"), (F.col("value") < 45).alias("replied"))


_SEEN = """attempts AS (SELECT event_id AS id, event_id // 30 AS partition, 1 + (event_id // 3) % 10 AS coordinate, event_type AS body, value < 60 AS arrived, value < 45 AS replied FROM events),
earlier AS (SELECT a.id, a.partition, a.coordinate, a.body, a.replied, (SELECT arg_min(b.body, b.id) FROM attempts b WHERE b.partition = a.partition AND b.coordinate = a.coordinate AND b.arrived AND b.id < a.id) AS before, a.arrived FROM attempts a),
seen AS (SELECT id, partition, coordinate, body, CASE WHEN NOT arrived OR NOT replied THEN 'Unresolved' WHEN before IS NULL THEN 'Direct' WHEN before = body THEN 'DurableMatch' ELSE 'NotOurs' END AS evidence,
  CASE WHEN before = body OR (before IS NULL AND arrived) THEN 'Match' WHEN before IS NOT NULL THEN 'Foreign' ELSE 'Absent' END AS found FROM earlier),
ended AS (SELECT *, CASE evidence WHEN 'Unresolved' THEN found WHEN 'NotOurs' THEN 'Foreign' ELSE 'Match' END AS sure,
  CASE WHEN evidence = 'Unresolved' THEN 'Unresolved' WHEN evidence = 'Direct' THEN 'Authored' WHEN evidence = 'DurableMatch' AND coordinate = 1 THEN 'Authored' ELSE 'Lost' END AS won FROM seen)"""

_SEAL = "CASE won WHEN 'Authored' THEN CASE coordinate WHEN 1 THEN 'Established' ELSE 'Authored' END WHEN 'Lost' THEN CASE coordinate WHEN 1 THEN 'LostRace' ELSE 'NoAuthority' END ELSE 'Unresolved' END"


@query(f"WITH {_SEEN} SELECT id, CASE sure WHEN 'Match' THEN 'Durable' WHEN 'Foreign' THEN 'Occupied' ELSE 'UnresolvedAbsent' END AS outcome FROM ended")
def x15_wal_outcome(spark, sf):
    return R.evidence(_attempts(spark, sf)).select("id", R.wal_outcome().alias("outcome"))


@query(f"WITH {_SEEN} SELECT id, {_SEAL} AS outcome FROM ended")
def x16_seal_outcome(spark, sf):
    return R.evidence(_attempts(spark, sf)).select("id", R.seal_outcome().alias("outcome"))


@query(f"WITH {_SEEN} SELECT id, CASE sure WHEN 'Match' THEN 'Established' WHEN 'Foreign' THEN 'Contradiction' ELSE 'Abandoned' END AS outcome FROM ended")
def s26_table_establish(spark, sf):
    return R.evidence(_attempts(spark, sf)).select("id", R.table_outcome().alias("outcome"))


@query(f"WITH {_SEEN} SELECT t.id, CASE WHEN t.sure = 'Absent' THEN 'Clear' WHEN t.sure = 'Foreign' THEN 'Exit' WHEN s.won = 'Authored' THEN 'Install' WHEN s.won = 'Lost' THEN 'Fenced' ELSE 'Poisoned' END AS action FROM ended t JOIN ended s ON s.id = t.id + 1")
def x38_checkpoint_outcomes(spark, sf):
    """The table's create, then the seal's: the attempt after it."""
    seen = R.evidence(_attempts(spark, sf))
    seal = seen.select((F.col("id") - 1).alias("id"), R.seal_outcome().alias("seal"))
    return seen.select("id", R.table_outcome().alias("table")).join(seal, "id").select("id", R.checkpoint_action(F.col("table"), F.col("seal")).alias("action"))


_HEADS = f"""{_SEEN}, objects AS (SELECT partition, coordinate, arg_min(body, id) AS held FROM attempts WHERE arrived GROUP BY ALL),
heads AS (SELECT partition, max(coordinate) AS head FROM objects WHERE held <> 'error' GROUP BY partition),
claims AS (SELECT id, e.partition, coordinate AS generation, head FROM ended e LEFT JOIN heads h ON h.partition = e.partition WHERE won = 'Authored')"""


def _claims(spark, sf):
    """Claims that were won, and the heads found again; seals whose body is 'error' are gone by then."""
    a = _attempts(spark, sf)
    won = R.evidence(a).where(R.seal_outcome().isin("Authored", "Established")).select("id", "partition", F.col("coordinate").alias("generation"))
    return won, R.stored(a).where("held != 'error'").groupBy("partition").agg(F.max("coordinate").alias("head"))


@query(f"WITH {_HEADS} SELECT id, CASE WHEN head > generation THEN 'Fenced' WHEN head = generation THEN 'Complete' ELSE 'Contradiction' END AS verdict FROM claims")
def x14_head_refresh(spark, sf):
    return R.refreshed(*_claims(spark, sf), "Complete").select("id", "verdict")


@query(f"WITH {_HEADS}, gaps AS (SELECT partition FROM objects GROUP BY partition HAVING count(*) < max(coordinate)) SELECT id, CASE WHEN head > generation THEN 'Fenced' ELSE 'Contradiction' END AS verdict FROM claims JOIN gaps USING (partition)")
def x41_anomaly(spark, sf):
    """Claims on partitions whose replay meets a gap."""
    won, heads = _claims(spark, sf)
    gaps = R.stored(_attempts(spark, sf)).groupBy("partition").agg((F.count("*") < F.max("coordinate")).alias("gap")).where("gap").select("partition")
    return R.refreshed(won.join(gaps, "partition", "left_semi"), heads, "Contradiction").select("id", "verdict")


@query(f"""WITH {_HEADS}, cuts AS (SELECT partition, partition % 4 AS old_cut, 10 - partition % 7 AS new_cut FROM (SELECT DISTINCT partition FROM attempts)),
due AS (SELECT c.partition, n.i AS coordinate, held, bool_or(held = 'signup') OVER (PARTITION BY c.partition ORDER BY n.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stopped FROM cuts c JOIN (SELECT unnest(range(1, 11)) AS i) n ON n.i > old_cut AND n.i <= new_cut LEFT JOIN objects o ON o.partition = c.partition AND o.coordinate = n.i)
SELECT partition, coordinate, CASE WHEN stopped THEN 'unreached' WHEN held IS NULL THEN 'skip' WHEN held = 'signup' THEN 'stop' WHEN held = 'purchase' THEN 'keep' ELSE 'delete' END AS ruling FROM due""")
def x11_collect(spark, sf):
    """Objects of a purchase are fences, those of a signup cannot be read, others are runs."""
    a = _attempts(spark, sf)
    objects = R.stored(a).select("partition", "coordinate", F.when(F.col("held") == "purchase", "FENCE").when(F.col("held") == "signup", "unreadable").otherwise("RUN").alias("kind"))
    cuts = a.select("partition").distinct().select("partition", (F.col("partition") % 4).alias("old_cut"), (10 - F.col("partition") % 7).alias("new_cut"))
    return R.collected(objects, cuts)


#: The bounds are smaller than the engine's, so that a small log reaches them.
_MOST, _DUE = 6, 4
_SUFFIX = f"{FACTS}, b AS (SELECT batch, count(*) FILTER (kind = 'StreamDeleted') AS gone FROM facts GROUP BY batch), s AS (SELECT batch, coalesce(max(CASE WHEN gone >= 12 THEN batch END) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cut, max(CASE WHEN gone = 5 THEN batch END) OVER (ORDER BY batch) AS attempted FROM b)"


def _suffix(spark, sf):
    """batch, cut (of the seal installed before it) and the head of the last checkpoint attempted; both follow from how many deletes a batch has."""
    b = facts(spark, sf).groupBy("batch").agg(F.count(F.when(F.col("kind") == "StreamDeleted", 1)).alias("gone"))
    spread = commands(spark, sf).select(F.floor(F.col("seq") / L.RUN_FACTS).alias("batch"))  # any cut points do, and these need no fold
    tried = scan(b, "batch", [], maxima={"attempted": F.when(F.col("gone") == 5, F.col("batch"))}, like=spread)
    cut = scan(tried, "batch", [], maxima={"cut": F.when(F.col("gone") >= 12, F.col("batch"))}, like=spread, before=True)
    return cut.withColumn("cut", F.coalesce("cut", F.lit(0)))


@query(f"WITH {_SUFFIX}, r AS (SELECT d.seq, d.outcome, f.batch FROM decided d LEFT JOIN facts f USING (seq)) SELECT seq, CASE WHEN r.batch IS NULL THEN 'Reply' WHEN r.batch + 1 - cut BETWEEN 2 AND {_MOST} THEN 'Accept' ELSE 'Overloaded' END AS ruling FROM r LEFT JOIN s USING (batch)")
def x4_room(spark, sf):
    """Only facts are shed; refused and repeated commands are answered."""
    room = _suffix(spark, sf).select("batch", R.takeover_room(F.col("cut"), F.col("batch"), _MOST).alias("room"))
    ruled = facts(spark, sf).select("seq", "batch").join(room, "batch").select("seq", "room")
    return commands(spark, sf).select("seq").join(ruled, "seq", "left").select("seq", F.when(F.col("room").isNull(), "Reply").when(F.col("room"), "Accept").otherwise("Overloaded").alias("ruling"))


@query(f"WITH {_SUFFIX} SELECT batch, batch - cut AS span, batch - cut >= {_DUE} AND coalesce(attempted, 0) <> batch AS trigger FROM s")
def x8_trigger(spark, sf):
    b = F.col("batch")
    return _suffix(spark, sf).select("batch", (b - F.col("cut")).alias("span"), R.checkpoint_due(F.col("cut"), b, F.col("attempted"), _DUE).alias("trigger"))


_PUTS = """puts AS (SELECT o_orderkey AS seq, o_custkey % 200 AS sub, CASE o_orderstatus WHEN 'P' THEN 'pull-wake' ELSE 'webhook' END AS kind, CASE WHEN o_totalprice < 400000 THEN 'users/*' END AS pattern,
  CASE o_orderpriority WHEN '1-URGENT' THEN ['b', 'a'] WHEN '2-HIGH' THEN ['a', 'b', 'a'] WHEN '5-LOW' THEN [] ELSE ['a'] END AS streams, CASE WHEN o_totalprice > 1500 THEN 'x' END AS target, CASE WHEN o_totalprice > 450000 THEN 700000 WHEN o_totalprice > 200000 THEN 30000 END AS lease_ms FROM orders)"""


@query(f"""WITH {_PUTS}, g AS (SELECT *, coalesce(pattern IS NOT NULL OR len(streams) > 0, false) AND target IS NOT NULL AND coalesce(lease_ms, 30000) BETWEEN 1000 AND 600000 AS good, [kind, pattern, list_aggregate(list_sort(list_distinct(streams)), 'string_agg', ','), target, coalesce(lease_ms, 30000)::VARCHAR] AS config FROM puts),
m AS (SELECT *, first_value(CASE WHEN good THEN seq END IGNORE NULLS) OVER w AS made, first_value(CASE WHEN good THEN config END IGNORE NULLS) OVER w AS kept FROM g WINDOW w AS (PARTITION BY sub ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT seq, sub, CASE WHEN NOT good THEN 400 WHEN seq = made THEN 201 WHEN config = kept THEN 200 ELSE 409 END AS status FROM m""")
def x42_confirm_subscription(spark, sf):
    price, rank = F.col("o_totalprice"), F.col("o_orderpriority")
    streams = F.when(rank == "1-URGENT", F.array(F.lit("b"), F.lit("a"))).when(rank == "2-HIGH", F.array(F.lit("a"), F.lit("b"), F.lit("a"))).when(rank == "5-LOW", F.array().cast("array<string>")).otherwise(F.array(F.lit("a")))
    kind = F.when(F.col("o_orderstatus") == "P", "pull-wake").otherwise("webhook")
    lease = F.when(price > 450000, 700000).when(price > 200000, 30000)
    return S.confirmed(table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), (F.col("o_custkey") % 200).alias("sub"), kind.alias("kind"), F.when(price < 400000, "users/*").alias("pattern"), streams.alias("streams"), F.when(price > 1500, "x").alias("target"), lease.alias("lease_ms"), F.lit(None).cast("string").alias("description")))


_TTL = 3 * 3_600_000_000


@query(f"""WITH log AS (SELECT event_id AS seq, user_id AS sub, epoch_us(ts) AS t, CASE event_type WHEN 'error' THEN 'append' WHEN 'purchase' THEN 'done' ELSE 'ack' END AS act FROM events),
h AS (SELECT *, lag(t) OVER w AS held, lag(seq) OVER w AS held_seq, lag(act) OVER w AS was FROM log WHERE act <> 'append' WINDOW w AS (PARTITION BY sub ORDER BY seq)),
j AS (SELECT *, was = 'ack' AND t >= held + {_TTL} AS expired FROM h)
SELECT seq, sub, CASE WHEN expired THEN 'expired' WHEN was = 'ack' THEN 'holds' ELSE 'claims' END AS verdict,
  CASE WHEN expired AND EXISTS (SELECT 1 FROM log a WHERE a.sub = j.sub AND a.act = 'append' AND a.seq > held_seq AND a.seq < j.seq AND a.t < held + {_TTL}) THEN held + {_TTL} END AS wake_at FROM j""")
def x44_lease_expiry(spark, sf):
    act = F.when(F.col("event_type") == "error", "append").when(F.col("event_type") == "purchase", "done").otherwise("ack")
    return S.leases(table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("sub"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), act.alias("act")), _TTL)


_URLS = """urls AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'http' ELSE 'https' END AS scheme, CASE page_id % 13 WHEN 0 THEN 'localhost' WHEN 1 THEN '[fd00::1]' WHEN 2 THEN split_part(url, '/', 3)
  ELSE (CASE page_id % 13 WHEN 3 THEN 10 WHEN 4 THEN 127 WHEN 5 THEN 172 WHEN 6 THEN 192 WHEN 7 THEN 169 WHEN 8 THEN 0 ELSE page_id % 256 END) || '.' || (CASE WHEN page_id % 2 = 0 THEN 168 ELSE page_id % 64 END) || '.0.' || page_id % 9 END AS host FROM pages)"""


@query(f"""WITH {_URLS}, v AS (SELECT *, regexp_full_match(host, '[0-9.]+') AS ip, TRY_CAST(split_part(host, '.', 1) AS BIGINT) * 256 + TRY_CAST(split_part(host, '.', 2) AS BIGINT) AS top FROM urls)
SELECT page_id, CASE WHEN scheme = 'http' THEN host = 'localhost' OR (ip AND top // 256 = 127) WHEN host = 'localhost' OR host[1] = '[' THEN false
  WHEN ip THEN NOT (top < 256 OR top BETWEEN 2560 AND 2815 OR top BETWEEN 32512 AND 32767 OR top BETWEEN 44048 AND 44063 OR top = 49320 OR top = 43518) ELSE true END AS safe FROM v""")
def f30_webhook_url(spark, sf):
    i = F.col("page_id")
    m = i % 13
    first = F.when(m == 3, 10).when(m == 4, 127).when(m == 5, 172).when(m == 6, 192).when(m == 7, 169).when(m == 8, 0).otherwise(i % 256)
    numeric = F.concat_ws(".", first.cast("string"), F.when(i % 2 == 0, 168).otherwise(i % 64).cast("string"), F.lit("0"), (i % 9).cast("string"))
    host = F.when(m == 0, "localhost").when(m == 1, "[fd00::1]").when(m == 2, F.split_part("url", F.lit("/"), F.lit(3))).otherwise(numeric)
    url = F.concat(F.when(i % 3 == 0, "http").otherwise("https"), F.lit("://"), host, F.lit(":8443/hook?x=1"))
    return table(spark, sf, "pages").select("page_id", S.webhook_safe(url).alias("safe"))


_FULL, _BUDGET, _SPACING = 11_000, 9_930, 9 * 3_600_000_000
_PENDING = f"""{FACTS}, b AS (SELECT batch, count(*) AS n, CAST(128 + sum(128 + strlen(path) + CASE WHEN kind = 'StreamCreated' THEN strlen(content_type) ELSE 0 END) AS BIGINT) AS bytes, epoch_us(max(ts)) AS last_at FROM facts JOIN events ON event_id = seq - 1 GROUP BY batch),
pending AS (SELECT *, last_at - lag(last_at) OVER (ORDER BY batch) AS waited, batch = max(batch) OVER () AS closing, n >= 4096 OR bytes + 896 > {_FULL} AS hard FROM b)"""


def _pending(spark, sf):
    """Each batch as it was when its last fact came; the log ends in a shutdown."""
    at = table(spark, sf, "events").select((F.col("event_id") + 1).alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    size = 128 + F.octet_length("path") + F.when(F.col("kind") == "StreamCreated", F.octet_length("content_type")).otherwise(0)
    b = facts(spark, sf).join(at, "seq").groupBy("batch").agg(F.count("*").alias("n"), (128 + F.sum(size)).cast("bigint").alias("bytes"), F.max("at").alias("last_at"))
    spread = commands(spark, sf).select(F.floor(F.col("seq") / L.RUN_FACTS).alias("batch"))
    timed = scan(b, "batch", [], maxima={"taken": F.col("last_at")}, like=spread, before=True)
    end = b.agg(F.max("batch").alias("end"))
    return timed.crossJoin(F.broadcast(end)).withColumns({"waited": F.col("last_at") - F.col("taken"), "closing": F.col("batch") == F.col("end"), "full": R.hard_full(F.col("n"), F.col("bytes"), most_bytes=_FULL)})


@query(f"WITH {_PENDING} SELECT batch, CASE WHEN closing THEN 'closing' WHEN hard THEN 'full' WHEN bytes >= {_BUDGET} THEN 'budget' WHEN waited < {_SPACING} THEN 'arm' ELSE 'spacing' END AS action FROM pending")
def x5_flush_trigger(spark, sf):
    action = R.flush_reason(F.col("n"), F.col("closing"), F.col("full"), F.col("bytes"), _BUDGET, F.col("waited"), _SPACING)
    return _pending(spark, sf).select("batch", action.alias("action"))


@query(f"WITH {_PENDING} SELECT batch, NOT closing AND NOT hard AS status FROM pending")
def p19_admission_open(spark, sf):
    return _pending(spark, sf).select("batch", (~F.col("closing") & ~F.col("full")).alias("status"))


@query("""WITH RECURSIVE streams AS (SELECT c_custkey AS stream, CASE WHEN c_custkey > 0 THEN c_custkey // 3 END AS parent, c_nationkey < 18 AS deleted FROM customer),
up AS (SELECT parent AS stream FROM streams WHERE NOT deleted UNION SELECT s.parent FROM up JOIN streams s USING (stream))
SELECT stream, CASE WHEN NOT deleted THEN 'live' WHEN stream IN (SELECT stream FROM up WHERE stream IS NOT NULL) THEN 'soft' ELSE 'gone' END AS state, CASE WHEN NOT deleted THEN 200 WHEN stream IN (SELECT stream FROM up WHERE stream IS NOT NULL) THEN 410 ELSE 404 END AS status FROM streams""")
def x22_soft_delete(spark, sf):
    """Each stream but the first was forked from the one a third as far along."""
    k = F.col("c_custkey")
    return streams.retained(table(spark, sf, "customer").select(k.alias("stream"), F.when(k > 0, F.floor(k / 3)).alias("parent"), (F.col("c_nationkey") < 18).alias("deleted")))


@query(f"WITH {CHANGES}, f AS (SELECT value AS txid, min(off) AS seen FROM changes GROUP BY value) SELECT c_custkey AS txid, seen, (SELECT max(off) FROM changes WHERE off // 100 = seen // 100) AS resolved FROM customer LEFT JOIN f ON txid = c_custkey")
def x28_txid_barrier(spark, sf):
    waits = table(spark, sf, "customer").select(F.col("c_custkey").alias("txid"))
    return streams.txid_barrier(waits, changes(spark, sf).withColumnRenamed("value", "txid"), 100)


@query(f"""WITH {TRANSFERS}, once AS (SELECT DISTINCT ON (id) * FROM transfers ORDER BY id, debit, credit, amount, code), apart AS (SELECT * FROM once WHERE debit <> credit),
sides AS (SELECT id, ts, debit AS account, amount AS d, 0 AS c, code = 1 AS pending FROM apart UNION ALL SELECT id, ts, credit, 0, amount, code = 1 FROM apart),
posn AS (SELECT *, coalesce(sum(d) OVER w, 0) AS debits, coalesce(sum(c) OVER w, 0) AS credits, coalesce(sum(CASE WHEN pending THEN 0 ELSE d END) OVER w, 0) AS dp, coalesce(sum(CASE WHEN pending THEN 0 ELSE c END) OVER w, 0) AS cp FROM sides WINDOW w AS (PARTITION BY account ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT id, CASE WHEN d > 0 AND account % 2 = 0 AND debits + d > cp THEN 2 WHEN c > 0 AND account % 3 = 0 AND credits + c > dp THEN 1 ELSE 0 END AS over_ FROM posn)
SELECT id, CASE max(over_) WHEN 2 THEN 'exceeds_credits' WHEN 1 THEN 'exceeds_debits' ELSE 'ok' END AS verdict FROM v GROUP BY id UNION ALL SELECT id, 'accounts_must_be_different' FROM once WHERE debit = credit""")
def f26_limit_check(spark, sf):
    """Accounts of even numbers limit their debits, every third one its credits; a third of the transfers is pending.  An id exists once: the smallest of its rows."""
    once = transfers(spark, sf).groupBy("id").agg(F.min(F.struct("debit", "credit", "amount", "code")).alias("t")).select("id", F.col("id").alias("ts"), "t.*")
    t = once.withColumn("pending", F.col("code") == 1)
    return limits(t, lambda a: a % 2 == 0, lambda a: a % 3 == 0)
