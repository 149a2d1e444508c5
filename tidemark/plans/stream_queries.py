"""Queries over messages, forks, producers, subscriptions and change events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import parsing as P
from tidemark.operators import streams as S
from tidemark.plans.inputs import CHANGES, COMMANDS, MESSAGES, changes, commands, messages
from tidemark.plans.registry import query
from tidemark.session import table

AT = "0000000000000000_0000000000001000"


@query(f"WITH {MESSAGES} SELECT stream, n, off FROM messages")
def a16_offsets(spark, sf):
    return messages(spark, sf).select("stream", "n", "off")


@query(f"WITH {MESSAGES} SELECT stream, max(off) AS tail FROM messages GROUP BY stream")
def a15_tail(spark, sf):
    return messages(spark, sf).groupBy("stream").agg(F.max("off").alias("tail"))


@query(f"WITH {MESSAGES} SELECT stream, off, data FROM messages WHERE off > '{AT}'")
def s17_catchup_rows(spark, sf):
    return messages(spark, sf).where(F.col("off") > AT).select("stream", "off", "data")


@query(f"WITH {MESSAGES}, t AS (SELECT stream, max(off) AS tail FROM messages GROUP BY stream), g AS (SELECT stream, count(*) AS n, max(off) AS last FROM messages WHERE off > '{AT}' GROUP BY stream) SELECT stream, coalesce(n, 0) AS n, coalesce(last, greatest('{AT}', tail)) AS next_offset, coalesce(last, tail) = tail AS up_to_date FROM t LEFT JOIN g USING (stream)")
def s17_catchup(spark, sf):
    return S.catch_up(messages(spark, sf), AT)


@query(f"WITH {MESSAGES} SELECT stream, count(*) AS n FROM messages WHERE off > '9999999999999999_0' GROUP BY stream")
def s19_long_poll_at_tail(spark, sf):
    return messages(spark, sf).where("off > '9999999999999999_0'").groupBy("stream").agg(F.count("*").alias("n"))


@query(f"WITH {MESSAGES}, r AS (SELECT *, sum(strlen(data)) OVER (PARTITION BY stream ORDER BY off) AS total FROM messages) SELECT stream, off FROM r WHERE (total <= 600 OR n = 1) AND n <= 20")
def s18_budget(spark, sf):
    return S.budget_read(messages(spark, sf), 600, 20).select("stream", "off")


@query(f"WITH {MESSAGES} SELECT stream, n, CASE WHEN off < '{AT}' THEN 410 ELSE 200 END AS status FROM messages")
def s28_retention(spark, sf):
    return messages(spark, sf).select("stream", "n", F.when(F.col("off") < AT, 410).otherwise(200).alias("status"))


@query("SELECT conv_id, count(*) AS n, string_agg(role, ',' ORDER BY turn) AS first_content FROM conversations GROUP BY conv_id")
def s27_initial_content(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    return c.select("conv_id", "n", F.array_join("r.role", ",").alias("first_content"))


@query(f"WITH {MESSAGES} SELECT stream, n, 'event: data\ndata: ' || to_base64(encode(data)) AS frame FROM messages")
def s20_sse_frames(spark, sf):
    return messages(spark, sf).select("stream", "n", F.concat(F.lit("event: data\ndata: "), F.base64(F.col("data").cast("binary"))).alias("frame"))


_BODIES = """bodies AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"a":' || event_id || '}' WHEN 1 THEN '[{"a":1},{"b":' || user_id || '}]' WHEN 2 THEN '[[1,2],[' || user_id || ']]' ELSE '[]' END AS body FROM events)"""


def _bodies(spark, sf):
    e, n = table(spark, sf, "events"), F.col("event_id")
    body = F.when(n % 4 == 0, F.concat(F.lit('{"a":'), n, F.lit("}"))).when(n % 4 == 1, F.concat(F.lit('[{"a":1},{"b":'), F.col("user_id"), F.lit("}]"))).when(n % 4 == 2, F.concat(F.lit("[[1,2],["), F.col("user_id"), F.lit("]]"))).otherwise("[]")
    return e.select("event_id", body.alias("body"))


@query(f"WITH {_BODIES} SELECT event_id, CAST(i - 1 AS BIGINT) AS place, CAST(CASE WHEN json_type(body) = 'ARRAY' THEN json_extract(body, '$[' || (i - 1) || ']') ELSE body END AS VARCHAR) AS message FROM bodies, generate_series(1, 2) AS g(i) WHERE i <= CASE WHEN json_type(body) = 'ARRAY' THEN json_array_length(body) ELSE 1 END")
def f16_flatten(spark, sf):
    many = F.from_json("body", "array<string>")
    rows = _bodies(spark, sf).select("event_id", F.posexplode(F.when(F.startswith("body", F.lit("[")), many).otherwise(F.array("body"))).alias("place", "message"))
    return rows.withColumn("place", F.col("place").cast("bigint"))


@query(f"WITH {_BODIES} SELECT event_id, CASE WHEN body = '[]' THEN 400 ELSE 204 END AS on_append, CASE WHEN body = '[]' THEN 201 ELSE 201 END AS on_create FROM bodies")
def f16_empty_array(spark, sf):
    return _bodies(spark, sf).select("event_id", F.when(F.col("body") == "[]", 400).otherwise(204).alias("on_append"), F.lit(201).alias("on_create"))


@query(f"WITH {MESSAGES} SELECT stream, '[' || string_agg(data, ',' ORDER BY off) || ']' AS body FROM messages GROUP BY stream")
def f17_wrap(spark, sf):
    rows = messages(spark, sf).groupBy("stream").agg(F.array_sort(F.collect_list(F.struct("off", "data"))).alias("m"))
    return rows.select("stream", F.concat(F.lit("["), F.array_join("m.data", ","), F.lit("]")).alias("body"))


_STATES = """states AS (SELECT event_id, '0000000000000000_' || lpad(CAST(event_id AS VARCHAR), 16, '0') AS off, CASE event_type WHEN 'click' THEN '{"key":"u' || user_id || '","headers":{"operation":"upsert","txid":"' || event_id || '"},"value":{"n":1}}'
  WHEN 'view' THEN '{"headers":{"control":"reset"}}' WHEN 'signup' THEN '{"id":' || user_id || '}' WHEN 'purchase' THEN '{"headers":{"operation":' || user_id || '}}' ELSE '[' || user_id || ',{"headers":{"operation":"x"}}]' END AS raw FROM events)"""


def _states(spark, sf):
    """Messages with and without state headers, by the kind of event."""
    user, t = F.col("user_id"), F.col("event_type")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    raw = F.when(t == "click", text('{"key":"u', user, '","headers":{"operation":"upsert","txid":"', F.col("event_id"), '"},"value":{"n":1}}')).when(t == "view", F.lit('{"headers":{"control":"reset"}}'))
    raw = raw.when(t == "signup", text('{"id":', user, "}")).when(t == "purchase", text('{"headers":{"operation":', user, "}}")).otherwise(text("[", user, ',{"headers":{"operation":"x"}}]'))
    return table(spark, sf, "events").select("event_id", P.offset_text(F.lit(0), F.col("event_id")).alias("off"), raw.alias("raw"))


@query(f"""WITH {_STATES}, h AS (SELECT *, CAST(json_extract(raw, '$.headers') AS VARCHAR) AS h, json_type(raw, '$.headers.operation') = 'VARCHAR' AS o, json_type(raw, '$.headers.control') = 'VARCHAR' AS c FROM states)
SELECT event_id, CASE WHEN coalesce(o, false) OR coalesce(c, false) THEN replace(raw, '"headers":' || h, '"headers":' || left(h, length(h) - 1) || ',"offset":"' || off || '"}}') ELSE raw END AS body FROM h""")
def f18_enrich(spark, sf):
    return _states(spark, sf).select("event_id", P.enriched(F.col("raw"), F.col("off")).alias("body"))


@query("SELECT event_id, CAST(floor((epoch(ts) - 1728432000) / 20) AS BIGINT) AS cursor FROM events")
def f21_cursor(spark, sf):
    return table(spark, sf, "events").select("event_id", P.cursor(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("cursor"))


@query(f"WITH {MESSAGES} SELECT stream, n, to_base64(encode(stream)) || ':-1:' || off || CASE WHEN n % 3 = 0 THEN ':c' ELSE '' END AS etag FROM messages")
def f22_etag(spark, sf):
    return messages(spark, sf).select("stream", "n", P.etag(F.col("stream"), F.lit("-1"), F.col("off"), F.col("n") % 3 == 0).alias("etag"))


@query("SELECT c_custkey, sha256('{\"pattern\":\"events/*\",\"streams\":[\"' || list_aggregate(list_sort(list_distinct(['a' || c_nationkey, 'b', 'a' || c_nationkey])), 'string_agg', '\",\"') || '\"]}') AS hash FROM customer")
def f23_config_hash(spark, sf):
    a = F.concat(F.lit("a"), F.col("c_nationkey"))
    streams = F.array_sort(F.array_distinct(F.array(a, F.lit("b"), a)))
    return table(spark, sf, "customer").select("c_custkey", F.sha2(F.concat(F.lit('{"pattern":"events/*","streams":["'), F.array_join(streams, '","'), F.lit('"]}')), 256).alias("hash"))


@query("SELECT r.r_regionkey AS src, n.n_nationkey AS fork, CASE WHEN n_nationkey % 3 = 1 THEN 'SlidingTtl' WHEN n_nationkey % 3 = 2 THEN 'AbsoluteExpiry' WHEN r_regionkey % 3 = 1 THEN 'SlidingTtl' WHEN r_regionkey % 3 = 2 THEN 'AbsoluteExpiry' ELSE 'None' END AS expiry FROM region r, nation n")
def f24_fork_expiry(spark, sf):
    kind = lambda c: F.when(F.col(c) % 3 == 1, "SlidingTtl").when(F.col(c) % 3 == 2, "AbsoluteExpiry")
    pairs = table(spark, sf, "region").crossJoin(table(spark, sf, "nation"))  # 5 x 25 rows of a fixed table
    return pairs.select(F.col("r_regionkey").alias("src"), F.col("n_nationkey").alias("fork"), F.coalesce(kind("n_nationkey"), kind("r_regionkey"), F.lit("None")).alias("expiry"))


@query(f"WITH {MESSAGES} SELECT stream, n, substr(data, 1, CAST(n % 9 AS INT)) AS prefix FROM messages")
def f25_sub_offset_slice(spark, sf):
    return messages(spark, sf).select("stream", "n", F.expr("substring(data, 1, cast(n % 9 as int))").alias("prefix"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 6 = 0 THEN 404 WHEN n_nationkey % 6 = 1 THEN 410 WHEN n_nationkey % 6 = 2 THEN 400 WHEN n_nationkey % 6 = 3 THEN 409 ELSE 201 END AS status FROM nation")
def f32_fork_errors(spark, sf):
    m = F.col("n_nationkey") % 6
    return table(spark, sf, "nation").select("n_nationkey", F.when(m == 0, 404).when(m == 1, 410).when(m == 2, 400).when(m == 3, 409).otherwise(201).alias("status"))


def _forks(spark):
    names = ["signup", "click", "view", "purchase", "error"]
    rows = [(f"events/{a}", f"events/{b}", f"0000000000000000_{n:016d}") for a, b, n in zip(names, names[1:], (700, 400, 900, 500), strict=False)]
    return spark.createDataFrame(rows, "child string, parent string, at string")


_FORKS = "forks(child, parent, upto) AS (VALUES ('events/signup','events/click','0000000000000000_0000000000000700'), ('events/click','events/view','0000000000000000_0000000000000400'), ('events/view','events/purchase','0000000000000000_0000000000000900'), ('events/purchase','events/error','0000000000000000_0000000000000500'))"
_LINEAGE = f"{_FORKS}, line AS (SELECT child AS stream, parent AS ancestor, upto AS cap FROM forks UNION ALL SELECT l.stream, f.parent, least(l.cap, f.upto) FROM line l JOIN forks f ON l.ancestor = f.child)"


@query(f"WITH RECURSIVE {_LINEAGE} SELECT * FROM line")
def j7_lineage(spark, sf):
    return S.lineage(_forks(spark))


@query(f"WITH RECURSIVE {MESSAGES}, {_LINEAGE} SELECT stream, off, data FROM messages UNION ALL SELECT l.stream, m.off, m.data FROM line l JOIN messages m ON m.stream = l.ancestor AND m.off <= l.cap")
def j7_fork_stitch(spark, sf):
    return S.stitched(messages(spark, sf), _forks(spark))


@query(f"WITH RECURSIVE {MESSAGES}, {_LINEAGE} SELECT stream, count(*) AS n FROM (SELECT stream FROM messages UNION ALL SELECT l.stream FROM line l JOIN messages m ON m.stream = l.ancestor AND m.off <= l.cap) GROUP BY stream")
def u6_bag_union(spark, sf):
    return S.stitched(messages(spark, sf), _forks(spark)).groupBy("stream").agg(F.count("*").alias("n"))


def _producer_log(spark, sf):
    l = table(spark, sf, "lineitem")
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber")
    n = F.row_number().over(order)
    year = F.floor((n - 1) / 25)
    place = (n - 1) % 25
    seq = F.when(place % 7 == 6, place - 2).when(place % 11 == 10, place + 3).otherwise(place - F.floor(place / 7) - F.floor(place / 11))
    return l.select(F.lit("s").alias("stream"), F.col("l_suppkey").alias("producer"), n.cast("bigint").alias("arrival"), (year - F.when(n % 13 == 0, 1).otherwise(0)).cast("bigint").alias("epoch"), F.greatest(seq, F.lit(0)).cast("bigint").alias("seq"))


_LOG = """n AS (SELECT l_suppkey AS producer, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem),
log AS (SELECT producer, n AS arrival, (n - 1) // 25 - CASE WHEN n % 13 = 0 THEN 1 ELSE 0 END AS epoch, greatest(CASE WHEN ((n-1)%25) % 7 = 6 THEN (n-1)%25 - 2 WHEN ((n-1)%25) % 11 = 10 THEN (n-1)%25 + 3 ELSE (n-1)%25 - ((n-1)%25)//7 - ((n-1)%25)//11 END, 0) AS seq FROM n)"""


@query(f"""WITH RECURSIVE {_LOG}, run AS (
 SELECT producer, arrival, epoch, seq, CASE WHEN seq = 0 THEN epoch END AS ce, CASE WHEN seq = 0 THEN 0 ELSE -1 END AS cl, CASE WHEN seq = 0 THEN 'accepted' ELSE 'sequence_gap' END AS status, CAST(0 AS BIGINT) AS expected FROM log WHERE arrival = 1
 UNION ALL
 SELECT producer, arrival, epoch, seq, CASE WHEN status = 'accepted' THEN epoch ELSE ce END, CASE WHEN status = 'accepted' THEN seq ELSE cl END, status, expected FROM (
  SELECT l.producer, l.arrival, l.epoch, l.seq, r.ce, r.cl, CASE WHEN r.ce IS NULL THEN CASE WHEN l.seq = 0 THEN 'accepted' ELSE 'sequence_gap' END WHEN l.epoch < r.ce THEN 'stale_epoch' WHEN l.epoch > r.ce THEN CASE WHEN l.seq = 0 THEN 'accepted' ELSE 'invalid_epoch_seq' END
   WHEN l.seq <= r.cl THEN 'duplicate' WHEN l.seq = r.cl + 1 THEN 'accepted' ELSE 'sequence_gap' END AS status, CASE WHEN r.ce = l.epoch THEN CAST(r.cl + 1 AS BIGINT) ELSE 0 END AS expected
  FROM run r JOIN log l ON l.producer = r.producer AND l.arrival = r.arrival + 1))
SELECT producer, arrival, epoch, seq, status, expected FROM run""")
def a17_producer(spark, sf):
    return S.judge_producers(_producer_log(spark, sf)).drop("stream")


_TOKENS = "log AS (SELECT 'events/' || event_type AS stream, event_id AS arrival, lpad(CAST((event_id * 7919) % 10007 AS VARCHAR), 6, '0') AS token FROM events)"


@query(f"WITH {_TOKENS} SELECT stream, arrival, token, token > coalesce(max(token) OVER (PARTITION BY stream ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS accepted FROM log")
def a18_stream_seq(spark, sf):
    e = table(spark, sf, "events")
    return S.increasing(e.select(F.concat(F.lit("events/"), F.col("event_type")).alias("stream"), F.col("event_id").alias("arrival"), F.lpad(((F.col("event_id") * 7919) % 10007).cast("string"), 6, "0").alias("token")))


@query(f"WITH {_TOKENS} SELECT stream, count(*) AS n FROM log WHERE token > '-1' AND token >= '005000' GROUP BY stream")
def p10_offset_compare(spark, sf):
    e = table(spark, sf, "events").select(F.concat(F.lit("events/"), F.col("event_type")).alias("stream"), F.lpad(((F.col("event_id") * 7919) % 10007).cast("string"), 6, "0").alias("token"))
    return e.where("token > '-1' and token >= '005000'").groupBy("stream").agg(F.count("*").alias("n"))


PATTERNS = ["users/*/k1", "users/**", "users/1*/k2", "*/3/k3", "**", "users/%2A/k1", "users/5/*"]
_PATTERNS = "p(sub, pattern) AS (VALUES " + ", ".join(f"({i}, '{p}')" for i, p in enumerate(PATTERNS)) + ")"
_PATHS = "paths AS (SELECT DISTINCT path FROM commands)"
_REGEX = r"""'^' || list_aggregate(list_transform(string_split(pattern, '/'), lambda s: CASE s WHEN '**' THEN '(/[^/]+)*' WHEN '*' THEN '/[^/]+' ELSE '/' || regexp_replace(replace(s, '%2A', '*'), '([*.])', '\\\1', 'g') END), 'string_agg', '') || '$'"""


def _patterns(spark):
    return spark.createDataFrame(list(enumerate(PATTERNS)), "sub int, pattern string")


_MATCHED = f"{COMMANDS}, {_PATTERNS}, {_PATHS}, matched AS (SELECT sub, pattern, path FROM p, paths WHERE regexp_matches('/' || path, {_REGEX}))"


@query(f"WITH {_MATCHED} SELECT sub, pattern, path FROM matched")
def j8_pattern_join(spark, sf):
    return S.match_patterns(_patterns(spark), commands(spark, sf).select("path").distinct())


@query(f"WITH {COMMANDS}, {_PATHS} SELECT path, regexp_matches('/' || path, '^/users/[^/]+/k1$') AS hit FROM paths")
def p7_glob(spark, sf):
    return commands(spark, sf).select("path").distinct().select("path", F.concat(F.lit("/"), F.col("path")).rlike(r"^/users/[^/]+/k1$").alias("hit"))


@query(f"WITH {COMMANDS}, {_PATHS} SELECT path FROM paths WHERE path >= 'users/1' AND path < 'users/2'")
def p6_prefix(spark, sf):
    return commands(spark, sf).select("path").distinct().where(F.col("path").startswith("users/1"))


_LINKS = f"{_MATCHED}, explicit AS (SELECT CAST(length(path) % 7 AS INT) AS sub, path FROM paths), links AS (SELECT sub, path, min(t) AS link_type FROM (SELECT sub, path, 'glob' AS t FROM matched UNION ALL SELECT sub, path, 'explicit' FROM explicit) GROUP BY sub, path)"


def _links(spark, sf):
    paths = commands(spark, sf).select("path").distinct()
    return S.links(S.match_patterns(_patterns(spark), paths), paths.select((F.length("path") % 7).alias("sub"), "path"))


@query(f"WITH {_LINKS} SELECT sub, path, link_type FROM links")
def j9_link_precedence(spark, sf):
    return _links(spark, sf)


_TAILS = "tails AS (SELECT path, max(seq) AS tail FROM commands GROUP BY path), cur AS (SELECT l.*, tail, CASE WHEN link_type = 'glob' THEN 100 ELSE 300 END AS acked, tail > CASE WHEN link_type = 'glob' THEN 100 ELSE 300 END AS has_pending FROM links l JOIN tails USING (path))"


def _cursors(spark, sf):
    tails = commands(spark, sf).groupBy("path").agg(F.max("seq").alias("tail"))
    acked = F.when(F.col("link_type") == "glob", 100).otherwise(300)
    return _links(spark, sf).join(tails, "path", "left").select("sub", "path", "link_type", "tail", acked.alias("acked"), (F.col("tail") > acked).alias("has_pending"))


@query(f"WITH {_LINKS}, {_TAILS} SELECT sub, path, link_type, tail, acked, has_pending FROM cur")
def j10_pending(spark, sf):
    return _cursors(spark, sf)


@query(f"WITH {_LINKS}, {_TAILS} SELECT sub, min(path) AS first_path FROM cur WHERE has_pending GROUP BY sub")
def o10_first_pending(spark, sf):
    return _cursors(spark, sf).where("has_pending").groupBy("sub").agg(F.min("path").alias("first_path"))


@query(f"WITH {_LINKS}, {_TAILS}, want AS (SELECT *, CAST(CASE WHEN length(path) % 3 = 0 THEN acked - 1 WHEN length(path) % 3 = 1 THEN tail ELSE acked + 1 END AS BIGINT) AS off FROM cur), v AS (SELECT *, off >= acked AND off <= tail AS good FROM want) SELECT sub, CASE WHEN bool_and(good) THEN 'applied' ELSE 'rejected' END AS verdict, count(*) AS n FROM v GROUP BY sub")
def x24_ack_range(spark, sf):
    c = _cursors(spark, sf)
    m = F.length("path") % 3
    off = F.when(m == 0, F.col("acked") - 1).when(m == 1, F.col("tail")).otherwise(F.col("acked") + 1)
    good = (off >= F.col("acked")) & (off <= F.col("tail"))
    return c.groupBy("sub").agg(F.when(F.min(good), "applied").otherwise("rejected").alias("verdict"), F.count("*").alias("n"))


@query(f"WITH {_LINKS}, removed AS (SELECT sub, path FROM explicit WHERE path LIKE '%/k1' OR path LIKE '%/k3') SELECT sub, path, CASE WHEN bool_or(t = 'explicit') THEN 'explicit' ELSE 'glob' END AS link_type FROM (SELECT sub, path, 'glob' AS t FROM matched UNION ALL SELECT sub, path, 'explicit' FROM (SELECT sub, path FROM explicit EXCEPT SELECT sub, path FROM removed)) GROUP BY sub, path")
def x43_remove_explicit(spark, sf):
    """Explicit links removed: a glob link of the same stream stays, and removing what is absent changes nothing."""
    paths = commands(spark, sf).select("path").distinct()
    explicit = paths.select((F.length("path") % 7).alias("sub"), "path")
    removed = paths.where(F.col("path").endswith("/k1") | F.col("path").endswith("/k3")).select((F.length("path") % 7).alias("sub"), "path")
    return S.links(S.match_patterns(_patterns(spark), paths), explicit.join(removed, ["sub", "path"], "left_anti"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN coalesce(epoch(ts) >= 1705276800, true) WHEN event_id % 3 = 1 THEN 1705276800 >= epoch(ts) + user_id * 3600 ELSE false END AS expired FROM events")
def p9_expired(spark, sf):
    e, now, at = table(spark, sf, "events"), F.lit(1705276800), F.unix_seconds(F.col("ts").cast("timestamp"))
    kind = F.when(F.col("event_id") % 3 == 0, "AbsoluteExpiry").when(F.col("event_id") % 3 == 1, "SlidingTtl").otherwise("None")
    return e.select("event_id", S.expired(F.when(kind == "AbsoluteExpiry", at).otherwise(now), kind, now, at, F.col("user_id") * 3600).alias("expired"))


@query(f"WITH {COMMANDS}, m AS (SELECT path, arg_min(content_type, seq) AS made_type FROM commands WHERE cmd = 'create' GROUP BY path), r AS (SELECT path AS stream, seq AS arrival, CASE WHEN cmd = 'delete' THEN 'append' ELSE cmd END AS kind, content_type, made_type, coalesce(bool_or(cmd = 'create') OVER w, false) AS made, coalesce(bool_or(cmd = 'close') OVER w, false) AS shut FROM commands LEFT JOIN m USING (path) WINDOW w AS (PARTITION BY path ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT stream, arrival, CASE WHEN NOT made THEN 404 WHEN shut THEN 409 WHEN content_type <> made_type THEN 415 ELSE 204 END AS status FROM r WHERE kind = 'append'")
def x18_append(spark, sf):
    c = commands(spark, sf)
    made = c.where("cmd = 'create'").groupBy("path").agg(F.min_by("content_type", "seq").alias("made_type"))
    r = c.join(made, "path", "left").select(F.col("path").alias("stream"), F.col("seq").alias("arrival"), F.when(F.col("cmd") == "delete", "append").otherwise(F.col("cmd")).alias("kind"), "content_type", "made_type")
    return S.judge_appends(r)


@query("SELECT user_id, event_id, CAST(sum(CASE WHEN before IS NULL OR epoch(ts) - epoch(before) > 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS life FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)")
def x20_sliding_ttl(spark, sf):
    """A gap counts to the microsecond; only a user's first row, one after a row without a time, or one after a gap starts a life, and equal event_ids share the sum."""
    order = Window.partitionBy("user_id").orderBy(F.asc_nulls_last("event_id"))
    s = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6  # epoch's double
    before = F.lag(s).over(order)
    e = table(spark, sf, "events").select("user_id", "event_id", F.when(before.isNull() | (s - before > 86400), 1).otherwise(0).alias("starts"))
    return e.select("user_id", "event_id", F.sum("starts").over(order).alias("life"))


@query("SELECT user_id, event_id FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE epoch(ts) - epoch(before) > 604800")
def x21_producer_state_ttl(spark, sf):
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").withColumn("gap", s - F.lag(s).over(Window.partitionBy("user_id").orderBy("event_id"))).where("gap > 604800").select("user_id", "event_id")


@query(f"WITH {MESSAGES}, t AS (SELECT stream, max(off) AS tail FROM messages GROUP BY stream) SELECT stream, n, off = tail AS up_to_date, off = tail AND stream IN ('events/click', 'events/view') AS eof FROM messages JOIN t USING (stream)")
def x23_eof(spark, sf):
    m = messages(spark, sf)
    t = m.groupBy("stream").agg(F.max("off").alias("tail"))
    end = F.col("off") == F.col("tail")
    return m.join(t, "stream").select("stream", "n", end.alias("up_to_date"), (end & F.col("stream").isin("events/click", "events/view")).alias("eof"))


@query(f"WITH {COMMANDS}, f AS (SELECT path, min(seq) AS closer FROM commands WHERE cmd = 'close' GROUP BY path) SELECT seq, CASE WHEN seq = closer THEN 200 ELSE 204 END AS status FROM commands JOIN f USING (path) WHERE cmd = 'close'")
def x19_append_and_close(spark, sf):
    c = commands(spark, sf).where("cmd = 'close'")
    return c.join(c.groupBy("path").agg(F.min("seq").alias("closer")), "path").select("seq", F.when(F.col("seq") == F.col("closer"), 200).otherwise(204).alias("status"))


@query("SELECT n_nationkey, CAST(least(60, power(2, n_nationkey % 8)) AS BIGINT) AS seconds FROM nation")
def x25_backoff(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", F.least(F.lit(60), F.pow(F.lit(2), F.col("n_nationkey") % 8)).cast("bigint").alias("seconds"))


@query(f"WITH {CHANGES}, v AS (SELECT type, key, arg_max(op, off) AS op, arg_max(value, off) AS value FROM changes WHERE control IS NULL GROUP BY type, key) SELECT type, key, value FROM v WHERE op <> 'delete'")
def a19_materialize(spark, sf):
    return S.materialize(changes(spark, sf))


@query(f"WITH {CHANGES}, v AS (SELECT type, key, arg_max(op, off) AS op, arg_max(value, off) AS value FROM changes WHERE control IS NULL AND off > (SELECT coalesce(max(off), -1) FROM changes WHERE control = 'reset') GROUP BY type, key) SELECT type, key, value FROM v WHERE op <> 'delete'")
def a20_reset_aware(spark, sf):
    return S.materialize(changes(spark, sf), reset=True)


@query(f"WITH {CHANGES}, l AS (SELECT *, lag(op) OVER (PARTITION BY type, key ORDER BY off) AS before FROM changes) SELECT off, CASE WHEN op = 'delete' THEN 'delete' WHEN before IS NULL OR before = 'delete' THEN CASE WHEN op IN ('upsert','insert') THEN 'insert' ELSE 'update' END ELSE 'update' END AS op FROM l")
def a21_normalize(spark, sf):
    before = F.lag("op").over(Window.partitionBy("type", "key").orderBy("off"))
    absent = F.col("before").isNull() | (F.col("before") == "delete")
    op = F.when(F.col("op") == "delete", "delete").when(absent & F.col("op").isin("upsert", "insert"), "insert").otherwise("update")
    return changes(spark, sf).withColumn("before", before).select("off", op.alias("op"))


@query(f"WITH {CHANGES} SELECT off // 100 AS batch, count(*) AS n, max(off) AS txid FROM changes GROUP BY off // 100")
def x29_batch_commit(spark, sf):
    return changes(spark, sf).groupBy(F.floor(F.col("off") / 100).alias("batch")).agg(F.count("*").alias("n"), F.max("off").alias("txid"))
