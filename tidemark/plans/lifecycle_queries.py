"""Queries over commands, facts and versions of the stream store."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import lifecycle as L
from tidemark.operators.ordering import by_text, running
from tidemark.plans.inputs import COMMANDS, FACTS, MANIFEST, commands, decided_sql, facts, folded, folded_sql, manifest
from tidemark.plans.registry import query

DECISION = "seq, path, cmd, outcome, uid"


@query(f"WITH {FACTS} SELECT {DECISION} FROM decided")
def x1_admit_all(spark, sf):
    return L.decide(commands(spark, sf)).select("seq", "path", "cmd", "outcome", "uid")


@query(f"WITH {decided_sql(20)} SELECT {DECISION} FROM decided")
def x1_capacity(spark, sf):
    return L.decide(commands(spark, sf), capacity=20).select("seq", "path", "cmd", "outcome", "uid")


@query(f"WITH {FACTS} SELECT outcome, count(*) AS n FROM decided WHERE cmd = 'close' GROUP BY outcome")
def x2_admit_close(spark, sf):
    return L.decide(commands(spark, sf)).where("cmd = 'close'").groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"WITH {FACTS} SELECT outcome, count(*) AS n FROM decided WHERE cmd = 'delete' GROUP BY outcome")
def x3_admit_delete(spark, sf):
    return L.decide(commands(spark, sf)).where("cmd = 'delete'").groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"WITH {FACTS} SELECT path, uid FROM facts WHERE kind = 'StreamCreated'")
def a5_uids(spark, sf):
    return facts(spark, sf).where("kind = 'StreamCreated'").select("path", "uid")


@query(f"WITH {FACTS} SELECT batch, count(*) AS n_facts, string_agg(path, ',' ORDER BY fact_no) AS paths FROM facts GROUP BY batch")
def a11_batches(spark, sf):
    rows = facts(spark, sf).groupBy("batch").agg(F.count("*").alias("n_facts"), F.array_sort(F.collect_list(F.struct("fact_no", "path"))).alias("f"))
    return rows.select("batch", "n_facts", F.array_join("f.path", ",").alias("paths"))


_BYTES = "sum(128 + strlen(path) + CASE WHEN kind = 'StreamCreated' THEN strlen(content_type) ELSE 0 END)"


def _wal_bytes(rows):
    return F.sum(128 + F.octet_length("path") + F.when(F.col("kind") == "StreamCreated", F.octet_length("content_type")).otherwise(0)).cast("bigint")


@query(f"WITH {FACTS} SELECT batch, CAST(128 + {_BYTES} AS BIGINT) AS bytes FROM facts GROUP BY batch")
def a12_wal_bytes(spark, sf):
    return facts(spark, sf).groupBy("batch").agg((128 + _wal_bytes(None)).alias("bytes"))


@query(f"WITH {FACTS} SELECT batch, batch - 3 AS span, batch - 3 >= 512 AS due, batch - 3 < 1024 AS room FROM (SELECT DISTINCT batch FROM facts)")
def a13_span(spark, sf):
    span = F.col("batch") - 3
    return facts(spark, sf).select("batch").distinct().select("batch", span.alias("span"), (span >= 512).alias("due"), (span < 1024).alias("room"))


@query(f"WITH {FACTS}, b AS (SELECT batch, 128 + {_BYTES} AS bytes, count(*) AS n FROM facts GROUP BY batch) SELECT batch, n >= 4096 OR bytes + 896 > 4194304 AS hard_full, NOT (n >= 4096 OR bytes + 896 > 4194304) AS admission_open FROM b")
def x6_hard_full(spark, sf):
    rows = facts(spark, sf).groupBy("batch").agg((128 + _wal_bytes(None)).alias("bytes"), F.count("*").alias("n"))
    full = (F.col("n") >= 4096) | (F.col("bytes") + 896 > 4194304)
    return rows.select("batch", full.alias("hard_full"), (~full).alias("admission_open"))


@query(f"WITH {FACTS}, {folded_sql()} SELECT path, state, uid FROM folded")
def a1_fold_directory(spark, sf):
    return L.directory(folded(spark, sf))


@query(f"WITH {FACTS}, {folded_sql()} SELECT uid, content_type, lifecycle, created_at FROM folded WHERE state = 'Live'")
def a1_fold_ledger(spark, sf):
    return L.ledger(folded(spark, sf)).drop("expiry")


def _broken(spark, sf):
    """Facts with one in 50 uids moved, and closes and deletes doubled onto other paths."""
    f = facts(spark, sf)
    return f.withColumn("uid", F.when(F.col("fact_no") % 50 == 0, F.col("uid") + 1).otherwise(F.col("uid"))).withColumn("kind", F.when((F.col("fact_no") % 31 == 0) & (F.col("kind") == "StreamDeleted"), "StreamClosed").otherwise(F.col("kind")))


_CHECKED = f"""{FACTS}, broken AS (SELECT fact_no, path, content_type, lifecycle, CASE WHEN fact_no % 50 = 0 THEN uid + 1 ELSE uid END AS uid, CASE WHEN fact_no % 31 = 0 AND kind = 'StreamDeleted' THEN 'StreamClosed' ELSE kind END AS kind FROM facts),
ex AS (SELECT *, CASE WHEN kind = 'StreamCreated' THEN sum(CASE WHEN kind = 'StreamCreated' THEN 1 ELSE 0 END) OVER (ORDER BY fact_no) END AS expected,
  coalesce(bool_or(kind = 'StreamCreated') OVER w, false) AS had, coalesce(bool_or(kind = 'StreamDeleted') OVER w, false) AS dead, max(CASE WHEN kind = 'StreamCreated' THEN uid END) OVER w AS owner,
  coalesce(bool_or(kind = 'StreamClosed' OR (kind = 'StreamCreated' AND lifecycle = 'closed')) OVER w, false) AS shut
  FROM broken WINDOW w AS (PARTITION BY path ORDER BY fact_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
checked AS (SELECT fact_no, kind, path, CASE WHEN kind = 'StreamCreated' THEN CASE WHEN had THEN 'PathOccupied' WHEN uid <> expected THEN 'UidNotDenseSuccessor' END
  WHEN NOT had OR dead THEN 'PathNotLive' WHEN uid <> owner THEN 'PathUidMismatch' WHEN kind = 'StreamClosed' AND shut THEN 'StreamAlreadyClosed' END AS error FROM ex)"""


@query(f"WITH {_CHECKED} SELECT fact_no, kind, path, error FROM checked")
def a2_fold_contradictions(spark, sf):
    return L.contradictions(_broken(spark, sf))


@query(f"WITH {_CHECKED} SELECT kind, error, count(*) AS n FROM checked WHERE error IS NOT NULL AND kind = 'StreamClosed' GROUP BY kind, error")
def a3_close_rule(spark, sf):
    return L.contradictions(_broken(spark, sf)).where("error is not null and kind = 'StreamClosed'").groupBy("kind", "error").agg(F.count("*").alias("n"))


@query(f"WITH {_CHECKED} SELECT kind, error, count(*) AS n FROM checked WHERE error IS NOT NULL AND kind = 'StreamDeleted' GROUP BY kind, error")
def a4_delete_rule(spark, sf):
    return L.contradictions(_broken(spark, sf)).where("error is not null and kind = 'StreamDeleted'").groupBy("kind", "error").agg(F.count("*").alias("n"))


@query(f"WITH {_CHECKED} SELECT fact_no FROM checked WHERE fact_no < (SELECT coalesce(min(fact_no), 1000000000000) FROM checked WHERE error IS NOT NULL)")
def a1_fold_stops_at_first(spark, sf):
    checked = L.contradictions(_broken(spark, sf))
    first = checked.where("error is not null").agg(F.coalesce(F.min("fact_no"), F.lit(1_000_000_000_000)).alias("first"))
    return checked.crossJoin(first).where("fact_no < first").select("fact_no")  # first is one row


_ASKED = "asked AS (SELECT DISTINCT path FROM commands UNION ALL SELECT 'users/none/k' || r_regionkey FROM region)"


def _asked(spark, sf):
    return commands(spark, sf).select("path").distinct().union(spark.read.parquet(f"{sf}/region.parquet").select(F.concat(F.lit("users/none/k"), F.col("r_regionkey"))))


@query(f"WITH {FACTS}, {folded_sql()}, {_ASKED} SELECT path, CASE WHEN state IS NULL THEN 'Missing' WHEN state = 'Tombstone' THEN 'Deleted' ELSE 'Live' END AS status, content_type, lifecycle FROM asked LEFT JOIN folded USING (path)")
def p1_status(spark, sf):
    return L.status(_asked(spark, sf), folded(spark, sf))


@query(f"WITH {FACTS}, {folded_sql()} SELECT path, state, uid FROM folded WHERE path = 'users/3/k1'")
def p2_resolve(spark, sf):
    return L.directory(folded(spark, sf)).where("path = 'users/3/k1'")


@query(f"WITH {FACTS}, {folded_sql()} SELECT uid, content_type, lifecycle FROM folded WHERE state = 'Live' AND uid BETWEEN 5 AND 40")
def p3_record(spark, sf):
    return L.ledger(folded(spark, sf)).where("uid between 5 and 40").select("uid", "content_type", "lifecycle")


@query(f"WITH {FACTS}, {folded_sql()} SELECT path, CASE WHEN state <> 'Live' THEN 'NotLive' WHEN uid <> length(path) THEN 'UidMismatch' ELSE 'Ok' END AS ruling FROM folded")
def p4_live_uid(spark, sf):
    return L.directory(folded(spark, sf)).select("path", F.when(F.col("state") != "Live", "NotLive").when(F.col("uid") != F.length("path"), "UidMismatch").otherwise("Ok").alias("ruling"))


@query(f"WITH {FACTS}, {folded_sql()} SELECT c.seq, c.content_type IS NOT DISTINCT FROM f.content_type AND c.lifecycle IS NOT DISTINCT FROM f.lifecycle AS same FROM commands c JOIN folded f USING (path) WHERE cmd = 'create'")
def p5_config_equal(spark, sf):
    f = folded(spark, sf).select("path", F.col("content_type").alias("ct"), F.col("lifecycle").alias("lc"))
    return commands(spark, sf).where("cmd = 'create'").join(f, "path").select("seq", (F.col("content_type").eqNullSafe(F.col("ct")) & F.col("lifecycle").eqNullSafe(F.col("lc"))).alias("same"))


@query(f"WITH {FACTS}, {folded_sql()} SELECT path FROM folded WHERE state = 'Live' AND path LIKE 'users/1%'")
def p8_live(spark, sf):
    return L.directory(folded(spark, sf)).where(F.col("path").startswith("users/1") & (F.col("state") == "Live")).select("path")


@query(f"WITH {FACTS}, {folded_sql()} SELECT path, uid, lifecycle FROM folded WHERE state = 'Live'")
def j1_directory_ledger(spark, sf):
    f = folded(spark, sf)
    return L.directory(f).where("state = 'Live'").join(L.ledger(f), "uid").select("path", "uid", "lifecycle")


_SPOILT = """d AS (SELECT path, CASE WHEN uid % 41 = 0 THEN uid + 1 WHEN uid % 53 = 0 THEN uid + 100000 ELSE uid END AS uid, CASE WHEN uid % 37 = 0 THEN 'Tombstone' ELSE state END AS state FROM folded),
l AS (SELECT uid FROM folded WHERE state = 'Live' AND uid % 29 <> 0)"""


@query(f"WITH {FACTS}, {folded_sql()}, {_SPOILT} SELECT CASE WHEN uid < 1 THEN 'UidGap' ELSE 'CountMismatch' END AS error, uid FROM d WHERE uid < 1 OR uid > (SELECT count(*) FROM d) UNION ALL SELECT 'UidGap', uid FROM d GROUP BY uid HAVING count(*) > 1 UNION ALL SELECT CASE WHEN d.uid IS NULL THEN 'RecordWithoutLive' WHEN l.uid IS NULL THEN 'LiveWithoutRecord' ELSE 'TombstoneWithRecord' END, coalesce(d.uid, l.uid) FROM d FULL JOIN l ON d.uid = l.uid WHERE d.uid IS NULL OR (state = 'Live' AND l.uid IS NULL) OR (state = 'Tombstone' AND l.uid IS NOT NULL)")
def j2_invariants(spark, sf):
    f, uid = folded(spark, sf), F.col("uid")
    d = f.select("path", F.when(uid % 37 == 0, "Tombstone").otherwise(F.col("state")).alias("state"), F.when(uid % 41 == 0, uid + 1).when(uid % 53 == 0, uid + 100000).otherwise(uid).alias("uid"))
    return L.integrity(d, L.ledger(f).where("uid % 29 != 0").select("uid"))


@query(f"""WITH {FACTS}, {folded_sql('whole')}, {folded_sql('base', '3')}, suffix AS (SELECT path, max(uid) AS uid, bool_or(kind = 'StreamDeleted') AS dead, bool_or(kind = 'StreamClosed' OR (kind = 'StreamCreated' AND lifecycle = 'closed')) AS shut, max(CASE WHEN kind = 'StreamCreated' THEN content_type END) AS ct, max(CASE WHEN kind = 'StreamCreated' THEN fact_no END) AS made FROM facts WHERE batch > 3 GROUP BY path),
one AS (SELECT path, coalesce(b.uid, s.uid) AS uid, coalesce(s.dead, false) OR coalesce(b.state = 'Tombstone', false) AS gone, coalesce(b.content_type, s.ct) AS ct, coalesce(b.lifecycle = 'closed', false) OR coalesce(s.shut, false) AS shut, coalesce(b.created_at, s.made) AS made FROM base b FULL JOIN suffix s USING (path)),
replayed AS (SELECT path, uid, CASE WHEN gone THEN 'Tombstone' ELSE 'Live' END AS state, CASE WHEN NOT gone THEN ct END AS content_type, CASE WHEN NOT gone THEN CASE WHEN shut THEN 'closed' ELSE 'open' END END AS lifecycle, CASE WHEN NOT gone THEN made END AS created_at FROM one)
SELECT count(*) AS differing FROM ((SELECT path, uid, state, content_type, lifecycle, created_at FROM whole EXCEPT ALL SELECT * FROM replayed) UNION ALL (SELECT * FROM replayed EXCEPT ALL SELECT path, uid, state, content_type, lifecycle, created_at FROM whole))""")
def a14_replay_equals_fold(spark, sf):
    rows = facts(spark, sf)
    whole, base = L.fold(rows), L.fold(rows, 3)
    # the base's rows as facts again, then the suffix
    again = base.select(F.lit("StreamCreated").alias("kind"), "path", "uid", "content_type", "expiry", F.coalesce("lifecycle", F.lit("open")).alias("lifecycle"), F.coalesce("created_at", F.lit(0)).alias("fact_no"), F.lit(0).cast("bigint").alias("batch"))
    dead = base.where("state = 'Tombstone'").select(F.lit("StreamDeleted").alias("kind"), "path", "uid", F.lit(None).cast("string").alias("content_type"), F.lit(None).cast("string").alias("expiry"), F.lit(None).cast("string").alias("lifecycle"), F.lit(0).cast("bigint").alias("fact_no"), F.lit(0).cast("bigint").alias("batch"))
    replayed = L.fold(again.unionByName(dead).unionByName(rows.where("batch > 3").select(again.columns)))
    one = replayed.exceptAll(whole).unionByName(whole.exceptAll(replayed))
    return one.agg(F.count("*").alias("differing"))


def _runs(spark, sf):
    """Directory rows in runs cut at every second batch; run 0 is the newest."""
    rows = facts(spark, sf)
    cut = F.floor((F.col("batch") - 1) / 2)
    state = rows.withColumn("cut", cut).groupBy("path", "cut").agg(F.max("uid").alias("uid"), F.max(F.col("kind") == "StreamDeleted").alias("gone"), F.max("fact_no").alias("last_fact"))
    return state.select("path", (1_000_000 - F.col("cut")).alias("run"), "uid", F.when(F.col("gone"), "Tombstone").otherwise("Live").alias("state"), "last_fact")


_RUNS = "runs AS (SELECT path, 1000000 - (batch - 1) // 2 AS run, max(uid) AS uid, CASE WHEN bool_or(kind = 'StreamDeleted') THEN 'Tombstone' ELSE 'Live' END AS state, max(fact_no) AS last_fact FROM facts GROUP BY path, (batch - 1) // 2)"


@query(f"WITH {FACTS}, {_RUNS} SELECT path, arg_min(uid, run) AS uid, arg_min(state, run) AS state, arg_min(last_fact, run) AS last_fact FROM runs GROUP BY path")
def a6_directory_merge(spark, sf):
    return L.newest_wins(_runs(spark, sf), "path")


@query(f"WITH {FACTS}, {_RUNS} SELECT * FROM (SELECT uid, arg_min(state, run) AS state, arg_min(last_fact, run) AS last_fact FROM runs GROUP BY uid) WHERE state <> 'Tombstone'")
def a7_ledger_merge(spark, sf):
    return L.newest_wins(_runs(spark, sf).drop("path"), "uid", drop=F.col("state") == "Tombstone")


_CHARGE = "CASE kind WHEN 'StreamCreated' THEN 525 + 1035 WHEN 'StreamDeleted' THEN -1035 ELSE 0 END"


@query(f"WITH {FACTS} SELECT fact_no, CAST(sum({_CHARGE}) OVER (ORDER BY fact_no) AS BIGINT) AS resident, sum({_CHARGE}) OVER (ORDER BY fact_no) > 17179869184 AS over FROM facts")
def a8_resident(spark, sf):
    charge = F.when(F.col("kind") == "StreamCreated", 1560).when(F.col("kind") == "StreamDeleted", -1035).otherwise(0).cast("bigint")
    return running(facts(spark, sf), "fact_no", [], charge, "resident").select("fact_no", "resident", (F.col("resident") > 17179869184).alias("over"))


@query(f"WITH {MANIFEST} SELECT gen, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS total, count(*) <= 1024 AND sum(bytes) <= 34359738368 AS bounded FROM manifest GROUP BY gen")
def a9_sources(spark, sf):
    return manifest(spark, sf).groupBy("gen").agg(F.count("*").alias("n"), F.sum("bytes").alias("total")).withColumn("bounded", (F.col("n") <= 1024) & (F.col("total") <= 34359738368))


@query(f"WITH {FACTS}, {folded_sql()} SELECT path, (row_number() OVER (ORDER BY path) - 1) // 8 AS chunk FROM folded")
def a10_chunks(spark, sf):
    return by_text(folded(spark, sf).select("path"), "path", "place").select("path", F.floor((F.col("place") - 1) / 8).alias("chunk"))


@query(f"WITH {FACTS}, {folded_sql()} SELECT path AS row_key, 'directory' AS tree FROM folded UNION ALL SELECT CAST(uid AS VARCHAR), 'ledger' FROM folded WHERE state = 'Live'")
def a31_full_base(spark, sf):
    f = folded(spark, sf)
    return L.directory(f).select(F.col("path").alias("row_key"), F.lit("directory").alias("tree")).union(L.ledger(f).select(F.col("uid").cast("string"), F.lit("ledger")))


@query(f"WITH {MANIFEST} SELECT tree, run_ord, table_ord, row_number() OVER (PARTITION BY gen ORDER BY tree, run_ord, table_ord) AS n FROM manifest")
def a32_manifest_order(spark, sf):
    return manifest(spark, sf).select("tree", "run_ord", "table_ord", F.row_number().over(Window.partitionBy("gen").orderBy("tree", "run_ord", "table_ord")).cast("bigint").alias("n"))


@query(f"WITH {MANIFEST} SELECT DISTINCT table_id FROM manifest WHERE gen = 0 AND table_id NOT IN (SELECT table_id FROM manifest WHERE gen = 1)")
def j3_dropped_tables(spark, sf):
    m = manifest(spark, sf)
    return m.where("gen = 0").join(m.where("gen = 1"), "table_id", "left_anti").select("table_id").distinct()


@query(f"WITH {MANIFEST} SELECT table_id FROM manifest WHERE gen = 0 EXCEPT SELECT table_id FROM manifest WHERE gen = 1")
def u1_identity_difference(spark, sf):
    m = manifest(spark, sf)
    return m.where("gen = 0").select("table_id").subtract(m.where("gen = 1").select("table_id"))


@query(f"WITH {MANIFEST} SELECT gen, table_id, count(*) AS copies FROM manifest GROUP BY gen, table_id HAVING count(*) > 1")
def j4_duplicate_tables(spark, sf):
    return manifest(spark, sf).groupBy("gen", "table_id").agg(F.count("*").alias("copies")).where("copies > 1")


_DIFF = f"{FACTS}, {folded_sql('a', '2')}, {folded_sql('b', '5')}"


@query(f"WITH {_DIFF} SELECT path, CASE WHEN a.path IS NULL THEN 'Add' WHEN b.path IS NULL THEN 'Remove' ELSE 'Update' END AS change FROM a FULL JOIN b USING (path) WHERE a.path IS NULL OR b.path IS NULL OR a.state IS DISTINCT FROM b.state OR a.uid IS DISTINCT FROM b.uid")
def j5_directory_diff(spark, sf):
    return L.difference(folded(spark, sf, 2), folded(spark, sf, 5), "path", ["state", "uid"])


@query(f"WITH {_DIFF}, x AS (SELECT uid, lifecycle, content_type FROM a WHERE state = 'Live'), y AS (SELECT uid, lifecycle, content_type FROM b WHERE state = 'Live') SELECT uid, CASE WHEN x.uid IS NULL THEN 'Add' WHEN y.uid IS NULL THEN 'Remove' ELSE 'Update' END AS change FROM x FULL JOIN y USING (uid) WHERE x.uid IS NULL OR y.uid IS NULL OR x.lifecycle IS DISTINCT FROM y.lifecycle")
def u2_ledger_diff(spark, sf):
    return L.difference(L.ledger(folded(spark, sf, 2)), L.ledger(folded(spark, sf, 5)), "uid", ["lifecycle", "content_type"])


@query(f"WITH {FACTS}, {folded_sql('base', '2')}, r AS (SELECT path FROM base UNION ALL SELECT path FROM facts WHERE batch > 2 AND batch <= 4) SELECT path, count(*) AS n FROM r GROUP BY path")
def j6_manifest_suffix(spark, sf):
    suffix = facts(spark, sf).where("batch > 2 and batch <= 4").select("path")
    return folded(spark, sf, 2).select("path").union(suffix).groupBy("path").agg(F.count("*").alias("n"))


@query(f"WITH {MANIFEST}, g AS (SELECT *, lag(hi) OVER (PARTITION BY gen, tree, run_ord ORDER BY table_ord) AS before FROM manifest) SELECT gen, tree, run_ord, table_ord FROM g WHERE lo <= before")
def j17_run_overlap(spark, sf):
    before = F.lag("hi").over(Window.partitionBy("gen", "tree", "run_ord").orderBy("table_ord"))
    return manifest(spark, sf).withColumn("before", before).where("lo <= before").select("gen", "tree", "run_ord", "table_ord")


@query(f"WITH {MANIFEST}, t AS (SELECT gen, count(DISTINCT tree || run_ord) AS runs, max(bytes) AS most, max(birth) AS birth, count(*) - count(DISTINCT table_id) AS twice FROM manifest GROUP BY gen) SELECT gen, CASE WHEN runs > 16 THEN 'TooManyRuns' WHEN birth > gen + 3 THEN 'BornLater' WHEN twice > 0 THEN 'DuplicateTable' WHEN most > 134217728 THEN 'TableTooLarge' END AS error FROM t")
def x36_seal_validity(spark, sf):
    t = manifest(spark, sf).groupBy("gen").agg(F.countDistinct(F.concat("tree", F.col("run_ord").cast("string"))).alias("runs"), F.max("bytes").alias("most"), F.max("birth").alias("birth"), (F.count("*") - F.countDistinct("table_id")).alias("twice"))
    return t.select("gen", F.when(F.col("runs") > 16, "TooManyRuns").when(F.col("birth") > F.col("gen") + 3, "BornLater").when(F.col("twice") > 0, "DuplicateTable").when(F.col("most") > 134217728, "TableTooLarge").alias("error"))


@query(f"WITH {FACTS}, all_ AS (SELECT d.seq, d.outcome, f.batch FROM decided d LEFT JOIN facts f USING (seq)), r AS (SELECT seq, outcome, max(batch) OVER (ORDER BY seq) AS reply_batch FROM all_) SELECT seq, outcome, coalesce(reply_batch, 0) AS reply_batch FROM r WHERE outcome LIKE 'Already%'")
def x37_reply_barrier(spark, sf):
    decided = L.decide(commands(spark, sf))
    took = decided.withColumn("is_fact", F.col("outcome").isin("Created", "Closed", "Deleted").cast("bigint"))
    before = running(took, "seq", [], F.col("is_fact"), "facts_before")
    batch = F.when(F.col("facts_before") > 0, F.floor((F.col("facts_before") - 1) / L.RUN_FACTS) + 1).otherwise(0)
    return before.where("outcome like 'Already%'").select("seq", "outcome", batch.alias("reply_batch"))


@query(f"WITH {MANIFEST} SELECT gen, tree, CASE WHEN count(DISTINCT run_ord) + 1 <= 16 AND count(*) <= 1024 AND sum(bytes) <= 34359738368 THEN 'Delta' ELSE 'Full' END AS plan FROM manifest GROUP BY gen, tree")
def x9_plan(spark, sf):
    t = manifest(spark, sf).groupBy("gen", "tree").agg(F.countDistinct("run_ord").alias("runs"), F.count("*").alias("n"), F.sum("bytes").alias("total"))
    return t.select("gen", "tree", F.when((F.col("runs") + 1 <= 16) & (F.col("n") <= 1024) & (F.col("total") <= 34359738368), "Delta").otherwise("Full").alias("plan"))


@query(f"WITH {FACTS}, {MANIFEST}, {folded_sql('a', '2')}, {folded_sql('b', '5')}, fresh AS (SELECT count(*) AS n FROM b LEFT JOIN a USING (path) WHERE a.path IS NULL OR a.state <> b.state) SELECT run_ord + 1 AS run_ord, count(*) AS n FROM manifest WHERE gen = 0 AND tree = 'directory' GROUP BY run_ord UNION ALL SELECT 0, n FROM fresh WHERE n > 0")
def x10_build_runs(spark, sf):
    fresh = L.difference(folded(spark, sf, 2), folded(spark, sf, 5), "path", ["state"]).agg(F.count("*").alias("n")).where("n > 0").select(F.lit(0).cast("bigint").alias("run_ord"), "n")
    return manifest(spark, sf).where("gen = 0 and tree = 'directory'").groupBy((F.col("run_ord") + 1).alias("run_ord")).agg(F.count("*").alias("n")).unionByName(fresh)


_WAL = f"{FACTS}, wal AS (SELECT batch, CASE WHEN batch % 16 = 0 THEN 'FENCE' ELSE 'RUN' END AS body, 1 + batch // 16 AS owner FROM (SELECT DISTINCT batch FROM facts))"


def _wal(spark, sf):
    return facts(spark, sf).select("batch").distinct().select("batch", F.when(F.col("batch") % 16 == 0, "FENCE").otherwise("RUN").alias("body"), (F.floor(F.col("batch") / 16) + 1).alias("owner"))


@query(f"WITH {_WAL} SELECT greatest(3, max(batch)) + 1 AS fence_at, max(owner) + 1 AS owner FROM wal")
def x12_fence_position(spark, sf):
    return _wal(spark, sf).agg((F.greatest(F.lit(3), F.max("batch")) + 1).alias("fence_at"), (F.max("owner") + 1).alias("owner"))


@query(f"WITH {_WAL}, g AS (SELECT batch, body, CASE WHEN batch % 11 = 0 THEN owner + 1 ELSE owner END AS owner FROM wal WHERE batch % 13 <> 5), p AS (SELECT *, lag(batch) OVER (ORDER BY batch) AS pb, max(CASE WHEN body = 'FENCE' THEN owner END) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cur FROM g) SELECT batch, CASE WHEN batch - pb > 1 THEN 'Gap' WHEN body = 'FENCE' AND owner <= coalesce(cur, 0) THEN 'FenceNotNewer' WHEN body = 'RUN' AND owner <> coalesce(cur, 1) THEN 'WrongOwner' ELSE 'Ok' END AS verdict FROM p")
def x13_replay_check(spark, sf):
    g = _wal(spark, sf).where("batch % 13 != 5").withColumn("owner", F.when(F.col("batch") % 11 == 0, F.col("owner") + 1).otherwise(F.col("owner"))).withColumn("one", F.lit(1))
    order = Window.partitionBy("one").orderBy("batch")  # a replayed suffix: 1024 batches at most
    cur = F.max(F.when(F.col("body") == "FENCE", F.col("owner"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    p = g.withColumn("cur", cur).withColumn("pb", F.lag("batch").over(order))
    return p.select("batch", F.when(F.col("batch") - F.col("pb") > 1, "Gap").when((F.col("body") == "FENCE") & (F.col("owner") <= F.coalesce("cur", F.lit(0))), "FenceNotNewer").when((F.col("body") == "RUN") & (F.col("owner") != F.coalesce("cur", F.lit(1))), "WrongOwner").otherwise("Ok").alias("verdict"))


@query(f"WITH {_WAL} SELECT batch FROM wal WHERE body = 'RUN' AND batch <= 20")
def s14_run_delete(spark, sf):
    return _wal(spark, sf).where("body = 'RUN' and batch <= 20").select("batch")


@query(f"WITH {_WAL} SELECT max(batch) AS tail FROM wal")
def s5_tail(spark, sf):
    return _wal(spark, sf).agg(F.max("batch").alias("tail"))


_STATUS = {"Created": 201, "AlreadyExists": 200, "Occupied": 409, "CapacityExhausted": 429, "Closed": 204, "AlreadyClosed": 204, "Deleted": 204}


@query(f"WITH {decided_sql(60)} SELECT seq, CASE outcome " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _STATUS.items()) + " ELSE CASE WHEN coalesce(max(CASE WHEN outcome = 'Created' THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY seq), 0) = 1 THEN 410 ELSE 404 END END AS status FROM decided")
def x17_http_status(spark, sf):
    d = L.decide(commands(spark, sf), capacity=60)
    ever = F.max((F.col("outcome") == "Created").cast("int")).over(Window.partitionBy("path").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    code = F.create_map(*[F.lit(x) for kv in _STATUS.items() for x in kv])[F.col("outcome")]
    return d.withColumn("ever", ever).select("seq", F.coalesce(code, F.when(F.col("ever") == 1, 410).otherwise(404)).alias("status"))


@query(f"WITH {MANIFEST} SELECT gen + 1 AS gen, table_id, table_ord FROM manifest")
def x35_claim_successor(spark, sf):
    return manifest(spark, sf).select((F.col("gen") + 1).alias("gen"), "table_id", "table_ord")


@query(f"WITH {COMMANDS} SELECT count(*) AS n, count(DISTINCT path) AS paths FROM commands")
def x26_fan_out(spark, sf):
    return commands(spark, sf).agg(F.count("*").alias("n"), F.countDistinct("path").alias("paths"))


@query(f"WITH {FACTS} SELECT path, min(batch) AS first_batch, max(batch) AS last_batch FROM facts WHERE batch <= 6 GROUP BY path")
def p17_durable_view(spark, sf):
    return facts(spark, sf).where("batch <= 6").groupBy("path").agg(F.min("batch").alias("first_batch"), F.max("batch").alias("last_batch"))


@query(f"WITH {MANIFEST} SELECT m.table_ord, n.table_id IS NULL AS missing FROM manifest m LEFT JOIN (SELECT DISTINCT table_id FROM manifest WHERE gen = 1) n USING (table_id) WHERE gen = 0")
def s13_selected_tables(spark, sf):
    m = manifest(spark, sf)
    there = m.where("gen = 1").select("table_id").distinct().withColumn("here", F.lit(True))
    return m.where("gen = 0").join(there, "table_id", "left").select("table_ord", F.col("here").isNull().alias("missing"))
