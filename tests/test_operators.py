"""Operators against sequential models and laws."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import parsing
from tidemark.operators import keyvalue, lifecycle, ordering, streams
from tidemark.plans import relational_queries, stream_queries  # noqa: F401
from tidemark.sources import objects
from tidemark.streaming import sources


def fold(commands, capacity):
    paths, out = {}, {}
    for seq, path, cmd, ct, lc in commands:
        p = paths.get(path)
        if cmd == "create":
            if p is None and len(paths) >= capacity:
                out[seq] = "CapacityExhausted"
            elif p is None:
                paths[path] = {"ct": ct, "state": lc}
                out[seq] = "Created"
            else:
                out[seq] = "AlreadyExists" if p["state"] == lc and p["ct"] == ct else "Occupied"
        elif p is None or p["state"] == "gone":
            out[seq] = "NotLive"
        elif cmd == "close":
            out[seq] = "Closed" if p["state"] == "open" else "AlreadyClosed"
            p["state"] = "closed"
        else:
            p["state"] = "gone"
            out[seq] = "Deleted"
    return out


@pytest.mark.parametrize("capacity", [3, 5, 99])
def test_decide_is_the_sequential_fold(spark, capacity):
    r = random.Random(capacity)
    cmds = [(i, f"p{r.randrange(9)}", r.choice(["create", "create", "close", "delete"]), r.choice("ab"), r.choice(["open", "closed"])) for i in range(1, 250)]
    df = spark.createDataFrame(cmds, "seq long, path string, cmd string, content_type string, lifecycle string").withColumn("expiry", F.lit(None).cast("string"))
    assert {x["seq"]: x["outcome"] for x in lifecycle.decide(df, capacity).collect()} == fold(cmds, capacity)


def test_running_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(ordering, "RANGE_ROWS", 20)
    r = random.Random(1)
    rows = [(r.randrange(40), i, r.randrange(5)) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, i long, n long")
    got = {(x["k"], x["i"]): x["s"] for x in ordering.running(df, "k", ["i"], F.col("n"), "s").collect()}
    total = 0
    for k, i, n in sorted(rows):
        total += n
        assert got[k, i] == total


def test_delta_runs_merge_to_the_fold(spark):
    r = random.Random(4)
    rows = list({(k, run): (k, run, op, v) for k, run, op, v in [(r.randrange(30), run, r.choice(["Value", "Delete"]), r.randrange(100)) for run in range(6) for _ in range(20)]}.values())
    df = spark.createDataFrame(rows, "key int, run int, op string, value int")
    want = {}
    for k, _, op, v in sorted(rows, key=lambda x: -x[1]):  # oldest first
        want.pop(k, None) if op == "Delete" else want.__setitem__(k, v)
    merged = lifecycle.newest_wins(df, "key", drop=F.col("op") == "Delete")
    assert {x["key"]: x["value"] for x in merged.collect()} == want


def match(p, s):
    if not p:
        return not s
    if p[0] == "**":
        return any(match(p[1:], s[i:]) for i in range(len(s) + 1))
    return bool(s) and (p[0] == "*" or p[0].replace("%2A", "*").replace("%2a", "*") == s[0]) and match(p[1:], s[1:])


def test_globs(spark):
    r = random.Random(2)
    pats = ["/".join(r.choices(["*", "**", "a", "b.c", "%2A", "x+"], k=r.randrange(1, 4))) for _ in range(60)]
    paths = ["/".join(r.choices(["a", "b.c", "bxc", "*", "x+"], k=r.randrange(1, 4))) for _ in range(60)]
    p = spark.createDataFrame(list(enumerate(set(pats))), "sub int, pattern string")
    q = spark.createDataFrame([(x,) for x in set(paths)], "path string")
    got = {(x["pattern"], x["path"]) for x in streams.match_patterns(p, q).collect()}
    assert got == {(a, b) for a in set(pats) for b in set(paths) if match(a.split("/"), b.split("/"))}


def test_path_rules(spark):
    cases = {"a" * 512: None, "a" * 513: "OverMaxBytes", "é" * 256: None, "é" * 257: "OverMaxBytes", "events/\x07": "ControlCharacter", "a\nb": "ControlCharacter", "__ds/x": "ReservedRootSegment", "__dsx/x": None, "a//b": "EmptySegment", "a/../b": "RelativeSegment", "": "EmptySegment", "events/__ds": None}
    df = spark.createDataFrame([(c,) for c in cases], "p string").select("p", parsing.path_error(F.col("p")).alias("e"))
    assert {x["p"]: x["e"] for x in df.collect()} == cases


def test_golden_keys(spark):
    df = spark.createDataFrame([("seal", 1), ("seal", 2), ("wal", 42)], "k string, n long")
    seal = df.select(parsing.reverse_key("seal", F.col("n")).alias("s"), parsing.reverse_key("wal", F.col("n")).alias("w")).collect()
    assert seal[0]["s"] == "seal/v1/18446744073709551614" and seal[1]["s"] == "seal/v1/18446744073709551613" and seal[2]["w"] == "wal/v1/18446744073709551573"


def producer_log():
    r = random.Random(3)
    return [("s", r.randrange(3), i, i // 40 + r.randrange(2), r.randrange(6)) for i in range(200)]


def test_producers_batch_and_stream_agree(spark, tmp_path):
    df = spark.createDataFrame(producer_log(), "stream string, producer long, arrival long, epoch long, seq long").coalesce(1)
    batch = {(x["producer"], x["arrival"]): x["status"] for x in streams.judge_producers(df).collect()}
    df.write.parquet(f"{tmp_path}/in")
    live = sources.producers(sources.tail(spark, f"{tmp_path}/in", df.schema))
    sources.drain(live, f"{tmp_path}/state", f"{tmp_path}/out")
    assert {(x["producer"], x["arrival"]): x["status"] for x in spark.read.parquet(f"{tmp_path}/out").collect()} == batch
    assert {"accepted", "duplicate", "stale_epoch"} <= set(batch.values())


def test_streamed_producers_with_many_chunks(spark, tmp_path):
    """A producer whose rows of one micro-batch come in many chunks, out of order."""
    rows = [("s", 1, i, 0, i) for i in range(600)]
    random.Random(6).shuffle(rows)
    df = spark.createDataFrame(rows, "stream string, producer long, arrival long, epoch long, seq long").coalesce(1)
    df.write.parquet(f"{tmp_path}/in")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        sources.drain(sources.producers(sources.tail(spark, f"{tmp_path}/in", df.schema)), f"{tmp_path}/state", f"{tmp_path}/out")
        assert [x["status"] for x in spark.read.parquet(f"{tmp_path}/out").collect()] == ["accepted"] * 600
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_lineage_of_any_depth(spark):
    forks = spark.createDataFrame([(f"s{i}", f"s{i + 1}", f"{50 + (i * 7) % 30:04d}") for i in range(12)], "child string, parent string, at string").coalesce(1)
    got = {(x["stream"], x["ancestor"]): x["cap"] for x in streams.lineage(forks).collect()}
    assert got == {(f"s{i}", f"s{j}"): f"{min(50 + (k * 7) % 30 for k in range(i, j)):04d}" for i in range(12) for j in range(i + 1, 13)}


def test_scans_of_groups_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(ordering, "RANGE_ROWS", 20)
    r = random.Random(9)
    rows = [(r.choice("aaab"), i, r.randrange(9)) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i long, n long").repartition(3)
    got = {x["i"]: (x["s"], x["m"]) for x in ordering.scan(df, "i", [], {"s": F.col("n")}, {"m": F.col("n")}, group=["g"], before=True).collect()}
    for g, i, _ in rows:
        seen = [n for h, j, n in rows if h == g and j < i]
        assert got[i] == (sum(seen), max(seen, default=None))
    names = sorted({"".join(r.choices("abcé", k=r.randrange(1, 6))) for _ in range(200)}, key=str.encode)
    placed = ordering.by_text(spark.createDataFrame([(x,) for x in names], "t string").repartition(3), "t", "place").collect()
    assert [x["t"] for x in sorted(placed, key=lambda x: x["place"])] == names and sorted(x["place"] for x in placed) == list(range(1, len(names) + 1))


def test_all_producers_are_judged(spark, tmp_path):
    """a17_producer against a sequential model, for suppliers beyond any fixed prefix of ids."""
    from tidemark.plans.registry import QUERIES

    r = random.Random(7)
    lines = [(r.choice([1, 40, 41, 77, 12345]), i // 4, i % 4) for i in range(400)]
    spark.createDataFrame(lines, "l_suppkey long, l_orderkey long, l_linenumber long").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {}
    for p in {x[0] for x in lines}:
        epoch, last = None, -1
        for n in range(1, sum(x[0] == p for x in lines) + 1):
            place = (n - 1) % 25
            seq = max(0, place - 2 if place % 7 == 6 else place + 3 if place % 11 == 10 else place - place // 7 - place // 11)
            e = (n - 1) // 25 - (n % 13 == 0)
            if epoch is not None and e < epoch:
                status = "stale_epoch"
            elif epoch is None or e > epoch:
                status = "accepted" if seq == 0 else "sequence_gap" if epoch is None else "invalid_epoch_seq"
            else:
                status = "duplicate" if seq <= last else "accepted" if seq == last + 1 else "sequence_gap"
            want[p, n] = (e, seq, status, last + 1 if e == epoch else 0)
            if status == "accepted":
                epoch, last = e, seq
    got = {(x["producer"], x["arrival"]): (x["epoch"], x["seq"], x["status"], x["expected"]) for x in QUERIES["a17_producer"](spark, str(tmp_path)).collect()}
    assert got == want


def test_conflicts_of_the_whole_log(spark, tmp_path):
    """x32_conflicts with conflicts only late in the log, and the relation itself with any span."""
    from tidemark.plans.registry import QUERIES

    ids = [*range(0, 4000, 400), *range(7000, 7300, 7)]
    events = [(i, "click", i % 2 if i >= 7000 else i, float(i)) for i in ids]
    spark.createDataFrame(events, "event_id long, event_type string, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    keys = {i: (u % 97, i % 7) for i, _, u, _ in events}
    want = {a % 200 for a in ids for b in ids if keys[a] == keys[b] and a < b + 15 < a + 15}
    assert want and {x["txn"] for x in QUERIES["x32_conflicts"](spark, str(tmp_path)).collect()} == want
    r = random.Random(5)
    rows = [(r.randrange(4), i, s, s + r.randrange(-3, 60)) for i, s in enumerate(r.choices(range(900), k=200))]
    want = {i for k, i, s, c in rows for k2, _, _, c2 in rows if k == k2 and s < c2 < c}
    df = spark.createDataFrame(rows, "key long, txn long, snapshot long, committed long")
    for span in (1, 15, 1000):
        assert {x["txn"] for x in keyvalue.conflicts(df, df, span).collect()} == want


def test_sliding_ttl_of_fractions_and_odd_rows(spark, tmp_path):
    """x20_sliding_ttl: gaps a microsecond round the limit, rows without a time, an id or a user, repeated rows."""
    import datetime

    import duckdb

    from tidemark.plans.registry import ORACLE_SQL, QUERIES

    at = lambda s, us=0: None if s is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s, microseconds=us)
    rows = [  # user, event, time, life
        (1, 0, at(0, 250_000), 1), (1, 1, at(86400, 750_000), 2), (1, 2, at(2 * 86400, 750_000), 2), (1, 3, at(3 * 86400, 750_001), 3), (1, 4, at(4 * 86400 + 1, 0), 4), (1, 5, at(5 * 86400, 999_999), 4),
        (2, 0, None, 1), (2, 1, at(5), 2), (2, 2, None, 2), (2, 3, at(7), 3), (2, 4, None, 4), (2, 4, None, 4), (2, 5, at(9), 5),
        (3, 0, at(0), 1), (3, 1, at(10), 1), (3, None, at(90_000), 2),
        (None, 0, at(0), 1), (None, 1, at(86400, 1), 2),
    ]
    spark.createDataFrame([r[:3] for r in rows], "user_id long, event_id long, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(((u, e, n) for u, e, _, n in rows), key=repr)
    assert sorted(c.sql(ORACLE_SQL["x20_sliding_ttl"]).fetchall(), key=repr) == want
    assert sorted(map(tuple, QUERIES["x20_sliding_ttl"](spark, str(tmp_path)).collect()), key=repr) == want


def test_live_counts(spark, tmp_path):
    df = spark.createDataFrame([(i % 3, i) for i in range(20)], "k int, v int")
    df.write.parquet(f"{tmp_path}/in")
    live = sources.live_counts(sources.tail(spark, f"{tmp_path}/in", df.schema, 1), "k")
    sources.drain_update(live, f"{tmp_path}/state", f"{tmp_path}/out", ["k"])
    assert {x["k"]: x["n"] for x in sources.newest(spark, f"{tmp_path}/out").collect()} == {0: 7, 1: 7, 2: 6}


def test_objects(spark, tmp_path):
    df = spark.range(10)
    assert objects.create_if_absent(df, f"{tmp_path}/t") == "created"
    assert objects.create_if_absent(df, f"{tmp_path}/t") == "exists"
    assert objects.read_bounded(spark, f"{tmp_path}/t", 1 << 20).count() == 10
    with pytest.raises(ValueError):
        objects.read_bounded(spark, f"{tmp_path}/t", 1)
    keys = spark.createDataFrame([(f"a/{i:02d}",) for i in range(9)] + [("b/1",)], "key string")
    assert objects.page(keys, "a/", "a/02", 4) == (["a/03", "a/04", "a/05", "a/06"], "a/06")
    assert objects.page(keys, "a/", "a/06", 4) == (["a/07", "a/08"], None)
    assert objects.listing(spark, f"{tmp_path}/t", "*.parquet").count() >= 1


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 1000
