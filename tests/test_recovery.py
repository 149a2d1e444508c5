"""Racing creates, collection, subscriptions and leases against step-by-step versions."""

import random

import pytest

from pyspark.sql import functions as F
from tidemark.operators import keyvalue as K
from tidemark.operators import recovery as R
from tidemark.operators import streams
from tidemark.operators import subscriptions as S


def test_creates_against_a_store_played_through(spark):
    rnd = random.Random(5)
    log = [(i, rnd.randrange(3), 1 + rnd.randrange(3), rnd.choice("ab"), rnd.random() < 0.8, rnd.random() < 0.7) for i in range(300)]
    store, expect = {}, {}
    for i, p, c, body, arrived, replied in log:
        created = arrived and (p, c) not in store
        if created:
            store[p, c] = body
        there = store.get((p, c))
        read = "Absent" if there is None else "Match" if there == body else "Foreign"
        known = "Unresolved" if not (arrived and replied) else "Direct" if created else "DurableMatch" if there == body else "NotOurs"
        wal = {"Match": "Durable", "Foreign": "Occupied", "Absent": "UnresolvedAbsent"}[read]
        seal = "Unresolved" if known == "Unresolved" else ("Established" if read == "Match" else "LostRace") if c == 1 else "Authored" if known == "Direct" else "NoAuthority"
        expect[i] = (known, wal, seal)
    df = spark.createDataFrame(log, "id bigint, partition bigint, coordinate bigint, body string, arrived boolean, replied boolean")
    got = R.evidence(df).select("id", "evidence", R.wal_outcome().alias("wal"), R.seal_outcome().alias("seal")).collect()
    assert {r.id: (r.evidence, r.wal, r.seal) for r in got} == expect
    assert R.evidence(df.limit(0)).count() == 0


def test_refresh_reads_newer_equal_lower_and_missing_heads(spark):
    claims = spark.createDataFrame([(1, 4), (2, 4), (3, 4), (4, 4)], "partition bigint, generation bigint")
    heads = spark.createDataFrame([(1, 5), (2, 4), (3, 3)], "partition bigint, head bigint")
    got = {r.partition: r.verdict for r in R.refreshed(claims, heads, "Complete").collect()}
    assert got == {1: "Fenced", 2: "Complete", 3: "Contradiction", 4: "Contradiction"}


def test_collection_stops_at_the_first_unreadable_object(spark):
    objects = spark.createDataFrame([(1, 2, "RUN"), (1, 3, "FENCE"), (1, 5, "torn"), (1, 6, "RUN"), (2, 1, "RUN")], "partition bigint, coordinate bigint, kind string")
    cuts = spark.createDataFrame([(1, 1, 7), (2, 1, 1)], "partition bigint, old_cut bigint, new_cut bigint")
    got = {r.coordinate: r.ruling for r in R.collected(objects, cuts).collect()}
    assert got == {2: "delete", 3: "keep", 4: "skip", 5: "stop", 6: "unreached", 7: "unreached"}


@pytest.mark.parametrize("cut,run,room", [(0, 1, True), (0, 1023, True), (0, 1024, False), (5, 1028, True), (5, 1029, False), (5, 5, False)])
def test_room_for_a_takeover(spark, cut, run, room):
    assert spark.range(1).select(R.takeover_room(F.lit(cut), F.lit(run))).first()[0] is room


def test_subscriptions_confirmed_by_their_normal_form(spark):
    rows = [
        (0, "s", "webhook", None, [], "u", None, None, 400),
        (1, "s", "webhook", None, ["b", "a", "a"], "u", None, None, 201),
        (2, "s", "webhook", None, ["a", "b"], "u", 30000, None, 200),
        (3, "s", "webhook", "x/*", ["a", "b"], "u", 30000, None, 409),
        (4, "s", "webhook", None, ["a", "b"], "u", 999, None, 400),
        (5, "t", None, "x/*", None, "u", None, None, 400),
        (6, "t", "pull-wake", "x/*", None, "w", None, "d", 201),
        (7, "t", "pull-wake", "x/*", None, "w", None, None, 409),
    ]
    df = spark.createDataFrame([r[:-1] for r in rows], "seq bigint, sub string, kind string, pattern string, streams array<string>, target string, lease_ms bigint, description string")
    assert {r.seq: r.status for r in S.confirmed(df).collect()} == {r[0]: r[-1] for r in rows}


def test_leases_against_a_timer_played_through(spark):
    rnd, at, log = random.Random(9), 0, []
    for seq in range(400):
        at += rnd.choice([0, 1, 3, 20])
        log.append((seq, rnd.randrange(3), at, rnd.choice(["ack", "ack", "done", "append"])))
    expect, state = {}, {}
    for seq, sub, now, act in log:
        ends, came = state.get(sub, (None, None))
        if act == "append":
            state[sub] = (ends, now if came is None else came)
            continue
        expired = ends is not None and now >= ends
        expect[seq] = ("expired" if expired else "claims" if ends is None else "holds", ends if expired and came is not None and came < ends else None)
        state[sub] = (now + 10 if act == "ack" else None, None)
    df = spark.createDataFrame(log, "seq bigint, sub bigint, at bigint, act string")
    assert {r.seq: (r.verdict, r.wake_at) for r in S.leases(df, 10).collect()} == expect


def test_webhook_addresses(spark):
    safe = {
        "https://a.example/x": True, "HTTPS://A.example": True, "https://8.8.8.8/": True, "https://172.15.0.1": True, "https://172.32.0.1": True,
        "http://localhost:3000/x": True, "http://127.0.0.9": True, "http://a.example": False, "https://localhost": False, "https://10.1.2.3": False,
        "https://172.16.0.1": False, "https://172.31.255.1:8": False, "https://192.168.0.1": False, "https://169.254.1.1": False, "https://0.0.0.0": False,
        "https://127.0.0.1": False, "https://[::1]/": False, "https://u:p@10.0.0.1/": False, "ftp://a.example": False, "": False, "no url": False,
    }
    rows = spark.createDataFrame([(u,) for u in [*safe, None]], "u string").select("u", S.webhook_safe(F.col("u")).alias("safe")).collect()
    assert {r.u: r.safe for r in rows} == {**safe, None: False}


def test_deleted_streams_are_kept_for_living_forks_only(spark):
    rnd = random.Random(3)
    rows = [(i, None if i == 0 else rnd.randrange(max(0, i - 4), i), rnd.random() < 0.7) for i in range(60)]
    children = {}
    for i, parent, _ in rows:
        children.setdefault(parent, []).append(i)
    dead = {i: d for i, _, d in rows}

    def lives(i):
        return not dead[i] or any(map(lives, children.get(i, [])))

    expect = {i: ("live", 200) if not dead[i] else ("soft", 410) if lives(i) else ("gone", 404) for i in dead}
    df = spark.createDataFrame(rows, "stream bigint, parent bigint, deleted boolean")
    assert {r.stream: (r.state, r.status) for r in streams.retained(df).collect()} == expect


def test_barrier_waits_for_the_batch_that_commits_the_transaction(spark):
    changes = spark.createDataFrame([(1, 7), (3, 8), (4, 7), (12, 9)], "off bigint, txid bigint")
    got = streams.txid_barrier(spark.createDataFrame([(7,), (9,), (1,)], "txid bigint"), changes, 10).collect()
    assert {r.txid: (r.seen, r.resolved) for r in got} == {7: (1, 4), 9: (12, 12), 1: (None, None)}


def test_limits_against_balances_kept_step_by_step(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.randrange(4), rnd.randrange(4), rnd.randrange(1, 9), i, rnd.random() < 0.3) for i in range(200)]
    balance, expect = {}, {}
    for i, debit, credit, amount, _, pending in rows:
        if debit == credit:
            expect[i] = "accounts_must_be_different"
            continue
        d, c = balance.setdefault(debit, [0] * 4), balance.setdefault(credit, [0] * 4)  # debits, credits: all, posted
        over = debit % 2 == 0 and d[0] + amount > d[3], credit % 2 == 1 and c[1] + amount > c[2]
        expect[i] = "exceeds_credits" if over[0] else "exceeds_debits" if over[1] else "ok"
        d[0] += amount
        c[1] += amount
        if not pending:
            d[2] += amount
            c[3] += amount
    df = spark.createDataFrame(rows, "id bigint, debit bigint, credit bigint, amount bigint, ts bigint, pending boolean")
    assert {r.id: r.verdict for r in K.limits(df, lambda a: a % 2 == 0, lambda a: a % 2 == 1).collect()} == expect


def test_flush_reasons_in_their_order(spark):
    rows = [(0, True, True, 9, None), (1, True, True, 9, 0), (1, False, True, 9, 0), (1, False, False, 9, 0), (1, False, False, 0, None), (1, False, False, 0, 5), (1, False, False, 0, 4)]
    df = spark.createDataFrame(rows, "facts bigint, closing boolean, full boolean, size bigint, waited bigint").select("*", F.monotonically_increasing_id().alias("i"))
    got = df.select("i", R.flush_reason(F.col("facts"), F.col("closing"), F.col("full"), F.col("size"), 9, F.col("waited"), 5).alias("r")).orderBy("i").collect()
    assert [r.r for r in got] == ["idempotent", "closing", "full", "budget", "spacing", "spacing", "arm"]
    assert [spark.range(1).select(R.hard_full(F.lit(n), F.lit(b))).first()[0] for n, b in ((4095, 4_193_408), (4096, 0), (1, 4_193_409))] == [False, True, True]
