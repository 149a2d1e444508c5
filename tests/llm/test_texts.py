"""Near-duplicates, shards, classifiers, fingerprints and revisits against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann_srs, labelled, minhash_oph, quality_nbsvm, shard_shuffle, shared, syncmers, token_text, toxic_zstd, warc_revisit

WORDS = [a + b for a in ("er", "th", "an", "on", "in", "ti", "ed", "st") for b in ("ha", "re", "ou", "ly", "nd", "", "sh", "ble")]


def prose(r, n):
    return " ".join(r.choices(WORDS, k=n))


def edited(r, text, share):
    return " ".join(r.choice(WORDS) if r.random() < share else w for w in text.split())


def corpus():
    r = random.Random(9)
    out = [prose(r, r.choice([1, 2, 3, 8, 40, 200])) for _ in range(60)]
    base = prose(r, 150)
    out += [base] * 20 + [edited(r, base, s) for s in (0.005, 0.01, 0.02, 0.03, 0.05) for _ in range(25)]
    chain = prose(r, 120).split()
    out += [" ".join(chain[k : k + 100]) for k in range(0, 20, 4)]
    out += ["", None, "  \t ", "one", "ONE", "one two", "One  two", prose(r, 30_000), "x" * 100_000]
    return list(enumerate(out))


def sets_of(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize(("k", "percent", "bands", "rows"), [(3, 85, 32, 6), (5, 80, 40, 5)])
def test_near_duplicates(spark, k, percent, bands, rows):
    data = corpus()
    df = spark.createDataFrame([(i, t, i, "s") for i, t in data], "doc_id long, text string, key long, bucket string").repartition(4)
    got = {r["doc_id"]: r for r in minhash_oph.near_duplicates(df, k, percent, bands, rows).collect()}
    sets = [sets_of(t, k) for _, t in data]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    for i in range(len(sets)):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), root(i), root(i) == i)
    assert minhash_oph.near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_in_a_hot_bucket(spark):
    """Hundreds of versions of one template, too far from each other for links, and pairs of near copies among them."""
    r = random.Random(14)  # with this seed each pair shares a bucket
    head, texts = prose(r, 20), []
    for i in range(700):
        words = [f"{w}{i}" for w in prose(r, 12).split()]
        texts.append(" ".join([head, *words]))
        if i % 20 == 0:
            texts.append(" ".join([head, *words[:-1], "end"]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {x["doc_id"]: x["component_id"] for x in minhash_oph.near_duplicates(df, bands=2, rows=1).collect()}
    sets = [sets_of(t, 3) for t in texts]
    for i in range(len(texts)):
        copy = i > 0 and texts[i].endswith(" end")
        assert not copy or 100 * len(sets[i] & sets[i - 1]) >= 85 * len(sets[i] | sets[i - 1])
        assert got[i] == (i - 1 if copy else i)


def test_sets_of_a_slice():
    texts = pa.array([t or "" for _, t in corpus()[:120]])
    with np.errstate(over="ignore"):
        whole = [x.tolist() for x in minhash_oph.shingle_sets(texts, 3)]
        assert [x.tolist() for x in minhash_oph.shingle_sets(texts.slice(40, 30), 3)] == whole[40:70]
        for most in (1, 2000, 1 << 20):
            cut = token_text.batches(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), "text", most)
            assert [x.tolist() for b in cut for x in minhash_oph.shingle_sets(b.column("text"), 3)] == whole


def test_near_duplicates_odd_keys(spark):
    df = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (3, "A b c d"), (4, None)], "doc_id long, text string")
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in minhash_oph.near_duplicates(df).collect())
    assert got == {(None, None, True): 1, (5, 3, False): 2, (3, 3, True): 1, (4, 4, True): 1}


def test_near_duplicates_of_one_key_with_several_texts(spark):
    """A key joins what any of its rows is linked with."""
    a, b, c = "a b c d e", "f g h i j", "k l m n o"
    df = spark.createDataFrame([(5, a), (7, a), (3, b), (5, b), (9, c), (9, c + " "), (8, a)], "doc_id long, text string")
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in minhash_oph.near_duplicates(df).collect())
    assert got == {(5, 3, False): 2, (7, 3, False): 1, (8, 3, False): 1, (3, 3, True): 1, (9, 9, True): 2}
    # two texts of one key, each with near copies of its own
    r = random.Random(3)
    one, other = prose(r, 60), prose(r, 60)
    df = spark.createDataFrame([(1, one), (1, other), (2, one + " end"), (3, other + " end"), (4, prose(r, 60))], "doc_id long, text string")
    assert Counter((r["doc_id"], r["component_id"]) for r in minhash_oph.near_duplicates(df).collect()) == {(1, 1): 2, (2, 1): 1, (3, 1): 1, (4, 4): 1}


def test_densified_sketch_estimates_likeness():
    one = minhash_oph.Sketcher(32, 6)
    r = np.random.default_rng(0)
    for n in (8, 40, 2000):
        same = []
        for _ in range(60):
            pool = np.unique(r.integers(0, 1 << 63, n * 2, dtype=np.uint64) * np.uint64(2))
            r.shuffle(pool)
            a, b = np.sort(pool[:n]), np.sort(pool[n // 4 : n // 4 + n])
            same.append((one.sketch(a) == one.sketch(b)).mean())
        both = n - n // 4
        assert abs(np.mean(same) - both / (2 * n - both)) < 0.08


def test_shards(spark):
    data = [(i, t) for i, t in corpus()] + [(7, "same"), (7, "same"), (None, "n")]
    df = spark.createDataFrame([(i, t, "c", 3) for i, t in data], "doc_id long, text string, shard string, size int").repartition(3)
    out = shard_shuffle.shuffle_shards(df, 5, bucket_bytes=20_000).collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter(data)
    by, of = {}, {}
    for r in out:
        raw = (r["text"] or "").encode()
        assert r["size"] == len(raw) + 8 and r["text_crc32"] == zlib.crc32(raw) and r["grown_shard"] in (r["shard"], 5)
        by.setdefault(r["shard"], []).append(r["slot"])
        assert of.setdefault(r["doc_id"], r["shard"]) == r["shard"]
    assert all(sorted(x) == list(range(len(x))) for x in by.values()) and len(by) == 5
    again = shard_shuffle.shuffle_shards(df, 5, bucket_bytes=20_000).collect()
    assert {(r["doc_id"], r["text"], r["slot"]) for r in out if r["text"] != "same"} == {(r["doc_id"], r["text"], r["slot"]) for r in again if r["text"] != "same"}
    assert shard_shuffle.shuffle_shards(df.limit(0), 5).count() == 0


def labelled_corpus(spark, bad_of):
    r = random.Random(3)
    docs, labels = [], []
    for i in range(900):
        bad = i % 3 == 0
        text = prose(r, r.choice([20, 60, 200]))
        docs.append((i, bad_of(r, text) if bad else text, "x"))
        if i % 5:
            labels.append((i, int(not bad), int(bad)))
    docs += [(1000, "", "x"), (1001, None, "x"), (1002, "w" * 200_000, "x")]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(out, wrong):
    rows = {r["doc_id"]: r for r in out.collect()}
    assert len(rows) == 903 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows.values())
    return np.mean([rows[i]["predicted"] == (wrong if i % 3 == 0 else 1 - wrong) for i in range(0, 900, 5)])  # rows without a label


def test_quality(spark):
    docs, labels = labelled_corpus(spark, lambda r, t: " ".join(w + r.choice(["###", "&&&"]) for w in t.split()))
    model = quality_nbsvm.fit(docs, labels, F.lit(True))
    assert accuracy(quality_nbsvm.score(docs, model), 0) > 0.97
    nothing = quality_nbsvm.fit(docs, labels.limit(0), F.lit(True))
    assert {r["score"] for r in quality_nbsvm.score(docs, nothing).collect()} == {0.5}
    assert quality_nbsvm.score(docs.limit(0), model).count() == 0


def test_toxic(spark):
    insult = ["blockhead", "nitwit", "dimwit", "lowlife"]
    docs, labels = labelled_corpus(spark, lambda r, t: " ".join(x for w in t.split() for x in ([w, r.choice(insult)] if r.random() < 0.15 else [w])))
    model = toxic_zstd.fit(docs, labels, F.lit(True))
    assert accuracy(toxic_zstd.score(docs, model), 1) > 0.93
    nothing = toxic_zstd.fit(docs, labels.where("toxic = 0"), F.lit(True))
    assert len({r["score"] for r in toxic_zstd.score(docs, nothing).collect()}) == 1
    assert toxic_zstd.score(docs.limit(0), model).count() == 0


def test_toxic_words_of_a_small_language():
    """Words of one toxic text in 100 enter the dictionary; a common word does not."""
    r = random.Random(4)
    texts = [prose(r, 30) + (" bomenteco" if i % 200 == 1 else " blockhead" if i % 2 else "") for i in range(3000)]
    model = toxic_zstd.Model(texts, np.arange(3000) % 2, np.array([r.randrange(1 << 40) for _ in texts]))
    assert b" bomenteco" in model.toxic and b" blockhead" in model.toxic
    assert len(model.toxic) - len(model.ordinary) < 300
    assert toxic_zstd.tail(2, 3, 0.5) == pytest.approx(0.5) and toxic_zstd.tail(0, 3, 0.5) == pytest.approx(1)


def test_windows_are_whole():
    r = random.Random(1)
    for n in (0, 1, 3, 500):
        text = prose(r, n)
        assert b"".join(toxic_zstd.windows(text.encode())).split() == text.encode().split()


def test_fold(spark):
    df = spark.range(50).withColumn("m", labelled.fold("id", 5))
    assert all(r["m"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in df.collect())


def brute_anchors(words, hash_of, k=syncmers.K, s=syncmers.S):
    """(run of words, words since the anchor before)."""
    out, last = [], 0
    for i in range(len(words) - k + 1):
        inner = [hash_of[tuple(words[i + j : i + j + s])] for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((tuple(words[i : i + k]), i - last))
            last = i
    return out or ([(tuple(words), 0)] if words else [])


def test_syncmers(spark):
    r = random.Random(8)
    texts = [prose(r, n) for n in (0, 1, 4, 5, 6, 40, 300)] + ["漢字かな" * 10, "y" * 1000, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x for x in df.select("doc_id", "text", syncmers.anchors(F.coalesce("text", F.lit(""))).alias("a"), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(syncmers.WORDS), F.lit(0)).alias("w")).collect()}
    pairs = {tuple(x["w"][i : i + 2]) for x in got.values() for i in range(len(x["w"]) - 1)}
    hashed = spark.createDataFrame([(list(p),) for p in pairs], "p array<string>").select("p", F.xxhash64(F.xxhash64(F.col("p")[0]), F.xxhash64(F.col("p")[1])).alias("h")).collect()
    hash_of = {tuple(x["p"]): x["h"] for x in hashed}
    names = {}
    for x in got.values():
        want = brute_anchors(x["w"], hash_of)
        assert [a & ((1 << syncmers.DISTANCE) - 1) for a in x["a"]] == [far for _, far in want]
        assert [names.setdefault(run, a >> syncmers.DISTANCE) for (run, _), a in zip(want, x["a"], strict=True)] == [a >> syncmers.DISTANCE for a in x["a"]]
        assert all(0 < far <= syncmers.K - syncmers.S for _, far in want[1:])
    assert len(set(names.values())) == len(names)
    assert "".join(got[7]["w"]) == texts[7] and len(got[7]["w"]) == 40


def test_syncmers_of_short_texts(spark):
    """Every text with words has an anchor, and different short texts are not alike."""
    r = random.Random(14)
    texts = sorted({prose(r, n) for n in (1, 4, 5, 5, 5, 6, 6, 7) for _ in range(30)})
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", syncmers.anchors(F.col("text")).alias("a"), syncmers.fingerprint(syncmers.anchors(F.col("text"))).alias("f"))
    rows = df.collect()
    assert all(x["a"] and x["f"] for x in rows)
    assert len({x["f"] for x in rows}) == len(rows)
    pairs = spark.createDataFrame(list(zip(texts, texts[1:])), "x string, y string")
    assert max(x[0] for x in pairs.select(syncmers.likeness(syncmers.anchors(F.col("x")), syncmers.anchors(F.col("y")))).collect()) < 1


def test_next_document(spark):
    data = [(i * 3, t) for i, t in corpus()]
    df = spark.createDataFrame([(i, t, "r") for i, t in data], "doc_id long, text string, range string").repartition(3)
    got = {r["doc_id"]: r for r in syncmers.with_next(df, range_bytes=30_000).collect()}
    order = [t or "" for _, t in data]
    for k, (i, t) in enumerate(data):
        assert got[i]["text"] == (t or "") and got[i]["next_text"] == order[(k + 1) % len(order)]
    one = syncmers.with_next(df.where("doc_id = 0")).collect()
    assert one[0]["next_text"] == one[0]["text"]
    assert syncmers.with_next(df.limit(0)).count() == 0
    ties = spark.createDataFrame([(None, "n"), (1, "a"), (1, "a"), (1, "b")], "doc_id long, text string")
    assert Counter(r["next_text"] for r in syncmers.with_next(ties).collect()) == Counter(["n", "a", "a", "b"])


@pytest.mark.parametrize("seed", range(3))
def test_next_document_of_hot_keys(spark, seed):
    """Null and repeated keys with the rows of many ranges, with equal and different texts."""
    r = random.Random(seed)
    data = [(r.choice([None, 7, 7, 7, 8, r.randrange(100)]), r.choice(["same text", "x", None, prose(r, 20), prose(r, 200)])) for _ in range(400)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    hashes = {x["text"]: x["h"] for x in df.select(F.coalesce("text", F.lit("")).alias("text")).distinct().withColumn("h", F.xxhash64("text")).collect()}
    order = sorted(((k, t or "") for k, t in data), key=lambda x: (x[0] is not None, x[0] or 0, hashes[x[1]]))
    want = Counter((k, t, order[(i + 1) % len(order)][1]) for i, (k, t) in enumerate(order))
    rows = syncmers.with_next(df, range_bytes=2000)
    assert Counter((x["doc_id"], x["text"], x["next_text"]) for x in rows.collect()) == want


@pytest.mark.parametrize("parts", [1, 3, 40, 2000])
def test_ranges_ascend(spark, parts):
    r = random.Random(parts)
    rows = [(r.choice([None, 5, 5, r.randrange(50), r.randrange(10_000)]), r.randrange(1 << 40)) for _ in range(3000)]
    df, split = shared.ranged(spark.createDataFrame(rows, "key long, tie long").repartition(3), "key", "tie", parts, "range")
    got = sorted(((x["key"] is not None, x["key"] or 0, x["tie"], x["range"]) for x in df.collect()))
    assert len(got) == 3000 and [x[3] for x in got] == sorted(x[3] for x in got)
    assert split == (parts > 3)
    if parts > 1:
        assert max(Counter(x[3] for x in got).values()) < 4 * 3000 / parts + 30


def test_likeness(spark):
    a = prose(random.Random(1), 60)
    b = a[:120] + " other words " + a[120:]
    df = spark.createDataFrame([(a, a), (a, b), (a, "zz"), ("", ""), ("", a)], "x string, y string")
    got = [r[0] for r in df.select(syncmers.likeness(syncmers.anchors(F.col("x")), syncmers.anchors(F.col("y")))).collect()]
    assert got[0] == 1 and 0 < got[1] < 1 and got[2] == 0 and got[3] == 1 and got[4] == 0


def test_ann_recall_and_odd_vectors(spark):
    r = np.random.default_rng(5)
    centers = r.standard_normal((30, 24))
    x = (centers[r.integers(0, 30, 3000)] + 0.4 * r.standard_normal((3000, 24))).astype(np.float32)
    x[500:1500] = x[500]  # a hot vector
    rows = [(i, v.tolist(), "e") for i, v in enumerate(x)] + [(9000, None, "e"), (9100, [0.0] * 24, "e"), (9200, [float("nan")] * 24, "e"), (9300, [1.0] * 7, "e"), (9400, [None] * 24, "e")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cell string").repartition(4)
    out = ann_srs.search(df, F.col("vec_id") % 100 == 0).toPandas()
    y, ids, hits = x.astype(float), np.arange(3000), 0
    for q in range(0, 3000, 100):
        far = ((y - y[q]) ** 2).sum(1)
        m = ids != q
        best = ids[m][np.lexsort((ids[m], far[m]))[:10]]
        mine = out[out["query_id"] == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11))
        assert mine["score"].tolist() == np.sqrt(far[mine["vec_id"]]).tolist()
        hits += len({*best} & {*mine["vec_id"]})
    assert hits >= 0.95 * 300 and set(out["query_id"]) == set(range(0, 3000, 100))
    few = ann_srs.search(df.where("vec_id < 4"), F.col("vec_id") == 0).collect()
    assert len(few) == 3
    assert ann_srs.search(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_chi_square():
    assert abs(ann_srs.chi_square_quantile(0.95, 10) - 18.307038) < 1e-4


def test_canonical_url(spark):
    cases = {"HTTP://User@Ex.COM:80/a?b#c": "http://ex.com/a?b", "https://x.org": "https://x.org/", "https://x.org:443?q": "https://x.org/?q", "http://x.org:8080/p?": "http://x.org:8080/p", "mailto:x": "mailto:x"}
    df = spark.createDataFrame([(u,) for u in cases], "u string").select("u", warc_revisit.canonical_url(F.col("u")).alias("c"))
    assert {r["u"]: r["c"] for r in df.collect()} == cases


@pytest.mark.parametrize("span_rows", [7, 20_000])
def test_revisits(spark, span_rows):
    r = random.Random(6)
    rows = []
    for i in range(300):
        url = r.choice(["http://hot.org/", "http://HOT.org", "http://a.org/x", "http://b.org/y"]) if i % 50 else None
        kind = r.choice(["response", "revisit"])
        etag = r.choice(['"1"', 'W/"1"', '"2"', None])
        rows.append((i, r.choice([None, *range(100)]), url, kind, etag, r.choice([None, "mon"]), r.choice([None, "SHA", "sha"]), {"Date": f"d{i}", "Content-Length": f"{i}"}, "extra"))
    df = spark.createDataFrame(rows, "record_id long, ts long, url string, kind string, etag string, last_modified string, digest string, headers map<string,string>, span string")
    got = {x["record_id"]: x for x in warc_revisit.resolve(df, span_rows).collect()}
    assert len(got) == 300
    canon = lambda u: {"http://HOT.org": "http://hot.org/"}.get(u, u)
    weak = lambda e: e and e.removeprefix("W/")
    for i, ts, url, kind, etag, modified, digest, headers, _ in rows:
        x = got[i]
        if kind == "response":
            assert x["status"] == "response" and x["headers"] == headers
            continue
        before = [q for q in rows if ts is not None and url and q[3] == "response" and q[1] is not None and q[2] and canon(q[2]) == canon(url) and (q[1], q[0]) < (ts, i)]
        if not before:
            assert x["status"] == "unresolved"
            continue
        full = max(before, key=lambda q: (q[1], q[0]))
        checks = [a == b for a, b in ((weak(etag), weak(full[4])), (modified, full[5]), (digest and digest.lower(), full[6] and full[6].lower())) if a is not None and b is not None]
        good = bool(checks) and all(checks)
        assert x["status"] == ("resolved" if good else "mismatch") and x["refers_to"] == (full[0] if good else None)
        if good:
            assert x["headers"] == {"date": f"d{i}", "content-length": full[7]["Content-Length"]}
    assert warc_revisit.resolve(df.limit(0)).count() == 0


def test_revisits_with_odd_headers_and_ids(spark):
    """Names that differ in case, null headers, repeated ids at other times, equal rows, a hot time."""
    schema = "record_id long, ts long, url string, kind string, etag string, last_modified string, digest string, headers map<string,string>, canonical int, span string"
    rows = [
        (1, 1, "http://a/", "response", "x", None, None, {"Date": "one", "date": "two", "X": "1"}, 0, ""),
        (2, 2, "HTTP://A", "revisit", "x", None, None, {"x": "3", "X": "2"}, 0, ""),
        (2, 3, "http://b/", "revisit", "x", None, None, None, 0, ""),
        (2, 2, "HTTP://A", "revisit", "x", None, None, {"x": "3", "X": "2"}, 0, ""),
        (3, None, "http://a/", "revisit", "x", None, None, None, 0, ""),
        (4, 4, "http://a/", "other", "x", None, None, None, 0, ""),
        (5, 5, "http://c/", "response", "z", None, None, None, 0, ""),
        (5, 5, "http://c/", "response", "y", None, None, {"B": "c"}, 0, ""),
        (6, 6, "http://c/", "revisit", 'W/y', None, None, None, 0, ""),
        (6, 5, "http://c/", "revisit", "y", None, None, None, 0, ""),
    ]
    df = spark.createDataFrame(rows, schema)
    got = sorted(((x["record_id"], x["canonical"], x["status"], x["refers_to"], tuple(sorted((x["headers"] or {}).items()))) for x in warc_revisit.resolve(df).collect()), key=repr)
    one = (2, "http://a/", "resolved", 1, (("date", "one"), ("x", "2")))
    want = [
        (1, "http://a/", "response", None, (("Date", "one"), ("X", "1"), ("date", "two"))), one, one, (2, "http://b/", "unresolved", None, ()), (3, "http://a/", "unresolved", None, ()), (4, "http://a/", "unresolved", None, ()),
        (5, "http://c/", "response", None, ()), (5, "http://c/", "response", None, (("B", "c"),)), (6, "http://c/", "resolved", 5, (("b", "c"),)), (6, "http://c/", "resolved", 5, (("b", "c"),)),
    ]
    assert got == sorted(want, key=repr)
    # one URL and one time for all records: cut by record id
    hot = [(i, 9, "http://h/", "response" if i % 7 == 0 else "revisit", str(i // 7) if i % 3 or i % 7 == 0 else "no", None, None, None, 0, "") for i in range(300)]
    out = {x["record_id"]: (x["status"], x["refers_to"]) for x in warc_revisit.resolve(spark.createDataFrame(hot, schema), span_rows=20).collect()}
    for i, _, _, kind, *_ in hot:
        assert out[i] == (("response", None) if kind == "response" else ("resolved", i // 7 * 7) if i % 3 else ("mismatch", None))
