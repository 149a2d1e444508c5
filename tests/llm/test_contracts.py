"""Every registered query over whole tables of the smallest size, against a plain version of what it returns."""

import hashlib
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import regex
import xxhash
import zstandard
from tokenizers import Tokenizer

from tests.llm.test_texts import sets_of
from tidemark.llm import quality_nbsvm, syncmers, toxic_zstd
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"



@pytest.fixture(scope="module")
def docs():
    return sorted((r[0], r[1]) for r in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def library():
    one = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    one.no_padding()
    one.no_truncation()
    return one


def run(spark, name):
    return [r.asDict() for r in QUERIES[name](spark, SF).collect()]


def by_id(rows):
    found = {r["doc_id"]: r for r in rows}
    assert len(found) == len(rows)
    return found


def hashed(*values):
    """Spark's xxhash64 of strings (str), bigints (int) and ints (np.int32): each value is hashed with the hash before it as the seed."""
    h = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else int(v).to_bytes(4 if isinstance(v, np.int32) else 8, "little", signed=True)
        h = xxhash.xxh64_intdigest(raw, h)
    return h - (1 << 64) if h >> 63 else h


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_op1(spark):
    rows = {i: np.array(v, float) for i, v, *_ in duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall() if v and any(v)}
    hits, of, got = 0, 0, {}
    for r in run(spark, "op1_ann_srs"):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in rows if i % 100 == 0}
    for q, mine in got.items():
        want = sorted((float(np.sqrt(((rows[i] - rows[q]) ** 2).sum())), i) for i in rows if i != q)[:10]
        mine.sort()
        assert [r for r, _, _ in mine] == list(range(1, len(want) + 1))
        assert [(s, i) for _, i, s in mine] == sorted((s, i) for _, i, s in mine)
        assert all(s == pytest.approx(float(np.sqrt(((rows[i] - rows[q]) ** 2).sum())), rel=1e-12) for _, i, s in mine)
        hits += len({i for _, i in want} & {i for _, i, _ in mine})
        of += len(want)
    assert hits >= 0.9 * of


def test_op2(spark, docs):
    """One bucket a shard at this size: the shard of highest random weight, and Fisher-Yates over the rows by doc_id."""
    heaviest = lambda i, n: max((hashed(str(i), np.int32(s), np.int32(1)), s) for s in range(n))[1]
    text, members, want = dict(docs), {}, {}
    for i, _ in docs:
        members.setdefault(heaviest(i, 24), []).append(i)
    for shard, ids in members.items():
        draws = np.random.default_rng([1, shard, 0]).integers(0, np.arange(len(ids), 1, -1)).tolist()
        for last in range(len(ids) - 1, 0, -1):
            j = draws[len(ids) - 1 - last]
            ids[last], ids[j] = ids[j], ids[last]
        want |= {i: (shard, slot) for slot, i in enumerate(ids)}
    got = by_id(run(spark, "op2_shard_shuffle"))
    assert got.keys() == want.keys()
    for i, r in got.items():
        raw = (text[i] or "").encode()
        assert (r["shard"], r["slot"], r["grown_shard"], r["law"]) == (*want[i], heaviest(i, 25), "key")
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))


def test_op4(spark, docs, library):
    got = by_id(run(spark, "op4_bpe_automaton"))
    assert len(got) == len(docs)
    for i, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def training(docs, label, n, held):
    """The labelled rows that may train, by doc_id: all of them, as they are fewer than the sample's bound."""
    text, at = dict(docs), {"quality": 1, "toxic": 2}[label]
    rows = sorted({(r[0], r[at]) for r in duckdb.sql(f"SELECT doc_id, quality, toxic FROM '{SF}/labels.parquet'").fetchall() if zlib.crc32(str(r[0]).encode()) % n != held and r[at] in (0, 1) and text.get(r[0]) is not None})
    return [text[i] for i, _ in rows], np.array([y for _, y in rows]), np.array([hashed(i, np.int32(8)) for i, _ in rows])


def check_scores(got, docs, n, held, score):
    assert len(got) == len(docs)
    for i, t in docs:
        want = score(t or "")
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % n == held)
        assert got[i]["score"] == pytest.approx(want, abs=1e-5)
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.5)


def plain_features(text):
    raw, found = text.encode(), set()
    for n in (1, 2, 3):
        for i in range(len(raw) - n + 1):
            h = n
            for b in raw[i : i + n]:
                h = (h * 257 + b) % 2**32
            found.add((h * 2654435761) % 2**32 >> (32 - quality_nbsvm.BITS))
    if words := raw.split():
        again, base, n = sum(a == b for a, b in zip(words, words[1:])), 1 << quality_nbsvm.BITS, len(words)
        found |= {base + min(15, n.bit_length()), base + 16 + 8 * len(set(words)) // n, base + 32 + (min(7, 1 + 16 * again // n) if again else 0)}
    return sorted(found)


def test_op5(spark, docs):
    """Log-count ratios, the hinge-loss optimum and the scores, each by plain Python."""
    texts, y, h = training(docs, "quality", 3, 1)
    model = quality_nbsvm.Model(texts, y, h)
    sets = [plain_features(t) for t in texts]
    seen = [k for k in range(len(y)) if h[k] % 3]
    places = quality_nbsvm.PLACES
    total = {c: places + sum(len(sets[k]) for k in seen if y[k] == c) for c in (0, 1)}
    count = {c: Counter(f for k in seen if y[k] == c for f in sets[k]) for c in (0, 1)}
    ratio = lambda f: math.log((1 + count[1][f]) / total[1]) - math.log((1 + count[0][f]) / total[0])
    for f in sorted({f for s in sets for f in s})[::50]:
        assert model.ratio[f] == pytest.approx(ratio(f), abs=1e-5)
    # the objective of what was fitted is near a lower bound, the dual of many more passes
    vector = {k: np.array([ratio(f) for f in sets[k]]) for k in seen}
    vector = {k: v / (np.linalg.norm(v) or 1) for k, v in vector.items()}
    sign, most = {k: 2 * int(y[k]) - 1 for k in seen}, {k: len(seen) / (2 * sum(y[j] == y[k] for j in seen)) for k in seen}
    w, bias, alpha = np.zeros(places), 0.0, dict.fromkeys(seen, 0.0)
    for _ in range(300):
        for k in seen:
            step = min(max(alpha[k] - (sign[k] * (w[sets[k]] @ vector[k] + bias) - 1) / 2, 0.0), most[k]) - alpha[k]
            alpha[k] += step
            w[sets[k]] += step * sign[k] * vector[k]
            bias += step * sign[k]
    bound = sum(alpha.values()) - (w @ w + bias**2) / 2
    mine = np.divide(model.weights, model.ratio, out=np.zeros(places), where=model.ratio != 0)
    primal = (mine @ mine + model.bias**2) / 2 + sum(most[k] * max(0.0, 1 - sign[k] * (mine[sets[k]] @ vector[k] + model.bias)) for k in seen)
    assert bound * 0.999 <= primal <= bound * 1.03

    def score(text):
        found = plain_features(text)
        norm = math.sqrt(sum(float(model.ratio[f]) ** 2 for f in found)) or 1.0
        margin = sum(float(model.weights[f]) for f in found) / norm + model.bias
        return 1 / (1 + math.exp(-(model.curve[0] * margin + model.curve[1])))

    check_scores(by_id(run(spark, "op5_quality_nbsvm")), docs, 3, 1, score)


def test_op6(spark, docs, library):
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in docs}
    rows, taken = run(spark, "op6_best_fit"), {}
    assert {(r["doc_id"], r["piece"]) for r in rows} == {(i, p) for i, x in ids.items() for p in range(-(-len(x) // 2048))}
    assert len(rows) == sum(-(-len(x) // 2048) for x in ids.values())
    for r in rows:
        part = ids[r["doc_id"]][2048 * r["piece"] :][:2048]
        assert (r["start"], r["length"], r["ids_crc32"]) == (2048 * r["piece"], len(part), crc(part))
        taken.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in taken.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    # a plain best fit over the same pieces, longest first
    free = []
    for n in sorted((r["length"] for r in rows), reverse=True):
        fits = [f for f in free if f >= n]
        if fits:
            free.remove(min(fits))
        free.append((min(fits) if fits else 2048) - n)
    assert len(taken) <= 1.1 * len(free) + 1


def test_op7(spark, docs):
    sets = {i: sets_of(t, 3) for i, t in docs}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    got = by_id(run(spark, "op7_minhash_oph"))
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def test_op8(spark, docs, library):
    got, start = by_id(run(spark, "op8_repair_tokens")), 0
    assert len(got) == len(docs)
    for i, t in docs:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)


def test_op9(spark, docs):
    """Windows, lengths under either dictionary, features and the curve, each by plain Python."""
    texts, y, h = training(docs, "toxic", 5, 0)
    model = toxic_zstd.Model(texts, y, h)

    def length(window, dictionary):
        d = zstandard.ZstdCompressionDict(dictionary or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=toxic_zstd.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(window))

    def score(text):
        windows = [b""]
        for w in text.lower().encode().split():
            if len(windows[-1]) >= toxic_zstd.WINDOW - 1:
                windows.append(b"")
            windows[-1] += (b" " if windows[-1] else b"") + w
        gain = sorted((length(b" " + w + b" ", model.ordinary) - length(b" " + w + b" ", model.toxic) for w in windows if w), reverse=True) or [0]
        good, n = [g for g in gain if g >= toxic_zstd.LEAST_GAIN], len(gain)
        x = [gain[0], sum(gain[:2]), sum(gain[:3]), math.log1p(sum(good)), sum(good) / (10 + n), sum(good) / (40 + n), len(good) / (10 + n), math.log1p(n)]
        z = sum(c * (a - m) / s for c, a, m, s in zip(model.curve, x, model.center, model.scale)) + model.curve[-1]
        return 1 / (1 + math.exp(-min(max(z, -30), 30)))

    short = [(i, t) for i, t in docs if len(t or "") <= 4000]  # a compressor for each window is slow
    got = by_id(run(spark, "op9_toxic_zstd"))
    assert len(got) == len(docs)
    check_scores({i: got[i] for i, _ in short}, short, 5, 0, score)


def plain_fingerprint(text):
    words = regex.findall(syncmers.WORDS, text)
    h = [hashed(w) for w in words]
    pairs = [hashed(a, b) for a, b in zip(h, h[1:])]
    out, last = [], 0
    for i in range(len(words) - syncmers.K + 1):
        inner = pairs[i : i + syncmers.K - syncmers.S + 1]
        if min(inner) in (inner[0], inner[-1]):
            out.append((hashed(pairs[i], pairs[i + 2], pairs[i + 3]), i - last))
            last = i
    return out, words


def test_op10(spark, docs):
    """Edited texts, anchors by hashes of a library of their own, and likeness from the returned strings alone."""
    got = by_id(run(spark, "op10_syncmers"))
    assert len(got) == len(docs)

    def entries(x):
        return set(x.split())

    def dice(a, b):
        return 2 * len(entries(a) & entries(b)) / (len(entries(a)) + len(entries(b))) if a or b else 1.0

    for k, (i, t) in enumerate(docs):
        j, after = docs[(k + 1) % len(docs)]
        t, after, r = t or "", after or "", got[i]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for text, mine in ((t, r["fingerprint"]), (edited, r["edited_fingerprint"])):
            want, words = plain_fingerprint(text)
            if want:
                assert mine == " ".join(f"{h % 2**64 >> 32:08x}+{far}" for h, far in want)
            else:
                assert len(mine.split()) == (1 if words else 0)
        assert r["near_edited"] == pytest.approx(dice(r["fingerprint"], r["edited_fingerprint"]))
        assert r["near_next"] == pytest.approx(dice(r["fingerprint"], got[j]["fingerprint"]))
