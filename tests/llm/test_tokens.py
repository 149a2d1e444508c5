"""Encoding, packing and token files against the tokenizers library and brute force."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidemark.llm import best_fit, bpe, repair_tokens
from tidemark.llm.token_text import TextEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", None, "  \n ", "Hello <|endoftext|> wörld don't", "<|startoftext|><|endoftext|>x", "ΣΑΣ ǅ İstanbul ﬁ Å Å ́x 漢字かな 123 １２ a b c <| |> '",
    "x'S'T 're'LL it's", "\x1c\x1d a\x1cb", "\x85 a\x85b ​z", "a" * 5000 + "b" * 300 + "é" * 400, "the\tTHE\vx\fy\rz", "\U0001f600👍🏽 éé ",
    "ǰ ŉ ß ẞ ſ K Å ª º ×÷ ÿŸ", "Ünïcödé!!?? __x__ ###%%%",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def rows(n=60):
    r = random.Random(4)
    words = ["the", "erthha", "Zukeitpf", "ééreaux", "a,", "don't", "###", "42", "x" * 30, "漢字"]
    made = [" ".join(r.choices(words, k=r.choice([1, 5, 50, 700]))) for _ in range(n)]
    return [(i, t) for i, t in enumerate([*ODD, *made, made[0], made[0]])]


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("by_library", [False, True])
def test_encoder_equals_library(library, by_library):
    one = TextEncoder(PATH, by_library)
    texts = [t for _, t in rows()]
    ids, stops = one.encode(pa.array(texts))
    decoded = TextEncoder(PATH, False).split.decode(ids, stops).to_pylist()
    for k, t in enumerate(texts):
        want = ids_of(library, t)
        assert ids[stops[k] : stops[k + 1]].tolist() == want
        assert decoded[k] == library.decode(want, skip_special_tokens=False)


def test_every_vocabulary_word(library):
    one = TextEncoder(PATH, False)
    words = [w.removesuffix("</w>") for w in list(library.get_vocab())[::7] if w.isascii() and "<|" not in w]
    ids, stops = one.encode(pa.array(words))
    assert [ids[a:b].tolist() for a, b in zip(stops[:-1], stops[1:])] == [e.ids for e in library.encode_batch(words, add_special_tokens=False)]


def test_encode_decode(spark, library):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows()], "doc_id long, text string, ids string, key int")
    got = {r["doc_id"]: r for r in bpe.encode_decode(df, PATH).collect()}
    for i, t in rows():
        want = ids_of(library, t)
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == want and got[i]["n_tokens"] == len(want)
        assert got[i]["decoded"] == library.decode(want, skip_special_tokens=False)
    assert bpe.encode_decode(df.limit(0), PATH).count() == 0


def check_packing(out, data, library, size):
    by_doc, by_seq = {}, {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for i, t in data:
        want = np.array([*ids_of(library, t), 0], "<u4")
        at = 0
        for p in sorted(by_doc[i], key=lambda r: r["piece"]):
            body = want[at : at + p["length"]].tobytes()
            assert (p["start"], p["ids_crc32"], bytes(p["ids"])) == (at, zlib.crc32(body), body)
            assert p["length"] == size or p["start"] + p["length"] == len(want)
            at += p["length"]
        assert at == len(want)
    for seq in by_seq.values():
        at = 0
        for p in sorted(seq, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= size
    return len(by_seq)


@pytest.mark.parametrize("open_bins", [2, 1024])
def test_packing(spark, library, open_bins):
    data = rows()
    df = spark.createDataFrame([(i, t, 0) for i, t in data], "doc_id long, text string, piece int").repartition(5)
    out = best_fit.pack(df, PATH, size=256, open_bins=open_bins, together=2).collect()
    n = check_packing(out, data, library, 256)
    total = sum(len(ids_of(library, t)) + 1 for _, t in data)
    assert n <= -(-total // 256) * (1.5 if open_bins == 2 else 1.25) + 2
    assert best_fit.pack(df.limit(0), PATH).count() == 0


def test_packer_takes_best_fit_and_closes_fullest():
    p = best_fit.Packer(10, 2)
    assert p.add(6, "a") == [] and p.add(7, "b") == []
    assert p.add(3, "c") == [[1, 10, (0, "b"), (7, "c")]]  # the fuller bin that still has room
    assert p.add(5, "d") == []
    assert p.add(8, "e") == [[2 + 1, 8, (0, "e")]]  # it would be the fullest of three
    assert sorted(b[1] for b in p.rest()) == [5, 6]


def test_token_files(spark, library):
    data = rows()
    random.Random(1).shuffle(data)
    df = spark.createDataFrame([(i, t, "k") for i, t in data], "doc_id long, text string, key string").repartition(3)
    blobs = repair_tokens.write_files(df, PATH)
    got = {r["doc_id"]: r for r in repair_tokens.read_files(blobs).collect()}
    at = 0
    for i, t in sorted(data):
        want = [*ids_of(library, t), 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == want
        at += len(want)
    for blob in blobs.collect():
        for k, i in enumerate(blob["keys"]):
            assert repair_tokens.document(blob.asDict(), k).tolist() == [*ids_of(library, dict(data)[i]), 2]
    assert repair_tokens.read_files(repair_tokens.write_files(df.limit(0), PATH)).count() == 0


def test_repair_round_trip():
    r = np.random.default_rng(2)
    for case in ([7] * 501, r.integers(0, 3, 3000), r.zipf(1.3, 5000) % 50, [1, 2] * 400):
        seq = np.asarray(case, np.int32)
        stops = np.unique(np.concatenate([[0], r.integers(1, len(seq), 20), [len(seq)]]))
        rules, packed, places = repair_tokens.compress(seq, stops, 100, min_count=4, least_gain=0.0)
        assert len(packed) < len(seq) and len(rules)
        assert repair_tokens.expand(packed, rules, 100).tolist() == seq.tolist()
        size = repair_tokens.expansion_lengths(rules, 100)
        for k, n in enumerate(size):
            assert len(repair_tokens.expand(np.array([100 + k], np.int32), rules, 100)) == n
        for k in range(len(stops) - 1):
            part = repair_tokens.expand(packed[places[k] : places[k + 1]], rules, 100)
            assert part.tolist() == seq[stops[k] : stops[k + 1]].tolist()


def test_repeated_and_null_keys(spark):
    df = spark.createDataFrame([(None, "a b"), (None, None), (1, "x y"), (1, "x y")], "doc_id long, text string")
    assert bpe.encode_decode(df, PATH).count() == 4
    assert best_fit.pack(df, PATH).count() == 4
    out = repair_tokens.read_files(repair_tokens.write_files(df, PATH)).orderBy("start").collect()
    assert [r["doc_id"] for r in out] == [None, None, 1, 1]
    assert [r["start"] for r in out] == [0, *np.cumsum([r["n_tokens"] for r in out])[:-1].tolist()]
