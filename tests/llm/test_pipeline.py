"""Each stage of the pipeline on its own input, and all of them together."""

from collections import Counter

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.test_texts import edited, prose  # noqa: F401
from tests.llm.test_tokens import check_packing


def test_run(spark, tmp_path):
    import random

    r = random.Random(2)
    docs, labels = [], []
    for i in range(400):
        text = prose(r, 80)
        if i % 4 == 1:
            text = " ".join(x for w in text.split() for x in ([w, r.choice(["nitwit", "blockhead"])] if r.random() < 0.15 else [w]))
        if i % 4 == 2:
            text = " ".join(w + "&&&" for w in text.split())
        docs.append((i, text, "en", "src", len(text)))
        labels.append((i, int(i % 4 != 2), int(i % 4 == 1)))
    docs += [(1000 + i, docs[4 * i][1], "en", "src", 1) for i in range(20)] + [(2000, None, None, None, None)] * 2
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, str(tmp_path))
        assert table.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        sizes.append(table.count())
    kept = Counter(x["doc_id"] for x in table.collect())
    assert sizes[0] > sizes[1] > sizes[2]
    clean = [i for i in range(0, 400) if i % 4 in (0, 3)]
    assert sum(kept[i] for i in clean) >= 0.95 * len(clean)
    assert sum(kept[i] for i in range(400) if i % 4 in (1, 2)) <= 20
    assert sum(kept[1000 + i] for i in range(20)) <= 1
    assert max(kept.values()) == 1
    data = [(x["doc_id"], x["text"]) for x in table.collect()]
    check_packing(corpus_pipeline.run(spark, str(tmp_path)).collect(), data, Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 2048)
