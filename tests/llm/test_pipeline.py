"""The pipeline's stages on a small corpus."""

import random
from collections import Counter

import corpus_pipeline


def corpus(spark):
    draw = random.Random(9)
    text = lambda n: " ".join(f"w{draw.randint(0, 3000)}" for _ in range(n))
    texts = [text(draw.randint(60, 300)) for _ in range(80)]
    near = texts[0].split()
    texts += [" ".join([*near[:-1], f"edit{i}"]) for i in range(6)] + [texts[1]] * 4
    texts += ["too short", "", None, "again again again " * 40]
    rows = [(i, t, "en", ["a", "b", None][i % 3], len(t or ""), "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")


def test_stages_keep_columns_and_clean_documents(spark):
    docs = corpus(spark).cache()
    kept = corpus_pipeline.quality_rules(spark, docs, "")
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(90))
    assert kept.select("kept").distinct().first()[0] == "x"
    single = corpus_pipeline.near_duplicates(spark, kept, "")
    assert single.columns == docs.columns and {r["doc_id"] for r in single.collect()} == set(range(80))
    twice = corpus_pipeline.near_duplicates(spark, kept.union(kept.where("doc_id = 5")), "")
    assert twice.where("doc_id = 5").count() == 1
    mixed = corpus_pipeline.mixed_sources(spark, single, "")
    assert mixed.columns == docs.columns
    packed = corpus_pipeline.packed(spark, mixed, "").collect()
    words = Counter()
    for r in mixed.collect():
        words[r["doc_id"]] += len(r["text"].split())
    got = Counter()
    for r in packed:
        got[r["doc_id"]] += r["n_words"]
    assert got == words and sum(words.values()) > 1.3 * sum(len(r["text"].split()) for r in single.collect())


def test_empty_corpus(spark):
    docs = corpus(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_near_duplicates_go_by_row(spark):
    draw = random.Random(3)
    text = lambda: " ".join(f"w{draw.randint(0, 3000)}" for _ in range(120))
    a, b, c, d = (text() for _ in range(4))
    rows = [(7, a), (7, b), (7, a), (8, b + " edit"), (None, c), (None, c + " edit"), (None, a + " other"), (None, d)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t), "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert len(got) == 4 and {(7, a), (7, b), (None, d)} < set(got)
    assert len({(None, c), (None, c + " edit")} & set(got)) == 1


def test_workers_give_freed_memory_back():
    import numpy as np

    from inspectra.llm.common import give_back

    def held() -> float:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096 / 1e6

    give_back()
    arrays = [np.ones(8_000) for _ in range(3_000)]  # 192 MB in pieces that the allocator keeps
    pin = arrays[-1]
    before = held()
    del arrays
    give_back()
    assert held() < before - 120 and pin[0] == 1
