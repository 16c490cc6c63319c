"""Whitening against a dense decomposition, and histogram packing against the tokenizer and the definition of its order."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from inspectra.llm import histogram_packing as H
from inspectra.llm import whitening
from pyspark.sql import functions as F
from tokenizers import Tokenizer


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, x string, n int")


def checked(got, ids, entries, components):
    x = np.floor(np.asarray(entries, "float32").astype("float64") * 64).astype("int64") + 1_000_000
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    want = c @ axes / np.sqrt(values)
    table = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    assert np.allclose(table * np.sign((table * want).sum(axis=0)), want, rtol=0, atol=1e-9)
    each = got.groupby("component").first()
    assert np.allclose(each.explained, values / np.trace(c.T @ c / n), rtol=1e-12) and (each.n == n).all() and (each.identity_error < 1e-10).all()
    assert got.groupby("vec_id").deviation.first().loc[ids].tolist() == ((n * x - s) ** 2).sum(axis=1).tolist()


@pytest.mark.parametrize("d,n,wanted", [(70, 300, 8), (5, 40, 32)])
def test_equals_a_dense_decomposition(spark, d, n, wanted):
    draw = np.random.default_rng(d)
    entries = draw.standard_normal((n, d)) * draw.uniform(0.1, 3, d) @ draw.standard_normal((d, d)) + 100
    rows = [(i, [float(v) for v in row], "a", 1) for i, row in enumerate(entries)]
    rows += [(900, None, "a", 1), (901, [1.0, None] + [0.0] * (d - 2), "a", 1), (902, [float("nan")] * d, "a", 1), (903, [float("inf")] * d, "a", 1), (904, [1.0], "a", 1), (905, [], "a", 1)]
    got = whitening.whiten(vectors(spark, rows), components=wanted, guard=6).toPandas()
    assert len(got) == n * min(d, wanted)
    checked(got, list(range(n)), entries, min(d, wanted))


def test_flat_directions_single_rows_and_empty_tables(spark):
    rows = [(i, [float(i % 4), 2.0 * (i % 4), 7.0, float(i % 3)], "a", 1) for i in range(24)] + [(None, [0.0, 0.0, 7.0, 0.0], "a", 1)]
    got = whitening.whiten(vectors(spark, rows)).toPandas()
    assert set(got.component) == {1, 2} and len(got) == 50 and got.identity_error.max() < 1e-10
    assert whitening.whiten(vectors(spark, rows[:1] * 5)).count() == 0
    assert whitening.whiten(vectors(spark, rows).limit(0)).count() == 0


def test_a_hidden_eigenvalue_is_found():
    values = np.concatenate([np.linspace(5, 1, 200), [0.0]])
    found, axes = whitening.leading(lambda q: values[:, None] * q, len(values), 10, 8, 8, 1)
    assert np.allclose(found, values[:10], rtol=1e-12) and np.allclose(np.abs(axes[:10]).max(axis=0), 1)
    assert not whitening.nothing_above(lambda q: values[:, None] * q, np.eye(201)[:, 1:19], values[1:19], 10, 1)


def test_equal_eigenvalues_at_the_edge_of_the_block():
    values = np.concatenate([[9.0, 8.0], np.full(60, 3.0), np.linspace(2.9, 0, 40)])
    found, axes = whitening.leading(lambda q: values[:, None] * q, len(values), 10, 6, 8, 1)
    assert np.allclose(found, values[:10], rtol=1e-11) and np.abs(axes[62:]).max() < 1e-9


@pytest.mark.parametrize("n,spikes", [(600_000, 0), (6_000_000, 0), (6_000_000, 3)])
def test_many_vectors_drawn_alike(n, spikes):
    """The covariance of n vectors drawn alike: its eigenvalues differ by little of their size."""
    draw = np.random.default_rng(n + spikes)
    low = np.tril(draw.standard_normal((64, 64)), -1) + np.diag(np.sqrt(draw.chisquare(n - np.arange(64))))
    for_spikes = draw.standard_normal((64, spikes))
    c = low @ low.T / n + for_spikes @ for_spikes.T
    found, axes = whitening.leading(lambda q: c @ q, 64, 32, 16, 8, 1)
    values, want = np.linalg.eigh(c)
    assert np.allclose(found, values[::-1][:32], rtol=1e-12) and np.allclose(np.abs((axes * want[:, ::-1][:, :32]).sum(axis=0)), 1, atol=1e-9)


def test_deviations_beyond_a_long_are_null():
    x = np.array([[1 << 20, 0], [0, 0]])
    assert whitening.deviations(x, 2, [1 << 20, 0]).to_pylist() == [1 << 40, 1 << 40]
    assert whitening.deviations(x << 15, 2, [1 << 35, 0]).to_pylist() == [None, None]


FILES = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def one_by_one(lengths, capacity):
    """Fills of shortest-pack-first for single pieces."""
    packs = []
    for x in sorted(lengths, reverse=True):
        open_ = [p for p in packs if p + x <= capacity]
        if open_:
            packs.remove(min(open_))
            packs.append(min(open_) + x)
        else:
            packs.append(x)
    return sorted(packs)


def test_patterns_are_those_of_single_pieces():
    draw = random.Random(4)
    for capacity, most, n in ((10, 10, 60), (100, 60, 300), (2048, 2047, 400), (16, 3, 500)):
        lengths = [draw.randint(1, most) for _ in range(n)]
        patterns = H.shortest_pack_first(Counter(lengths), capacity)
        assert Counter(x for many, p in patterns for x, k in p for _ in range(many * k)) == Counter(lengths)
        assert all(sum(x * k for x, k in p) <= capacity for _, p in patterns)
        fills = sorted(sum(x * k for x, k in p) for many, p in patterns for _ in range(many))
        assert len(fills) <= len(one_by_one(lengths, capacity)) * 1.02 + 1


def words(draw, n):
    return "".join(draw.choice(["a", "the", " ", "  ", "\n", "é", "日本", "x1", "'s", "<|endoftext|>", ", ", "Word", "\x85", " "]) for _ in range(n))


def test_every_id_lies_in_one_piece(spark):
    draw = random.Random(5)
    texts = [words(draw, draw.randint(0, 400)) for _ in range(60)] + [words(draw, 30_000), None, "", " ", "plain words here " * 3000]
    rows = [(i, t, 5, "x") for i, t in enumerate(texts)] + [(7, texts[7], 5, "x"), (None, texts[7], 5, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int, sequence_id string").repartition(3)
    out = H.pack_by_histogram(df, *FILES, capacity=512, ways=(512, 128)).collect()
    library = Tokenizer.from_file(FILES[0])
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert sum(r["length"] for r in out) > 0.97 * 512 * (len(sequences) - 1)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 512
    for i, t, *_ in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at, step = 0, 2 if i == 7 else 1
        for r in sorted(pieces[i], key=lambda r: r["start"])[::step]:
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids[at : at + r["length"]].tobytes()))
            at += r["length"]
        assert at == len(ids)
    assert H.pack_by_histogram(df.limit(0), *FILES).count() == 0
    assert H.pack_by_histogram(spark.createDataFrame([(1, None)], "doc_id long, text string"), FILES[0]).first()[1:5] == (0, 1, zlib.crc32(b"\x01\0\0\0"), 1)


def test_ranks_of_another_vocabulary_are_refused():
    with pytest.raises(ValueError):
        H.Encoder(FILES[0], public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), FILES[2])


def test_hot_lengths_spread_over_sequences(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("same text for all").alias("text")).repartition(5)
    out = H.pack_by_histogram(df, *FILES).collect()
    n = out[0]["length"]
    per = Counter(r["sequence_id"] for r in out)
    assert len(out) == 3000 and max(per.values()) == 2048 // n and len(per) == -(-3000 // (2048 // n))
    assert len({(r["sequence_id"], r["offset"]) for r in out}) == 3000


def test_texts_of_a_run_are_learned_together():
    import public_tokenizers
    from tokenizers import Tokenizer

    from inspectra.llm import histogram_packing

    path = public_tokenizers.path("byte_bpe_50k.json")
    coder, library = histogram_packing.Encoder(path, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), Tokenizer.from_file(path)
    learned, learn = [], coder.learn
    coder.learn = lambda new: learned.extend(new) or learn(new)
    texts = [f"alpha beta{i % 7} größe  two\nlines <|endoftext|> gamma{i} don't" for i in range(60)] + ["", "alpha beta1", " x ", "y" * 900]
    got = [x for run in histogram_packing.runs(texts, 500) for x in coder.encode(run)]
    assert got == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert len(learned) == len(set(learned))
    assert [x for run in histogram_packing.runs(texts, 500) for x in run] == texts and max(sum(map(len, r)) for r in histogram_packing.runs(texts, 500) if len(r) > 1) <= 500
