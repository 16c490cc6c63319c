"""Mixing, packing, near duplicates, vectors and language-model scores."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from inspectra.llm import attention, graph, jaccard, lm, mixing, packing, shingles, vectors

DOCS = "doc_id long, text string, source string, lang string, n_chars long, size string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "en", len(t or ""), "clash") for i, t, s in rows], DOCS)


def by_quotients(weights, seats):
    won = [0] * len(weights)
    for _ in range(seats):
        best = max(range(len(weights)), key=lambda i: (weights[i] / (2 * won[i] + 1), -i))
        won[best] += 1
    return won


@pytest.mark.parametrize("weights,seats", [([5.0, 2.0, 1.0], 7), ([1.0] * 9, 4), ([100.0, 1.0, 1.0, 0.5], 11), ([3.0, 0.0, 2.0], 50), ([1e6, 3e5, 7.0], 1000)])
def test_highest_quotients(spark, weights, seats):
    df = spark.createDataFrame([(i, w, seats) for i, w in enumerate(weights)], "k int, w double, s long")
    got = {r["k"]: r["won"] for r in mixing.highest_quotients(df, ["k"], "w", "s").collect()}
    assert [got[i] for i in range(len(weights))] == by_quotients(weights, seats)


def test_null_and_equal_ids_mix_alike_again(spark):
    rows = [(None, f"w{i} x{i % 7} y", "a") for i in range(300)] + [(3, f"v{i} x y", "a") for i in range(50)] + [(4, "long " * 100_000, None)]
    runs = []
    for n in (1, 3, 5):
        out = mixing.mix(docs(spark, rows).repartition(n, "text"), shard_words=100, carry=("text",)).select("_in.text", "taken").collect()
        runs.append(sorted(map(tuple, out)))
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == len(rows)
    one = mixing.mix(docs(spark, rows), shard_words=100).collect()
    assert sum(r["taken"] for r in one if r["doc_id"] is None) > 0


def test_mix_targets_and_takes(spark):
    draw = random.Random(1)
    rows = [(i, "w " * draw.randint(0, 200), ["a", "b", "c", "d", None][min(i % 9, 4)]) for i in range(400)] + [(900, None, "a"), (901, "", None)]
    out = mixing.mix(docs(spark, rows), shard_words=4000).collect()
    again = mixing.mix(docs(spark, rows).repartition(3), shard_words=4000).collect()
    assert sorted(out) == sorted(again) and len(out) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[2]] += len((r[1] or "").split())
    of = {r["doc_id"]: r for r in out}
    taken, target = Counter(), {}
    for i, t, s in rows:
        taken[s] += of[i]["taken"]
        target[s] = of[i]["target"]
        assert 0 <= of[i]["taken"] <= 2 * of[i]["size"] and of[i]["source_size"] == sizes[s]
    weight = dict(zip(sorted([s for s in sizes if s is not None]) + [None], [5, 2, 1, 5, 2]))
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        level = (total - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in sizes if s not in capped)
        more = {s for s in sizes if s not in capped and level * weight[s] > 2 * sizes[s]}
        if not more:
            break
        capped |= more
    for s in sizes:
        assert target[s] == pytest.approx(2 * sizes[s] if s in capped else level * weight[s])
        assert abs(taken[s] - target[s]) <= 0.02 * target[s] + 3 * mixing.BLOCK
    assert mixing.mix(docs(spark, []).limit(0)).count() == 0


def test_mixed_rows_hold_the_words_taken(spark):
    rows = [(i, f"a{i} b c d e f " * 20, "xy"[i % 2]) for i in range(60)]
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs(spark, rows)).collect()}
    mixed = mixing.mixed_rows(docs(spark, rows))
    assert mixed.columns == docs(spark, rows).columns
    words = Counter()
    for r in mixed.collect():
        words[r["doc_id"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    assert words == +Counter(taken)


def test_parts_keep_their_white_space(spark):
    text = lambda i: "\n \n" * (i % 2) + "".join(f"w{i}x{k}{[' ', chr(10), '  ', chr(9)][k % 4]}" for k in range(300))
    rows = [(i, text(i), "xy"[i % 2]) for i in range(8)]
    parts = [r for r in mixing.mixed_rows(docs(spark, rows)).collect() if r["text"] != text(r["doc_id"])]
    assert parts and all(text(r["doc_id"]).startswith(r["text"]) and r["text"][-1:].isdigit() and r["n_chars"] == len(r["text"]) for r in parts)


def test_packing_equals_brute_force():
    """Small cases against every way to fill bins in the same falling order, by cost."""
    lengths = (4, 8, 16)

    def best(rest, bins):
        if not rest:
            return sum(packing.cost(min(x for x in lengths if x >= b)) for b in bins)
        size, tail = rest[0], rest[1:]
        ways = [best(tail, [*bins[:i], b + size, *bins[i + 1 :]]) for i, b in enumerate(bins) if b + size <= lengths[-1]]
        return min([best(tail, [*bins, size]), *ways])

    draw = random.Random(12)
    for _ in range(40):
        sizes = sorted((draw.randint(1, 16) for _ in range(draw.randint(1, 6))), reverse=True)
        cost, bins, final = packing.pack(sizes, lengths)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert cost == pytest.approx(sum(map(packing.cost, final))) and all(sum(sizes[i] for i in b) <= x for b, x in zip(bins, final))
        assert best(sizes, []) - 1e-9 <= cost <= 1.25 * best(sizes, [])


def test_packing_holds_every_word_once(spark):
    draw = random.Random(2)
    rows = [(i, "w " * draw.choice([0, 1, 5, 90, 400, 3000, 20000]), "a") for i in range(200)] + [(500, None, "a"), (None, "x y", "b"), (7, "again", "a")]
    out = packing.pack_documents(docs(spark, rows), shard_pieces=60).collect()
    got = Counter()
    bins = {}
    for r in out:
        got[r["doc_id"]] += r["n_words"]
        if r["bin_id"] is None:
            assert r["n_words"] == 0
        else:
            bins.setdefault(r["bin_id"], []).append(r)
    want = Counter()
    for i, t, _ in rows:
        want[i] += len((t or "").split())
    assert +got == +want
    for b in bins.values():
        b.sort(key=lambda r: r["bin_offset"])
        assert [r["bin_offset"] for r in b] == list(np.cumsum([0] + [r["n_words"] for r in b[:-1]]))
        fill = sum(r["n_words"] for r in b)
        assert {r["bin_words"] for r in b} == {fill} and b[0]["bin_length"] == min(x for x in packing.LENGTHS if x >= fill)
    assert packing.pack_documents(docs(spark, []).limit(0)).count() == 0


def test_pack_is_near_the_best_and_downsizes():
    cost, bins, final = packing.pack([500, 30], (512, 1024))
    assert final == [1024] and len(bins) == 1 or sum(map(packing.cost, final)) == cost
    assert packing.pack([100], packing.LENGTHS)[2] == [512]
    draw = random.Random(3)
    sizes = [draw.randint(1, 512) for _ in range(400)]
    _, _, final = packing.pack(sizes, (512,))
    assert len(final) <= 1.1 * sum(sizes) / 512 + 1


def brute_components(texts):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for t in texts:
        w = (t or "").translate(lower).encode().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def family(draw, n, base, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(draw.randint(0, edits)):
            w[draw.randrange(len(w))] = f"e{draw.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


def test_jaccard_components_equal_brute_force(spark):
    draw = random.Random(4)
    word = lambda: f"w{draw.randint(0, 5000)}"
    passage = [word() for _ in range(60)]
    texts = family(draw, 60, [word() for _ in range(120)], 5) + family(draw, 25, [word() for _ in range(40)], 2)
    texts += [" ".join([word() for _ in range(draw.randint(30, 200))] + passage) for _ in range(60)]
    texts += ["Same Text here TODAY ok then"] * 7 + ["same text here today ok then"] + ["", None, "one", "One", "a b c d", " \n", "a b c d e", "a b c d e f"]
    texts += family(draw, 20, [word() for _ in range(30)], 1)
    n, part = brute_components(texts)
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    draw.shuffle(rows)
    for rounds in (0, 2):
        got = {r["doc_id"]: r for r in jaccard.jaccard_components(docs(spark, rows), cells=1 << 12, rounds=rounds, block=8).collect()}
        assert [got[i]["n_shingles"] for i in range(len(texts))] == n
        assert [got[i]["component_id"] for i in range(len(texts))] == part


def test_jaccard_edge_rows(spark):
    rows = [(5, "a b c d e f g", "s"), (5, "a b c d e f g", "s"), (2, "A B C D E F G", "s"), (None, "a b c d e f g", "s"), (9, None, None)]
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs(spark, rows), cells=1 << 10).collect())
    assert got == [(-1, 3, None), (2, 3, 2), (5, 3, 2), (5, 3, 2), (9, 0, 9)]
    assert jaccard.jaccard_components(docs(spark, []).limit(0), cells=1 << 10).count() == 0


def test_sets_wait_for_the_text_of_their_id():
    import zlib

    texts = [" ".join(f"{p}{k}" for k in range(60)) for p in "ab"]
    bodies = [zlib.compress(t.encode(), 1) for t in texts]
    ids = [jaccard.set_id(next(jaccard.shingle_sets(pa.array([t]), jaccard.WIDTH))) for t in texts]
    sets = jaccard.Sets(jaccard.WIDTH)
    assert sets.of(ids[1], bodies[0]) is None and len(sets.of(ids[1], bodies[1])) and len(sets.of(ids[0], bodies[0]))


def test_jaccard_links_all_texts_of_an_id(spark):
    text = lambda p: " ".join(f"{p}{k}" for k in range(120))
    names = [f"t{i}x" for i in range(12)]
    rows = [(1, text(p), "s") for p in names] + [(100 + i, text(p) + " edit", "s") for i, p in enumerate(names)]
    for rounds in (0, 2):
        assert {r["component_id"] for r in jaccard.jaccard_components(docs(spark, rows), rounds=rounds).collect()} == {1}


def test_shingle_words_are_byte_runs():
    texts = ["Ab cD x", None, "", "ab cd x", "\x1cq \x0b w", "ab"]
    spans = list(shingles.word_spans(pa.array(texts)))
    hashes, bounds = spans[0][3], spans[0][4]
    assert list(np.diff(bounds)) == [2, 0, 0, 2, 2, 1]
    assert hashes[0] == hashes[2] == hashes[6] and hashes[1] == hashes[3] and len(set(hashes.tolist())) == 4


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 120)] + [(7, 7), (200, 201), (201, 202), (202, 200)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(df, "a", "b").collect()}
    assert {got[i] for i in range(41)} == {0} and {got[x] for x in range(100, 120)} == {100} and got[202] == 200
    assert graph.components(df.limit(0), "a", "b").count() == 0


def test_vectors_equal_brute_force(spark):
    draw = np.random.default_rng(5)
    base = draw.standard_normal((12, 16))
    x = np.concatenate([b + draw.standard_normal((12, 16)) * 0.08 * (1 + i % 3) for i, b in enumerate(base)])
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)]
    rows += [(500, rows[0][1], 0), (501, rows[0][1], 0), (502, [0.0] * 16, 0), (503, None, 0), (504, [float("nan")] * 16, 0), (505, rows[2][1], None), (506, [1.0], 0), (507, [float("inf")] + [0.0] * 15, 0), (508, [None] * 16, 0)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, label int, kept string")
    got = {r["vec_id"]: r for r in vectors.near_vectors(df, block=5).collect()}
    real = [(i, np.array(v, float), lab) for i, v, lab in rows if v and lab is not None and all(c is not None for c in v) and np.isfinite(np.array(v, float)).all() and np.any(v)]
    links = {i: {j for j, w, m in real if j != i and m == lab and len(w) == len(v) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93} for i, v, lab in real}
    assert all(got[i]["n_links"] <= len(links[i]) for i in links)
    assert sum(got[i]["n_links"] for i in links) >= 0.95 * sum(map(len, links.values())) > 100
    assert got[500]["component_id"] == got[501]["component_id"] == got[0]["component_id"] and got[0]["n_links"] >= 2
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in (502, 503, 504, 505, 506, 507, 508))
    assert vectors.near_vectors(df.limit(0)).count() == 0
    assert vectors.recall(0.93) > 0.95 and vectors.recall(0.99) > 0.999


def test_gradients_equal_differences():
    draw = np.random.default_rng(6)
    m = {k: v.astype("float64") for k, v in attention.fresh(np.ones(attention.IDS)).items()}
    m["U"], m["G"] = draw.standard_normal(m["U"].shape) * 0.3, draw.standard_normal(m["G"].shape) * 0.3
    seq, bounds = draw.integers(0, attention.IDS, 90), np.array([0, 50, 90])
    inputs, padding, targets, owner = attention.windows(seq, bounds)
    assert (targets >= 0).sum() == 90 and list(np.bincount(owner)) == [-(-50 // attention.SPAN), -(-40 // attention.SPAN)]
    assert [t for t in targets.ravel() if t >= 0] == seq.tolist()
    rows, aims, _, ahead = attention.laid(seq, bounds, np.array([3, 2 * attention.SPAN - 1]), 2 * attention.SPAN)
    every = (rows, ahead, aims)
    assert sorted(t for t in every[2].ravel() if t >= 0) == sorted(seq.tolist())
    loss, g = attention.gradients(m, *every)
    for k in m:
        at = tuple(draw.integers(0, n) for n in m[k].shape) if k != "E" else (int(every[0][0, 5]), 3)
        if k in "Uc":
            at = (int(every[2][0, 5]) // attention.SIZE, *at[1:])
        up, down = ({**m, k: m[k].copy()} for _ in range(2))
        up[k][at] += 1e-4
        down[k][at] -= 1e-4
        slope = (attention.gradients(up, *every)[0] - attention.gradients(down, *every)[0]) / 2e-4
        assert slope == pytest.approx(float(g[k][at]), abs=2e-4)


def test_scoring_equals_the_plain_model():
    draw = np.random.default_rng(8)
    m = attention.fresh(np.ones(attention.IDS))
    m["U"], m["G"] = draw.standard_normal(m["U"].shape).astype("float32"), draw.standard_normal(m["G"].shape).astype("float32")
    seq, bounds = draw.integers(0, attention.IDS, 150), np.array([0, 0, 100, 150])
    inputs, padding, targets, owner = attention.windows(seq, bounds)
    y = attention.forward(m, inputs, padding)["y"].reshape(len(inputs), 2 * attention.SPAN, -1)[:, attention.SPAN :]
    group = y @ m["G"] + m["g"]
    want = np.zeros(targets.shape)
    for i, j in zip(*np.nonzero(targets >= 0)):
        k, own = divmod(int(targets[i, j]), attention.SIZE)
        inner = y[i, j] @ m["U"][k] + m["c"][k]
        want[i, j] = group[i, j, k] - np.log(np.exp(group[i, j]).sum()) + inner[own] - np.log(np.exp(inner).sum())
    assert attention.log_probabilities(m, inputs, padding, targets, batch=3) == pytest.approx(want, abs=1e-3)
    total = sum(np.exp(attention.outputs(m, np.repeat(y[0, :1], attention.IDS, 0), np.arange(attention.IDS))).tolist())
    assert total == pytest.approx(1, abs=1e-3)


def test_attention_learns_what_came_before():
    draw = np.random.default_rng(7)
    runs = np.concatenate([np.append(np.full(40, draw.integers(0, 20)), attention.END) for _ in range(150)])
    bounds = np.arange(0, len(runs) + 1, 41)
    before = attention.fresh(np.bincount(runs, minlength=attention.IDS))
    after = attention.train(before, runs, bounds, 0.01, 200, 1)
    w = attention.windows(runs, bounds)[:3]
    assert attention.log_probabilities(after, *w).sum() > 0.5 * attention.log_probabilities(before, *w).sum()


def test_scores_base_and_held_out(spark):
    import public_tokenizers

    draw = random.Random(8)
    langs = [[f"{p}{k}" for k in range(60)] for p in ("the", "der", "les")]
    rows = [(i, " ".join(draw.choice(langs[i % 3]) for _ in range(draw.randint(20, 120))), "s") for i in range(300)]
    rows += [(1000, None, "s"), (1001, "", "s"), (1002, "never seen anything", "s"), (None, "the1 the2", "s"), (1003, "The1 the2 x", "s"), (5, "the1", "s")]
    out = lm.score_texts(docs(spark, rows), ranks=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN, head=50).collect()
    assert len(out) == len(rows)
    import zlib

    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = lambda t: [*(t or "").translate(lower).encode().split(), "end"]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    counts = Counter(w for i, t, _ in rows if not held(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t, _ in rows:
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t))
        want[(i, held(i), len(words(t)), sum(counts[w] > 0 for w in words(t)), n, round(base, 6))] += 1
    got = Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out)
    assert got == want
    fresh = [r for r in out if r["held_out"] and r["n_tokens"] > 10]
    assert fresh and sum(r["score"] for r in fresh) > sum(r["base_score"] for r in fresh)
    assert all(r["score"] < 0 for r in out)
    empty = lm.score_texts(docs(spark, []).limit(0), ranks=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)
    assert empty.count() == 0


def test_attention_learns_from_every_training_document(spark, monkeypatch):
    import public_tokenizers

    rows = [(i, " ".join(f"w{i}x{k}" for k in range(30 + i % 7)), "s") for i in range(120)]
    learned, averaged = [], lm.averaged

    def watched(sample, *rest):
        learned.extend(len(r["ids"]) // 2 + 1 for r in sample.collect())
        return averaged(sample, *rest)

    monkeypatch.setattr(lm, "averaged", watched)
    out = lm.score_texts(docs(spark, rows), ranks=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN).collect()
    assert sorted(learned) == sorted(r["n_tokens"] for r in out if not r["held_out"])
    assert attention.RARE >= 254


def test_end_counts_outside_the_head(spark):
    import public_tokenizers

    rows = [(i, "aa bb cc " * 40, "s") for i in range(30)]
    score = lambda head: sorted((r["doc_id"], r["n_known"], round(r["base_score"], 6)) for r in lm.score_texts(docs(spark, rows), ranks=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN, head=head, rounds=0).collect())
    assert score(3) == score(100)


def test_scores_beat_the_base_on_held_out_documents(spark):
    from inspectra.llm import queries

    out = queries.op10_lm_scores(spark, "/root/testdata/sf0.1").where("held_out").toPandas()
    assert out["score"].sum() > out["base_score"].sum() and (out["score"] > out["base_score"]).mean() > 0.75


def test_score_gives_every_subword_through_attention(spark, monkeypatch):
    import public_tokenizers

    draw, sets, seen = np.random.default_rng(3), [], []
    m = {k: v.astype("float32") for k, v in attention.fresh(draw.integers(1, 9, attention.IDS)).items()}
    m["U"], m["G"] = draw.standard_normal(m["U"].shape).astype("float32"), draw.standard_normal(m["G"].shape).astype("float32")

    def trained(sample, model, id_of, *rest):
        seen.extend(lm.whole(np.frombuffer(r["ids"], np.uint16), np.frombuffer(r["later"], np.uint16)).tolist() for r in sample.collect())
        return m

    made = lm.Subsequent.__init__
    monkeypatch.setattr(lm, "averaged", trained)
    monkeypatch.setattr(lm.Subsequent, "__init__", lambda self, *a: sets.append(self) or made(self, *a))
    some = ["straightforward", "straightforwardly", "uninteresting", "the", "x", "antidisestablishmentarianism", "zzqx" * 30]
    rows = [(i, " ".join(some[k] for k in draw.integers(0, 7, 5 + i)), "s") for i in range(30)] + [(100, None, "s"), (101, "neverseen straightforwardest x", "s"), (102, "", "s")]
    source = dict(ranks=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)
    out = {r["doc_id"]: r for r in lm.score_texts(docs(spark, rows), **source).collect()}
    coder, t = lm.Subwords(*source.values()), sets[0]
    spelled = {i: [coder.encode(" " + w) for w in (x or "").split()] for i, x, _ in rows}
    assert sorted(seen) == sorted([s for w in spelled[i] for s in w] for i in spelled if not out[i]["held_out"])
    counts = Counter((tuple(w[: j + 1]), (w[j + 1 :] or [None])[0]) for i, x in spelled.items() if not out[i]["held_out"] for w in x for j in range(min(len(w), lm.CARRIED)))
    totals = Counter()
    for (begin, _), n in counts.items():
        totals[begin] += n
    first = t.border * attention.SIZE
    for i, x in spelled.items():
        steps = [(w[j], tuple(w[:j])) for w in x for j in range(len(w))] + [(None, ())]
        ids = [attention.END if s is None else int(t.id_of[s]) for s, _ in steps]
        inputs, padding, targets, _ = attention.windows(np.array(ids), np.array([0, len(ids)]))
        y = attention.forward(m, inputs, padding)["y"].reshape(len(inputs), 2 * attention.SPAN, -1)[:, attention.SPAN :].reshape(-1, attention.DIM)
        want, before = 0.0, None
        for k, (s, begin) in enumerate(steps):
            group = np.exp(y[k] @ m["G"] + m["g"])
            p = np.concatenate([group[g] / group.sum() * (e := np.exp(y[k] @ m["U"][g] + m["c"][g])) / e.sum() for g in range(attention.GROUPS)])
            own, opens = p[ids[k]] * (1 if s is None else np.exp(t.within[s])), p[first:].sum()
            at = begin or before or ()
            n = totals[at] if len(at) <= lm.CARRIED else 0
            c = counts[(at, s if begin else None)] if len(at) <= lm.CARRIED else 0
            worth = 5 + 3 * math.sqrt(n)
            if begin:
                want += math.log10((c + worth * own) / (n + worth))
            else:
                want += math.log10(own / opens) + (math.log10((c + worth * opens) / (n + worth)) if k else 0)
            before = (*begin, s)
        assert out[i]["score"] == pytest.approx(want, rel=1e-4, abs=1e-3)


def test_counts_outside_the_table_and_late_in_words_have_their_say(spark, monkeypatch):
    import public_tokenizers

    draw, source = np.random.default_rng(8), dict(ranks=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN, rounds=0)
    some = ["straightforward", "straightforwardly", "uninteresting", "the", "zzqx" * 30, "zzqx" * 29 + "yy", "qj" * 400, "antidisestablishmentarianism"]
    rows = [(i, " ".join(some[k] for k in draw.integers(0, len(some), 5 + i)), "s") for i in range(30)] + [(100, None, "s"), (101, "neverseen straightforwardest " + "zzqx" * 31, "s")]
    score = lambda: {r["doc_id"]: r["score"] for r in lm.score_texts(docs(spark, rows), **source).collect()}
    full = score()
    for size in (0, 3, 20):
        monkeypatch.setattr(lm, "FOLLOWED", size)
        assert score() == pytest.approx(full, rel=1e-6, abs=1e-5)
    # a word of many subwords that was seen often costs little more than a short one: every step inside it is known
    assert full[29] > -12 * len(rows[29][1].split())


def test_runs_of_megabytes_take_little_memory(monkeypatch):
    import tracemalloc

    import pyarrow as pa
    import public_tokenizers

    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, task, _):
            return task

    draw = np.random.default_rng(5)
    spelled = np.array([f"{k:x}" for k in range(70_000)])
    texts = pa.array([" ".join(spelled[draw.integers(0, len(spelled), 8_000)]) for _ in range(100)])
    pieces = [h for _, _, _, h, _ in shingles.word_spans(texts, 100_000)]
    tracemalloc.start()
    long = [h for _, _, _, h, _ in shingles.word_spans(texts, lm.RUN)]
    assert tracemalloc.get_traced_memory()[1] < 60e6
    assert len(long) < len(pieces) and np.array_equal(np.concatenate(long), np.concatenate(pieces))
    monkeypatch.setattr(lm, "keep", lambda task, _: task)
    coder = lm.Subwords(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    tracemalloc.reset_peak()
    begin, rows = tracemalloc.get_traced_memory()[0], 0
    for batch in lm.counted(Docs(), lambda: coder)(iter([pa.RecordBatch.from_arrays([texts], ["text"])])):
        assert batch.num_rows <= 50_000
        rows += batch.num_rows
    assert rows > 70_000 and tracemalloc.get_traced_memory()[1] - begin < 110e6
    tracemalloc.stop()


def test_spelling_is_a_distribution_and_knows_pairs():
    keys = np.array([1 << 16 | 2, 1 << 16 | lm.NONE, 2 << 16 | lm.NONE])
    before, after = np.zeros(lm.NONE + 1), np.zeros(lm.NONE + 1)
    before[[1, 2]], after[[2, lm.NONE]] = [4, 3], [3, 4]
    t = lm.Tables(np.full(10, 5.0), np.ones(10), 7, (keys, np.array([3, 1, 3])), before, after)
    likely, rare = t.spelling(np.array([1, 2, 1, 3]), np.array([0, 2, 4]))
    assert likely > rare and rare < 0
    following = (np.isin(np.arange(lm.NONE + 1), [2, lm.NONE]) * np.where(np.arange(lm.NONE + 1) == 2, 3, 1) + lm.BACK * t.after) / (before[1] + lm.BACK)
    assert following.sum() == pytest.approx(1)
    one, two = lm.packed_rest(np.array([5, 6, 7, 8]), np.array([0, 3, 4]))
    assert [int(one.view(np.uint64)[0]) >> 16 * j & 0xFFFF for j in range(4)] == [6, 7, lm.NONE, lm.NONE] and two.tolist() == [-1, -1] and one[1] == -1
