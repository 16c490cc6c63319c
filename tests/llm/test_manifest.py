"""The Merkle manifest against a tree built in memory."""

import hashlib
import random
import zlib

import pytest
from inspectra.llm import merkle

DOCS = "doc_id long, text string, source string, lang string, n_chars long, leaf string, t int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(r, text):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)])


def brute(rows):
    """Rows of the contract, by building every level and noting everybody's siblings on the way."""
    ways = [[] for _ in rows]

    def end(nodes):
        while len(nodes) > 1:
            runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
            for run in runs:
                hs = [h for h, _ in run]
                for k, (_, members) in enumerate(run):
                    for x in members:
                        ways[x].append((hs[:k], hs[k + 1 :]))
            nodes = [(sha(*[h for h, _ in run]), [x for _, members in run for x in members]) for run in runs]
        return nodes[0]

    leaf = [leaf_of(r, r["text"]) for r in rows]
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    tops = {}
    for s in sources:
        own = sorted((i for i, r in enumerate(rows) if r["source"] == s), key=lambda i: (rows[i]["doc_id"] is not None, rows[i]["doc_id"] or 0, leaf[i]))
        tops[s] = end([(leaf[i], [i]) for i in own])
    root = end([tops[s] for s in sources])[0] if rows else None
    out = []
    for i, r in enumerate(rows):
        changed = r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
        h = leaf_of(r, r["text"].replace("\n", "")) if changed else leaf[i]
        for a, b in ways[i]:
            h = sha(*a, h, *b)
        out.append((r["doc_id"], leaf[i], tops[r["source"]][0], root, sha(*[x for a, b in ways[i] for x in a + b]), h, h == root))
    return sorted(out, key=repr)


def corpus(spark, n, sources, seed=1):
    draw = random.Random(seed)
    rows = [(i * 3 - 40, "".join(draw.choice("ab\n é") for _ in range(draw.randint(0, 30))), draw.choice(sources), draw.choice(["en", None]), draw.randint(0, 9), "own", 7) for i in range(n)]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("n,sources", [(1, ["a"]), (3, ["a"]), (28, [None]), (120, ["a", "a", "a", "b", "B", "é", "", None]), (40, [f"s{i}" for i in range(30)])])
def test_equals_a_tree_in_memory(spark, n, sources):
    df = corpus(spark, n, sources)
    got = merkle.manifest(df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(df.collect())


def test_far_ancestors_go_on_alone(spark, monkeypatch):
    monkeypatch.setattr(merkle, "HOPS", 1)
    df = corpus(spark, 300, ["hot"] * 20 + ["a", "b", "c", "d", None])
    assert sorted(map(tuple, merkle.manifest(df).collect()), key=repr) == brute(df.collect())


def test_nulls_copies_long_texts_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(merkle, "COPIES", 4)
    rows = [(None, None, None, None, None, "", 0)] * 3 + [(5, "same\ntext", "a", "en", 9, "", 0)] * 11 + [(5, "other\n", "a", "en", 9, "", 0), (6, "x\n" * 300_000, "a", "en", 1, "", 0), (7, "", "a", None, 0, "", 0), (8, None, "z", "en", None, "", 0)]
    df = spark.createDataFrame(rows, DOCS)
    got = merkle.manifest(df).collect()
    assert sorted(map(tuple, got), key=repr) == brute(df.collect()) and len(got) == len(rows)
    assert merkle.manifest(df.limit(0)).count() == 0


def test_a_proof_fails_for_any_other_leaf(spark):
    df = corpus(spark, 50, ["a", "b"])
    found = merkle.proofs(df)
    right = found.select((merkle.folded(found["leaf"], found["siblings"], found["codes"]) == found["root"]).alias("x"), (merkle.folded(found["subroot"], found["siblings"], found["codes"]) == found["root"]).alias("y")).collect()
    assert all(r["x"] and not r["y"] for r in right)
