from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
from leafmill.llm.components import components
from leafmill.llm.ngram_join import LONGEST, NODES, TREES, Forest, _tries, first_of_each, join, least_likeness, level_of, prefix_length, shingles


def brute(rows):
    """Links and least connected ids by comparing all pairs."""
    sets = [set(shingles(t).tolist()) for _, t in rows]
    links, root = Counter(), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            where[x].append(k)
    shared = Counter((a, b) for x in where.values() for i, a in enumerate(x) for b in x[i + 1 :])
    for (a, b), n in shared.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            links[a] += 1
            links[b] += 1
            root[max(find(a), find(b))] = min(find(a), find(b))
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[find(k)].append(rows[k][0])
    least = {k: min((i for i in v if i is not None), default=None) for k, v in groups.items()}
    return sorted(((rows[k][0], least[find(k)], links[k]) for k in range(len(rows))), key=str)


def test_prefix_is_shortened_until_the_recall_is_met():
    assert prefix_length(0.8, 20, 8, 0.999) == 5 and prefix_length() == 5
    assert prefix_length(0.99, 20, 8, 0.999) == 8
    assert prefix_length(0.1, 1, 8, 0.999) == 1


def test_a_text_looks_for_others_at_the_longest_prefix_that_finds_them():
    for n in range(1, 40):
        likely = [k / (n + m - k) for m in range(1, 60) for k in range(min(n, m) + 1) if not n == m == k and k >= 0.8 * (n + m - k) - 1e-9]
        assert least_likeness(n) == (min(likely) if likely else None)
        assert level_of(n) == (prefix_length(min(likely)) if likely else 0)
    # From the longest prefix on: a set of seven keeps it, one of six gives up two values, one of ten three.
    assert [level_of(n) for n in (0, 3, 7, 6, 10, 300)] == [0, 0, LONGEST, 6, 5, 5]


def _trees(signature: bytes) -> np.ndarray:
    return np.frombuffer(signature, ">u2").reshape(TREES, LONGEST)


def test_signatures_agree_as_often_as_they_should():
    rng, forest = np.random.default_rng(1), Forest(TREES, LONGEST)
    for length in (1, 5):
        hits = 0
        for _ in range(200):
            x = np.unique(rng.integers(0, 1 << 63, 300, np.uint64))
            y = np.unique(np.concatenate([x[30:], rng.integers(0, 1 << 63, 30, np.uint64)]))
            hits += (_trees(forest.signature(x)) == _trees(forest.signature(y)))[:, :length].all(1).sum()
        assert abs(hits / (200 * TREES) - (270 / 330) ** length) < 0.05


def test_nodes_of_the_tries_by_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(0, 2)), bytes(np.minimum(rng.integers(0, 3, 2 * LONGEST), 1).astype(np.uint8)), int(rng.integers(5, LONGEST + 1)), 10, k, k * k) for k in range(3000)]
    frame = spark.createDataFrame(rows, "tree int, signature binary, level int, n int, x long, y long")
    parts = frame.repartitionByRange(7, "tree", "signature", "x").sortWithinPartitions("tree", "signature").mapInArrow(_tries([5, 6, 7, 8]), NODES)
    got: dict = defaultdict(lambda: [0, 0, 0, 0])
    for r in parts.collect():
        node = got[r.level, r.tree, bytes(r.node)]
        node[0], node[1], node[2], node[3] = node[0] + r.texts, node[1] + r.askers, node[2] + r.runs, node[3] ^ r.x
    expected: dict = defaultdict(lambda: [0, 0, 0, 0])
    for tree, signature, level, n, x, _ in rows:
        for k in range(5, level + 1):
            node = expected[k, tree, signature[: 2 * k]]
            node[0], node[1], node[2], node[3] = node[0] + 1, node[1] + (level == k), node[2] + n, node[3] ^ x
    assert {k: v for k, v in got.items() if v[0] > 1} == {k: v for k, v in expected.items() if v[0] > 1}


def test_short_texts_at_every_level(spark):
    """Sets of four to twelve runs with all their neighbours: every level of the forest has askers."""
    import random

    rng, rows = random.Random(5), []
    for group in range(60):
        w = [f"w{group}x{k}" for k in range(5 + group % 12)]
        rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join([*w, "more"])), (len(rows) + 2, " ".join(w[1:])), (len(rows) + 3, " ".join([*w[:-1], rng.choice("abc")]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in join(docs).collect()), key=str) == brute(rows)


def test_join_equals_all_pairs(spark):
    from tests_llm_data import table

    docs = table(spark, "documents")
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in join(docs).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    kept = first_of_each(docs, join(docs))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _ in got})


def test_a_large_group_of_different_near_copies(spark, monkeypatch):
    import leafmill.llm.ngram_join as m
    from conftest import words

    monkeypatch.setattr(m, "BLOCK_TEXTS", 16)
    base = words(9, 100).split()
    rows = []
    for k in range(90):
        copy = list(base)
        copy[k] = f"changed{k}"
        rows.append((k, " ".join(copy)))
    rows += [(200 + k, words(300 + k, 60)) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got, expected = sorted(((r.doc_id, r.class_id, r.n_links) for r in join(docs).collect()), key=str), brute(rows)
    assert [x[:2] for x in got] == [x[:2] for x in expected]
    found, there = sum(x[2] for x in got), sum(x[2] for x in expected)
    assert all(a[2] <= b[2] for a, b in zip(got, expected, strict=True)) and found >= 0.999 * there and there == 90 * 89


def test_awkward_rows_and_no_rows(spark, awkward, empty):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in join(awkward).collect()), key=str)
    expected = brute(rows)
    assert Counter((i, n) for i, _, n in got) == Counter((i, n) for i, _, n in expected)
    assert {c for i, c, _ in got if i in (1, 2, 3)} == {1} and {c for i, c, _ in got if i in (10, 11)} == {10}
    assert {(i, c) for i, c, n in got if i in (4, 5, 6)} == {(4, 4), (5, 5), (6, 6)}
    kept = first_of_each(awkward, join(awkward)).collect()
    ids = Counter(r.doc_id for r in kept)
    assert ids[1] == 1 and not ids[2] and not ids[3] and ids[10] == 1 and not ids[11]
    assert join(empty).collect() == [] and first_of_each(empty, join(empty)).collect() == []


def test_equal_ids_with_different_texts_are_told_apart(spark):
    from conftest import words

    a, b = words(1, 50), words(2, 50)
    docs = spark.createDataFrame([(1, a), (1, b), (1, a), (2, b), (None, words(3, 50)), (None, words(4, 50))], "doc_id long, text string")
    kept = sorted((r.text for r in first_of_each(docs, join(docs)).collect()))
    assert kept == sorted([a, b, words(3, 50), words(4, 50)])


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (7, 7)]
    out = {r.a: r.b for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert out == {**{k: 0 for k in range(1, 41)}, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
