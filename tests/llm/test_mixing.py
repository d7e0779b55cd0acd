from __future__ import annotations

import itertools
import random
import re
import time
from collections import Counter, defaultdict

from leafmill.llm import mixing
from leafmill.llm.mixing import mix, route, share_targets, take
from leafmill.llm.queries_mixing import by_turn, op1_mixing
from pyspark.sql import functions as F

SIZE = re.compile(r"[^\x20\x09-\x0D]+")


def test_targets_fill_up_to_the_limit():
    sizes = {"a": 100, "b": 100, "c": 10}
    t = share_targets(sizes, {"a": 3, "b": 1, "c": 2}, 315, 2)
    assert t["c"] == 20 and t["a"] == 200 and abs(t["b"] - 95) < 1e-9
    assert share_targets({}, {}, 0, 2) == {}
    assert share_targets({"a": 0}, {"a": 1}, 0, 2) == {"a": 0.0}


def test_flow_prefers_first_copies_and_meets_quotas():
    flow = route({"x": 100, "y": 100, "xy": 100}, {"x": ["a"], "y": ["b"], "xy": ["a", "b"]}, {"a": 150, "b": 150}, 3)
    by_pattern, by_source = defaultdict(int), defaultdict(int)
    for (p, s), f in flow.items():
        by_pattern[p] += f
        by_source[s] += f
    assert by_source == {"a": 150, "b": 150}
    assert max(by_pattern.values()) == 100  # no pattern repeats while another is not used up
    flow = route({"x": 100}, {"x": ["a"]}, {"a": 180}, 2)
    assert flow == {("x", "a"): 180}


def test_flow_is_the_cheapest_of_the_largest():
    rng = random.Random(4)
    for _ in range(60):
        members = {"x": ["a"], "y": rng.choice([["b"], ["a", "b"]]), "z": ["a", "b"]}
        capacity, quota = {p: rng.randint(0, 2) for p in members}, {"a": rng.randint(0, 5), "b": rng.randint(0, 5)}
        pairs = [(p, s) for p in members for s in members[p]]
        best = None
        for flow in itertools.product(*(range(2 * capacity[p] + 1) for p, _ in pairs)):
            used = {p: sum(f for (q, _), f in zip(pairs, flow, strict=True) if q == p) for p in members}
            got = {s: sum(f for (_, q), f in zip(pairs, flow, strict=True) if q == s) for s in quota}
            if all(used[p] <= 2 * capacity[p] for p in used) and all(got[s] <= quota[s] for s in quota):
                told = (-sum(flow), sum(max(0, used[p] - capacity[p]) for p in used))
                best = told if best is None else min(best, told)
        found = route(capacity, members, quota, 2)
        used = {p: sum(f for (q, _), f in found.items() if q == p) for p in members}
        assert (-sum(found.values()), sum(max(0, used[p] - capacity[p]) for p in used)) == best


def test_many_overlapping_patterns_are_routed_in_time():
    rng = random.Random(5)
    sources = [f"s{k}" for k in range(15)]
    members = {str(k): sorted(rng.sample(sources, rng.randint(1, 5))) for k in range(1500)}
    capacity = {p: rng.randint(1, 10**9) for p in members}
    quota = {s: sum(capacity.values()) // 12 for s in sources}
    began = time.monotonic()
    flow = route(capacity, members, quota, 2)
    assert sum(flow.values()) == sum(quota.values()) and time.monotonic() - began < 60


def test_contract_by_brute_force(spark, tmp_path):
    from tests_llm_data import table

    docs = table(spark, "documents")
    rows = {r.doc_id: r for r in op1_mixing(spark, "", docs).collect()}
    texts = {r.doc_id: r for r in docs.collect()}
    size = {k: len(SIZE.findall(r.text or "")) for k, r in texts.items()}
    assert {k: r["size"] for k, r in rows.items()} == size
    total: dict = defaultdict(int)
    for k, r in texts.items():
        total[r.source] += size[k]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    targets = share_targets(total, weights, 1.5 * sum(size.values()), 2)
    taken: dict = defaultdict(int)
    for k, r in rows.items():
        s = texts[k].source
        assert r.source_size == total[s] and abs(r.target - targets[s]) < 1e-6
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[s] += r.taken
    for s in total:
        assert abs(taken[s] - targets[s]) <= 0.02 * targets[s] + 50, (s, taken[s], targets[s])
    again = {r.doc_id: r.taken for r in op1_mixing(spark, "", docs.repartition(3)).collect()}
    assert again == {k: r.taken for k, r in rows.items()}


def test_awkward_rows_and_no_rows(spark, awkward, empty):
    rows = op1_mixing(spark, "", awkward).collect()
    assert len(rows) == awkward.count()
    assert all(r["size"] == 0 and r.taken == 0 for r in rows if r.doc_id in (4, 5, 6))
    assert all(r.taken <= 2 * r["size"] for r in rows)
    assert op1_mixing(spark, "", empty).collect() == []


def test_take_repeats_rows(spark, awkward):
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    args = (F.array("source"), size, by_turn, 1.5, 2)
    copies = sum(r.copies for r in mix(awkward, *args).collect())
    out = take(awkward, *args)
    assert out.columns == awkward.columns and out.count() == copies


def some():
    return F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))


def test_repeated_and_null_ids_meet_the_target(spark):
    rng = random.Random(8)
    sizes = [rng.randint(5, 60) for _ in range(6000)]
    for name, id_of in (("null", lambda k: None if k % 10 < 7 else k), ("three", lambda k: k % 3), ("alike", lambda k: 1 if k % 2 else k)):
        rows = [(id_of(k), " ".join(["w"] * (30 if name == "alike" and k % 2 else sizes[k])) + ("" if name == "alike" and k % 2 else f" {k}"), "a" if k % 5 else "b") for k in range(6000)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
        found = [(r.doc_id, r["size"], r.taken, r.source, r.target) for r in op1_mixing(spark, "", docs).collect()]
        assert sorted((str(i), n) for i, n, *_ in found) == sorted((str(i), len(t.split())) for i, t, _ in rows)
        for s in "ab":
            got, target = sum(x[2] for x in found if x[3] == s), next(x[4] for x in found if x[3] == s)
            assert abs(got - target) <= 0.001 * target, (name, s, got, target)
        again = [(r.doc_id, r["size"], r.taken, r.source, r.target) for r in op1_mixing(spark, "", docs.repartition(5)).collect()]
        assert Counter(again) == Counter(found)
        taken = Counter((r.doc_id, r.text) for r in take(docs, F.array("source"), some(), by_turn, 1.5, 2).collect())
        assert Counter((i, len(t.split())) for (i, t), n in taken.items() for _ in range(n)) == Counter((i, n) for i, n, t, *_ in found for _ in range(t // n))


def test_tables_route_as_the_driver_does(spark, monkeypatch):
    """Many sources, one pattern each, and patterns of several sources: above the driver's number the plan comes from tables, and it is the same."""
    rng = random.Random(9)
    rows = [(k, " ".join(["w"] * rng.randint(0, 30)) + f" {k}", f"s{rng.randint(0, 39):02d}" if k % 7 else None, [f"m{j}" for j in rng.sample(range(6), rng.randint(0, 3))]) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, several array<string>")
    for members in (F.array("source"), F.when(F.size("several") > 0, F.col("several")).otherwise(F.array("source"))):
        one = mix(docs, members, some(), by_turn, 1.5, 2).collect()
        monkeypatch.setattr(mixing, "PATTERNS_AT_ONCE", 0)
        other = mix(docs, members, some(), by_turn, 1.5, 2).collect()
        monkeypatch.undo()

        def told(rows):
            return {r.doc_id: (r.taken, [(p.source, p.source_size, round(p.target, 6)) for p in r.plan]) for r in rows}

        a, b = told(one), told(other)
        assert {k: v[1] for k, v in a.items()} == {k: v[1] for k, v in b.items()}
        words = [sum(v[0] for v in x.values()) for x in (a, b)]
        assert abs(words[0] - words[1]) <= 0.001 * words[0]


def test_more_sources_than_the_driver_routes(spark):
    n = mixing.PATTERNS_AT_ONCE + 500
    docs = spark.range(4 * n).selectExpr("id AS doc_id", "concat('a b c d e ', id) AS text", f"concat('s', id % {n}) AS source")
    rows = op1_mixing(spark, "", docs)
    total = rows.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target")).collect()
    assert len(total) == n and all(abs(r.t - r.target) <= 6 for r in total)


def test_the_nearest_choice_of_few_rows():
    rng = random.Random(2)
    for _ in range(200):
        sizes, aim = [rng.randint(1, 30) for _ in range(rng.randint(0, 8))], rng.randint(0, 150)
        chosen = mixing.subset(sizes, aim)
        got = sum(n for n, x in zip(sizes, chosen, strict=True) if x)
        sums = {sum(c) for k in range(len(sizes) + 1) for c in itertools.combinations(sizes, k)}
        assert got == min(sums, key=lambda x: (abs(x - aim), x))
