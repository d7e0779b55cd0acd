from __future__ import annotations

from collections import Counter

import corpus_pipeline as c


def test_stages_by_brute_force(spark):
    from leafmill.llm.common import stash
    from test_decontamination import brute as contaminated
    from test_near_duplicates import brute as near
    from test_tokens import _expected
    from tests_llm_data import HERE, table

    docs = table(spark, "documents")
    seen = [docs]
    for name, stage in c.STAGES:
        seen.append(stash(stage(spark, seen[-1], str(HERE)), name))
    for df in seen[:-1]:
        assert df.columns == docs.columns
    rows = [[(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()] for df in seen[:-1]]
    assert sorted(rows[1]) == sorted(rows[0])  # every document is in a learnt language
    assert sorted(i for i, _ in rows[2]) == sorted({x[1] for x in near(rows[1])})
    items = [(r.item_id, r.text) for r in table(spark, "benchmark").collect()]
    dirty = {x[0] for x in contaminated(rows[2], items) if x[5]}
    assert dirty and sorted(i for i, _ in rows[3]) == sorted(i for i, _ in rows[2] if i not in dirty)
    assert set(Counter(i for i, _ in rows[4]).values()) <= {1, 2} and {i for i, _ in rows[4]} <= {i for i, _ in rows[3]}
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in seen[-1].collect())
    assert got == sorted((x[1], x[0], *x[2:]) for x in _expected(sorted(rows[4])))


def test_awkward_rows_and_no_rows(spark, awkward, empty):
    from tests_llm_data import HERE, table

    table(spark, "benchmark")
    for docs in (awkward, empty):
        for _, stage in c.STAGES[:-1]:
            out = stage(spark, docs, str(HERE))
            assert out.columns == docs.columns
            docs = out.cache()
        c.STAGES[-1][1](spark, docs, str(HERE)).collect()


def test_documents_in_no_language_go(spark):
    from tests_llm_data import HERE, table

    docs = table(spark, "documents")
    odd = [(10**9, "xqzv jjkw vvqx zzqk wxkj qqzz " * 40), (10**9 + 1, "12 34 56"), (10**9 + 2, docs.first().text)]
    more = docs.unionByName(spark.createDataFrame([(i, t, None, "src1", len(t)) for i, t in odd], docs.schema))
    kept = {r.doc_id for r in c.STAGES[0][1](spark, more, str(HERE)).select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.select("doc_id").collect()} | {10**9 + 2}


def test_run_is_registered(spark):
    import __spark_entry__ as e

    assert "pipeline" in e.queries() and [n for n, _ in c.STAGES] == ["language_id", "ngram_jaccard_join", "decontamination", "mixing", "token_output"]
    assert sorted(int(n[2:].split("_")[0]) for n in e.queries() if n.startswith("op")) == list(range(1, 11))
