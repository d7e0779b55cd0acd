from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest
from leafmill.llm import language, toxicity, urls
from leafmill.llm.boosting import BoostedTrees
from leafmill.llm.queries_language import op10_language_id
from leafmill.llm.queries_toxicity import op7_toxicity
from leafmill.llm.queries_urls import RULES, op8_url_filter


def held(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


@pytest.mark.parametrize(("raw", "folded"), [("ID10T!", ["idiot"]), ("cl0wn", ["clown"]), ("Ѕсum", ["scum"]), ("m\u200bo\u00adron", ["moron"]), ("$tup1d", ["tupid"]), ("stup1d.", ["stupid"]), ("Ｔｒａｓｈ", ["trash"]), ("2024", ["2024"]), ("3.14", ["3", "14"]), ("réeux", ["reeux"]), ("a|b", ["alb"]), ("", [])])
def test_folding(raw, folded):
    assert toxicity.fold_words(raw) == folded


def test_lexicon_matches_words_beginnings_and_exceptions():
    lex = toxicity.Lexicon({" trash ": 2.0, " stup": 1.0, " stupid ": 3.0}, exceptions=("trash can",), bias=-2, slope=1)
    found = lambda t: [round(w, 1) for _, _, w in lex.matches(toxicity.folded(t)[0])]
    assert found("Trash, the trash can and stup1d stupor; trashy") == [2.0, 3.0, 1.0]
    assert found("") == [] and lex.score(None) == lex.score("") == lex.score("fine") < 0.5
    assert lex.score("trash stupid") > 0.5
    assert lex.score("trash") > lex.score("trash " + "fine words here " * 400)
    assert toxicity.Lexicon({}).matches(" x ") == []


def test_toxicity_of_the_tables_documents(spark):
    from tests_llm_data import table

    docs, labels = table(spark, "documents"), table(spark, "labels")
    got = op7_toxicity(spark, "", docs, labels).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs.collect())
    assert all(r.held_out == (held(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_toxicity_learns_and_generalises(spark):
    from conftest import words

    rows, labels = [], []
    for k in range(400):
        bad = k % 4 == 0
        text = words(k, 80).split()
        if bad:
            text[10:10] = ["You", ["blurgh", "Blurghs", "zorkface"][k % 3]]
        rows.append((k, " ".join(text), "en", "s"))
        labels.append((k, int(bad)))
    rows += [(1000, "you bLurgh", None, None), (1001, "you bl\u200burgh5 and z0rkface", None, None), (1002, None, None, None), (1003, "", None, None), (None, "fine", None, None), (1004, words(9, 30_000), None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    told = spark.createDataFrame([*labels, (None, 1), (5, None), (5, 0)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in op7_toxicity(spark, "", docs, told).collect()}
    assert len(got) == len(rows)
    out = [k for k in range(400) if held(k, 5) == 0]
    assert all(got[k].held_out for k in out)
    assert np.mean([got[k].predicted == (k % 4 == 0) for k in out]) > 0.95
    assert got[1000].predicted == got[1001].predicted == 1
    assert got[1002].score == got[1003].score < 0.5 and not got[1004].predicted
    plain = op7_toxicity(spark, "", docs, told.limit(0)).collect()
    assert len(plain) == len(rows) and not any(r.predicted for r in plain)
    assert op7_toxicity(spark, "", docs.limit(0), told).collect() == []


def test_boosted_trees_learn_a_rule_and_survive_little():
    rng = np.random.default_rng(1)
    x = rng.random((800, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    model = BoostedTrees().fit(x[:600], y[:600])
    assert ((model.predict(x[600:]) > 0.5) == y[600:]).mean() > 0.93
    assert (BoostedTrees().fit(np.zeros((0, 4)), np.zeros(0)).predict(x[:3]) == 0.5).all()
    assert (BoostedTrees().fit(x[:5], np.ones(5)).predict(x[:3]) > 0.5).all()


def test_url_rules_by_brute_force(spark):
    url = ["http://example.org/es/1", "https://www.example.org/en/15?x=/es/", "http://example.org/en/2", "http://EXAMPLE.org", "http://a.com/fr/x", "http://a.com/de/#f", "http://a.com/fr", "http://notexample.org/es/", "http://org/", "ftp://u@A.Org:80/x", "nothing", "", None, "http://", "x://y://z.com/de/", "http://a.net/p1", "http://a\nb.com/de/q", "http://b.com.evil.net/de/1"]
    rows = [(k, u, "x") for k, u in enumerate(url)] + [(3, "http://a.com/de/1", "x"), (None, "http://a.com/de/1", "x")]
    got = op8_url_filter(spark, "", spark.createDataFrame(rows, "page_id long, url string, host string")).collect()

    def parts(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        path = rest[end:]
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]

    def expected(u):
        host, path = parts(u)
        fits = [(len(t), t, v) for t, v in RULES for h, p in [t.split("/", 1)] if (host == h or host.endswith(f".{h}")) and path.startswith(f"/{p}")]
        return (host, path, *(max(fits)[1:] if fits else (None, None)))

    assert len(got) == len(rows)
    by_url = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in got), key=str)
    assert by_url == sorted(((k, *expected(u)) for k, u, _ in rows), key=str)
    assert all(r.verdict in ("allow", "block") for r in got)
    assert op8_url_filter(spark, "", spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_every_host_suffix_has_its_statistics(spark, monkeypatch):
    from pyspark.sql import functions as F

    # 50,010 suffixes of two unlabelled pages each, and a rarer one of a single page, after the 50,000 commonest.
    many = spark.range(100_020).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.floor(F.col("id") / 2), F.lit(".net/p")).alias("url"))
    rare = spark.createDataFrame([(-1, "http://zz.rare/p"), (-2, "http://a.com/de/1"), (-3, "http://b.com/fr/1")], "page_id long, url string")

    def fit(self, x, y):  # one cut, between no row of a suffix and one
        self.depth, self.trees = 1, [(np.array([urls.FEATURES.index("suffix_rows")]), np.array([0.3]), np.array([-1.0, 1.0]))]
        return self

    monkeypatch.setattr(BoostedTrees, "fit", fit)
    for sized in (urls.small, lambda df, row_bytes: df):  # broadcast while small, and shuffled
        monkeypatch.setattr(urls, "small", sized)
        got = op8_url_filter(spark, "", many.unionByName(rare))
        assert {(r.verdict, r["count"]) for r in got.where("rule IS NULL").groupBy("verdict").count().collect()} == {("block", 100_021)}


def test_a_suffix_rate_does_not_tell_a_urls_own_label(spark, monkeypatch):
    # Suffixes of one labelled page each, whose path alone tells the label, repeated; and one suffix with many of both.
    lone = [(f"http://h{k}.org/{'aa' if k % 2 else 'a/b/c/d/e/f'}", k % 2) for k in range(300)]
    shared = [(f"http://big.net/{'x' if k % 2 else 'y'}{k}", k % 2) for k in range(400)]
    rules = [*((u.split("://")[1], "block" if y else "allow") for u, y in lone), ("big.net/x", "block"), ("big.net/y", "allow")]
    free = [f"http://new{k}.com/{'aa' if k % 2 else 'a/b/c/d/e/f'}" for k in range(40)]
    rows = [*(u for u, _ in lone for _ in range(2)), *(u for u, _ in shared), *free]
    seen = []
    fit = BoostedTrees.fit
    monkeypatch.setattr(BoostedTrees, "fit", lambda self, x, y: seen.append((x, y)) or fit(self, x, y))
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    monkeypatch.setattr(urls, "matched_rule", lambda host, path, told: by_table(host, path, told))

    def by_table(host, path, told):  # as many rules as these would make too long an expression
        from itertools import chain

        from pyspark.sql import functions as F

        text = F.concat(host, path)
        said = F.create_map(*[F.lit(x) for x in chain.from_iterable(told[:-2])])
        said = F.coalesce(said[text], F.when(text.startswith("big.net/x"), "block").when(text.startswith("big.net/y"), "allow"))
        return F.when(said.isNotNull(), text), said

    got = urls.judge(pages, rules, "page_id").collect()
    (x, y), at = seen[0], urls.FEATURES.index("suffix_rate")
    alone = math.log1p(2) == x[:, urls.FEATURES.index("suffix_rows")]  # of the library that made it: another may differ in the last bit
    assert alone.sum() == 600 and (x[alone, at] == 0.5).all()
    shared_rates = [set(x[~alone & (y == label), at]) for label in (0, 1)]
    assert shared_rates[0] == shared_rates[1] and len(shared_rates[0]) > 1
    new = {r.page_id: r.verdict for r in got if r.rule is None}
    assert new == {len(rows) - 40 + k: "block" if k % 2 else "allow" for k in range(40)}


def test_url_features_have_names():
    assert len(urls.features("https://a.b-c.org/x/y1.html?p=1&q=22#f", 3, 0.5)) == len(urls.FEATURES) == len(urls.features(None, 0, 0.5))


def test_bitmask_filters_return_every_language_and_correct_false_positives():
    f = language.Filters(["aa", "bb"], bits=12)
    rng = np.random.default_rng(2)
    a, b, both, other = (rng.integers(0, 1 << 63, 300, np.uint64) for _ in range(4))
    for k, h in ((0, a), (1, b), (0, both), (1, both)):
        f.add(3, k, h)
    assert (f.lookup(3, both) == 3).all() and (f.lookup(3, a) & 1).all()
    rate = f.rates(3)
    assert abs((f.lookup(3, other) & 1).mean() - rate[0]) < 0.05


@pytest.mark.parametrize(("n", "kind"), [(1, "uint8"), (8, "uint8"), (9, "uint16"), (33, "uint64"), (64, "uint64")])
def test_masks_have_a_bit_for_each_language(n, kind):
    f = language.Filters([str(k) for k in range(n)], bits=10)
    h = np.arange(1, 50, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    f.add(3, n - 1, h)
    assert f.slots[3].dtype == kind and (f.lookup(3, h) >> (n - 1) == 1).all() and f.rates(3)[: n - 1].sum() == 0


def test_every_language_is_learnt(spark):
    from conftest import words

    def tongue(k):  # stems that no other language has
        return tuple(f"{a}{chr(0x4E00 + k)}{b}" for a in "bdk" for b in ("", "a", "o"))

    # 70 languages; the last six are the rarest.
    rows = [(100 * k + i, words(100 * k + i, 40, tongue(k)), f"l{k:02}") for k in range(70) for i in range(12 if k < 64 else 8)]
    got = op10_language_id(spark, "", spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    lang = {i: name for i, _, name in rows}
    assert len(got) == len(rows) and all(r.lang_pred == lang[r.doc_id] for r in got)


@pytest.mark.parametrize("n", [65, 130])
def test_masks_of_several_words(n):
    f = language.Filters([str(k) for k in range(n)], bits=10)
    h = np.arange(1, 50, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    f.add(3, n - 1, h)
    f.add(3, 0, h[:5])
    assert f.slots[3].shape == (1024, -(-n // 64)) and (f.has(f.lookup(3, h))[[0, n - 1]] >= [5, 49]).all()
    assert f.rates(3)[1 : n - 1].sum() == 0 < f.rates(3)[n - 1]


def test_language_of_the_tables_documents(spark):
    from tests_llm_data import table

    docs = table(spark, "documents")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = op10_language_id(spark, "", docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(lang)
    assert all(r.held_out == (held(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got if r.held_out]) > 0.9


def test_language_of_awkward_rows(spark, awkward, empty):
    got = op10_language_id(spark, "", awkward).collect()
    assert len(got) == awkward.count()
    by_id = {r.doc_id: r.lang_pred for r in got if r.doc_id is not None}
    assert by_id[4] == by_id[5] == by_id[6] == by_id[9] == "und" and by_id[8] == "en"
    assert op10_language_id(spark, "", empty).collect() == []
    assert {r.lang_pred for r in op10_language_id(spark, "", awkward.withColumn("lang", awkward["lang"].substr(9, 1))).collect()} <= {"und", ""}
    kept = language.known_only(awkward, language.fit(awkward))
    assert kept.columns == awkward.columns and kept.count() == sum(r.lang_pred != "und" for r in got)
    assert language.known_only(awkward.where("doc_id IN (1, 4, 5, 9)"), language.Filters()).count() == 1


def test_matches_against_every_exception_phrase_by_brute_force():
    import time

    rng = random.Random(6)
    lexicon = toxicity.Lexicon({" bad ": 1.0, " wor": 2.0, " ugly": 0.5}, ["not bad", "bad bad luck", "word list", "ugly duck word list"])
    for _ in range(300):
        line, _ = toxicity.folded(" ".join(rng.choice(["not", "bad", "luck", "word", "list", "ugly", "duck", "worst"]) for _ in range(rng.randint(0, 12))))
        spans = [(k, k + len(x) - 1) for x in lexicon.exceptions for k in range(len(line)) if line.startswith(x, k)]
        expected = {}
        for entry, weight in lexicon.entries.items():
            for k in range(len(line)):
                if line.startswith(entry, k) and (k not in expected or weight > expected[k][1]):
                    expected[k] = (k + len(entry) - 1, weight)
        assert lexicon.matches(line) == [(s, e, w) for s, (e, w) in sorted(expected.items()) if not any(a <= s and e <= b for a, b in spans)]
    began = time.monotonic()
    assert lexicon.evidence("not bad luck " * 20_000)[2] == 0 and time.monotonic() - began < 5


def test_harmless_phrases_are_learnt(spark):
    rng = random.Random(7)
    plain = ["river", "stone", "paper", "music", "garden", "window", "summer", "bread"]
    rows, labels = [], []
    for k in range(1200):
        words = [rng.choice(plain) + rng.choice(plain) for _ in range(30)]
        toxic = int(k % 3 == 0)
        words.insert(rng.randrange(30), "trash" if toxic else "trash can" if k % 10 == 1 else "calm")
        rows.append((k, " ".join(words)))
        labels.append((k, toxic))
    docs, told = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, y int")
    lexicon = toxicity.fit(docs, told, "doc_id")
    assert " trash can " in lexicon.exceptions
    assert lexicon.score("you are trash my friend of mine") > 0.5 > lexicon.score("put it into the trash can please")


def test_accuracy_on_the_tables(spark):
    """Held-out documents: the score by its contract, and how often it is right."""
    from leafmill.llm.queries_language import op10_language_id
    from leafmill.llm.queries_toxicity import op7_toxicity
    from tests_llm_data import table

    docs, labels = table(spark, "documents"), table(spark, "labels")
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    found = [r for r in op7_toxicity(spark, "", docs, labels).collect() if r.doc_id in toxic]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in found)
    assert sum(r.predicted == toxic[r.doc_id] for r in found if r.held_out) >= 0.8 * sum(r.held_out for r in found)
    langs = {r.doc_id: r.lang for r in docs.collect()}
    told = [r for r in op10_language_id(spark, "", docs).collect() if langs[r.doc_id] is not None]
    assert sum(r.lang_pred == langs[r.doc_id] for r in told if r.held_out) >= 0.95 * sum(r.held_out for r in told)


def test_copies_of_one_text_are_one_text_of_the_sample(spark):
    rows = [("Only this sentence stands here a thousand times over.", "en")] * 3000 + [(f"der {w} und die {w}keit am {w}tag", "de") for w in ("haus", "baum", "wald", "berg") for _ in range(50)] + [(f"this is the {w} with many {w}s of his own", "en") for w in ("house", "river", "tree", "stone")] * 50
    filters = language.fit(spark.createDataFrame(rows, "text string, lang string"), rows=20)
    assert filters.predict("this is the river of the house")[0] == "en" and filters.predict("der wald und die berg")[0] == "de"


def test_filters_grow_with_what_is_learnt(spark):
    rng = random.Random(3)
    rows = [("".join(chr(rng.randint(0x4E00, 0x9F00)) for _ in range(3000)), lang) for lang in ("a", "b") for _ in range(3)]
    rows = [(t + t, lang) for t, lang in rows]
    filters = language.fit(spark.createDataFrame(rows, "text string, lang string"), bits=8)
    assert filters.bits > 12 and all(filters.predict(t)[0] == lang for t, lang in rows)


def test_texts_of_no_learnt_language_go(spark):
    rows = [(k, f"the {a} and the {b} of this {c}", "en") for k, (a, b, c) in enumerate([("house", "river", "town"), ("tree", "stone", "day"), ("river", "tree", "house"), ("day", "town", "stone")] * 10)]
    docs = spark.createDataFrame([*rows, (100, "xqzv jjkw vvqx zzqk wxkj", None), (101, "12 34", None), (102, None, None), (103, "the house of the river", None)], "doc_id long, text string, lang string")
    filters = language.fit(docs, with_floor=True)
    assert 0 < filters.floor <= 0.1
    assert {r.doc_id for r in language.known_only(docs, filters).where("doc_id >= 100").collect()} == {103}
    assert language.known_only(docs, language.Filters()).where("doc_id >= 100").count() == 2
