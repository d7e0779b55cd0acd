from __future__ import annotations

import json
import zipfile

import books
import pytest
from leafmill.cli import main, parse_chapters
from leafmill.operators import relational as rel
from leafmill.package import BookError
from leafmill.plans.engine import Options, translate_file
from leafmill.providers import Completion, Factory, ProviderError, read_request
from leafmill.sources.books import read_books
from leafmill.streaming.resume import translate_stream
from leafmill.tables import stash
from leafmill.verify import compare, facts, problems, skeleton
from pyspark.sql import functions as F


@pytest.fixture
def shelf(tmp_path):
    (tmp_path / "in").mkdir()

    def put(name="a.epub", data=None, **options):
        (tmp_path / "in" / name).write_bytes(books.book(**options) if data is None else data)
        return tmp_path

    return put


def options(at, model="marking", target="zh-CN", **more):
    return Options(target, Factory("marking", model=model), f"file://{at}/cache", f"file://{at}/out", **more)


def told(out):
    return {(r["name"], r.status, r.requests, tuple((i.seg, i.kind) for i in r.issues)) for r in out.reports.collect()}


def scripted(rule, name="scripted"):
    """A factory whose provider answers by rule(segments, wanted), defined here so that it travels by value."""

    class Provider:
        model = name

        def complete(self, system, user, cancel=None):
            reply = rule(*read_request(user))
            if isinstance(reply, Exception):
                raise reply
            return reply if isinstance(reply, Completion) else Completion(json.dumps(reply), False, "stop")

    class Made:
        model = name

        def __call__(self):
            return Provider()

    return Made()


def test_a_book_end_to_end_and_again(spark, shelf):
    at, events = shelf(), []
    run = lambda **more: translate_file(spark, f"file://{at}/in", options(at, emit=lambda kind, **data: events.append((kind, data)), **more))
    first = run()
    counts = first.counts().collect()[0]
    assert (counts.documents, counts.done, counts.cached, counts.segments, counts.requests, counts.ok) == (3, 3, 0, 11, 4, True)
    assert events[0] == ("plan", {"documents": 3, "translatable": 3, "cached": 0, "segments": 11})
    path = at / "out" / "a.zh-CN.epub"
    data = path.read_bytes()
    with zipfile.ZipFile(path) as z:
        assert z.infolist()[0].filename == "mimetype" and z.testzip() is None
        assert "译：The Ferry" in z.read("OEBPS/one.xhtml").decode() and "<em>late</em>" in z.read("OEBPS/one.xhtml").decode()
        assert z.read("OEBPS/nav.xhtml").decode().count("译：") == 5 and z.read("OEBPS/toc.ncx").decode().count("译：") == 4
        assert "<dc:language>zh-CN</dc:language>" in z.read("OEBPS/content.opf").decode() and "译：A Day Out" in z.read("OEBPS/content.opf").decode()
    again = run()
    assert sum(r.requests for r in again.reports.collect()) == 0 and path.read_bytes() == data
    assert {r.status for r in again.reports.collect()} == {"cached"}
    assert sum(r.requests for r in run(model="other").reports.collect()) == 4

    before, after = (stash(facts(read_books(spark, f"file://{p}").select(F.lit("b").alias("book"), "content")), "facts") for p in (at / "in", path))
    assert problems(before).collect() == problems(after).collect() == []
    assert compare(before, after).collect() == []
    assert skeleton(after).where("name = 'OEBPS/two.xhtml'").first().ids == ["b"]


def test_one_chapter(spark, shelf):
    at = shelf()
    out = translate_file(spark, f"file://{at}/in", options(at, chapters=frozenset({2})))
    assert told(out) == {("OEBPS/two.xhtml", "translated", 1, ())}
    with zipfile.ZipFile(at / "out" / "a.zh-CN.epub") as z:
        assert "译：The Island" in z.read("OEBPS/nav.xhtml").decode() and "译：The Ferry" not in z.read("OEBPS/nav.xhtml").decode()
        assert "<dc:language>en</dc:language>" in z.read("OEBPS/content.opf").decode() and b'lang="en"' in z.read("OEBPS/nav.xhtml")
    with pytest.raises(BookError, match="9"):
        translate_file(spark, f"file://{at}/in", options(at, chapters=frozenset({2, 9})))


def test_documents_that_cannot_be_parsed_or_have_no_words(spark, shelf):
    at = shelf(chapters={**books.CHAPTERS, "bad.xhtml": ("Bad", "<p>open"), "none.xhtml": ("1", "<p>2</p>")})
    out = translate_file(spark, f"file://{at}/in", options(at))
    assert ("OEBPS/bad.xhtml", "unparseable", 0, ((None, "parse"),)) in told(out) and ("OEBPS/none.xhtml", "empty", 0, ()) in told(out)
    assert not out.counts().first().ok
    with zipfile.ZipFile(at / "out" / "a.zh-CN.epub") as z, zipfile.ZipFile(at / "in" / "a.epub") as y:
        assert z.read("OEBPS/bad.xhtml") == y.read("OEBPS/bad.xhtml")


def test_several_books_and_one_that_is_none(spark, shelf):
    shelf("b.epub", chapters={"x.xhtml": ("Other", "<p>Some more words here.</p>")})
    shelf("c.epub", data=b"nothing")
    at = shelf()
    out = translate_file(spark, f"file://{at}/in", options(at))
    assert out.counts().count() == 2 and [r.book[-6:] for r in out.failed.collect()] == ["c.epub"]
    assert sorted(p.name for p in (at / "out").iterdir()) == ["a.zh-CN.epub", "b.zh-CN.epub"]
    with pytest.raises(BookError):
        translate_file(spark, f"file://{at}/in/c.epub", options(at))


def test_dropped_documents_go_with_what_only_they_used(spark, shelf):
    chapters = {**books.CHAPTERS, "ad.xhtml": ("Advert", "<p>Buy the other book.</p><p><img src='ad.png' alt='ad'/><img src='cover.png' alt='c'/></p>")}
    at = shelf(chapters=chapters, extra={"OEBPS/ad.png": b"x", "OEBPS/content.opf": books.parts(chapters)["OEBPS/content.opf"].replace(b"  </manifest>", b'    <item id="ad" href="ad.png" media-type="image/png"/>\n  </manifest>')})
    out = translate_file(spark, f"file://{at}/in", options(at, drop_documents=frozenset({"ad.xhtml"}), drop_if_present=frozenset({"never.xhtml"})))
    assert len(out.reports.collect()) == 4
    with zipfile.ZipFile(at / "out" / "a.zh-CN.epub") as z:
        assert not {"OEBPS/ad.xhtml", "OEBPS/ad.png"} & set(z.namelist()) and "OEBPS/cover.png" in z.namelist()
        assert b"ad." not in z.read("OEBPS/content.opf") and b"Advert" not in z.read("OEBPS/nav.xhtml") and b"Advert" not in z.read("OEBPS/toc.ncx")
    with pytest.raises(BookError, match="never"):
        translate_file(spark, f"file://{at}/in", options(at, drop_documents=frozenset({"never.xhtml"})))


def test_salvaged_documents_are_asked_for_again(spark, shelf):
    at, events = shelf(), []
    o = options(at, target="fr", emit=lambda kind, **data: events.append((kind, data)))
    o.factory = scripted(lambda segments, wanted: {"translations": [{"id": k, "text": "fr " + segments[k].replace("<x1>", "")} for k in wanted]})
    out = translate_file(spark, f"file://{at}/in", o)
    rows = {r["name"]: r for r in out.reports.collect()}
    assert [(k, d["attempt"], d["pending"], d["reason"]) for k, d in events if k == "retry"] == [("retry", 2, 2, "invalid"), ("retry", 3, 2, "invalid")]
    assert rows["OEBPS/one.xhtml"].requests == 3 and {i.kind for i in rows["OEBPS/one.xhtml"].issues} == {"placeholder"} and not out.counts().first().ok
    o.factory = scripted(lambda segments, wanted: {"translations": [{"id": k, "text": "fr " + segments[k]} for k in wanted]})
    again = {r["name"]: (r.status, r.requests) for r in translate_file(spark, f"file://{at}/in", o).reports.collect()}
    assert again == {"OEBPS/one.xhtml": ("translated", 1), "OEBPS/two.xhtml": ("cached", 0), "OEBPS/notes.xhtml": ("cached", 0), "(contents)": ("cached", 0)}


def test_fatal_failures_keep_what_is_done_and_refusals_stop_a_run(spark, shelf):
    at = shelf()
    o = options(at, target="fr", concurrency=1)

    def fails_on_the_island(segments, wanted):
        if any("Island" in x for x in segments.values()):
            return ProviderError("the key is bad")
        return {"translations": [{"id": k, "text": "fr " + segments[k]} for k in wanted]}

    o.factory, o.wave = scripted(fails_on_the_island), 1
    with pytest.raises(ProviderError, match="bad"):
        translate_file(spark, f"file://{at}/in", o)
    assert not (at / "out").exists()
    o.factory = scripted(lambda segments, wanted: {"translations": [{"id": k, "text": "fr " + segments[k]} for k in wanted]})
    assert sum(r.requests for r in translate_file(spark, f"file://{at}/in", o).reports.collect()) <= 4
    o.factory, o.cache = scripted(lambda segments, wanted: ProviderError("too long", "request")), f"file://{at}/cache2"
    with pytest.raises(ProviderError, match="refused"):
        translate_file(spark, f"file://{at}/in", o)


def test_one_wording_for_a_book(spark):
    rows = [("b", "s", "broken heading", True, "heading", 1, 1), ("b", "s", "text", False, "text", 1, 2), ("b", "s", "late title", False, "title", 9, 1), ("b", "s", "early title", False, "title", 8, 3), ("c", "s", "only", True, "attr", 1, 1)]
    got = rel.harmonise(spark.createDataFrame(rows, "book string, source string, text string, broken boolean, kind string, ord int, id int"))
    assert {(r.book, r.text) for r in got.collect()} == {("b", "early title"), ("c", "only")}


def test_issue_runs(spark):
    rows = [(1, 0, 1, "a", "x"), (1, 1, 2, "a", "x"), (1, 2, 3, "a", "y"), (1, 3, None, "a", "y"), (1, 4, None, "a", "y"), (1, 5, 4, "a", None), (1, 6, 5, "a", None), (1, 7, 7, "a", None), (2, 0, 8, "a", None)]
    got = rel.issue_runs(spark.createDataFrame(rows, "doc int, pos int, seg int, kind string, detail string"), ["doc"])
    assert sorted((r.doc, r.first_pos, r.seg, r.last_seg) for r in got.collect()) == [(1, 0, 1, 2), (1, 2, 3, 3), (1, 3, None, None), (1, 4, None, None), (1, 5, 4, 5), (1, 7, 7, 7), (2, 0, 8, 8)]


def test_functions_in_sql(spark):
    from leafmill.functions.register import register

    register(spark)
    one = lambda sql: spark.sql(f"SELECT {sql} AS x").first().x
    assert one("resolve_path('a/b.x', '../c%20d+e')") == "c d+e" and one("has_words('12 a')") and not one("has_words('12')")
    assert one("parse_answer('[{\"id\": 3, \"text\": \"t\"}]')") == {3: "t"} and one("salvage_text(array(), array(1), 'w')") == "w<x1/>"
    assert one("placeholder_faults(array(1), array(), map(1, 0), '<x1>a</x1>')") == [] and one("looks_untranslated('a', 'a', 'fr')") is False
    assert [r.kind for r in spark.sql("SELECT t.kind FROM (SELECT 'a<x1/>' AS s), LATERAL segment_tokens(s) t").collect()] == ["text", "atom"]


def test_stream_takes_only_new_books(spark, shelf):
    at = shelf()
    go = lambda: translate_stream(spark, f"file://{at}/in", options(at), f"file://{at}/check", f"file://{at}/reports", per_batch=1).awaitTermination(120)
    go()
    shelf("b.epub", chapters={"x.xhtml": ("Other", "<p>Some more words here.</p>")})
    go()
    seen = spark.read.parquet(f"file://{at}/reports").groupBy("batch").agg(F.countDistinct("book").alias("n")).collect()
    assert {r.n for r in seen} == {1} and len(seen) == 2
    assert sorted(p.name for p in (at / "out").iterdir()) == ["a.zh-CN.epub", "b.zh-CN.epub"]


def test_command_line(spark, shelf, monkeypatch, capsys, tmp_path):
    at = shelf()
    monkeypatch.setenv("LEAFMILL_PROVIDER", "marking")
    monkeypatch.setenv("LEAFMILL_MODEL", "marking")
    book = str(at / "in" / "a.epub")
    assert main(["translate", book, "--to", "fr"], spark) == 0
    said = capsys.readouterr().out
    assert "3 of 3 documents done" in said and "4 requests" in said and (at / "in" / "a.fr.epub").exists()
    assert main(["translate", book, "--to", "fr", "-o", book], spark) == 2
    assert main(["translate", str(at / "none.epub")], spark) == 2
    assert main(["translate", book, "--chapters", "0"], spark) == 2
    monkeypatch.setenv("LEAFMILL_PROVIDER", "nobody")
    assert main(["translate", book], spark) == 2
    assert parse_chapters("1-3, 7") == {1, 2, 3, 7} and parse_chapters(None) is None


def test_unusual_books(spark, shelf):
    opf = books.parts()["OEBPS/content.opf"]
    change = lambda *pairs: {"OEBPS/content.opf": __import__("functools").reduce(lambda x, p: x.replace(*p), pairs, opf)}
    first = b'<itemref idref="t0"/>'
    shelf("nav-in-spine.epub", extra=change((first, b'<itemref idref="nav"/>' + first)))
    shelf("twice.epub", extra=change((first, first + first)))
    shelf("no-contents.epub", extra=change((b' properties="nav"', b""), (b"application/x-dtbncx+xml", b"text/plain"), (b' toc="ncx"', b"")))
    shelf("bad-contents.epub", extra={"OEBPS/toc.ncx": b"<ncx", "OEBPS/nav.xhtml": b"<html><p></html>"})
    shelf("nameless.epub", extra=change((b"<dc:title>A Day Out</dc:title>", b"<dc:title> </dc:title>"), (b"<dc:language>en</dc:language>", b"")))
    shelf("empty-spine.epub", extra=change((b'idref="t', b'idref="none')))
    shelf("odd-paths.epub", chapters={"a b+c.xhtml": ("T", "<p>Words here</p>")}, extra={"OEBPS/content.opf": books.parts({"a b+c.xhtml": ("T", "<p>Words here</p>")})["OEBPS/content.opf"].replace(b"a b+c.xhtml", b"./x/../a%20b+c.xhtml")})
    at = shelf("late-mimetype.epub", data=books.archive(dict(reversed(books.parts().items()))))
    out = translate_file(spark, f"file://{at}/in", options(at))
    assert not out.failed.count() and out.written.count() == 8
    by_book: dict = {}
    for r in out.reports.collect():
        by_book.setdefault(r.book.rpartition("/")[2], []).append((r.idx, r.status, r.segments))
    assert sorted(i for i, _, _ in by_book["nav-in-spine.epub"]) == [0, 2, 3, 4]
    assert sorted(i for i, _, _ in by_book["twice.epub"]) == [0, 1, 2, 3, 4]
    assert sorted(by_book["no-contents.epub"]) == [(0, "translated", 1), (1, "translated", 5), (2, "translated", 3), (3, "translated", 3)]
    assert [x for x in by_book["nameless.epub"] if x[0] == 0] == [(0, "translated", 2)]
    assert sorted(by_book["empty-spine.epub"])[0][0] == 0 and len(by_book["empty-spine.epub"]) == 1
    assert sorted(by_book["odd-paths.epub"])[1] == (1, "translated", 2)
    with zipfile.ZipFile(at / "out" / "late-mimetype.zh-CN.epub") as z:
        assert z.namelist()[0] == "mimetype"
    with zipfile.ZipFile(at / "out" / "bad-contents.zh-CN.epub") as z:
        assert z.read("OEBPS/toc.ncx") == b"<ncx" and z.read("OEBPS/nav.xhtml") == b"<html><p></html>"


def test_problems_are_found(spark, shelf):
    parts = books.parts(extra={"OEBPS/two.xhtml": books.page("T", "<p id='a'>x</p><p id='a'><a href='gone.xhtml'>y</a><a href='one.xhtml#nope'>z</a></p>")})
    del parts["OEBPS/style.css"]
    at = shelf(data=books.archive({**{k: v for k, v in parts.items() if k != "mimetype"}, "mimetype": parts["mimetype"]}))
    found = stash(facts(read_books(spark, f"file://{at}/in")), "facts")
    said = sorted(r.problem for r in problems(found).collect())
    assert [x for x in said if "style.css" not in x] and any("gone" in x for x in said) and any("nope" in x for x in said) and any("repeats the id a" in x for x in said) and any("missing" in x for x in said) and any("first member" in x for x in said)


def test_driver_entry(spark):
    from pathlib import Path

    import __spark_entry__ as e

    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("no test data")
    assert e.entry(spark).columns == ["source", "text"] and e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_books_of_one_name_and_damaged_ones(spark, tmp_path):
    from leafmill.plans.engine import translate

    good = books.book()
    at = good.index(b".xhtml") + 60
    bad = good[:at] + bytes(255 - x for x in good[at : at + 8]) + good[at + 8 :]
    made = spark.createDataFrame([("mem:/s/a/x.epub", good), ("mem:/s/b/x.epub", good), ("mem:/s/b/y.epub", bad), ("mem:/s/b/z.epub", b"no archive")], "book string, content binary")
    out = translate(made, options(tmp_path))
    assert {(r.book, r.output.rpartition("/out/")[2]) for r in out.written.collect()} == {("mem:/s/a/x.epub", "a/x.zh-CN.epub"), ("mem:/s/b/x.epub", "b/x.zh-CN.epub")}
    assert {r.book for r in out.failed.collect()} == {"mem:/s/b/y.epub", "mem:/s/b/z.epub"}
    one = options(tmp_path)
    one.output = f"file://{tmp_path}/all.epub"
    with pytest.raises(BookError, match="both be written"):
        translate(made, one)


def test_a_stop_file_ends_requests_and_waits(spark, tmp_path):
    import time

    from leafmill.plans.engine import translate
    from leafmill.providers import Cancelled
    from leafmill.tables import StopFile

    stop = StopFile(f"file://{tmp_path}/stop", every=0.0)
    assert not stop.is_set() and not stop.wait(0.01)
    stop.set()
    began = time.monotonic()
    assert stop.wait(30) and time.monotonic() - began < 5
    made = spark.createDataFrame([("mem:/x.epub", books.book())], "book string, content binary")
    with pytest.raises(Cancelled):
        translate(made, options(tmp_path, stop=stop.uri))


def test_a_wave_is_a_few_jobs_and_may_be_empty(spark, tmp_path):
    from leafmill.plans.engine import translate

    made = spark.createDataFrame([("mem:/x.epub", books.book({f"c{k}.xhtml": (f"Chapter {k}", f"<p>Words of chapter {k}</p>") for k in range(8)}))], "book string, content binary")

    def run(wave):
        """The jobs, the waves of documents, and the reports."""
        done = []
        o = options(tmp_path / str(wave), wave=wave, emit=lambda kind, **data: done.append(data) if kind == "done" else None)
        spark.sparkContext.setJobGroup(f"waves of {wave}", "")
        out = translate(made, o)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert (done[-1]["succeeded"], sum(r.requests for r in translate(made, o).reports.collect())) == (8, 0)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"waves of {wave}")), done[-1]["waves"], told(out)

    few, many = run(100), run(1)
    assert (few[1], many[1]) == (1, 8) and few[2] == many[2]
    assert many[0] - few[0] <= 4 * 7
