from __future__ import annotations

import base64
import hashlib
import io
import itertools
import math
import wave
import zlib
from collections import Counter

import pytest
import zstandard
from leafmill.llm import html as extraction
from leafmill.llm import media
from leafmill.llm.queries_html import op3_html_extraction
from leafmill.llm.queries_media import op6_media
from leafmill.llm.queries_warc import op5_warc
from leafmill.llm.common import shared_dir
from leafmill.llm.warc import read_archives, read_records, resolve, write_archives, write_record

PAGES = "page_id long, url string, html string, key string, digest string, type string, length string, best string, path string, host string"


@pytest.fixture
def pages(spark):
    rows = [(1, "http://a/x", "<p>same</p>"), (2, "http://a/y", "<p>same</p>"), (3, "http://a/z", "<p>other é</p>"), (4, None, None), (5, "http://b/", None), (6, "http://b/", ""), (None, "http://c/ sp\nace", "<p>same</p>"), (7, "x", "y" * 300_000), (3, "http://a/z", "<p>another</p>"), (9, "http://one", "two rows"), (9, "http://two", "two rows"), (8, "http://three", "two rows"), (None, "u", "no id"), (None, "v", "no id")]
    return spark.createDataFrame([(*r, *"xxxxxxx") for r in rows], PAGES)


def test_warc_query_by_brute_force(spark, pages):
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    best: dict = {}
    for i, data in rows:
        best[data] = max(best.get(data, (False, 0)), (i is not None, i or 0))
    expected = []
    for i, data in rows:
        known, first = best[data]
        own = (i is not None, i or 0) == best[data]
        expected.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if own else "revisit", None if own else first))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in op5_warc(spark, "", pages).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    archives = write_archives(pages, shared_dir(spark, "warc-test"))
    assert all(r.verified for r in read_archives(archives).collect())
    assert op5_warc(spark, "", pages.limit(0)).collect() == []


def test_least_bytes(spark, pages):
    kinds = {(r.key, r.type) for r in resolve(pages, "page_id", "html", least_bytes=5).collect()}
    assert {(4, "response"), (5, "response"), (6, "response"), (1, "revisit"), (2, "response")} <= kinds


def test_records_survive_small_reads(monkeypatch):
    import leafmill.llm.warc as m

    sink = io.BytesIO()
    for k in range(5):
        write_record(sink, "response" if k % 2 == 0 else "revisit", k, f"http://h/{k}", b"\r\n\r\nbody" * k, 8 * k, "D", (k - 1, "http://h") if k % 2 else None)
    monkeypatch.setattr(m, "CHUNK", 7)
    found = list(read_records(io.BytesIO(sink.getvalue())))
    assert [f["X-Page-ID"] for f, _ in found] == list("01234") and found[2][1].endswith(b"\r\n\r\nbody" * 2)
    with pytest.raises(ValueError):
        list(read_records(io.BytesIO(sink.getvalue()[:-3])))


def test_chunks_cut_alike_and_join(spark):
    data = b"".join(hashlib.sha256(bytes([k % 256, k // 256])).digest() for k in range(6000))
    parts = media.chunks(data)
    assert b"".join(parts) == data and max(map(len, parts)) <= media.MOST and min(map(len, parts[:-1])) >= media.LEAST
    moved = media.chunks(b"inserted" + data)
    assert len(set(parts) & set(moved)) >= len(parts) - 3
    assert media.chunks(b"") == [] and media.chunks(b"a") == [b"a"]
    h, ends = 0, []
    for k, c in enumerate(data[:20_000]):  # the hash by its definition
        h = (2 * h + int(media._GEAR[c])) % (1 << 32)
        if h >> (32 - media.BITS) == 0:
            ends.append(k + 1)
    start = 0
    for end in media.cuts(data)[:5]:
        assert end == next(e for e in ends if e >= start + media.LEAST)
        start = end


def told(payload: bytes) -> str:
    """The feature by its definition, in plain Python."""
    mean = math.fsum(payload) / len(payload)
    dev = math.sqrt(math.fsum((x - mean) ** 2 for x in payload) / len(payload))
    cross = sum((a >= mean) != (b >= mean) for a, b in itertools.pairwise(payload)) / len(payload)
    ranges = Counter(x // 32 for x in payload)
    return f"mean={mean:.4f};dev={dev:.4f};cross={cross:.4f};hist=" + ",".join(f"{ranges[k] / len(payload):.4f}" for k in range(8))


def sound(payload: bytes) -> bytes:
    """The WAV file as the standard library writes it."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(8000)
        w.writeframes(payload)
    return out.getvalue()


def test_media_query_by_brute_force(spark, awkward, empty):
    def expected(text):
        data = (text or "").encode()
        p = data + b" " * (-len(data) % 192 if data else 192)
        w = sound(p)
        assert media.samples(w) == p
        return len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(w), hashlib.sha256(w).hexdigest(), told(p)

    long = awkward.where("doc_id = 8").first().text
    more = [(50, long[:90_000] + " tail"), (1, "another text of id 1"), (None, long), (None, long), (8, long), (51, long * 8), (52, long[:5000] * 3)]
    texts = awkward.unionByName(spark.createDataFrame([(i, t, *[None] * 3, *"x" * 13) for i, t in more], awkward.schema))
    got = [(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) for r in op6_media(spark, "", texts).collect()]
    assert sorted(got, key=str) == sorted(((r.doc_id, *expected(r.text)) for r in texts.collect()), key=str)
    assert op6_media(spark, "", empty).collect() == []

    # Every chunk's bytes stand in the store once, alone in `shared` or together with others in `data`.
    rows, unpack = media.store(texts)[0].collect(), zstandard.ZstdDecompressor().decompress
    held = Counter()
    for r in rows:
        data, at = unpack(r.data) if r.data else b"", 0
        for n in r.sizes:
            held[data[at : at + n]] += 1
            at += n
        assert at == len(data)
        held.update(unpack(x.chunk) for x in r.shared)
    every = {c for r in texts.collect() for c in media.chunks(sound(media.padded(r.text)[0]))}
    assert set(held) == every and set(held.values()) == {1}
    assert any(r.shared for r in rows) and any(r.foreign for r in rows)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<html><body><nav><a href=x>Menu</a></nav><article><h1>T &amp; U</h1><p>One <b>bold</b> word.<p>Two\n  words<br>more</article><footer>f</footer>", "T & U One bold word. Two words more"),
        ("<body><div class='ad'>buy</div><main><p>Text of the page, long enough to count.</p><div class=comments><p>nice!</p></div></main></body>", "Text of the page, long enough to count."),
        ("<script>var a='</p>';</script><style>p{}</style><!-- <p>no</p> --><p>Only this.</p>", "Only this."),
        ("<div class=sidebar><p>side side side</p></div><div class=post><h2>Head</h2><ul><li>a<li>b</ul><table><tr><td>c<td>d</table><pre>e  f</pre></div>", "Head a b c d e f"),
        ("<article><header><h1>Kept</h1></header><p>x&#160;y &lt;z&gt;</p><form><input><button>Go</button></form><aside>no</aside></article>", "Kept x y <z>"),
        ("<p hidden>no</p><p style='display: none'>no</p><p>yes</p><p", "yes"),
        ("<p title=it's>one</p><p data-x=\"a>b\" class='k'>two isn't</p>", "one two isn't"),
        ("", ""), (None, ""), ("plain", "plain"), ("<<<>>>", "<<<>>>"), ("<article></article>", ""),
    ],
)
def test_extraction(page, text):
    own = extraction.containers(page)
    assert extraction.extract(page, max(own, key=own.get) if own else None) == text
    assert extraction.extract(page, "html>body>nowhere") == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<html class=no-print><body class='right-sidebar'><p>Body text.</p></body></html>", "Body text."),
        ("<body class='page no-sidebar sidebar'><div class='has-sidebar'><p>Body text.</p></div></body>", "Body text."),
        ("<body id=search><article class='post category-social social'><p>Post.</p></article></body>", "Post."),
        ("<main role=main class=search id=search><p>Post.</p></main>", "Post."),
        ("<article><h2 id='related-work'>Related work</h2><p>One.</p><h2 id=search>Search</h2><p id=notice class=copyright>Two.</p></article>", "Related work One. Search Two."),
        ("<article><section id='search'><h2>Search</h2><p>One.</p></section><div class=section id=tags><p>Two <span id=share>three</span>.</p></div><dl><dt id=menu>Menu<dd>Four.</dl></article>", "Search One. Two three. Menu Four."),
        ("<article><p>One.</p><div class='Comments x'><p>nice!</p></div><div id=comments>no</div><section class=related>no</section><ul class='social'><li>no</ul><div role=search>no</div></article><div id=sidebar><p>no</p></div>", "One."),
    ],
)
def test_layout_classes_and_anchors_keep_their_text(page, text):
    assert extraction.extract(page, None) == text


def test_hosts_vote(spark):
    good = "<body><div class='c{}'><p>The text of page {}, which is the article, has a few commas, and words.</p></div><div class=links><p><a href=a>one</a> <a href=b>two</a></p></div></body>"
    odd = "<body><div class='c9'><p>Short.</p></div><div class=box><p>A long and busy box, with much text, that other pages of this host, all of them, do not have at all.</p></div></body>"
    rows = [(k, "http://H.example/x", good.format(k, k)) for k in range(5)] + [(9, "http://h.example/y", odd), (10, None, None), (11, "http://other/", odd)]
    got = {r.page_id: r.text for r in op3_html_extraction(spark, "", spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "Short." and got[10] == "" and got[11].startswith("A long") and got[1].startswith("The text of page 1")
    assert op3_html_extraction(spark, "", spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


LEAD = "The lead of article {}, which says in a sentence what follows."
BODY = "The body of article {}, which is much longer than its lead, has commas, and goes on for several lines of text. " * 4


@pytest.mark.parametrize(
    ("page", "kept"),
    [
        ("<body><div id=content><div class=lead><p>{lead}</p></div><div class=body><p>{body}</p></div></div><div class=links><a href=x>One of many links of this page</a></div></body>", "{lead} {body}"),
        ("<body><div id=content><section class=lead><p>{lead}</p></section><div class=in><div class=bar><a href=x>Share</a></div><div class=body><p>{body}</p></div></div></div></body>", "{lead} Share {body}"),
        ("<div class=lead><p>{lead}</p></div><div class=body><p>{body}</p><blockquote class=q>{lead}</blockquote></div>", "{lead} {body} {lead}"),
        ("<body><div class=body><p>{body}</p></div><div class=links><p><a href=x>A link with a text as long as that of a sentence has</a></p><p>{lead}</p><a href=y>Another link with as long a text as the first</a></div></body>", "{body}"),
        ("<body><div class=lead><p>{lead}</p></div><article><p>{body}</p></article></body>", "{body}"),
    ],
)
def test_articles_in_several_boxes_are_whole(spark, page, kept):
    put = lambda text, k: " ".join(text.format(lead=LEAD.format(k), body=BODY.replace("{}", str(k)).strip()).split())
    rows = [(k, "http://h.example/x", page.format(lead=LEAD.format(k), body=BODY.replace("{}", str(k)))) for k in range(4)]
    got = {r.page_id: r.text for r in op3_html_extraction(spark, "", spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: put(kept, k) for k in range(4)}
    assert extraction.extract(rows[1][2], None) == put(kept, 1)


def test_extraction_of_the_tables_pages(spark):
    import html
    import re

    from tests_llm_data import table

    pages = table(spark, "pages")
    got = {r.page_id: (r.text, r.n_chars) for r in op3_html_extraction(spark, "", pages).collect()}
    for r in pages.collect():
        inner = r.html.split("<article>")[1].split("</article>")[0]
        parts = (" ".join(html.unescape(re.sub("<[^>]+>", "", x)).split()) for x in re.split("</?(?:p|h1|br)[^>]*>", inner))
        text = " ".join(x for x in parts if x)
        assert got[r.page_id] == (text, len(text))


def test_deep_pages_take_linear_time_and_keep_their_text():
    import time

    for page, texts in (
        ("<div>" * 50_000 + "text" + "</div>" * 50_000, "text"),
        ("<span>" * 8_000 + "<div>a</div>" * 8_000, " ".join(["a"] * 8_000)),
        ("<span>" * 8_000 + "x<br>" * 8_000, " ".join(["x"] * 8_000)),
        ("<b>" * 8_000 + "</i>" * 8_000 + "y", "y"),
        ("<ul>" + "<i>" * 5_000 + "<li>z" * 5_000, " ".join(["z"] * 5_000)),
        ("".join(f"<div class=c{k}>t" for k in range(5_000)), None),
    ):
        began = time.monotonic()
        assert extraction.extract(page, None) == texts or texts is None
        assert texts or [x[-1] for x in extraction.blocks(page)] == ["t"] * 5_000
        assert time.monotonic() - began < 5
