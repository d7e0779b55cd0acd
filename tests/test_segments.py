from __future__ import annotations

import pytest
from books import page
from hypothesis import given
from hypothesis import strategies as st
from leafmill.markup import MarkupError, parse
from leafmill.package import BookError, links, open_archive, prune, read_package, resolve, write_archive
from leafmill.segments import Labels, Page, Segment, has_words, put, tokens_of


def found(body, **options):
    return [(s.kind, s.source) for s in Page(page("Title", body), **options).segments if s.kind != "title"]


@pytest.mark.parametrize(
    ("body", "expected"),
    [
        ("<p>He said <em>no</em> to <a href='x'>her</a>.</p>", [("text", "He said <x1>no</x1> to <x2>her</x2>.")]),
        ("<p>One<br/>two</p>", [("text", "One<x1/>two")]),
        ("<p><b>All <i>of</i> it</b></p>", [("text", "All <x1>of</x1> it")]),
        ("<div>loose <em>text</em><p>block</p>more</div>", [("text", "loose <x1>text</x1>"), ("text", "block"), ("text", "more")]),
        ("<table><tr><td>a cell</td><td>two</td></tr></table>", [("text", "a cell"), ("text", "two")]),
        ("<h2>A <span>head</span></h2>", [("heading", "A <x1>head</x1>")]),
        ("<h1><span>Only</span></h1>", [("heading", "Only")]),
        ("<p><img src='a' alt='A cat'/></p>", [("attr", "A cat")]),
        ("<p title='Tip'>word</p>", [("attr", "Tip"), ("text", "word")]),
        ("<p><a id='p1' title='page 1'/>word</p>", [("text", "word")]),
        ("<span><p>block in inline</p></span>", [("text", "block in inline")]),
        ("<pre>code</pre><p>x <code>y</code> z</p>", [("text", "x <x1/> z")]),
        ("<p translate='no'>a</p><p class='notranslate b'>c</p><p>d <b translate='no'>e</b> f</p>", [("text", "d <x1/> f")]),
        ("<p>1 2 3</p><p>http://a.example/x</p><p>me@a.example</p><p> </p><p>***</p>", []),
        ("<p>note<sup>1</sup></p>", [("text", "note")]),
        ("<p>it &lt;x1&gt; looks</p>", []),
        ("<p>a<!-- c -->b</p>", [("text", "a<x1/>b")]),
        ("<p>caf&eacute;&nbsp;noir</p>", [("text", "café noir")]),
        ("<svg xmlns='http://www.w3.org/2000/svg'><text>no</text></svg>", []),
        ("<p>a <em><b>deep</b> one</em></p>", [("text", "a <x1><x2>deep</x2> one</x1>")]),
    ],
)
def test_extraction(body, expected):
    assert found(body) == expected


def test_classes_are_dropped_and_the_text_after_them_stays():
    p = Page(page("T", "<p>a<b class='mark x'>gone <i class='mark'>too</i></b>c</p><div class='mark'><p>x</p></div>"), {"mark"})
    assert [s.source for s in p.segments if s.kind == "text"] == ["ac"] and p.dropped == 3


def test_documents_of_other_kinds():
    assert [s.source for s in Page(b"<doc><p>Some words</p></doc>").segments] == ["Some words"]
    for bad in (b"<p>open", b"", b"<p>&nope;</p>", b"<a><x:b/></a>"):
        with pytest.raises(MarkupError):
            Page(bad)
    assert Page(b'<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.1//EN" "x.dtd"><html xmlns="http://www.w3.org/1999/xhtml"><body><p>a &nope; b</p></body></html>').segments[0].source == "a <x1/> b"


FORMS = [
    "<p>It was <em>dark</em>.<a id='r' href='n'><sup>1</sup></a></p>", "<p>\n   padded <b> text </b>\n  </p>", "<div>a<p>b</p>c<br/>d</div>", "<p title=\"a &quot;b&quot;\">x &amp; y &lt; z</p>", "<h1><span class='k'>One</span></h1><hr/><p></p>", "<p>a<!-- n --><?pi x?> b</p>", "<ul><li>a <i>b <b>c</b></i></li></ul>",
]


@pytest.mark.parametrize("body", FORMS)
def test_the_identity_gives_equal_bytes(body):
    data = page("T", body).replace(b"'r' href='n'", b'"r" href="n"').replace(b"='k'", b'="k"')
    p = Page(data)
    for s in p.segments:
        put(s, s.source)
    assert p.to_bytes() == data


@pytest.mark.parametrize("data", [b"<?xml version='1.0' encoding='utf-8'?>\n<a><b/></a>\n", b"<?xml version='1.0' encoding='UTF-8' standalone='yes'?>\n<a><b/></a>", b"<a><b/></a>\n", b"<!DOCTYPE a [<!ENTITY e \"v\">]>\n<a>&e;</a>", b"<!-- top -->\n<a c=\"&#10;\">&#13;</a>\n<!-- end -->"])
def test_markup_is_written_as_it_was(data):
    assert parse(data).to_bytes() == data


def written(body, *texts):
    p = Page(page("T", body))
    for s, t in zip([s for s in p.segments if s.kind != "title"], texts, strict=True):
        put(s, t)
    return p.to_bytes().decode().split('<body class="chapter">')[1].split("</body>")[0]


def test_writing_back():
    assert written("<p>He <em>x</em> and <b>y</b>.</p>", "<x2>B</x2> then <x1>A</x1>!") == "<p><b>B</b> then <em>A</em>!</p>"
    assert written("<p>\n  He <em>x</em>  </p>", "<x1>all</x1>") == "<p>\n  <em>all</em>  </p>"
    assert written("<p>a <em id=\"k\">x</em> <i>y</i> b<br/>c</p>", "broken <x9>") == "<p><em id=\"k\"></em>broken <br/></p>"
    assert written("<p><img alt=\"old\"/></p>", "new  <x1>words</x1>") == "<p><img alt=\"new words\"/></p>"
    assert written("<p>x</p><td></td>", "a & <b>") == "<p>a &amp; &lt;b&gt;</p><td></td>"


def test_language_goes_to_the_root():
    out = Page(page("T", "<p>x</p>")).to_bytes("zh-CN")
    assert b'lang="zh-CN" xml:lang="zh-CN"' in out


S = Segment(1, "a <x1>b</x1><x2/>", "text", frozenset({1}), frozenset({2}), {1: 0, 2: 0})


@pytest.mark.parametrize(
    ("text", "faults"),
    [
        ("<x1>b</x1><x2/>", 0), ("<x2></x2><x1>b</x1>", 0), ("< X1 >b</ x1><x2 />", 0), ("b<x2/>", 1), ("<x1>b</x1>", 1), ("<x1>b<x2/>", 1), ("<x1></x1>b<x2/>", 1), ("<x1><x2/></x1>b", 1), ("<x1>b</x1><x2/><x2/>", 1), ("<x3/><x1>b</x1><x2/>", 1), ("</x1><x1>b</x1><x2/>", 1), ("<x1/><x2/>", 1), ("<x2>b</x2><x1>c</x1>", 2),
    ],
)
def test_faults(text, faults):
    assert len(S.faults(text)) == faults


def test_faults_of_nesting_and_salvage():
    nested = Segment(1, "", "text", frozenset({1, 2}), frozenset(), {1: 0, 2: 1})
    assert not nested.faults("<x1>a<x2>b</x2></x1>") and len(nested.faults("<x1>a</x1><x2>b</x2>")) == 1
    assert S.salvage("<x1>words <x2/> and <x2/> more") == "words <x2/> and  more"
    assert S.salvage("words") == "words<x2/>"


@given(st.lists(st.sampled_from(["<x1>", "</x1>", "<x2/>", "<x2>", "</x2>", "<x7/>", "word", " "]), max_size=12))
def test_salvage_always_keeps_objects_once_and_writing_back_is_well_formed(parts):
    text = "".join(parts)
    kinds = [(k, n) for k, _, n in tokens_of(S.salvage(text)) if k != "text"]
    assert kinds == [("atom", 2)]
    p = Page(page("T", "<p>a <em>b</em><br/>c</p>"))
    put(p.segments[-1], text)
    again = Page(p.to_bytes())
    assert sum(x.html == "br" for x in again.root.walk()) == 1


def test_words():
    assert has_words("a") and has_words("字") and not has_words("12 http://x.y me@x.y www.z") and not has_words(None)


def test_paths_and_links():
    assert resolve("OEBPS/a.xhtml", "../b%20c+d.css#x") == "b c+d.css"
    assert links("d/a.css", b"url('x.png') url(http://z) href=\"b.html#f\" src='data:1' href='#q'") == ["d/x.png", "d/b.html"]


def test_packages():
    from books import archive, book, parts

    with open_archive(book()) as z:
        p = read_package(z)
    assert p.title == "A Day Out" and p.language == "en" and [x["path"] for x in p.items][:2] == ["OEBPS/one.xhtml", "OEBPS/two.xhtml"] and p.toc == "ncx"
    drm = '<encryption xmlns:e="http://www.w3.org/2001/04/xmlenc#"><e:EncryptionMethod Algorithm="{}"/></encryption>'
    with pytest.raises(BookError, match="DRM"), open_archive(book(extra={"META-INF/encryption.xml": drm.format("aes").encode()})) as z:
        read_package(z)
    with open_archive(book(extra={"META-INF/encryption.xml": drm.format("http://www.idpf.org/2008/embedding").encode()})) as z:
        read_package(z)
    with pytest.raises(BookError):
        open_archive(b"no archive")
    with pytest.raises(BookError), open_archive(archive({k: v for k, v in parts().items() if "container" not in k})) as z:
        read_package(z)
    late = dict(reversed(parts().items()))
    with open_archive(write_archive(archive(late), {"OEBPS/style.css": b"new"}, {"OEBPS/cover.png"})) as z:
        assert z.infolist()[0].filename == "mimetype" and z.infolist()[0].compress_type == 0
        assert z.read("OEBPS/style.css") == b"new" and "OEBPS/cover.png" not in z.namelist() and z.namelist()[1] == "OEBPS/notes.xhtml"


def test_pruning_takes_entries_with_what_is_below_them():
    from books import parts

    ncx = Labels(parts()["OEBPS/toc.ncx"])
    assert prune(ncx.root, "OEBPS/toc.ncx", {"OEBPS/two.xhtml"}) == 1
    assert b"The Island" not in ncx.to_bytes() and b"Remarks" in ncx.to_bytes()
