"""Makes small but complete book archives, of plain paragraphs or with what real books have; the source of synthetic books."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

_PAGE = "<?xml version='1.0' encoding='utf-8'?>\n<!DOCTYPE html>\n<html xmlns=\"http://www.w3.org/1999/xhtml\" lang=\"{lang}\" xml:lang=\"{lang}\">\n<head><title>{title}</title></head>\n<body>{body}</body>\n</html>\n"
_BOX = '<?xml version="1.0" encoding="UTF-8"?>\n<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container" version="1.0"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>\n'

#: Control characters that XML can't hold.
_BAD = {c: None for c in range(32) if c not in (9, 10, 13)}


def text(value: str | None) -> str:
    return escape((value or "").translate(_BAD))


def make_book(title: str, language: str, chapters: list[tuple[str, list[str]]]) -> bytes:
    """chapters: (title, paragraphs). Members are stored with a fixed date, so equal books have equal bytes."""
    names = [f"c{k:04d}.xhtml" for k in range(1, len(chapters) + 1)]
    items = "".join(f'<item id="c{k}" href="{n}" media-type="application/xhtml+xml"/>' for k, n in enumerate(names))
    refs = "".join(f'<itemref idref="c{k}"/>' for k in range(len(names)))
    links = "".join(f'<li><a href="{n}">{text(t)}</a></li>' for n, (t, _) in zip(names, chapters, strict=True))
    parts = {
        "META-INF/container.xml": _BOX,
        "OEBPS/content.opf": f'<?xml version="1.0" encoding="UTF-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" version="3.0"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{text(title)}</dc:title><dc:language>{language}</dc:language></metadata><manifest>{items}<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/></manifest><spine>{refs}</spine></package>\n',
        "OEBPS/nav.xhtml": _PAGE.format(lang=language, title=text(title), body=f"<nav><ol>{links}</ol></nav>"),
    }
    parts |= {f"OEBPS/{n}": _PAGE.format(lang=language, title=text(t), body="".join(f"<p>{text(p)}</p>" for p in ps)) for n, (t, ps) in zip(names, chapters, strict=True)}
    return _archive(parts)


def _archive(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip")
        for name, data in parts.items():
            info = zipfile.ZipInfo(name)
            info.compress_type = zipfile.ZIP_DEFLATED
            z.writestr(info, data if isinstance(data, bytes) else data.encode("utf-8", "replace"))
    return out.getvalue()


#: A chapter with a heading and words inside inline markup, an object with a text of its own, an entity, a link to a note, and text that stays as it is.
_RICH = """<h1>Part <em>no. {k}</em></h1>
<p class="note extra">Left out {k}</p>
<p>Before <b>said {words}</b> after <img src="p.png" alt="Picture {k}"/> end &eacute;!</p>
<pre>code {k}</pre>
<p>See <a id="n{k}" href="#m{k}">note {k}</a></p>
<div id="m{k}" translate="no">kept {k}</div>{more}"""


def make_rich_book(title: str, language: str, texts: list[str], faulty: bool = False) -> bytes:
    """A book with an NCX beside the navigation document, and a chapter made of _RICH for each text. faulty: every chapter repeats an id and has a broken link, and the package lists a file that isn't there."""
    names = [f"c{k:04d}.xhtml" for k in range(1, len(texts) + 1)]
    more = lambda k: f'<p id="m{k}"><a href="lost.xhtml">lost</a></p>' if faulty else ""
    pages = {f"OEBPS/{n}": _PAGE.format(lang=language, title=f"Part {k}", body=_RICH.format(k=k, words=text(t), more=more(k))) for k, (n, t) in enumerate(zip(names, texts, strict=True), 1)}
    items = "".join(f'<item id="c{k}" href="{n}" media-type="application/xhtml+xml"/>' for k, n in enumerate(names)) + ('<item id="gone" href="gone.css" media-type="text/css"/>' if faulty else "")
    points = "".join(f'<navPoint id="p{k}"><navLabel><text>Part {k}</text></navLabel><content src="{n}"/></navPoint>' for k, n in enumerate(names, 1))
    links = "".join(f'<li><a href="{n}">Part {k}</a></li>' for k, n in enumerate(names, 1))
    return _archive({
        "META-INF/container.xml": _BOX,
        "OEBPS/content.opf": f'<?xml version="1.0" encoding="UTF-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" version="3.0"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{text(title)}</dc:title><dc:language>{language}</dc:language></metadata><manifest>{items}<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="p" href="p.png" media-type="image/png"/></manifest><spine toc="ncx">{"".join(f'<itemref idref="c{k}"/>' for k in range(len(names)))}</spine></package>\n',
        "OEBPS/nav.xhtml": _PAGE.format(lang=language, title=text(title), body=f"<nav><ol>{links}</ol></nav>"),
        "OEBPS/toc.ncx": f'<?xml version="1.0" encoding="UTF-8"?>\n<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><docTitle><text>{text(title)}</text></docTitle><navMap>{points}</navMap></ncx>\n',
        "OEBPS/p.png": b"\x89PNG\r\n",
    } | pages)
