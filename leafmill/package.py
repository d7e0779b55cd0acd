"""Book archives: members, package metadata, manifest and reading order; and writing them back.

What is read from one archive is a pure function of its bytes, to be run in a task for each book.
"""

from __future__ import annotations

import io
import lzma
import posixpath
import re
import zipfile
import zlib
from dataclasses import dataclass, field
from urllib.parse import unquote

from .markup import MarkupError, Node, Tree, parse
from .segments import Segment, Whole, has_words, squeeze

#: Namespaces of the formats. Fixed values.
CONTAINER = "urn:oasis:names:tc:opendocument:xmlns:container"
OPF = "http://www.idpf.org/2007/opf"
DC = "http://purl.org/dc/elements/1.1/"
ENCRYPTION = "http://www.w3.org/2001/04/xmlenc#"

#: Ways of obfuscating fonts, which leave the text readable. Fixed values.
FONT_METHODS = frozenset(("http://www.idpf.org/2008/embedding", "http://ns.adobe.com/pdf/enc#RC"))

#: Media types and, where none is given, extensions of content documents. Fixed values.
CONTENT_TYPES = frozenset(("application/xhtml+xml", "text/html"))
CONTENT_EXTENSIONS = frozenset((".xhtml", ".html", ".htm", ".xml"))

NCX_TYPE = "application/x-dtbncx+xml"

#: Links in markup and style sheets. A fixed pattern.
LINK = re.compile(r"""(?:href|src)\s*=\s*["']([^"']+)["']|url\(\s*["']?([^"')]+)""")

MIMETYPE = "mimetype"


class BookError(ValueError):
    """The archive isn't a book that can be worked with."""


def resolve(base: str, href: str) -> str:
    """The member that `href` names in the member `base`; a plus sign stays a plus sign."""
    return posixpath.normpath(posixpath.join(posixpath.dirname(base), unquote(href.partition("#")[0])))


def is_content(media_type: str, path: str) -> bool:
    return media_type in CONTENT_TYPES or (not media_type and posixpath.splitext(path)[1].lower() in CONTENT_EXTENSIONS)


def links(name: str, data: bytes) -> list[str]:
    """The members that a text file points to, whether they exist or not, each once."""
    found = (a or b for a, b in LINK.findall(data.decode("utf-8", "replace")))
    return list(dict.fromkeys(resolve(name, x) for x in found if x and "://" not in x and not x.startswith(("#", "data:", "mailto:"))))


@dataclass
class Package:
    """What a package document says. Items and references keep their order."""

    path: str
    tree: Tree
    items: list[dict] = field(default_factory=list)
    spine: list[str] = field(default_factory=list)
    toc: str | None = None
    cover: str | None = None

    def _all(self, name: str, space: str = OPF) -> list[Node]:
        return [x for x in self.tree.root.walk() if x.markup is None and x.local == name and x.space == space]

    def read(self) -> Package:
        by_id: dict[str, dict] = {}
        for x in self._all("item"):
            if x.get("id") and x.get("href"):
                # A repeated id keeps its first place and takes its last value.
                by_id[x.get("id")] = {"id": x.get("id"), "path": resolve(self.path, x.get("href")), "media_type": (x.get("media-type") or "").strip().lower(), "properties": sorted(set((x.get("properties") or "").split()))}
        self.items = [{"ord": k, **v} for k, v in enumerate(by_id.values())]
        self.spine = [x.get("idref") or "" for x in self._all("itemref")]
        spine = next((x for x in self.tree.root.nodes() if x.local == "spine" and x.space == OPF), None)
        self.toc = spine.get("toc") if spine is not None else None
        self.cover = next((x.get("content") for x in self._all("meta") if x.get("name") == "cover"), None)
        return self

    def titles(self) -> list[Node]:
        return [x for x in self._all("title", DC) if x.first_text().strip()]

    @property
    def title(self) -> str | None:
        return next((x.first_text().strip() for x in self.titles()), None)

    @property
    def language(self) -> str | None:
        return next((x.first_text().strip() for x in self._all("language", DC) if x.first_text().strip()), None)

    def set_language(self, code: str) -> None:
        """Sets the first language; a package without one stays as it is."""
        for x in self._all("language", DC)[:1]:
            x.set_text(code)

    def title_segments(self) -> list[Segment]:
        return [Segment(0, squeeze(x.first_text()), "heading", place=Whole(x)) for x in self.titles() if has_words(x.first_text())]

    def without(self, removed: set[str]) -> None:
        """Takes the rows of removed members out, with the white space before each."""
        ids = {x["id"] for x in self.items if x["path"] in removed}
        for x in [*self._all("item"), *self._all("itemref"), *self._all("reference")]:
            key = x.get("id") if x.local == "item" else x.get("idref")
            if key in ids if x.local != "reference" else resolve(self.path, x.get("href") or "") in removed:
                x.detach(with_space_before=True)


def open_archive(data: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, OSError) as e:
        raise BookError(f"not an archive: {e}") from None


def read_member(z: zipfile.ZipFile, member: str | zipfile.ZipInfo) -> bytes:
    """A member's bytes. One that is missing, damaged, encrypted or packed in an unknown way is a BookError."""
    name = member if isinstance(member, str) else member.filename
    try:
        return z.read(member)
    except KeyError:
        raise BookError(f"the archive has no {name}") from None
    except (zipfile.BadZipFile, zlib.error, EOFError, OSError, RuntimeError, lzma.LZMAError) as e:  # NotImplementedError is a RuntimeError
        raise BookError(f"{name} can't be read: {e}") from None


def _xml(z: zipfile.ZipFile, name: str) -> Tree:
    try:
        return parse(read_member(z, name))
    except MarkupError as e:
        raise BookError(f"{name} can't be parsed: {e}") from None


def read_package(z: zipfile.ZipFile) -> Package:
    """Checks for encryption, finds the package document and reads it. Raises BookError."""
    if "META-INF/encryption.xml" in z.NameToInfo:
        for x in _xml(z, "META-INF/encryption.xml").root.walk():
            if x.local == "EncryptionMethod" and x.space == ENCRYPTION and x.get("Algorithm") not in FONT_METHODS:
                raise BookError("the book is encrypted (DRM)")
    path = next((x.get("full-path") for x in _xml(z, "META-INF/container.xml").root.walk() if x.local == "rootfile" and x.space == CONTAINER), None)
    if not path:
        raise BookError("the container names no package document")
    return Package(path, _xml(z, path)).read()


#: Elements that are an entry of a table of contents.
ENTRIES = ("li", "navPoint")


def prune(root: Node, base: str, removed: set[str]) -> int:
    """Takes the table-of-contents entries that point at removed members out, each with all that is below it."""
    entry_of: dict[int, Node | None] = {}  # by node, the nearest entry that it belongs to
    doomed: dict[int, Node] = {}
    for node in root.walk() if removed else ():
        entry = entry_of[id(node)] = node if node.local in ENTRIES else entry_of.get(id(node.parent))
        points_at = [x for x in (node.get("href"), node.get("src")) if x][:1] if node.markup is None and entry is not None else []
        if any("://" not in x and resolve(base, x) in removed for x in points_at):
            doomed[id(entry)] = entry
    found = [entry for entry in doomed.values() if entry.parent is not None]
    for entry in found:
        entry.detach(with_space_before=True)
    return len(found)


def write_archive(source: bytes, replaced: dict[str, bytes], removed: set[str]) -> bytes:
    """The archive with some members replaced or left out; mimetype first and stored, all else in its order, with its date and flags."""
    out = io.BytesIO()
    with open_archive(source) as z, zipfile.ZipFile(out, "w") as to:
        for old in sorted(z.infolist(), key=lambda x: x.filename != MIMETYPE):
            if old.is_dir() or old.filename in removed:
                continue
            new = zipfile.ZipInfo(old.filename, old.date_time)
            new.external_attr = old.external_attr
            plain = old.filename == MIMETYPE or old.compress_type == zipfile.ZIP_STORED
            new.compress_type = zipfile.ZIP_STORED if plain else zipfile.ZIP_DEFLATED
            to.writestr(new, replaced[old.filename] if old.filename in replaced else read_member(z, old))
    return out.getvalue()
