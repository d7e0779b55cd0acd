"""XML documents as mixed-content nodes, with a writer that reproduces normal-form input byte for byte.

Names stay as they are written; namespaces are resolved beside them. A node's content is one list of texts and nodes in
document order. Comments, processing instructions and unresolved entities are opaque nodes that carry their markup.
"""

from __future__ import annotations

import html.entities
import re
from collections.abc import Iterator
from xml.parsers import expat

XHTML = "http://www.w3.org/1999/xhtml"
XML_NAMESPACE = "http://www.w3.org/XML/1998/namespace"

_DECLARATION = re.compile(rb"(?:\xef\xbb\xbf)?\s*<\?xml\s([^>]*)\?>")
_NAMED = re.compile(rb"&([A-Za-z][A-Za-z0-9]{1,31});")

#: The entities that XML itself has. Fixed values.
XML_ENTITIES = frozenset((b"amp", b"lt", b"gt", b"quot", b"apos"))


class MarkupError(ValueError):
    """The bytes are not a well-formed document."""


class Text:
    __slots__ = ("value",)

    def __init__(self, value: str):
        self.value = value


class Node:
    """An element, or an opaque piece of markup (`markup` set, no name)."""

    __slots__ = ("name", "space", "attributes", "content", "parent", "markup", "filled")

    def __init__(self, name: str = "", space: str | None = None, attributes: dict[str, str] | None = None, markup: str | None = None):
        self.name, self.space, self.attributes, self.markup = name, space, attributes or {}, markup
        self.content: list[Text | Node] = []
        self.parent: Node | None = None
        self.filled = False  # written as a pair of tags even without content

    @property
    def local(self) -> str:
        """The name without its prefix; '' for opaque nodes."""
        return self.name.rpartition(":")[2]

    @property
    def html(self) -> str | None:
        """The lower-case name of an HTML element; None for opaque nodes and foreign markup."""
        return self.local.lower() if self.markup is None and self.space in (None, XHTML) else None

    def get(self, name: str, default: str | None = None) -> str | None:
        return self.attributes.get(name, default)

    def walk(self) -> Iterator[Node]:
        """This node and all below it in document order."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(x for x in reversed(node.content) if isinstance(x, Node))

    def nodes(self) -> list[Node]:
        return [x for x in self.content if isinstance(x, Node)]

    def first_text(self) -> str:
        """The text before the first node inside."""
        out = []
        for x in self.content:
            if isinstance(x, Node):
                break
            out.append(x.value)
        return "".join(out)

    def set_text(self, value: str) -> None:
        """Replaces the text before the first node inside."""
        k = 0
        while k < len(self.content) and isinstance(self.content[k], Text):
            k += 1
        self.content[:k] = [Text(value)] if value else []

    def place(self, content: list[Text | Node]) -> None:
        """Takes `content` as its own, with neighbouring texts joined and empty ones left out."""
        out: list[Text | Node] = []
        for x in content:
            if isinstance(x, Node):
                x.parent = self
                out.append(x)
            elif x.value:
                if out and isinstance(out[-1], Text):
                    out[-1] = Text(out[-1].value + x.value)
                else:
                    out.append(x)
        self.content = out

    def detach(self, with_space_before: bool = False) -> None:
        """Leaves its parent; the text after it stays, and so does the one before it unless told otherwise."""
        box = self.parent
        k = next(i for i, x in enumerate(box.content) if x is self)
        first = k - 1 if with_space_before and k and isinstance(box.content[k - 1], Text) else k
        box.place(box.content[:first] + box.content[k + 1 :])
        self.parent = None


class Tree:
    """A document: its root, what stands before and after it, and how it was declared."""

    def __init__(self, root: Node, before: list[str], after: list[str], declared: bool, encoding: str, standalone: str | None, tail: bytes):
        self.root, self.before, self.after = root, before, after
        self.declared, self.encoding, self.standalone, self.tail = declared, encoding, standalone, tail

    def to_bytes(self) -> bytes:
        """UTF-8 in normal form: the declaration if there was one, then the prologue line by line, the root, and the original's trailing white space."""
        head = ""
        if self.declared:
            flag = f" standalone='{self.standalone}'" if self.standalone else ""
            head = f"<?xml version='1.0' encoding='{self.encoding}'{flag}?>\n"
        out = [head, *(f"{x}\n" for x in self.before)]
        _write(self.root, out)
        out += [f"\n{x}" for x in self.after]
        return "".join(out).encode("utf-8") + self.tail


def numeric_entities(data: bytes) -> bytes:
    """HTML's named entities as numeric references; XML's own and unknown ones stay."""

    def numeric(m: re.Match) -> bytes:
        meaning = None if m[1] in XML_ENTITIES else html.entities.html5.get(f"{m[1].decode()};")
        return m[0] if meaning is None else "".join(f"&#{ord(c)};" for c in meaning).encode()

    return _NAMED.sub(numeric, data)


def parse(data: bytes) -> Tree:
    """Parses without DTD, network or entity expansion; raises MarkupError."""
    builder = _Builder(data)
    try:
        builder.parser.Parse(data, True)
    except expat.ExpatError as e:
        raise MarkupError(str(e)) from None
    except (ValueError, LookupError) as e:  # encodings that the parser doesn't know
        raise MarkupError(str(e)) from None
    return builder.tree()


def parse_html(data: bytes) -> Tree:
    """Parses an XHTML document, which may use HTML's named entities."""
    return parse(numeric_entities(data))


class _Builder:
    def __init__(self, data: bytes):
        self.data = data
        p = self.parser = expat.ParserCreate()
        p.buffer_text = True
        p.ordered_attributes = True
        p.UseForeignDTD(False)
        p.SetParamEntityParsing(expat.XML_PARAM_ENTITY_PARSING_NEVER)
        p.XmlDeclHandler = self.declaration
        p.StartDoctypeDeclHandler = self.doctype
        p.EndDoctypeDeclHandler = self.doctype_end
        p.StartElementHandler = self.start
        p.EndElementHandler = self.end
        p.CharacterDataHandler = self.text
        p.CommentHandler = lambda x: self.opaque(f"<!--{x}-->")
        p.ProcessingInstructionHandler = lambda name, x: self.opaque(f"<?{name} {x}?>" if x else f"<?{name}?>")
        p.SkippedEntityHandler = lambda name, is_parameter: None if is_parameter else self.opaque(f"&{name};")
        p.EntityDeclHandler = self.entity
        self.root: Node | None = None
        self.open: list[Node] = []
        self.scopes: list[dict[str, str]] = [{"xml": XML_NAMESPACE}]
        self.before: list[str] = []
        self.after: list[str] = []
        self.version, self.encoding, self.standalone = None, None, -1
        self.in_doctype = False

    def declaration(self, version, encoding, standalone):
        self.version, self.encoding, self.standalone = version, encoding, standalone

    def doctype(self, name, system, public, internal):
        self.in_doctype = True
        ids = f' PUBLIC "{public}" "{system}"' if public else f' SYSTEM "{system}"' if system else ""
        self.before.append(f"<!DOCTYPE {name}{ids}>")
        if internal:
            # The internal subset is kept as it stands in the source.
            at = self.parser.CurrentByteIndex
            begin = self.data.rfind(b"<!DOCTYPE", 0, at + 9)
            open_, close = self.data.find(b"[", begin), self.data.find(b"]", at)
            end = self.data.find(b">", close)
            if 0 <= begin < open_ < close < end:
                self.before[-1] = self.data[begin : end + 1].decode("utf-8", "replace")

    def doctype_end(self):
        self.in_doctype = False

    def entity(self, name, is_parameter, value, base, system, public, notation):
        if value is not None and not is_parameter:
            # Internal entities are not expanded: references to them stay opaque.
            self.parser.DefaultHandler = self.default

    def default(self, x):
        if self.open and x.startswith("&") and x.endswith(";"):
            self.opaque(x)

    def start(self, name, pairs):
        attributes = dict(zip(pairs[::2], pairs[1::2], strict=True))
        scope = self.scopes[-1]
        new = {k[6:] if k != "xmlns" else "": v for k, v in attributes.items() if k == "xmlns" or k.startswith("xmlns:")}
        if new:
            scope = scope | new
        self.scopes.append(scope)
        for k in (name, *attributes):
            prefix, colon, _ = k.partition(":")
            if colon and prefix != "xmlns" and prefix not in scope:
                raise MarkupError(f"the prefix {prefix} is not bound")
        node = Node(name, scope.get(name.partition(":")[0] if ":" in name else "") or None, attributes)
        if self.open:
            node.parent = self.open[-1]
            self.open[-1].content.append(node)
        else:
            self.root = node
        self.open.append(node)

    def end(self, name):
        node = self.open.pop()
        self.scopes.pop()
        if not node.content:  # <x/> and <x></x> look alike to the parser; the source tells
            at = self.parser.CurrentByteIndex
            node.filled = self.data[at : at + 2] == b"</" and self.data[at - 2 : at] != b"/>"

    def text(self, x):
        content = self.open[-1].content
        if content and isinstance(content[-1], Text):
            content[-1].value += x
        else:
            content.append(Text(x))

    def opaque(self, markup):
        if self.in_doctype:
            return
        if self.open:
            node = Node(markup=markup)
            node.parent = self.open[-1]
            self.open[-1].content.append(node)
        else:
            (self.before if self.root is None else self.after).append(markup)

    def tree(self) -> Tree:
        declared = _DECLARATION.match(self.data)
        encoding = "utf-8" if (self.encoding or "utf-8").islower() else "UTF-8"
        flag = {1: "yes", 0: "no"}.get(self.standalone)
        return Tree(self.root, self.before, self.after, declared is not None, encoding, flag if declared else None, self.data[len(self.data.rstrip(b" \t\r\n")) :])


_IN_TEXT = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", "\r": "&#13;"})
_IN_VALUE = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "\t": "&#9;", "\n": "&#10;", "\r": "&#13;"})


def _write(root: Node, out: list[str]) -> None:
    todo: list = [root]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif isinstance(x, Text):
            out.append(x.value.translate(_IN_TEXT))
        elif x.markup is not None:
            out.append(x.markup)
        else:
            tag = x.name + "".join(f' {k}="{v.translate(_IN_VALUE)}"' for k, v in x.attributes.items())
            if x.content or x.filled:
                out.append(f"<{tag}>")
                todo.append(f"</{x.name}>")
                todo.extend(reversed(x.content))
            else:
                out.append(f"<{tag}/>")
