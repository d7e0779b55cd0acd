"""Token ids of whole texts by the tokenizers library, with a bounded memory of the pieces that texts are cut into."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Pieces that a process learns before it forgets those not met since as many were learnt before: it remembers twice as many.
CACHE = 200_000

#: Characters of the texts that are cut together; a longer text is cut by itself, a stretch of about as many after the other.
GROUP = 2_000_000

#: Texts of these characters alone, without the start of an added token, are lower-cased and cut here; others are encoded whole.
_PLAIN = re.compile("[\t\n\r\x20-\x3b\x3d-\x7e\xa1-\xffĀ-įĲ-ž‐-‧‰-⁞€]*")
_SPACE = b"\t\n\r "
_BLANK = re.compile("[\t\n\r ]")


def _tables() -> tuple[bytes, bytes]:
    """Bits of each byte as the left and as the right neighbour of a place; the place is cut if both have a bit in common.

    Cut are places where the tokenizer's own rules always end a piece: around digits, between a letter and what is none,
    and before a letter but for an apostrophe, as there are rules for 's and the like. Next to signs beyond ASCII,
    and to letters that share a byte with one, only white space cuts. Left, 64 marks the first byte of a letter and 128
    a second one.
    """
    letters, digits, quote, continued = range(97, 123), range(48, 58), b"'", range(128, 192)
    signs = [c for c in range(33, 127) if c not in (*letters, *digits, *quote)]
    left, right = [0] * 256, [0] * 256
    for table, chars, bits in [
        (left, _SPACE, 1), (left, letters, 2), (left, signs, 4), (left, digits, 8), (left, quote, 16), (left, b"\xc3\xc4\xc5", 64), (left, set(continued) - {0x97, 0xB7}, 128),
        (right, set(range(256)) - {*_SPACE, *continued}, 1), (right, [*signs, *digits, *quote], 2), (right, [*letters, *digits, 0xC4, 0xC5], 4), (right, [*letters, *digits, *signs, *quote], 8), (right, digits, 16),
    ]:
        for c in chars:
            table[c] |= bits
    return bytes(left), bytes(right)


_LEFT, _RIGHT = _tables()


def _stretches(text: str) -> Iterator[str]:
    """The text in parts of GROUP characters and the word that ends there."""
    at = 0
    while at < len(text):
        blank = _BLANK.search(text, at + GROUP)
        end = blank.start() if blank else len(text)
        yield text[at:end]
        at = end


def _pieces(texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The pieces of plain texts, one text's after the other's, and where each text's begin; the end comes last."""
    parts = [t.lower().encode() for t in texts]
    raw = b"\n" + b"\n".join(parts)
    borders = np.cumsum([0, *(len(p) + 1 for p in parts)])
    del parts
    left, right = np.frombuffer(raw.translate(_LEFT), np.uint8), np.frombuffer(raw.translate(_RIGHT), np.uint8)
    ends = left.copy()
    ends[1:] |= (left[:-1] << 1 & left[1:] & 128) >> 6  # the second byte of a letter ends a letter
    first = np.flatnonzero(ends[:-1] & right[1:]) + 1  # of each piece's bytes
    del ends, right
    data = raw.translate(None, _SPACE)
    offsets = np.append(first - np.cumsum(left == 1, dtype=np.int32)[first], len(data))
    return pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode(), np.searchsorted(first, borders)


class ChunkedEncoder:
    """Equal to `Tokenizer.encode(text, add_special_tokens=False)` for a word-end BPE that lower-cases, drops white space and cuts runs of letters, digits and other signs apart.

    Many texts are lower-cased and cut at once, and each of their different pieces is looked up once; a piece's ids are
    remembered. New words are encoded by the library in one call and told apart by their end-of-word tokens.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def ids(self, text: str | None) -> np.ndarray:
        """Little-endian unsigned 32-bit ids; null counts as the empty text."""
        return next(self.many([text]))

    def many(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, in the texts' order."""
        held, size = [], 0
        for t in texts:
            t = t or ""
            if len(t) > GROUP and _PLAIN.fullmatch(t):
                yield from self._group(held)
                held, size = [], 0
                yield np.concatenate([self._cut([s])[0] for s in _stretches(t)])
                continue
            held.append(t)
            size += len(t)
            if size >= GROUP:
                yield from self._group(held)
                held, size = [], 0
        yield from self._group(held)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _group(self, texts: list[str]) -> Iterator[np.ndarray]:
        plain = [_PLAIN.fullmatch(t) is not None for t in texts]
        cut = iter(self._cut([t for t, p in zip(texts, plain, strict=True) if p]))
        for t, p in zip(texts, plain, strict=True):
            yield next(cut) if p else self._whole(t)

    def _cut(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of plain texts."""
        pieces, starts = _pieces(texts)
        found = pa.array(self._look(pieces.dictionary.to_pylist()), pa.large_binary()).take(pieces.indices)
        _, at, out = found.buffers()
        at = np.frombuffer(at, np.int64, len(pieces) + 1)[starts] // 4 if len(pieces) else 0 * starts
        ids = np.frombuffer(out, "<u4", at[-1]) if at[-1] else np.zeros(0, "<u4")
        return [ids[a:b] for a, b in zip(at, at[1:], strict=False)]

    def _look(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of different pieces."""
        if len(self.known) > CACHE:
            self.known, self.older = {}, self.known
        known = self.known
        found = list(map(known.get, pieces))
        if None in found:
            new = [p for p, f in zip(pieces, found, strict=True) if f is None]
            again = list(map(self.older.get, new))
            known.update((p, f) for p, f in zip(new, again, strict=True) if f is not None)
            self._learn([p for p, f in zip(new, again, strict=True) if f is None])
            found = list(map(known.__getitem__, pieces))
        return found

    def _learn(self, pieces: list[bytes]) -> None:
        known, words = self.known, []
        for p in pieces:
            w = p.decode()
            if w.isalpha():
                words.append(w)
            else:
                known[p] = self._whole(w).tobytes()
        if words:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(self.ends[ids]) + 1
            if len(at) != len(words):  # not a tokenizer of this kind
                known.update((w.encode(), self._whole(w).tobytes()) for w in words)
            else:
                data, ends = ids.tobytes(), (4 * at).tolist()
                known.update(zip(map(str.encode, words), map(data.__getitem__, map(slice, [0, *ends], ends)), strict=False))


_ENCODERS: dict[str, ChunkedEncoder] = {}


def encoder(path: str) -> ChunkedEncoder:
    """The process's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkedEncoder(path)
    return _ENCODERS[path]
