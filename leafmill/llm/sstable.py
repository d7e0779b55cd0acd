"""Token ids of documents in sorted-string-table shards.

A shard holds entries in ascending key order. Layout, all integers little-endian unless said otherwise:

    b"LMSST002"
    data blocks   zstd frames of entries: varint shared, varint unshared, varint value bytes, key suffix, value
    index block   zstd frame, for each data block: varint key bytes, last key, varint offset, varint length, crc32 (u32)
    bloom filter  bits of the keys, PROBES probes by double hashing of xxh64
    footer        index offset, index length, bloom offset, bloom bits, entries, tokens (six u64), id width in bytes, crc32 of the index block, of the bloom filter, and of the footer before it (four u32), b"LMSSTEND"

Every part is checked against its crc32 before it is used, so a damaged shard is an error and never another answer.
A key is byte 0 for a null identifier or byte 1 and the identifier as big-endian 64 bits with its sign bit flipped, so
keys sort as identifiers do, null first. Keys in a block share prefixes with the key before; a block's first key is whole.
A value is the ids, two bytes each where the vocabulary allows, else four. Equal identifiers keep an entry each.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
import zstandard

MAGIC, END = b"LMSST002", b"LMSSTEND"
HEAD, FOOTER = struct.Struct("<6Q3I"), struct.Struct("<6Q4I8s")

#: Bytes of a data block before compression, bloom bits a key, probes.
BLOCK, BLOOM_BITS, PROBES = 64 << 10, 10, 6


def key_of(identifier: int | None) -> bytes:
    return b"\x00" if identifier is None else b"\x01" + struct.pack(">Q", (int(identifier) + (1 << 63)) % (1 << 64))


def identifier_of(key: bytes) -> int | None:
    return None if key[:1] == b"\x00" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh64_intdigest(key)
    return [(h + k * (h >> 33 | 1)) % bits for k in range(PROBES)]  # of whole numbers, without overflow


class Writer:
    """Writes entries, given in key order, to a binary sink; holds one block and the index in memory."""

    def __init__(self, sink, width: int):
        self.sink, self.width, self.offset = sink, width, 0
        self.block, self.last, self.index, self.hashes, self.entries, self.tokens = [], b"", [], [], 0, 0
        self.block_bytes = 0
        self.packer = zstandard.ZstdCompressor(level=1)
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.offset += len(data)

    def add(self, identifier: int | None, ids: np.ndarray) -> None:
        key, value = key_of(identifier), ids.astype(f"<u{self.width}").tobytes()
        if self.entries and key < self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        entry = b"".join((_varint(shared), _varint(len(key) - shared), _varint(len(value)), key[shared:], value))
        self.block.append(entry)
        self.block_bytes += len(entry)
        self.hashes.append(xxhash.xxh64_intdigest(key))
        self.last, self.entries, self.tokens = key, self.entries + 1, self.tokens + len(ids)
        if self.block_bytes >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = self.packer.compress(b"".join(self.block))
            self.index.append(_varint(len(self.last)) + self.last + _varint(self.offset) + _varint(len(data)) + struct.pack("<I", zlib.crc32(data)))
            self._put(data)
            self.block, self.block_bytes = [], 0

    def close(self) -> None:
        self._flush()
        at = self.offset
        index = self.packer.compress(b"".join(self.index))
        self._put(index)
        bits = max(64, BLOOM_BITS * self.entries)
        h = np.array(self.hashes, np.uint64)
        bloom = np.zeros((bits + 7) // 8 * 8, bool)
        step = (h >> np.uint64(33)) | np.uint64(1)
        for k in range(PROBES):  # as in _probes: both terms are reduced first, so that neither overflows
            bloom[((h % np.uint64(bits)) + (np.uint64(k) * step) % np.uint64(bits)) % np.uint64(bits)] = True
        bloom_at = self.offset
        packed = np.packbits(bloom, bitorder="little").tobytes()
        self._put(packed)
        head = HEAD.pack(at, len(index), bloom_at, bits, self.entries, self.tokens, self.width, zlib.crc32(index), zlib.crc32(packed))
        self._put(head + struct.pack("<I8s", zlib.crc32(head), END))


class Reader:
    """Reads a shard from a random-access file: all entries in order, or the entries of an identifier."""

    def __init__(self, source):
        self.source = source
        size = source.size() if callable(source.size) else source.size
        if size < len(MAGIC) + FOOTER.size:
            raise ValueError("not a shard, or cut short")
        source.seek(size - FOOTER.size)
        foot = source.read(FOOTER.size)
        index_at, index_length, self.bloom_at, self.bits, self.entries, self.tokens, self.width, index_crc, self.bloom_crc, crc, end = FOOTER.unpack(foot)
        if end != END or zlib.crc32(foot[: HEAD.size]) != crc or self._at(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a shard, or cut short")
        self.unpacker = zstandard.ZstdDecompressor()
        data, at, self.keys, self.blocks = self.unpacker.decompress(self._sound(index_at, index_length, index_crc), 1 << 31) if index_length else b"", 0, [], []
        while at < len(data):
            n, at = _read_varint(data, at)
            self.keys.append(data[at : at + n])
            offset, at = _read_varint(data, at + n)
            length, at = _read_varint(data, at)
            self.blocks.append((offset, length, *struct.unpack_from("<I", data, at)))
            at += 4
        self.bloom = None

    def _at(self, offset: int, length: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(length)

    def _sound(self, offset: int, length: int, crc: int) -> bytes:
        data = self._at(offset, length)
        if len(data) != length or zlib.crc32(data) != crc:
            raise ValueError("the shard is damaged")
        return data

    def _entries(self, block: int) -> Iterator[tuple[bytes, np.ndarray]]:
        data, at, key = self.unpacker.decompress(self._sound(*self.blocks[block])), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            more, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + more]
            at += more
            yield key, np.frombuffer(data, f"<u{self.width}", size // self.width, at)
            at += size

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.blocks)):
            for key, ids in self._entries(k):
                yield identifier_of(key), ids

    def may_hold(self, identifier: int | None) -> bool:
        if self.bloom is None:
            self.bloom = self._sound(self.bloom_at, (self.bits + 7) // 8, self.bloom_crc)
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key_of(identifier), self.bits))

    def get(self, identifier: int | None) -> list[np.ndarray]:
        """The ids of every entry of an identifier: the Bloom filter first, then a binary search of the sparse index."""
        key, out = key_of(identifier), []
        if not self.entries or not self.may_hold(identifier):
            return out
        for k in range(bisect_left(self.keys, key), len(self.blocks)):
            for found, ids in self._entries(k):
                if found == key:
                    out.append(ids)
                elif found > key:
                    return out
        return out


def write_shard(uri: str, rows: Iterable[tuple[int | None, np.ndarray]], width: int) -> tuple[int, int, int | None, int | None]:
    """Writes a shard; returns its entries, tokens, first and last identifier."""
    from .common import write_atomically

    told = {}

    def write(sink):
        out, first, last = Writer(sink, width), None, None
        for identifier, ids in rows:
            first = identifier if not out.entries else first
            out.add(identifier, ids)
            last = identifier
        out.close()
        told["x"] = (out.entries, out.tokens, first, last)

    write_atomically(uri, write)
    return told["x"]


def open_shard(uri: str):
    from .common import open_fs

    system, path = open_fs(uri)
    return Reader(system.open_input_file(path))
