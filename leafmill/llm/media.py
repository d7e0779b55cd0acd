"""Media columns with content-defined chunking.

A payload is stored as a sound of 8-bit samples (a WAV file, one channel) whose bytes are cut where a rolling gear hash
says, so that equal passages give equal chunks wherever they stand. Chunk digests are deduplicated by joins; only digests
are shuffled for that. The store holds each distinct chunk once, inside the row of the medium that owns it, and every
distinct medium's ordered chunk list, from which media are put together again and verified.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, small, stash, tidy, tune

#: Payloads are filled up with spaces to a positive multiple of this.
UNIT = 192

#: Chunk sizes in bytes: least, most, and the bits of the hash that must be zero at a cut (2**bits bytes on average beyond the least).
LEAST, MOST, BITS = 1024, 65536, 11

#: Bytes that the gear hash remembers: its 32 bits.
REACH = 32

RATE = 8000

_GEAR = (mix64(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def padded(text: str | None) -> tuple[bytes, int]:
    """The payload of a text, null being empty, and its length before padding."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b" " * (-len(data) % UNIT if data else UNIT), len(data)


def wav(payload: bytes) -> bytes:
    """The payload as unsigned 8-bit samples of a WAV file; an odd length gets the format's pad byte."""
    pad = len(payload) & 1
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload + b"\0" * pad


def samples(medium: bytes) -> bytes:
    """The samples of a WAV file of 8-bit samples."""
    riff, _, wave = struct.unpack_from("<4sI4s", medium)
    if riff != b"RIFF" or wave != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at < len(medium):
        name, size = struct.unpack_from("<4sI", medium, at)
        if name == b"data":
            if at + 8 + size > len(medium):
                raise ValueError("the file is cut short")
            return medium[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no samples")


#: Bytes whose gear hashes are held at once.
PIECE = 1 << 20


def _places(data: bytes) -> np.ndarray:
    """Where the gear hash, h = 2 h + gear[byte] modulo 2**32, lets a chunk end; computed for all places of a piece at once by doubling."""
    out = []
    for start in range(0, len(data), PIECE):
        before = min(start, REACH - 1)  # bytes that the first places of the piece remember
        h = _GEAR[np.frombuffer(data, np.uint8, min(PIECE, len(data) - start) + before, start - before)]
        width = 1
        while width < REACH:
            more = h.copy()
            more[width:] += h[:-width] << np.uint32(width)
            h, width = more, 2 * width
        out.append(np.flatnonzero((h[before:] >> np.uint32(32 - BITS)) == 0) + start + 1)
    return np.concatenate(out)


def cuts(data: bytes) -> list[int]:
    """The ends of the chunks."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    places = _places(data)
    out, start = [], 0
    while n - start > LEAST:
        k = np.searchsorted(places, start + LEAST)
        end = int(places[k]) if k < len(places) else n
        end = min(end, start + MOST, n)
        out.append(end)
        start = end
    if start < n:
        out.append(n)
    return out


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def feature(payload: bytes) -> str:
    """What the samples are like: mean, deviation, crossings of the mean, and the shares of eight ranges, as text."""
    x = np.frombuffer(payload, np.uint8)
    mean = x.mean()
    above = x >= mean
    ranges = np.bincount(x >> 5, minlength=8) / len(x)
    return f"mean={mean:.4f};dev={x.std():.4f};cross={np.count_nonzero(above[1:] != above[:-1]) / len(x):.4f};hist=" + ",".join(f"{v:.4f}" for v in ranges)


def _digests(parts: list[bytes]) -> list[bytes]:
    return [xxhash.xxh3_128_digest(p) for p in parts]


#: One row for each distinct medium. list: the digests of its chunks in order; foreign: the places whose chunks stand in
#: another row or at an earlier place; sizes and data: the chunks that this medium alone has, in order and compressed
#: together; shared: those of its own that are referred to from elsewhere, each by itself.
STORE = "medium binary, list array<binary>, foreign array<int>, sizes array<int>, data binary, shared array<struct<digest:binary,chunk:binary>>"


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Writes the chunk store (STORE); returns it and the documents' manifest (id, medium, n_bytes).

    A medium is named by a digest of its text, so that the executors tell it without Python. A chunk is owned by the
    medium with the least digest, at the first place there. Of equal texts the row with the least id writes the medium; rows
    that share that id too meet in an aggregation first. Null texts count as empty ones.
    """
    tune(docs.sparkSession)
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("medium", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    kind = rows.schema["id"].dataType.simpleString()

    def manifest(batches):
        import pyarrow as pa

        for b in batches:
            sizes, lists = [], []
            for t in b.column(2).to_pylist():
                payload, n = padded(t)
                sizes.append(n)
                lists.append(_digests(chunks(wav(payload))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(lists, pa.list_(pa.binary()))], ["id", "medium", "n_bytes", "list"])

    found = stash(rows.select("id", "medium", "text").mapInArrow(tidy(manifest), f"id {kind}, medium binary, n_bytes long, list array<binary>"), "media-manifest")
    by_row = found.groupBy("medium", "id").agg(F.count("*").alias("n"), F.first("list").alias("list"))
    media_ = by_row.groupBy("medium").agg(F.sum("n").alias("n"), F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", F.col("n").alias("alike"))).alias("writer"), F.first("list").alias("list"))
    media_ = stash(media_, "media-distinct")
    places = media_.select("medium", F.posexplode("list").alias("place", "digest"))
    owners = places.groupBy("digest").agg(F.min(F.struct("medium", "place")).alias("owner"), F.count("*").alias("n")).where("n > 1").select("digest", "owner")
    owners = stash(owners, "media-owners")
    roles = places.join(small(owners, 80), "digest").withColumn("own", F.col("owner") == F.struct("medium", "place"))
    roles = roles.groupBy("medium").agg(F.collect_list(F.when(F.col("own"), F.col("place"))).alias("lent"), F.collect_list(F.when(~F.col("own"), F.col("place"))).alias("foreign"))
    # What there is to know of a medium is a written row, so that the join with all texts broadcasts these rows while they are small, and can split a medium with very many copies beyond that.
    known = stash(media_.where("n > 1").select("medium", "writer").join(roles, "medium", "full"), "media-known")
    ready = rows.join(small(known, 120, F.lit(4) * (F.coalesce(F.size("lent"), F.lit(0)) + F.coalesce(F.size("foreign"), F.lit(0)))), "medium", "left")
    ready = ready.where(F.col("writer").isNull() | F.col("id").eqNullSafe(F.col("writer.id"))).select("medium", "text", "lent", "foreign", F.coalesce("writer.alike", F.lit(1)).alias("alike"))
    alike = ready.where("alike > 1").groupBy("medium").agg(*(F.first(c).alias(c) for c in ("text", "lent", "foreign")))
    columns = ["medium", "text", "lent", "foreign"]

    def write(batches):
        import pyarrow as pa

        packer = zstandard.ZstdCompressor(level=3)
        schema = pa.schema([("medium", pa.binary()), ("list", pa.list_(pa.binary())), ("foreign", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("data", pa.binary()), ("shared", pa.list_(pa.struct([("digest", pa.binary()), ("chunk", pa.binary())])))])
        for b in batches:
            out = []
            for medium, t, lent, foreign in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
                parts = chunks(wav(padded(t)[0]))
                digests, lent = _digests(parts), sorted(lent or ())
                others = {*lent, *(foreign or ())}
                own = [p for k, p in enumerate(parts) if k not in others]
                out.append({"medium": medium, "list": digests, "foreign": sorted(foreign or ()), "sizes": list(map(len, own)), "data": packer.compress(b"".join(own)) if own else b"", "shared": [{"digest": digests[k], "chunk": packer.compress(parts[k])} for k in lent]})
            yield pa.RecordBatch.from_pylist(out, schema)

    dealt = ready.where("alike = 1").select(columns).unionByName(alike.select(columns))
    stored = stash(dealt.mapInArrow(tidy(write), STORE), "media-store")
    return stored, found.select("id", "medium", "n_bytes")


def _facts(medium: bytes) -> tuple:
    payload = samples(medium)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(medium), hashlib.sha256(medium).hexdigest(), feature(payload)


FACTS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media(stored: DataFrame, then, schema: str) -> DataFrame:
    """Puts every distinct medium together from its chunk list and applies `then(bytes)`; columns medium and `schema`.

    Media with all their chunks in their own row are read in place. For the others the chunks that they lack alone are
    shuffled: by digest to the references, and by medium to the lists. Every chunk is checked against its digest.
    """
    tune(stored.sparkSession)
    names = ["medium", *(x.split()[0] for x in schema.split(", "))]
    columns = ["medium", "list", "foreign", "sizes", "data", "shared"]

    def rebuild(batches):
        import pyarrow as pa

        unpacker = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for medium, digests, foreign, sizes, data, shared in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
                given = {x["digest"]: x["chunk"] for x in shared}
                raw, at, elsewhere, sizes = unpacker.decompress(data, max_output_size=sum(sizes)) if sizes else b"", 0, set(foreign), iter(sizes)
                parts = []
                for k, d in enumerate(digests):
                    if k in elsewhere or d in given:
                        parts.append(unpacker.decompress(given[d]))
                    else:
                        n = next(sizes)
                        parts.append(raw[at : at + n])
                        at += n
                    if xxhash.xxh3_128_digest(parts[-1]) != d:
                        raise ValueError("a stored chunk differs from its digest")
                out.append((medium, *then(b"".join(parts))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)

    lacking = F.array_except(F.transform("foreign", lambda k: F.element_at("list", k + 1)), F.transform("shared", lambda x: x.digest))
    whole = stored.where(F.size(lacking) == 0)
    broken = stored.where(F.size(lacking) > 0)
    bank = stored.select(F.inline("shared"))
    given = broken.select("medium", F.explode(lacking).alias("digest")).join(bank, "digest").groupBy("medium").agg(F.collect_list(F.struct("digest", "chunk")).alias("more"))
    mended = broken.join(given, "medium", "left").withColumn("shared", F.concat("shared", F.coalesce("more", F.array().cast(given.schema["more"].dataType))))
    return whole.select(columns).unionByName(mended.select(columns)).mapInArrow(tidy(rebuild), f"medium binary, {schema}")


def features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: the key, n_bytes, and the facts of its medium as read back from the chunk store."""
    stored, manifest = store(docs, key, text)
    told = stash(media(stored, _facts, FACTS), "media-told")
    return manifest.join(small(told, 400), "medium").select(F.col("id").alias(key), "n_bytes", *(x.split()[0] for x in FACTS.split(", ")))
