"""WARC archives with revisit resolution.

Only headers are shuffled to find equal payloads: each record's payload digest and key. The response of a digest that
occurs more than once is chosen by an aggregate; what it is is joined back by digest beside the scan, where the archives
are written with fresh headers, one gzip member a record. A revisit record carries headers alone.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import uuid
import zlib
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import open_fs, small, stash, tidy, tune, write_atomically

#: The profile of revisits with equal payloads, by the WARC standard. A fixed value.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: When the records were made, unless the caller says; a constant, so that reruns write equal bytes.
DATE = "1970-01-01T00:00:00Z"

#: Bytes of payload that one read of an archive takes.
CHUNK = 64 << 10


def payload_digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(key: int | None, url: str, digest: str) -> str:
    """A record's name, the same in every run."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}|{url}|{digest}')}>"


def _uri(url: str | None) -> str:
    """A URL as a header value: control characters and spaces are percent-encoded."""
    return "".join(f"%{b:02X}" if b <= 32 or b == 127 else chr(b) for b in (url or "").encode("utf-8", "surrogatepass")) if url else "urn:none"


def write_record(sink, kind: str, key: int | None, url: str | None, payload: bytes, length: int, digest: str, refers_to: tuple | None, date: str = DATE) -> None:
    """One record as a gzip member. refers_to: (key, url) of the response that a revisit stands for."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block = http + (payload if kind == "response" else b"")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(key, url or "", digest)), ("WARC-Date", date), ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{payload_digest(block)}"), ("Content-Type", "application/http; msgtype=response"), ("X-Page-ID", "" if key is None else str(key))]
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to[0], refers_to[1] or "", digest)), ("WARC-Refers-To-Target-URI", _uri(refers_to[1])), ("X-Refers-To-Page-ID", "" if refers_to[0] is None else str(refers_to[0]))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    sink.write(packer.compress(head.encode("latin-1")) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush())


def read_records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an archive of gzip members; holds one record at a time."""
    rest = b""
    while True:
        member, out = zlib.decompressobj(31), []
        if not rest and not (rest := source.read(CHUNK)):
            return
        while not member.eof:
            if not rest and not (rest := source.read(CHUNK)):
                raise ValueError("the archive is cut short")
            out.append(member.decompress(rest))
            rest = member.unused_data if member.eof else b""
        data = b"".join(out)
        head, _, body = data.partition(b"\r\n\r\n")
        first, *lines = head.decode("latin-1").split("\r\n")
        if not first.startswith("WARC/1."):
            raise ValueError("not a WARC record")
        fields = dict(x.split(": ", 1) for x in lines)
        n = int(fields["Content-Length"])
        if len(body) != n + 4:
            raise ValueError("a record's length is wrong")
        yield fields, body[:n]


def resolve(pages: DataFrame, key: str, payload: str, least_bytes: int = 0) -> DataFrame:
    """Every row's key, url, payload (bytes), digest (hex), length, type, and for revisits the response's key and URL. Only headers are shuffled.

    Of records with equal payloads of at least `least_bytes` bytes that with the largest key is the response, and the others
    revisit it; a null key is the least. Rows that share the largest key can't be told apart by it: all are responses, and
    revisits name the largest of their URLs.
    """
    tune(pages.sparkSession)
    data = F.coalesce(F.encode(F.col(payload).cast("string"), "utf-8"), F.lit(b""))
    rows = pages.select(F.col(key).alias("key"), F.col("url").cast("string").alias("url"), data.alias("payload")).withColumns({"digest": F.unhex(F.sha1("payload")), "length": F.length("payload").cast("long")})
    best = rows.where(F.col("length") >= least_bytes).groupBy("digest").agg(F.max(F.struct((~F.col("key").isNull()).alias("known"), "key", "url")).alias("best"), F.count("*").alias("n")).where("n > 1")
    best = stash(best.select(F.col("digest").alias("_digest"), "best"), "warc-responses")
    told = rows.join(small(best, 64, F.length("best.url")), F.col("digest") == F.col("_digest"), "left")
    revisit = F.col("best").isNotNull() & (F.col("length") >= least_bytes) & ~F.col("key").eqNullSafe(F.col("best.key"))
    return told.select("key", "url", "payload", F.lower(F.hex("digest")).alias("digest"), "length", F.when(revisit, "revisit").otherwise("response").alias("type"), F.when(revisit, F.col("best.key")).alias("to_key"), F.when(revisit, F.col("best.url")).alias("to_url"))


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes every row as a record in one of the archives; returns a row per archive: path, records, bytes.

    An archive is a partition of the rows, in their order: payloads stay where they are read, as long as the responses of
    repeated digests are counted as small enough to be broadcast; beyond that rows are shuffled by digest once.
    """
    told = resolve(pages, key, payload, least_bytes)
    dealt = told.select("key", "url", "type", "to_key", "to_url", "length", F.when(F.col("type") == "response", F.col("payload")).otherwise(F.lit(b"")).alias("payload"), "digest")

    def write(batches):
        import pyarrow as pa

        batches = iter(batches)
        part = TaskContext.get().partitionId()
        path = f"{folder}/part-{part:06d}.warc.gz"
        n = [0, 0]

        def put(sink):
            for b in batches:
                for k, url, kind, to_key, to_url, length, data, digest in zip(*(b.column(c).to_pylist() for c in range(8)), strict=True):
                    write_record(sink, kind, k, url, data, length, base64.b32encode(bytes.fromhex(digest)).decode(), (to_key, to_url))
                    n[0] += 1
            n[1] = sink.tell()

        first = next(batches, None)
        if first is None:
            return
        batches = itertools.chain([first], batches)
        write_atomically(path, put)
        if n[0]:
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [n[0]], "bytes": [n[1]]}, pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return stash(dealt.mapInArrow(tidy(write), "path string, records long, bytes long"), "warc-archives")


def read_archives(archives: DataFrame, key: str = "page_id") -> DataFrame:
    """Every record of the archives: the key, url, payload_bytes, payload_digest, record_type, refers_to, verified.

    `verified` says whether a response's payload has the digest and length that its headers name; a revisit has none.
    """
    placed = archives.select("path").collect()  # a row for each archive
    n = max(1, len(placed))
    spark = archives.sparkSession
    dealt = spark.createDataFrame([(k, r.path) for k, r in enumerate(placed)], "k int, path string").repartitionByRange(n, "k").select("path")

    def load(batches):
        import pyarrow as pa

        schema = pa.schema([(key, pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("verified", pa.bool_())])
        whole = lambda x: int(x) if x else None
        for b in batches:
            for path in b.column(0).to_pylist():
                system, name = open_fs(path)
                rows: list = []
                with system.open_input_stream(name, compression=None) as source:
                    for f, block in read_records(source):
                        http, _, body = block.partition(b"\r\n\r\n")
                        length = int(http.rpartition(b"Content-Length: ")[2])
                        digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
                        fits = f["WARC-Type"] == "revisit" or (len(body) == length and payload_digest(body) == digest)
                        if f["WARC-Type"] == "response":
                            digest, length = payload_digest(body), len(body)
                        rows.append((whole(f["X-Page-ID"]), f["WARC-Target-URI"], length, digest, f["WARC-Type"], whole(f.get("X-Refers-To-Page-ID")), fits))
                        if len(rows) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return dealt.mapInArrow(tidy(load), f"`{key}` long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, verified boolean")
