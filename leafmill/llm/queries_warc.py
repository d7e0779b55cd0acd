"""op5: a WARC record for every page, read back from the archives."""

from pyspark.sql import functions as F

from .common import read, shared_dir
from .warc import read_archives, write_archives

LEAST_BYTES = 0


def op5_warc(spark, sf_dir, pages=None):
    """page_id, payload_bytes, payload_digest, record_type, refers_to. Null html has the empty payload; null page_ids count as the least; rows that share the largest page_id of a payload are all responses."""
    pages = read(spark, sf_dir, "pages") if pages is None else pages
    archives = write_archives(pages.withColumn("page_id", F.col("page_id").cast("long")), shared_dir(spark, "warc"), least_bytes=LEAST_BYTES)
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op5_warc": op5_warc}
ORACLE = {
    # Base32 of the digest: its hexadecimal digits as bits, five at a time.
    "op5_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS data FROM pages),
d AS (SELECT *, sha1(data) AS hex, max(page_id) OVER (PARTITION BY data) AS best FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: right('000' || to_binary(strpos('0123456789abcdef', hex[i:i]) - 1), 4)), '') AS bits FROM d)
SELECT page_id, CAST(octet_length(data) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * CAST(bits[5 * i + 1:5 * i + 1] AS INTEGER) + 8 * CAST(bits[5 * i + 2:5 * i + 2] AS INTEGER) + 4 * CAST(bits[5 * i + 3:5 * i + 3] AS INTEGER) + 2 * CAST(bits[5 * i + 4:5 * i + 4] AS INTEGER) + CAST(bits[5 * i + 5:5 * i + 5] AS INTEGER)]), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS NOT DISTINCT FROM best THEN NULL ELSE best END AS refers_to
FROM b"""
}
