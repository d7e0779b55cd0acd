"""op6: every document's text as a medium in a content-defined chunk store, read back."""

from .common import read
from .media import features


def op6_media(spark, sf_dir, docs=None):
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature. Null counts as the empty text; equal texts have equal values."""
    return features(read(spark, sf_dir, "documents") if docs is None else docs)


QUERIES = {"op6_media": op6_media}
ORACLE = {}
