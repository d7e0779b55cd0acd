"""op1: mixes all documents. The targets come from SIZE and SOURCES below; the choice of documents is seeded."""

from pyspark.sql import functions as F

from .common import read
from .mixing import mix

#: Weights of the sources in code-point order, repeating; the budget's share of all words; copies at most.
WEIGHTS, SHARE, LIMIT = (3, 1, 2), 1.5, 2


def by_turn(rank, source):
    return F.element_at(F.array(*map(F.lit, WEIGHTS)), rank % len(WEIGHTS) + 1)


def op1_mixing(spark, sf_dir, docs=None):
    """doc_id, size, source_size, target, taken. Null and empty texts have size 0 and are taken 0 times; a null source is the last one."""
    docs = read(spark, sf_dir, "documents") if docs is None else docs
    mixed = mix(docs, F.array("source"), F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)), by_turn, SHARE, LIMIT)
    own = F.col("plan")[0]
    return mixed.select("doc_id", "size", own.source_size.alias("source_size"), own.target.alias("target"), "taken", "copies", F.col("members")[0].alias("source"))


QUERIES = {"op1_mixing": op1_mixing}
ORACLE = {}
