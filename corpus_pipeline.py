"""A training corpus from the documents: language ID, near duplicates, decontamination, mixing, token ids.

STAGES lists the stages; each takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import decontaminate, language, mixing, ngram_join
from leafmill.llm.common import read, shared_dir, stash, tune
from leafmill.llm.queries_mixing import LIMIT, SHARE, by_turn
from leafmill.llm.queries_tokens import END_ID, read_tokens, tokenizer_path, write_tokens


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in a language that labelled documents have: those with a null text, without a letter, or with next to none of any learnt language's n-grams go."""
    tune(spark)
    return language.known_only(docs, language.fit(docs, with_floor=True))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates the document with the least doc_id."""
    tune(spark)
    return ngram_join.first_of_each(docs, ngram_join.join(docs))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents without a run of words of a benchmark item."""
    _, found = decontaminate.matches(docs, read(spark, sf_dir, "benchmark"))
    return decontaminate.clean_only(docs, found)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes the documents as the mix has them, a row for each copy."""
    tune(spark)
    return mixing.take(docs, F.array("source"), F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)), by_turn, SHARE, LIMIT)


def output_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes every row's token ids as shards; returns what the shards hold, a row for each entry."""
    tune(spark)
    return read_tokens(write_tokens(docs, tokenizer_path(), END_ID, shared_dir(spark, "tokens")))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mix_sources),
    ("token_output", output_tokens),
]

#: SQL can't express the trained language filters, the seeded mix or the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; returns the last one's rows."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
