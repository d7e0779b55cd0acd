"""SQL names for the functions that need Python: placeholder checks, tolerant answers, path resolution.

As scalar functions they are Arrow-optimised; `segment_tokens` is a table function for LATERAL joins.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..answers import looks_untranslated, parse_answer
from ..package import resolve
from ..segments import Segment, has_words, tokens_of
from ..shipping import ship


def _segment(pairs, atoms, nesting) -> Segment:
    return Segment(0, "", "text", frozenset(pairs or ()), frozenset(atoms or ()), {int(k): int(v) for k, v in (nesting or {}).items()})


def placeholder_faults(pairs, atoms, nesting, text):
    return None if text is None else _segment(pairs, atoms, nesting).faults(text)


def salvage(pairs, atoms, text):
    return None if text is None else _segment(pairs, atoms, None).salvage(text)


def resolve_path(base, href):
    return None if base is None or href is None else resolve(base, href)


def read_answer(text):
    return parse_answer(text)


def echoes(source, text, target):
    return None if None in (source, text, target) else looks_untranslated(source, text, target)


def words_in(text):
    return has_words(text)


class SegmentTokens:
    """A row for each token of a text: pos, kind, text, n."""

    def eval(self, text: str):
        for k, (kind, words, n) in enumerate(tokens_of(text or "")):
            yield k, kind, words or None, n or None


FUNCTIONS = {
    "placeholder_faults": (placeholder_faults, "array<string>"),
    "salvage_text": (salvage, "string"),
    "resolve_path": (resolve_path, "string"),
    "parse_answer": (read_answer, "map<int,string>"),
    "looks_untranslated": (echoes, "boolean"),
    "has_words": (words_in, "boolean"),
}


def register(spark: SparkSession) -> None:
    """Makes the functions available to spark.sql."""
    ship(spark)
    for name, (function, kind) in FUNCTIONS.items():
        spark.udf.register(name, F.udf(function, kind, useArrow=not kind.startswith("map")))
    spark.udtf.register("segment_tokens", F.udtf(SegmentTokens, returnType="pos: int, kind: string, text: string, n: int"))
