"""URL filters: listed rules first, gradient-boosted trees on lexical features for the rest.

The trees learn from labelled URLs; here a rule's verdict is the label of the URLs that it fits. They read lexical
features alone: lengths, depth, digit ratio, entropy, parameter counts, and what is known of the host's suffix.
"""

from __future__ import annotations

import math
from collections import Counter
from urllib.parse import unquote

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .common import small, stash

FEATURES = ("url_length", "host_length", "path_length", "query_length", "depth", "longest_segment", "dots", "hyphens", "digit_ratio", "host_digits", "letter_entropy", "host_entropy", "parameters", "longest_parameter", "percents", "fragment", "secure", "file_suffix", "suffix_rows", "suffix_rate")


#: Parts of the labelled URLs; in the fit a URL's suffix rate comes from the other parts.
PARTS = 5


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, with A-Z lowered; '' where there is no '://'."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to '?', '#' or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest of the rules (text, verdict) that fits, and its verdict; null where none does. A text is host + path."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def suffix_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def features(url: str | None, suffix_rows: float, suffix_rate: float) -> list[float]:
    """The lexical features of one URL, in the order of FEATURES; null counts as ''."""
    url = url or ""
    scheme, mark, rest = url.partition("://")
    rest = rest if mark else ""
    main, sharp, fragment = rest.partition("#")
    main, _, query = main.partition("?")
    host, _, path = main.partition("/")
    parts, params = [x for x in path.split("/") if x], [x for x in query.split("&") if x]
    return [
        len(url), len(host), len(path), len(query), len(parts), max(map(len, parts), default=0), host.count("."), url.count("-"), sum(c.isdigit() for c in url) / max(1, len(url)), sum(c.isdigit() for c in host), _entropy(unquote(path)), _entropy(host),
        len(params), max(map(len, params), default=0), url.count("%"), float(bool(sharp)), float(scheme.lower() == "https"), float("." in (parts[-1] if parts else "")), math.log1p(suffix_rows), suffix_rate,
    ]


def judge(urls: DataFrame, rules: list[tuple[str, str]], key: str, url: str = "url", sample: int = 20_000) -> DataFrame:
    """One row per input row: key, host, path, rule, verdict, score (the trees' probability that it is blocked; null under a rule).

    The trees are fitted on the driver with the `sample` labelled URLs of the smallest hashes, which is the documented
    bound of the fit; the suffix statistics cover all rows and all suffixes, as a written table that is joined to the
    rows. Null URLs and those without '://' have empty hosts and paths and are judged by the trees.
    With no labelled URL of one kind the prior decides; with no labels at all the verdict is 'allow'.
    """
    spark = urls.sparkSession
    rows = urls.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"host": host, "path": path}).withColumns({"rule": rule, "said": verdict, "suffix": suffix_of(F.col("host"))})
    part, block = F.pmod(F.xxhash64("url"), F.lit(PARTS)), F.col("said") == "block"
    counts = [F.count("*").alias("n"), F.count("said").alias("m"), F.count_if(block).alias("k")]
    by_part = [F.array(*(F.count_if(x & (part == p)) for p in range(PARTS))).alias(name) for name, x in (("ms", F.col("said").isNotNull()), ("ks", block))]
    stats = stash(rows.groupBy("suffix").agg(*counts, *by_part).withColumn("rate", (F.col("k") + 1) / (F.col("m") + 2)), "url-suffixes")
    labelled = rows.where("said IS NOT NULL").select("url", "suffix", block.cast("int").alias("y"), part.alias("part"), F.xxhash64("url", "key").alias("h")).orderBy("h", "url").limit(sample).collect()
    # The sample's suffixes, `sample` at most, find their statistics on the executors.
    wanted = spark.createDataFrame([(s,) for s in sorted({r.suffix for r in labelled})], "suffix string")
    known = {r.suffix: r for r in stats.join(F.broadcast(wanted), "suffix").collect()}

    # In the fit a URL's own label is left out of its suffix's rate, and with it the labels of its whole part. Leaving
    # out one row alone would give a suffix's blocked URLs a lower rate than its allowed ones, which tells the label too.
    def rate(r):
        s = known[r.suffix]
        return s.n, (s.k - s.ks[r.part] + 1) / (s.m - s.ms[r.part] + 2)

    x = np.array([features(r.url, *rate(r)) for r in labelled], float).reshape(-1, len(FEATURES))
    model = BoostedTrees().fit(x, np.array([r.y for r in labelled], float))
    sent = spark.sparkContext.broadcast(model)

    def score(batches):
        import pandas as pd

        model = sent.value
        for b in batches:
            x = np.array([features(*r) for r in zip(b["url"], b["n"], b["rate"], strict=True)], float).reshape(-1, len(FEATURES))
            p = model.predict(x)
            free = b["rule"].isna()
            b["score"] = np.where(free, p, np.nan)
            b["verdict"] = b["said"].where(~free, pd.Series(np.where(p > 0.5, "block", "allow"), index=b.index))
            yield b[["key", "host", "path", "rule", "verdict", "score"]]

    dealt = rows.join(small(stats.select("suffix", "n", "rate"), 300), "suffix")
    out = dealt.select("key", "url", "host", "path", "rule", "said", "n", "rate").mapInPandas(score, f"key {rows.schema['key'].dataType.simpleString()}, host string, path string, rule string, verdict string, score double")
    return out.withColumnRenamed("key", key).withColumn("score", F.nanvl("score", F.lit(None)))
