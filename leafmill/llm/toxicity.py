"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded text.

Folding maps homoglyphs and accents to plain letters and, inside words that have letters, digits and signs to the letters
they stand for, so that disguised spellings meet the lexicon. Entries are whole words or word beginnings; exception
phrases cover harmless uses, and an entry inside one doesn't count. The weights found are normalised by the text's length.
"""

from __future__ import annotations

import itertools
import math
import unicodedata
from bisect import bisect_right
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, tidy, tune

#: Signs that stand for letters. Fixed values.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"}

#: Letters of other scripts that look like Latin ones. Fixed values.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁԛԝһӏвкмнтαβεικνορτυχγωıɡɑ", "aeopcyxijsdqwhlbkmhtabeiknoptuxywiga", strict=True))

#: Zero-width and soft-hyphen characters, which fall away. Fixed values.
INVISIBLE = "​‌‍⁠﻿­"


#: Seeds of the hashes by which near copies are found before the fit.
FAMILIES = (1, 2, 3)


class _Fold(dict):
    """A translation table to lower-case plain letters, filled as characters occur; what separates words becomes a space."""

    def __missing__(self, code: int):
        c = chr(code)
        if c in INVISIBLE or unicodedata.combining(c):
            out = ""
        else:
            out = "".join(self._plain(x) for x in unicodedata.normalize("NFKD", c).lower() if not unicodedata.combining(x))
        self[code] = out
        return out

    @staticmethod
    def _plain(x: str) -> str:
        x = HOMOGLYPHS.get(x, x)
        return x if x.isalnum() or x in SUBSTITUTES else " "


_FOLD = _Fold()
_DIGITS = str.maketrans(SUBSTITUTES)
_SIGNS = "".join(k for k in SUBSTITUTES if not k.isalnum())
_BLANK = str.maketrans(dict.fromkeys(_SIGNS, " "))


def fold_words(text: str | None) -> list[str]:
    """The folded words of a text. Digits and signs turn into letters only inside a word with letters on its other places; marks at its ends fall away."""
    out = []
    for w in (text or "").translate(_FOLD).split():
        if w.isalpha():
            out.append(w)
            continue
        w = w.strip(_SIGNS)
        if any(c.isalpha() for c in w):
            out.append(w.translate(_DIGITS))
        else:
            out += w.translate(_BLANK).split()
    return out


def folded(text: str | None) -> tuple[str, int]:
    """The folded text, a space on either side of each word, and its number of words."""
    words = fold_words(text)
    return f" {' '.join(words)} " if words else " ", len(words)


class Lexicon:
    """entries: text to weight, where ' word ' is a whole word and ' begin' any word that begins so; exceptions: phrases."""

    def __init__(self, entries: dict[str, float], exceptions=(), bias: float = -2.0, slope: float = 1.0):
        self.entries, self.exceptions, self.bias, self.slope = dict(entries), [f" {' '.join(fold_words(x))} " for x in exceptions], bias, slope
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    @property
    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for text, weight in self.entries.items():
                self._automaton.add_word(text, (len(text), weight, text))
            for text in self.exceptions:
                if text.strip():
                    self._automaton.add_word(text, (len(text), None, text))
            self._automaton.make_automaton()
        return self._automaton

    def matches(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) in the folded text, at most one a word (the heaviest), none inside an exception phrase."""
        if not self.entries:
            return []
        found, begins, ends = {}, [], []  # matches; the exception phrases' places, merged, in order
        for end, (length, weight, _) in self.automaton.iter(text):
            start = end - length + 1
            if weight is not None:
                if start not in found or weight > found[start][1]:
                    found[start] = (end, weight)
                continue
            # Ends ascend, so a phrase that begins before others takes them in. Phrases share a space at most, which is no match.
            while begins and begins[-1] >= start:
                begins.pop()
                ends.pop()
            if not begins or end > ends[-1]:
                begins.append(start)
                ends.append(end)
        out = []
        for s, (e, w) in sorted(found.items()):
            k = bisect_right(begins, s) - 1
            if k < 0 or ends[k] < e:
                out.append((s, e, w))
        return out

    def evidence(self, text: str | None) -> tuple[float, float, int]:
        """Total weight (an entry's c matches weigh 1 + ln c times), weight per fourth root of the length in hundreds of words, matches."""
        line, n = folded(text)
        found = self.matches(line)
        total = sum(w * (1 + math.log(c)) for (_, w), c in Counter((line[a : b + 1], w) for a, b, w in found).items())
        return total, total / max(1.0, n / 100) ** 0.25, len(found)

    def score(self, text: str | None) -> float:
        """0 to 1; texts without a match, empty and null ones get the score of no evidence."""
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + self.slope * self.evidence(text)[1]))))


def candidates(text: str | None, shortest: int = 4, longest: int = 9) -> set[str]:
    """The entries that a text gives evidence on: its words, and their beginnings."""
    out = set()
    for w in set(fold_words(text)):
        if len(w) >= 3:
            out.add(f" {w} ")
            out.update(f" {w[:k]}" for k in range(shortest, min(longest, len(w)) + 1))
    return out


def fit(docs: DataFrame, labels: DataFrame, key: str, text: str = "text", exceptions=(), rows: int = 20_000, least: int = 4, purity: float = 0.8) -> Lexicon:
    """Learns a lexicon from `labels` (columns `key`, unique and not null, and `y`, 1 or 0) of rows of `docs`.

    Of near copies about one counts. The fit reads about `rows` labelled rows, chosen by a hash of the key at a threshold
    from the exact number of labels: a documented bound, so that the chosen keys can be broadcast, no text is shuffled,
    and the driver holds no more entries than those rows' texts show often enough. An entry needs `least` texts of label 1 and a smoothed share of
    label 1 of at least `purity`; a beginning that says no more than what it contains, or is contained in, is dropped.
    Weights are the lower ends of log odds. Exception phrases are those given and those learnt: pairs of words, one of
    them an entry, that at least `least` texts of label 0 hold and that say no more of label 1 than of label 0.
    """
    spark = docs.sparkSession
    tune(spark)
    chosen = labels.select(F.col(key).alias("_key"), F.col("y").cast("int").alias("y")).where("y IN (0, 1)")
    share = min(1.0, rows / max(1, chosen.count()))
    chosen = chosen.where(F.expr(f"pmod(xxhash64(_key), 1000000) < {share * 1_000_000}"))
    texts = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("text"))

    def of(keys: DataFrame) -> DataFrame:
        return texts.join(F.broadcast(keys), "_key")

    families = of(chosen).withColumn("h", F.xxhash64("text", "y")).mapInPandas(_families, f"_key {labels.schema[key].dataType.simpleString()}, y int, h long, " + ", ".join(f"m{k} long" for k in FAMILIES))
    for k in FAMILIES:  # copies of one text are one piece of evidence
        rest = [c for c in families.columns if c not in ("h", f"m{k}")]
        families = families.groupBy(f"m{k}").agg(F.min(F.struct("h", *rest)).alias("x")).select("x.*")
    sample = stash(of(families.groupBy("_key").agg(F.max("y").alias("y"))).select("text", "y"), "toxic-sample")

    def count(batches):
        import pandas as pd

        pos, neg, n = Counter(), Counter(), [0, 0]
        for b in batches:
            for t, y in zip(b["text"], b["y"], strict=True):
                n[y] += 1
                (pos if y else neg).update(candidates(t))
        if n[0] + n[1]:
            keys = sorted(pos.keys() | neg.keys())
            yield pd.DataFrame({"entry": [*keys, ""], "pos": [*(pos[k] for k in keys), n[1]], "neg": [*(neg[k] for k in keys), n[0]]})

    counted = sample.mapInPandas(tidy(count), "entry string, pos long, neg long").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    counted = stash(counted, "toxic-entries")
    total = counted.where("entry = ''").collect()
    n1, n0 = (total[0].pos, total[0].neg) if total else (0, 0)
    rate = F.expr(f"(pos + 0.5) / ({n1} + 1) / ((pos + 0.5) / ({n1} + 1) + (neg + 0.5) / ({n0} + 1))")
    kept = counted.where((F.col("entry") != "") & (F.col("pos") >= least)).withColumn("share", rate).where(F.col("share") >= purity).collect()
    lexicon = Lexicon(_prune({r.entry: (r.pos, r.neg) for r in kept}, n1, n0, least), exceptions)
    if not n1 or not n0:
        lexicon.entries = {}
        return lexicon

    harmless = sample.mapInPandas(tidy(_pairs(spark.sparkContext.broadcast(lexicon))), "pair string, y int").groupBy("pair").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    learnt = harmless.where(F.col("neg") >= least).withColumn("share", rate).where("share <= 0.5").select("pair").orderBy("pair").collect()
    lexicon = Lexicon(lexicon.entries, [*exceptions, *(r.pair for r in learnt)])
    sent = spark.sparkContext.broadcast(lexicon)

    def weigh(batches):
        for b in batches:
            b["x"] = [sent.value.evidence(t)[1] for t in b["text"]]
            yield b[["x", "y"]]

    told = sample.mapInPandas(weigh, "x double, y int").groupBy(F.round("x", 1).alias("x"), "y").count().collect()
    lexicon.bias, lexicon.slope = _logistic(np.array([r.x for r in told]), np.array([r.y for r in told]), np.array([r["count"] for r in told]))
    return lexicon


def _pairs(sent):
    """mapInPandas: (pair, y) for each text and each pair of neighbouring folded words of which one has a match."""

    def run(batches):
        import pandas as pd

        for b in batches:
            out = set()
            for k, (t, y) in enumerate(zip(b["text"], b["y"], strict=True)):
                words = fold_words(t)
                hit = {w: bool(sent.value.matches(f" {w} ")) for w in set(words)}
                out |= {(k, f"{v} {w}", y) for v, w in itertools.pairwise(words) if hit[v] or hit[w]}
            yield pd.DataFrame([(pair, y) for _, pair, y in sorted(out)], columns=["pair", "y"])

    return run


def _families(batches):
    """For each seed the least hash of a text's runs of three words, which near copies share most often."""
    for b in batches:
        least: list = [[] for _ in FAMILIES]
        for t in b["text"]:
            w = (t or "").split()
            runs = {" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))}
            for k, out in zip(FAMILIES, least, strict=True):
                out.append(min(xxhash.xxh64_intdigest(r, k) for r in runs) >> 1)
        yield b[["_key", "y", "h"]].assign(**{f"m{k}": x for k, x in zip(FAMILIES, least, strict=True)})


def _prune(found: dict, n1: int, n0: int, least: int) -> dict[str, float]:
    """Keeps, from the strongest down, entries with enough texts that no kept entry explains already."""
    # The lower end of the log odds' interval, so that a few chance finds weigh little.
    odds = lambda p, n: math.log((p + 0.5) / (n1 + 1)) - math.log((n + 0.5) / (n0 + 1)) - 2.5 * math.sqrt(1 / (p + 0.5) + 1 / (n + 0.5))
    order = sorted(found, key=lambda e: (-odds(*found[e]) * found[e][0], len(e), e))
    kept: dict[str, float] = {}
    told: Counter = Counter()
    for e in order:
        word = e.strip()
        if any(e[:k] in kept for k in range(2, len(e))) or found[e][0] - told[e] < least:
            continue
        if odds(*found[e]) > 0.5:
            kept[e] = odds(*found[e])
        for k in range(4, len(word) + 1):
            told[f" {word[:k]}"] += found[e][0]
    return kept


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Weighted logistic regression of one variable, by Newton's method with a little ridge."""
    w = np.zeros(2)
    a = np.stack([np.ones(len(x)), x], 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (n * (y - p)) - 1e-3 * w
        hess = (a * (n * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.clip(np.linalg.solve(hess, grad), -1, 1)
        w += step
        if abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def score(docs: DataFrame, lexicon: Lexicon, keys: list[str], text: str = "text") -> DataFrame:
    """The keys, `score`, and `matches` (the number of lexicon hits), one row per input row."""
    tune(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        for b in batches:
            found = [sent.value.evidence(t) for t in b["_text"]]
            b["score"] = [1 / (1 + math.exp(-max(-30.0, min(30.0, sent.value.bias + sent.value.slope * x[1])))) for x in found]
            b["matches"] = [x[2] for x in found]
            yield b.drop(columns="_text")

    rows = docs.select(*keys, F.col(text).cast("string").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    return rows.mapInPandas(tidy(run), f"{fields}, score double, matches int")
