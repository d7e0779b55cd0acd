"""Language ID with language-bitmask n-gram filters.

One bit-sliced Bloom filter holds the n-grams of all languages: each slot is a word with one bit for each language, or
several words beyond 64 languages, so a lookup, the AND of a few slots, returns all languages that contain an n-gram. A text's n-grams are counted per bit; the
counts are corrected for each language's false-positive rate, and the largest share decides.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, stash, tidy, tune

UNDETERMINED = "und"

#: Lengths of the n-grams, in characters. A space marks a word's beginning and end.
SIZES = (3, 4, 5)


def letters(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text, with all that isn't a letter or a combining mark folded into single spaces."""
    if not text:
        return np.zeros(0, np.uint32)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where(_is_letter(codes), codes, np.uint32(32))
    blank = out == 32
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    out = out[keep]
    if not len(out) or (len(out) == 1 and out[0] == 32):
        return np.zeros(0, np.uint32)
    return np.concatenate([np.full(int(out[0] != 32), 32, np.uint32), out, np.full(int(out[-1] != 32), 32, np.uint32)])


_LETTERS: list[np.ndarray] = []


def _is_letter(codes: np.ndarray) -> np.ndarray:
    """By Unicode category L* or M*; a table of all code points, made once in each process."""
    if not _LETTERS:
        import unicodedata

        table = np.zeros(0x110000, bool)
        for a, b in ((0, 0x33480), (0xE0000, 0xE0200)):
            table[a:b] = [unicodedata.category(chr(c))[0] in "LM" for c in range(a, b)]
        _LETTERS.append(table)
    return _LETTERS[0][codes]


def has_letter(text: str | None) -> bool:
    """Whether a text has a letter; marks alone are none."""
    return bool(text) and any(c.isalpha() for c in text)


def grams(codes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the n-grams that begin with a space or a letter and hold no space but at their ends."""
    if len(codes) < size:
        return np.zeros(0, np.uint64)
    n = len(codes) - size + 1
    key = np.full(n, size, np.uint64)
    inner = np.zeros(n, bool)
    for k in range(size):
        part = codes[k : k + n]
        key = key * np.uint64(0x9E3779B97F4A7C15) + part
        if 0 < k < size - 1:
            inner |= part == 32
    return mix64(key[~inner])


@dataclass
class Filters:
    """slots: one bitmask a slot; scale: each language's rate of false positives; floor: the least share of a text's n-grams that its language has."""

    languages: list[str] = field(default_factory=list)
    bits: int = 20
    probes: int = 3
    slots: dict = field(default_factory=dict)
    scale: dict = field(default_factory=dict)
    floor: float = 0.0

    @property
    def kind(self) -> np.dtype:
        """The least unsigned integers that have a bit for each language; a small table stays in the processor's cache."""
        return np.min_scalar_type((1 << min(64, max(1, len(self.languages)))) - 1)

    def empty(self) -> np.ndarray:
        """No n-grams: a word a slot, or a row of words beyond 64 languages."""
        words = -(-len(self.languages) // 64)
        return np.zeros((1 << self.bits, words) if words > 1 else 1 << self.bits, self.kind)

    @staticmethod
    def word(masks: np.ndarray, language: int) -> tuple[np.ndarray, np.integer]:
        """Of bitmasks, the words that hold a language, and its bit in them."""
        return masks if masks.ndim == 1 else masks[:, language // 64], masks.dtype.type(1 << language % 64)

    def has(self, masks: np.ndarray) -> np.ndarray:
        """The number of bitmasks that hold each language."""
        return np.array([np.count_nonzero(words & bit) for words, bit in (self.word(masks, k) for k in range(len(self.languages)))], float)

    def at(self, h: np.ndarray) -> list[np.ndarray]:
        mask = np.uint64((1 << self.bits) - 1)
        step = (64 - self.bits) // max(1, self.probes - 1)
        return [(h >> np.uint64(k * step)) & mask for k in range(self.probes)]

    def add(self, size: int, language: int, h: np.ndarray) -> None:
        if size not in self.slots:
            self.slots[size] = self.empty()
        words, bit = self.word(self.slots[size], language)
        for at in self.at(h):
            np.bitwise_or.at(words, at, bit)

    def lookup(self, size: int, h: np.ndarray) -> np.ndarray:
        """The bitmask of the languages that contain each n-gram."""
        table = self.slots[size]
        first, *rest = self.at(h)
        found = table[first]
        for at in rest:
            found &= table[at]
        return found

    def rates(self, size: int) -> np.ndarray:
        """The chance, by language, that an n-gram that was never added is reported."""
        table = self.slots[size]
        return (self.has(table) / len(table)) ** self.probes

    def counts(self, text: str | None) -> tuple[np.ndarray, int]:
        """Corrected hits by language over all sizes, longer n-grams weighing more, and the weighted number of n-grams."""
        total, hits = 0, np.zeros(len(self.languages))
        codes = letters(text)
        for size in self.slots:
            h = grams(codes, size)
            if not len(h):
                continue
            n = self.has(self.lookup(size, h))
            rate = self.scale[size]
            hits += size * np.clip((n - rate * len(h)) / np.maximum(1 - rate, 1e-9), 0, None)
            total += size * len(h)
        return hits, total

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its share of the corrected hits; `und` and 0 without a letter or a learnt language."""
        return self.told(text)[:2]

    def told(self, text: str | None) -> tuple[str, float, float]:
        """As predict, and the share of the text's n-grams, longer ones weighing more, that the language has beyond its false positives."""
        if not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0, 0.0
        hits, total = self.counts(text)
        if not hits.sum():
            return self.languages[0], 0.0, 0.0  # letters, but nothing known: the commonest language, with no confidence
        best = int(hits.argmax())
        return self.languages[best], float(hits[best] / hits.sum()), float(hits[best] / total)


#: Distinct texts that one task counts n-grams of, and n-grams that it holds before it passes their counts on.
TEXTS_A_TASK, GRAMS_HELD = 400, 2_000_000

#: Slots of a filter for each n-gram of its largest language, at least; the filters grow with what is learnt, so that false positives don't.
SLOTS_A_GRAM = 5


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", rows: int = 2_000, keep: float = 0.9, bits: int = 20, with_floor: bool = False) -> Filters:
    """Learns the filters from about `rows` distinct texts of each language, those of smallest hash (the documented bound of the fit).

    An n-gram enters a language's filter if it is among the commonest ones that make up the share `keep` of that
    language's n-gram occurrences, so that stray foreign words stay out. All languages are learnt; a filter has 2**bits
    slots, or more if the n-grams need them, and takes 8 MB for each 64 languages at 2**20 slots. with_floor: sets the floor
    below which a text is in no learnt language, from the share of their n-grams that the sample's own texts have.
    """
    spark = docs.sparkSession
    tune(spark)
    rows_of = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL").withColumn("h", F.xxhash64("text", "lang"))
    # Numbers of distinct texts are estimated, as they only set the size of the sample; copies are one text.
    known = [(r.lang, r.texts) for r in rows_of.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h", 0.02).alias("texts")).orderBy(F.desc("n"), "lang").collect()]
    if not known:
        return Filters()
    # A hash threshold takes about `rows` texts of each language: no sort, no window over a language.
    shares = spark.createDataFrame([(name, min(1.0, rows / max(1, n))) for name, n in known], "lang string, share double")
    picked = rows_of.join(F.broadcast(shares), "lang").where("pmod(h, 1000000) < share * 1000000").groupBy("lang", "h").agg(F.first("text").alias("text"))
    picked = stash(picked.select("lang", "text"), "language-sample")

    def count(batches):
        gathered, held = {}, 0

        def told():
            for (name, size), parts in sorted(gathered.items()):
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pd.DataFrame({"lang": name, "size": size, "gram": keys.view(np.int64), "n": n})

        for b in batches:
            for name, value in zip(b["lang"], b["text"], strict=True):
                codes = letters(value)
                for size in SIZES:
                    gathered.setdefault((name, size), []).append(grams(codes, size))
                held += len(SIZES) * len(codes)
                if held > GRAMS_HELD:
                    yield from told()
                    gathered, held = {}, 0
        yield from told()

    tasks = -(-sum(min(n, rows) for _, n in known) // TEXTS_A_TASK)
    counted = picked.repartition(tasks).mapInPandas(tidy(count), "lang string, size int, gram long, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")).where("n > 1")
    counted = stash(counted, "language-grams")
    # The commonest that make up `keep` of the occurrences: the least count that qualifies comes from a histogram of counts.
    levels = counted.groupBy("lang", "size", "n").agg(F.count("*").alias("m")).collect()
    least, of, most = {}, {}, 1
    for r in levels:
        of.setdefault((r.lang, r["size"]), []).append((r.n, r.m))
    for key, level in of.items():
        level.sort(reverse=True)
        total, run, held = sum(n * m for n, m in level), 0, 0
        for n, m in level:
            run, held, least[key] = run + n * m, held + m, n
            if run >= keep * total:
                break
        most = max(most, held)
    bits = max(bits, (SLOTS_A_GRAM * most - 1).bit_length())
    floors = spark.createDataFrame([(*key, n) for key, n in sorted(least.items())], "lang string, size int, least long")
    chosen = counted.join(F.broadcast(floors), ["lang", "size"]).where("n >= least").select("lang", "size", "gram")

    # Each language's slice of a filter is made where its n-grams are; the driver gets the slices, 2**bits bits each.
    def cut(group: pd.DataFrame) -> pd.DataFrame:
        one = Filters(["x"], bits)
        one.add(3, 0, group["gram"].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "size": [group["size"].iloc[0]], "bits": [np.packbits(one.slots[3].astype(bool)).tobytes()]})

    slices = {(r["lang"], r["size"]): r.bits for r in chosen.groupBy("lang", "size").applyInPandas(cut, "lang string, size int, bits binary").collect()}
    out = Filters([name for name, _ in known], bits)
    for size in SIZES:
        table = out.slots[size] = out.empty()
        for k, name in enumerate(out.languages):
            if (name, size) in slices:
                words, bit = out.word(table, k)
                words |= np.unpackbits(np.frombuffer(slices[name, size], np.uint8)).astype(out.kind) * bit
        out.scale[size] = out.rates(size)
    if with_floor:
        out.floor = _floor(picked.repartition(tasks), out)
    return out


#: The floor: a share of what all but one in a hundred of the sample's texts have, and no more than that.
FLOOR_SHARE, FLOOR_MOST = 0.25, 0.1


def _floor(sample: DataFrame, filters: Filters) -> float:
    sent = sample.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"x": [sent.value.told(t)[2] for t in b["text"]]})

    least = sample.mapInPandas(tidy(run), "x double").agg(F.percentile("x", F.lit(0.01))).first()[0]
    return min(FLOOR_MOST, FLOOR_SHARE * (least or 0.0))


def predict(docs: DataFrame, filters: Filters, keys: list[str], text: str = "text") -> DataFrame:
    """The keys, `lang_pred` and `score`, one row per input row."""
    tune(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        for b in batches:
            found = [sent.value.predict(t) for t in b["_text"]]
            b["lang_pred"], b["score"] = [x[0] for x in found], [x[1] for x in found]
            yield b.drop(columns="_text")

    rows = docs.select(*keys, F.col(text).cast("string").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    return rows.mapInPandas(tidy(run), f"{fields}, lang_pred string, score double")


def known_only(docs: DataFrame, filters: Filters, text: str = "text") -> DataFrame:
    """The rows of `docs` that are in a learnt language.

    Null texts, those without a letter, and those of whose n-grams no language has the filters' floor go. Where no language
    was learnt, all texts with letters stay.
    """
    tune(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    def run(texts: pd.Series) -> pd.Series:
        known = sent.value
        return pd.Series([has_letter(t) and (not known.languages or known.told(t)[2] >= known.floor) for t in texts], dtype=bool)

    # Marked as nondeterministic, the function runs once for each row.
    stays = F.pandas_udf(run, "boolean").asNondeterministic()
    return docs.withColumn("__known", stays(F.col(text).cast("string"))).where("__known").select(*(f"`{c}`" for c in docs.columns))
