"""Benchmark decontamination with a distributed positional inverted index.

Training texts are cut into segments of a bounded number of words; a segment's postings list, for each of its words, the
places where it stands. The index is written to the shared folder once, one row a segment, and answers any phrases. Test
phrases are looked up in each segment by intersecting offset-adjusted posting lists from the phrase's rarest term on,
which gives exact matches and, with a slop, proximity matches.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stash, text_words, tidy, tune

#: Words of a window.
WINDOW = 10

#: Words of a segment, except where one text has more.
SEGMENT_WORDS = 1_000_000

#: Phrases that are looked up at once; with their terms they are what is broadcast.
PHRASES_MOST = 200_000

#: Empty places between two texts of a segment. A phrase and its slop are shorter, so no match spans two texts.
GAP = 64

SEGMENT = "segment string, ids array<{kind}>, hashes array<long>, lengths array<int>, terms array<binary>, counts array<int>, postings binary"


def phrases(items: DataFrame, key: str, text: str, window: int = WINDOW) -> DataFrame:
    """item (the key as text), words array<binary>: each run of `window` words of an item, or all words of a shorter one."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids, runs = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = text_words(t)
                for k in range(max(1, len(w) - window + 1) if w else 0):
                    ids.append(i)
                    runs.append(w[k : k + window])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(runs, pa.list_(pa.binary()))], ["item", "words"])

    rows = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "item string, words array<binary>").distinct()


class _Numbers(dict):
    """Numbers for words, as they occur."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def build_index(docs: DataFrame, key: str, text: str, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """Writes the positional index of all words of all texts."""
    tune(docs.sparkSession)
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text).cast("string")).alias("hash"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        part, made = TaskContext.get().partitionId(), 0
        id_type, ids, hashes, lengths, parts, numbers = None, [], [], [], [], _Numbers()

        def segment():
            places = np.concatenate(parts)
            order = np.argsort(places, kind="stable")
            order = order[np.searchsorted(places[order], 0) :].astype(np.int32)  # the gaps come first
            counts = np.bincount(places[order], minlength=len(numbers))
            first = np.cumsum(counts) - counts
            step = np.diff(order, prepend=np.int32(0))
            step[first] = order[first]
            schema = pa.schema([("segment", pa.string()), ("ids", pa.list_(id_type)), ("hashes", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("terms", pa.list_(pa.binary())), ("counts", pa.list_(pa.int32())), ("postings", pa.binary())])
            row = {"segment": f"{part}-{made}", "ids": ids, "hashes": hashes, "lengths": lengths, "terms": list(numbers), "counts": counts.tolist(), "postings": zstandard.ZstdCompressor(level=1).compress(step.astype("<i4").tobytes())}
            return pa.RecordBatch.from_pylist([row], schema)

        gap, total = np.full(GAP, -1, np.int32), 0
        for b in batches:
            id_type = b.schema.field(0).type
            for i, t, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                w = text_words(t)
                if ids and total + len(w) > segment_words:
                    yield segment()
                    ids, hashes, lengths, parts, numbers, made, total = [], [], [], [], _Numbers(), made + 1, 0
                ids.append(i)
                hashes.append(h)
                lengths.append(len(w))
                parts += [np.fromiter(map(numbers.__getitem__, w), np.int32, len(w)), gap]
                total += len(w)
        if ids:
            yield segment()

    return stash(rows.mapInArrow(tidy(run), SEGMENT.format(kind=kind)), "positional-index")


class Segment:
    """The posting lists of one segment."""

    def __init__(self, terms, counts, postings):
        ends = np.cumsum(counts)
        steps = np.frombuffer(zstandard.ZstdDecompressor().decompress(postings), "<i4") if postings else np.zeros(0, np.int32)
        self.lists = {t: (e - c, e) for t, c, e in zip(terms, counts, ends.tolist(), strict=True)}
        self.steps = steps

    def places(self, term: int) -> np.ndarray:
        a, b = self.lists[term]
        return np.cumsum(self.steps[a:b])

    def find(self, phrase: list[bytes], order: list[int], slop: int, memory: dict) -> tuple[np.ndarray, np.ndarray]:
        """Where the phrase begins, and where its rarest term stands. order: the offsets of its terms, the rarest first. With a slop, every term stands within that many places of its own place."""
        starts = found = None
        for offset in order:
            term = phrase[offset]
            if term not in memory:
                memory[term] = self.places(term)
            at = memory[term]
            if starts is None:
                starts, found = at - offset, at
                continue
            k = np.searchsorted(at, starts + offset - slop)
            ok = k < len(at)
            ok[ok] = at[k[ok]] <= starts[ok] + offset + slop
            starts, found = starts[ok], found[ok]
            if not len(starts):
                break
        return starts, found


def search(index: DataFrame, found: list[tuple[str, list[bytes]]], rarity: dict[bytes, int], slop: int = 0) -> DataFrame:
    """segment, doc (its place in the segment), id, hash (of the text), item, start, words: the runs of words, from the text's first word on, that occurrences of an item's phrases make up."""
    spark = index.sparkSession
    if any(len(phrase) + slop > GAP for _, phrase in found):
        raise ValueError(f"a phrase and its slop have {GAP} words at most")
    by_rarest = defaultdict(list)
    for item, phrase in found:
        order = sorted(range(len(phrase)), key=lambda k: (rarity.get(phrase[k], 0), k))
        if all(w in rarity for w in phrase):  # a word that is nowhere in the index has no match
            by_rarest[phrase[order[0]]].append((item, phrase, order))
    sent = spark.sparkContext.broadcast(dict(by_rarest))
    kind = index.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            id_type = b.schema.field("ids").type.value_type
            for k in range(b.num_rows):
                row = {c: b.column(c)[k] for c in b.schema.names}
                s = Segment(row["terms"].as_py(), row["counts"].as_py(), row["postings"].as_py())
                lengths = row["lengths"].values.to_numpy()
                starts, memory, hits = np.cumsum(lengths + GAP) - lengths - GAP, {}, []
                for term in s.lists.keys() & sent.value.keys():
                    for item, phrase, order in sent.value[term]:
                        if any(w not in s.lists for w in phrase):
                            continue
                        begin, at = s.find(phrase, order, slop, memory)
                        if not len(begin):
                            continue
                        doc = np.searchsorted(starts, at, side="right") - 1
                        first = begin - starts[doc]  # with a slop, the phrase's nominal place may reach beyond the text
                        end = np.minimum(first + len(phrase), lengths[doc])
                        first = np.maximum(first, 0)
                        hits += [(d, item, a, n) for d, a, n in zip(doc.tolist(), first.tolist(), (end - first).tolist(), strict=True)]
                if hits:
                    ids = row["ids"].values
                    doc, item, start, words = zip(*_runs(hits), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([row["segment"].as_py()] * len(doc)), pa.array(doc, pa.int32()), ids.take(pa.array(doc)).cast(id_type), row["hashes"].values.take(pa.array(doc)), pa.array(item, pa.string()), pa.array(start, pa.int32()), pa.array(words, pa.int32())], ["segment", "doc", "id", "hash", "item", "start", "words"])

    return index.mapInArrow(tidy(run), f"segment string, doc int, id {kind}, hash long, item string, start int, words int")


def _runs(hits: list[tuple]) -> list[tuple]:
    """(doc, item, start, words) with those that overlap or touch made one."""
    out: list = []
    for doc, item, start, words in sorted(hits):
        if out and out[-1][:2] == (doc, item) and start <= out[-1][2] + out[-1][3]:
            out[-1] = (doc, item, out[-1][2], max(out[-1][3], start + words - out[-1][2]))
        else:
            out.append((doc, item, start, words))
    return out


def matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text", window: int = WINDOW, slop: int = 0) -> tuple[DataFrame, DataFrame]:
    """The index, and all matches of the items' phrases in it, written to the shared folder.

    Phrases are looked up in blocks of at most PHRASES_MOST, each against the whole index, which is built once. The driver
    holds one block at a time.
    """
    index = build_index(docs, key, text)
    runs = stash(phrases(items, item_key, text, window), "phrases")
    blocks = max(1, -(-runs.count() // PHRASES_MOST))
    out = []
    for block in range(blocks):
        part = runs.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == block)
        terms = stash(part.select(F.explode("words").alias("term")).distinct(), "phrase-terms")
        counted = index.select(F.inline(F.arrays_zip("terms", "counts"))).join(small(terms, 48, F.octet_length("term")), F.col("terms") == F.col("term"))
        rarity = {bytes(r.term): r.n for r in counted.groupBy("term").agg(F.sum("counts").alias("n")).collect()}
        out.append(stash(search(index, [(r.item, [bytes(w) for w in r.words]) for r in part.collect()], rarity, slop), "matches"))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return index, found


def digest(index: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document: the key, n_words, n_hit (words inside a match), n_items, items_sha256, contaminated."""
    docs = index.select("segment", F.posexplode(F.arrays_zip("ids", "lengths")).alias("doc", "x")).select("segment", "doc", F.col("x.ids").alias("id"), F.col("x.lengths").cast("long").alias("n_words"))

    def run(keys, table):
        import pyarrow as pa

        start, words = table.column("start").to_numpy(), table.column("words").to_numpy()
        order = np.argsort(start, kind="stable")
        begin, end = start[order].astype(np.int64), (start + words)[order].astype(np.int64)
        reach = np.maximum.accumulate(np.concatenate([[0], end[:-1]]))
        hit = int(np.maximum(0, end - np.maximum(begin, reach)).sum())
        names = sorted(set(table.column("item").to_pylist()))
        return pa.table({"segment": pa.array([keys[0].as_py()]), "doc": pa.array([keys[1].as_py()], pa.int32()), "n_hit": pa.array([hit], pa.int64()), "n_items": pa.array([len(names)], pa.int64()), "items_sha256": pa.array([hashlib.sha256(",".join(names).encode()).hexdigest()])})

    told = found.groupBy("segment", "doc").applyInArrow(run, "segment string, doc int, n_hit long, n_items long, items_sha256 string")
    out = docs.join(told, ["segment", "doc"], "left")
    return out.select(F.col("id").alias(key), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


def clean_only(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` without a match; rows that share a key are told apart by their texts."""
    hit = stash(found.select(F.col("id").alias("__id"), F.col("hash").alias("__hash")).distinct(), "contaminated")
    return docs.join(small(hit, 32), F.col(key).eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text).cast("string")) == F.col("__hash")), "left_anti")
