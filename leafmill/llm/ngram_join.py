"""N-gram Jaccard self-join with a MinHash LSH forest and exact verification.

A text is the set of its runs of five words. Each tree of the forest sorts the texts by a signature of MinHash values; the
sorted signatures are a prefix trie, whose node at a level is a run of neighbours with that many equal leading values.
Every text begins at the longest prefix, which is shortened value by value until another text that is as unlike it as a
link allows is met in some tree with the target probability; how unlike that is depends on the size of its set. Pairs that
meet are verified exactly, each once: at the longer of the two prefixes, in the first tree where they share it. Equal sets
form one class beforehand, and large nodes are verified block against block, so that no task holds an unbounded group and
no pair is ever a row.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, small, stash, text_words, tidy, tune
from .components import components

#: Words of a shingle and the least similarity of a link.
WORDS, THRESHOLD = 5, 0.8

#: Trees, the longest prefix, and the chance that a pair at the threshold is met.
TREES, LONGEST, RECALL = 28, 8, 0.9999

#: A block of a large node: texts, and shingles, at most.
BLOCK_TEXTS, BLOCK_SHINGLES = 256, 1_000_000

#: Words whose hashes a process remembers.
CACHE = 300_000


def prefix_length(similarity: float = THRESHOLD, trees: int = TREES, longest: int = LONGEST, recall: float = RECALL) -> int:
    """Shortens the prefix from `longest` until a pair of that similarity meets with the target probability, 1 - (1 - similarity ** length) ** trees."""
    length = longest
    while length > 1 and 1 - (1 - similarity**length) ** trees < recall:
        length -= 1
    return length


@functools.lru_cache(1 << 16)
def least_likeness(n: int, threshold: float = THRESHOLD) -> float | None:
    """The least similarity of at least `threshold` that a set of n runs can have with another set; None if it can have none."""
    least = None
    for m in range(max(1, int(np.ceil(threshold * n - 1e-9))), int(n / threshold + 1e-9) + 1):
        shared = int(np.ceil(threshold * (n + m) / (1 + threshold) - 1e-9))
        if shared <= min(n, m) and (m != n or shared < n) and (least is None or shared / (n + m - shared) < least):
            least = shared / (n + m - shared)
        if least is not None and least < threshold + 1e-9:
            return least
    return least


def level_of(n: int, threshold: float = THRESHOLD, trees: int = TREES) -> int:
    """The prefix at which a set of n runs looks for others: the longest that has the target recall; 0 if no other set can link to it."""
    likeness = least_likeness(n, threshold) if n else None
    return prefix_length(likeness, trees) if likeness else 0


_WORDS: dict[bytes, int] = {}


def forget_words() -> None:
    _WORDS.clear()


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's runs of `words` words; a shorter text is one run; no word, no run."""
    found = text_words(text.lower()) if text else []
    if not found:
        return np.zeros(0, np.uint64)
    if len(_WORDS) > CACHE:
        _WORDS.clear()
    for w in {w for w in found if w not in _WORDS}:
        _WORDS[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))
    run = min(words, len(h))
    n = len(h) - run + 1
    key = np.full(n, run, np.uint64)
    for k in range(run):
        key = key * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    return np.unique(mix64(key))


class Forest:
    """The signatures' random functions; the same for every process."""

    def __init__(self, trees: int, length: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.trees, self.length = trees, length
        self.a = (rng.integers(0, 1 << 32, trees * length, np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
        self.b = rng.integers(0, 1 << 32, trees * length, np.uint64).astype(np.uint32)[:, None]

    def signature(self, keys: np.ndarray) -> bytes:
        """Of every tree the signature: sixteen bits, most significant first, of each MinHash value; values are minima over 32-bit permutations."""
        low = (keys ^ (keys >> np.uint64(32))).astype(np.uint32)
        least = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for k in range(0, len(low), 2048):
            part = low[k : k + 2048] * self.a
            part ^= self.b
            part *= np.uint32(0x9E3779B1)
            np.minimum(least, part.min(axis=1), out=least)
        # A least value has many leading zeros; its bits are spread before they are cut.
        return (mix64(least.astype(np.uint64)) >> np.uint64(48)).astype(">u2").tobytes()


def _sign(trees: int, words: int, threshold: float, with_sets: bool):
    """mapInArrow: from (id, text) to (id, key, n, level, signature) or (key, set)."""

    def run(batches):
        import pyarrow as pa

        forest = Forest(trees, LONGEST)
        for b in batches:
            keys, sizes, levels, signatures, sets = [], [], [], [], []
            for t in b.column(1).to_pylist():
                s = shingles(t, words)
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                if with_sets:
                    sets.append(s.tobytes())
                else:
                    sizes.append(len(s))
                    levels.append(level_of(len(s), threshold, trees))
                    signatures.append(forest.signature(s) if levels[-1] else None)
            if with_sets:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], ["key", "set"])
            else:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(levels, pa.int32()), pa.array(signatures, pa.binary())], ["id", "key", "n", "level", "signature"])

    return tidy(run, forget_words)


NODES = "level int, tree int, node binary, texts long, askers long, runs long, x long, y long"


def _tries(levels: list[int]):
    """mapInArrow over (tree, signature, level, n, x, y), sorted by tree and signature: the nodes of each level, in parts.

    A node is a run of neighbours with one tree and prefix. A run that a batch of rows may have cut off is given as a part;
    an inner run of a single text is no node. Only texts whose level is the node's or longer count: askers are those that
    look for others there.
    """

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = b.num_rows
            if not rows:
                continue
            tree, level, n, x, y = (b.column(k).to_numpy() for k in (0, 2, 3, 4, 5))
            signature = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(rows, 2 * LONGEST)
            differs = np.ones((rows, LONGEST + 1), bool)
            differs[1:, 0] = tree[1:] != tree[:-1]
            differs[1:, 1:] = differs[1:, :1] | np.logical_or.accumulate((signature[1:] != signature[:-1]).reshape(-1, LONGEST, 2).any(2), axis=1)
            for k in levels:
                first = np.flatnonzero(differs[:, k])
                counts = level >= k
                texts = np.add.reduceat(counts.astype(np.int64), first)
                keep = texts > 1
                keep[[0, -1]] = texts[[0, -1]] > 0
                if not keep.any():
                    continue
                at = first[keep]
                columns = [np.full(len(at), k, np.int32), tree[at], [signature[i, : 2 * k].tobytes() for i in at], texts[keep], np.add.reduceat((level == k).astype(np.int64), first)[keep], np.add.reduceat(np.where(counts, n, 0).astype(np.int64), first)[keep], *(np.bitwise_xor.reduceat(np.where(counts, z, 0), first)[keep] for z in (x, y))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["level", "tree", "node", "texts", "askers", "runs", "x", "y"])

    return tidy(run)


def _verify(threshold: float):
    """mapInArrow over rows sorted by (level, tree, node, i, j): counts each block pair's links and joins the linked texts."""

    def run(batches):
        import pyarrow as pa

        held: list = []
        at = None
        out: list = []
        for b in batches:
            for r in zip(*(b.column(k).to_pylist() for k in range(b.num_columns)), strict=True):
                if r[:5] != at:
                    if len(held) > 1:
                        _links(at, held, threshold, out)
                    at, held = r[:5], []
                held.append(r[5:])
            if len(out) > 5_000:
                yield _rows(pa, out)
                out = []
        if len(held) > 1:
            _links(at, held, threshold, out)
        if out:
            yield _rows(pa, out)

    return tidy(run)


def _rows(pa, out):
    key, root, links = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(root, pa.binary()), pa.array(links, pa.int64())], ["key", "root", "links"])


def _links(at, held, threshold: float, out: list) -> None:
    """Adds (key, root, links) for each text that has a link within this block pair, that is counted here."""
    level, tree, _, i, j = at
    m = len(held)
    sets = [np.frombuffer(r[5], np.uint64) for r in held]
    sizes = np.array([len(s) for s in sets])
    if m == 2:
        same = np.array([[0, len(np.intersect1d(sets[0], sets[1], assume_unique=True))]] * 2)
        same[1] = same[0][::-1]
    else:
        _, where, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(m), sizes)
        shared = often[where] > 1
        owner, where = owner[shared], np.unique(where[shared], return_inverse=True)[1]
        same = np.zeros((m, m))
        order = np.argsort(where, kind="stable")
        owner, where = owner[order], where[order]
        width = where[-1] + 1 if len(where) else 0
        for k in range(0, width, 4096):
            part = slice(*np.searchsorted(where, [k, k + 4096]))
            grid = np.zeros((m, min(4096, width - k)), np.float32)
            grid[owner[part], where[part] - k] = 1
            same += grid @ grid.T
    linked = same >= threshold * (sizes[:, None] + sizes[None, :] - same) - 1e-9
    np.fill_diagonal(linked, False)
    if i != j:
        block = np.array([r[0] for r in held])
        linked &= block[:, None] != block[None, :]
    asks = np.array([r[3] == level for r in held])
    linked &= asks[:, None] | asks[None, :]  # other pairs are looked for at a longer prefix
    if tree and linked.any():
        signatures = np.stack([np.frombuffer(r[4], ">u2") for r in held]).reshape(m, -1, LONGEST)[:, :, :level]
        for k in range(tree):  # a pair that met in an earlier tree was counted there
            linked &= (signatures[:, None, k] != signatures[None, :, k]).any(2)
    if not linked.any():
        return
    weight = np.array([r[2] for r in held])
    links = linked @ weight
    root = list(range(m))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in np.argwhere(np.triu(linked)).tolist():
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    for x in np.flatnonzero(links):
        out.append((held[x][1], held[find(x)][1], int(links[x])))


def _signatures() -> Column:
    """The column `signature` as an array of the trees' signatures."""
    width = 2 * LONGEST
    return F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda k: F.substring("signature", k * width + 1, F.lit(width)))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """One row per document: the key, `class_id` (the least key of the texts connected by links), `n_links`, and digests of its set and class.

    A link joins two documents whose sets of word runs have a Jaccard similarity of at least `threshold`; copies link
    too. Texts shorter than `words` words are one run; null texts and texts without words have no links and are classes
    of their own. Documents with equal keys are told apart by their texts only; where keys are null, so are class ids
    unless a linked document has one.
    """
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    signed = stash(rows.mapInArrow(_sign(TREES, words, threshold, False), f"id {kind}, key binary, n int, level int, signature binary"), "signatures")
    classes = stash(signed.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("copies"), F.min("id").alias("first_id"), *(F.min(c).alias(c) for c in ("n", "level", "signature"))), "classes")
    seeking = classes.where("level > 0")
    levels = sorted(r.level for r in seeking.select("level").distinct().collect())  # LONGEST at most

    # The tries: signatures in order, dealt in ranges that may cut a node anywhere. Parts of nodes are added up afterwards; of nodes with equal members the one in the first tree is enough.
    placed = seeking.select(F.posexplode(_signatures()).alias("tree", "signature"), "level", "n", F.xxhash64("key").alias("x"), F.xxhash64("key", F.lit(1)).alias("y"))
    parts = placed.repartitionByRange("tree", "signature", "x").sortWithinPartitions("tree", "signature").mapInArrow(_tries(levels), NODES)
    nodes = parts.groupBy("level", "tree", "node").agg(*(F.sum(c).alias(c) for c in ("texts", "askers", "runs")), *(F.bit_xor(c).alias(c) for c in ("x", "y"))).where("texts > 1 AND askers > 0")
    nodes = nodes.groupBy("level", "texts", "x", "y").agg(F.min(F.struct("tree", "node", "runs")).alias("f")).select("level", "f.*", "texts")
    nodes = stash(nodes.withColumn("blocks", F.greatest(F.ceil(F.col("texts") / BLOCK_TEXTS), F.ceil(F.col("runs") / BLOCK_SHINGLES)).cast("int")).select("level", "tree", "node", "blocks"), "nodes")
    at = F.explode(F.filter(F.array(*map(F.lit, levels)), lambda k: k <= F.col("level"))) if levels else F.lit(0)
    members = seeking.select("key", F.posexplode(_signatures()).alias("tree", "signature"), "level").select("key", "tree", "signature", at.alias("level"))
    members = members.select("key", "level", "tree", F.substring("signature", F.lit(1), 2 * F.col("level")).alias("node"))
    members = stash(members.join(small(nodes, 56), ["level", "tree", "node"]), "members")
    wanted = stash(members.select("key").distinct().join(classes, "key").select("key", "copies", F.col("level").alias("asks"), "signature", "first_id"), "wanted")

    # Only the texts that met are read again, for their whole sets.
    ids = stash(wanted.select(F.col("first_id").alias("_id")).distinct(), "wanted-ids")
    texts = rows.join(small(ids, 24), F.col("id").eqNullSafe(F.col("_id")), "left_semi")
    sets = texts.mapInArrow(_sign(TREES, words, threshold, True), "key binary, set binary")
    sets = stash(wanted.join(sets, "key").dropDuplicates(["key"]).drop("first_id"), "sets")
    block = F.pmod(F.xxhash64("key", F.lit(5)), F.col("blocks")).cast("int")
    pairs = members.withColumn("block", block).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    place = ["level", "tree", "node", "i", "j"]
    pairs = pairs.select("level", "tree", "node", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key")
    full = pairs.join(sets, "key").select(*place, "block", "key", "copies", "asks", "signature", "set")
    dealt = full.repartition(*place).sortWithinPartitions(*place)
    found = stash(dealt.mapInArrow(_verify(threshold), "key binary, root binary, links long"), "links")

    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")).where("a <> b"))
    told = classes.select("key", "copies", "first_id").join(links, "key", "left").join(parts.select(F.col("a").alias("key"), F.col("b").alias("top")), "key", "left").withColumn("top", F.coalesce("top", "key"))
    least = told.groupBy("top").agg(F.min("first_id").alias("class_id"))
    told = stash(told.join(least, "top").select("key", "class_id", "top", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "told")
    out = signed.select("id", "key").join(told, "key", "left")
    return out.select(F.col("id").alias(key), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.col("key").alias("set_key"), F.col("top").alias("class_key"))


def first_of_each(docs: DataFrame, joined: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` whose key is their class's least, one of each class: of rows with one key and class, the first by a hash of the text. Texts without words all stay."""
    kept = joined.where(F.col(key).eqNullSafe(F.col("class_id")))
    ones = stash(kept.groupBy(F.col(key).alias("__kept")).agg(F.count("*").alias("__n")), "kept")
    rows = docs.join(small(ones, 24), F.col(key).eqNullSafe(F.col("__kept")))
    again = rows.where("__n > 1").withColumn("__set", F.pandas_udf(_set_key, "binary")(F.col(text).cast("string")))
    twice = stash(joined.join(small(ones.where("__n > 1"), 24), F.col(key).eqNullSafe(F.col("__kept")), "left_semi").where("set_key IS NOT NULL").select(F.col("set_key").alias("__set"), F.col("class_key").alias("__class")).distinct(), "kept-twice")
    again = again.join(small(twice, 48), "__set", "left").withColumn("__r", F.when(F.col("__class").isNull(), 1).otherwise(F.row_number().over(Window.partitionBy("__class").orderBy(F.xxhash64(text), text))))
    return rows.where("__n = 1").select(docs.columns).unionByName(again.where("__r = 1").select(docs.columns))


def _set_key(texts: pd.Series) -> pd.Series:
    sets = [shingles(t) for t in texts]
    return pd.Series([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], dtype=object)
