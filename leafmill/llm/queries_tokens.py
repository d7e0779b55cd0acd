"""op2: token ids of every document in sorted-string-table shards, and what the shards hold."""

import bisect
import zlib
from collections import deque

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import read, shared_dir, stash, tidy, tune
from .sstable import open_shard, write_shard
from .tokens import encoder

TOKENIZER, END_ID = "word_bpe_49k.json", 2

#: Bytes of input, as Spark estimates them from the files, for each shard.
SHARD_BYTES = 256 << 20


def write_tokens(docs, tokenizer: str, end_id: int, folder: str, key: str = "doc_id", text: str = "text", shards: int | None = None):
    """Writes `docs` as shards in `folder`, ranges of `key` in ascending order; returns one row per shard: path, entries, tokens, first, last.

    The shuffle deals out whole texts by ranges of the key, so that tokens are made once, in the task that writes them.
    Null keys come first. Equal keys are ordered by a hash of the text and then by the text; they may stand in several
    shards, and so may equal rows. A null text has the end id alone. There are as many shards as shuffle partitions, or
    more if the input asks for them.
    """
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    shards = shards or shards_for(rows)
    dealt = rows.withColumns({"hash": F.xxhash64("text"), "place": F.monotonically_increasing_id()}).repartitionByRange(shards, F.asc_nulls_first("key"), "hash", "place").sortWithinPartitions(F.asc_nulls_first("key"), "hash", "text").select("key", "text")

    def write(batches):
        import pandas as pd

        tokens = encoder(tokenizer)
        width = 2 if len(tokens.ends) <= 1 << 16 and end_id < 1 << 16 else 4
        end = np.array([end_id], "<u4")

        keys: deque = deque()

        def texts():
            for b in batches:
                keys.extend(b.column(0).to_pylist())
                yield from b.column(1).to_pylist()

        def entries():
            for ids in tokens.many(texts()):
                yield keys.popleft(), np.concatenate([ids, end])

        part = TaskContext.get().partitionId()
        path = f"{folder}/shard-{part:06d}.sst"
        entries_, tokens_, first, last = write_shard(path, entries(), width)
        if entries_:
            yield from _arrow(pd.DataFrame({"part": [part], "path": [path], "entries": [entries_], "tokens": [tokens_], "first": pd.array([first], "Int64"), "last": pd.array([last], "Int64")}))

    return stash(dealt.mapInArrow(tidy(write), "part int, path string, entries long, tokens long, first long, last long"), "token-shards")


def shards_for(rows) -> int:
    """Shards of about SHARD_BYTES by the estimate of the plan; an estimate without meaning, as of joins, counts as none."""
    spark = rows.sparkSession
    estimate = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-estimate // SHARD_BYTES) if estimate < 1 << 52 else 1)


def read_tokens(shards, key: str = "doc_id"):
    """Reads the shards back: the key, start (ids before it in all shards), n_tokens and ids_crc32, one row per entry."""
    spark = shards.sparkSession
    placed = shards.withColumn("start", F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).collect()  # a row for each shard
    n = max(1, len(placed))
    dealt = spark.createDataFrame([(k, r.path, r.start) for k, r in enumerate(placed)], "k int, path string, start long").repartitionByRange(n, "k").drop("k")

    def load(batches):
        import pandas as pd

        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows: list = []
                for k, ids in open_shard(path):
                    rows.append((k, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) >= 20_000:
                        yield from _arrow(_frame(pd, rows, key))
                        rows = []
                if rows:
                    yield from _arrow(_frame(pd, rows, key))

    return dealt.mapInArrow(tidy(load), f"`{key}` long, start long, n_tokens long, ids_crc32 long")


def lookup_tokens(shards, wanted, key: str = "doc_id"):
    """The token ids of the documents named in `wanted` (one column, `key`): key, ids; a row for each entry found.

    The shards' key ranges (a row for each shard) go to every task; a key is looked up in the shards whose range holds
    it, by Bloom filter and binary search, and only the blocks that may hold it are read.
    """
    ranges = sorted(((r.first is not None, r.first or 0), (r.last is not None, r.last or 0), r.path) for r in shards.collect())
    sent = wanted.sparkSession.sparkContext.broadcast(ranges)

    def find(batches):
        import pyarrow as pa

        open_: dict = {}
        for b in batches:
            keys, found = [], []
            for k in b.column(0).to_pylist():
                place = (k is not None, k or 0)
                for first, last, path in sent.value[max(0, bisect.bisect_left(sent.value, (place,)) - 1) :]:
                    if first > place:
                        break
                    if place <= last:
                        if path not in open_:
                            if len(open_) >= 64:
                                open_.clear()
                            open_[path] = open_shard(path)
                        for ids in open_[path].get(k):
                            keys.append(k)
                            found.append(ids.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.list_(pa.int64()))], [key, "ids"])

    return wanted.select(F.col(key).cast("long").alias(key)).sortWithinPartitions(key).mapInArrow(find, f"`{key}` long, ids array<long>")


def _frame(pd, rows, key):
    ids, start, n, crc = zip(*rows, strict=True)
    return pd.DataFrame({key: pd.array(ids, "Int64"), "start": start, "n_tokens": n, "ids_crc32": crc})


def _arrow(frame):
    import pyarrow as pa

    types = {"part": pa.int32(), "path": pa.string()}
    yield from pa.Table.from_pandas(frame, pa.schema([(c, types.get(c, pa.int64())) for c in frame.columns]), preserve_index=False).to_batches()


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_token_output(spark, sf_dir, docs=None):
    """doc_id, start, n_tokens, ids_crc32, read back from the shards. Null texts have the end id alone; null doc_ids come first."""
    docs = read(spark, sf_dir, "documents") if docs is None else docs
    return read_tokens(write_tokens(docs, tokenizer_path(), END_ID, shared_dir(spark, "tokens")))


QUERIES = {"op2_token_output": op2_token_output}
ORACLE = {}
