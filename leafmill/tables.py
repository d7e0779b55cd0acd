"""Written tables in the folder that all executors share, and files there."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is only broadcast below this many bytes; every use has a shuffle join beyond it.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI below spark.checkpoint.dir; where that is unset, a temporary folder, if the session is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="leafmill-")
        atexit.register(shutil.rmtree, root[7:], True)
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` to the shared folder and reads it back, which cuts the lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int, more: Column | None = None) -> DataFrame:
    """`df` (a written table) marked for broadcast if its counted rows stay below BROADCAST_BYTES; else as it is, for a shuffle join.

    more: the bytes that a row has beyond `row_bytes`, for columns without a bound.
    """
    rows, beyond = df.agg(F.count("*"), F.sum(F.lit(0) if more is None else more)).first()
    return F.broadcast(df) if rows * row_bytes + (beyond or 0) < BROADCAST_BYTES else df


def open_fs(uri: str):
    """The pyarrow file system of a URI or local path, and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{os.path.abspath(uri)}")


def write_atomically(uri: str, write) -> None:
    """`write(sink)` into a file that appears whole or not at all, so that a task that is run again or twice does no harm."""
    system, path = open_fs(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with system.open_output_stream(part, compression=None) as sink:
            write(sink)
        system.move(part, path)
    except BaseException:
        if system.get_file_info(part).type.name != "NotFound":
            system.delete_file(part)
        raise


class StopFile:
    """Says whether a file in the shared folder is there: how the driver tells the executors to stop. Used like an event."""

    def __init__(self, uri: str, every: float = 1.0):
        self.uri, self.every, self.found, self.looked = uri, every, False, 0.0

    def set(self) -> None:
        write_atomically(self.uri, lambda sink: sink.write(b"stop"))

    def is_set(self) -> bool:
        if not self.found and time.monotonic() - self.looked >= self.every:
            system, path = open_fs(self.uri)
            self.found, self.looked = system.get_file_info(path).type.name != "NotFound", time.monotonic()
        return self.found

    def wait(self, seconds: float) -> bool:
        until = time.monotonic() + seconds
        while not self.is_set() and (left := until - time.monotonic()) > 0:
            time.sleep(min(left, self.every))
        return self.found
