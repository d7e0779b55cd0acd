"""Books as tables: archives, members, packages, manifest, reading order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..package import BookError, links, open_archive, read_member, read_package
from ..shipping import ship

MEMBERS = "book string, ord int, name string, data binary, stored boolean, date_time array<int>, external_attr long"
ITEM = "struct<ord:int,id:string,path:string,media_type:string,properties:array<string>>"
PACKAGES = f"book string, error string, opf_path string, language string, title string, toc string, cover string, items array<{ITEM}>, spine array<string>"
LINKS = "book string, name string, target string"


#: Bytes of members that are handed on at once.
BATCH_BYTES = 16 << 20


def _members(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["book", "ord", "name", "data", "stored", "date_time", "external_attr"])


FILES = "path string, modificationTime timestamp, length long, content binary"


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """book (its path), content."""
    ship(spark)
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("book"), "content")


def stream_books(spark: SparkSession, folder: str, per_batch: int) -> DataFrame:
    """As read_books, as a stream of the archives that are in a folder or come into it."""
    ship(spark)
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", per_batch).option("pathGlobFilter", "*.epub")
    return files.load(folder).select(F.col("path").alias("book"), "content")


def members(books: DataFrame) -> DataFrame:
    """A row for each member of each archive that can be opened, folders included; a member that can't be read has no data."""

    def run(batches):
        for b in batches:
            out, size = [], 0
            for book, content in zip(b["book"], b["content"], strict=True):
                try:
                    z = open_archive(content)
                except BookError:
                    continue
                with z:
                    for k, x in enumerate(z.infolist()):
                        try:
                            data = read_member(z, x)
                        except BookError:
                            data = None
                        out.append((book, k, x.filename, data, x.compress_type == 0, list(x.date_time), x.external_attr))
                        size += x.file_size
                        if size > BATCH_BYTES:
                            yield _members(out)
                            out, size = [], 0
            if out:
                yield _members(out)

    return books.select("book", "content").mapInPandas(run, MEMBERS)


def packages(books: DataFrame) -> DataFrame:
    """A row for each archive: what its package says, or the error that keeps it from being a book, a member that can't be read among them."""

    def run(batches):
        for b in batches:
            out = []
            for book, content in zip(b["book"], b["content"], strict=True):
                try:
                    with open_archive(content) as z:
                        p = read_package(z)
                        for x in z.infolist():  # a damaged member is the book's error, not the job's
                            read_member(z, x)
                    out.append((book, None, p.path, p.language, p.title, p.toc, p.cover, p.items, p.spine))
                except BookError as e:
                    out.append((book, str(e), None, None, None, None, None, [], []))
            yield pd.DataFrame(out, columns=["book", "error", "opf_path", "language", "title", "toc", "cover", "items", "spine"])

    return books.select("book", "content").mapInPandas(run, PACKAGES)


def manifest(packages_: DataFrame) -> DataFrame:
    """book, ord, id, path, media_type, properties, is_content."""
    rows = packages_.select("book", F.inline("items"))
    extension = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    content = F.col("media_type").isin("application/xhtml+xml", "text/html") | ((F.col("media_type") == "") & extension.isin(".xhtml", ".html", ".htm", ".xml"))
    return rows.withColumn("is_content", content)


def spine(packages_: DataFrame, manifest_: DataFrame, names: DataFrame) -> DataFrame:
    """book, ord, path: the content documents in reading order that the archive has; a repeated reference is a repeated row.

    names: book, name of the archive's members.
    """
    refs = packages_.select("book", F.posexplode("spine").alias("ord", "id"))
    found = refs.join(manifest_.where("is_content").select("book", "id", "path"), ["book", "id"])
    return found.join(names.select("book", F.col("name").alias("path")), ["book", "path"], "left_semi").select("book", "ord", "path")


def numbered(spine_: DataFrame) -> DataFrame:
    """The spine with idx, its positions from 1 without gaps."""
    return spine_.withColumn("idx", F.row_number().over(Window.partitionBy("book").orderBy("ord")))


def contents(packages_: DataFrame, manifest_: DataFrame) -> DataFrame:
    """book, nav_path, ncx_path: the navigation document (the first item with that property) and the NCX (the spine's, else the first of its type)."""
    nav = F.min_by("path", F.when(F.array_contains("properties", "nav"), F.col("ord")))
    by_type = F.min_by("path", F.when(F.col("media_type") == "application/x-dtbncx+xml", F.col("ord")))
    rows = manifest_.join(packages_.select("book", "toc"), "book")
    named = F.max(F.when(F.col("id") == F.col("toc"), F.col("path")))
    return rows.groupBy("book").agg(nav.alias("nav_path"), F.coalesce(named, by_type).alias("ncx_path"))


def member_links(members_: DataFrame, manifest_: DataFrame) -> DataFrame:
    """book, name, target: the links of content documents, style sheets and NCX files to members that the archive has."""

    def run(batches):
        for b in batches:
            rows = [(book, name, t) for book, name, data in zip(b["book"], b["name"], b["data"], strict=True) for t in links(name, data)]
            yield pd.DataFrame(rows, columns=["book", "name", "target"])

    told = manifest_.where(F.col("is_content") | F.col("media_type").isin("text/css", "application/x-dtbncx+xml")).select("book", F.col("path").alias("name")).distinct()
    text = members_.select("book", "name", "data").join(told, ["book", "name"], "left_semi")
    names = members_.select("book", F.col("name").alias("target"))
    return text.mapInPandas(run, LINKS).join(names, ["book", "target"], "left_semi").select("book", "name", "target")
