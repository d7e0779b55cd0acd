"""The relational operators of the document engine, on any DataFrames with the named columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..package import BookError

#: Where a wording counts most. Fixed values.
KIND_RANK = {"heading": 0, "title": 1, "text": 2, "attr": 3}


def kind_rank(kind: Column) -> Column:
    out = F.lit(len(KIND_RANK))
    for name, rank in KIND_RANK.items():
        out = F.when(kind == name, rank).otherwise(out)
    return out


def first_wording(candidates: DataFrame, keys: list[str], text: str, order: list[Column]) -> DataFrame:
    """The text of each key that comes first in a total order, by partial and final aggregation: no sort, no window."""
    return candidates.groupBy(*keys).agg(F.min_by(text, F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order)))).alias(text))


def harmonise(candidates: DataFrame) -> DataFrame:
    """book, source, text: one wording for each source text of a book; sound ones before broken ones, headings before titles, text and attributes, then the first in the book.

    candidates: book, source, text, broken, kind, ord, id.
    """
    return first_wording(candidates, ["book", "source"], "text", [F.col("broken"), kind_rank(F.col("kind")), F.col("ord"), F.col("id")])


def latest(rows: DataFrame, key: str, created: str) -> DataFrame:
    """The newest row of each key: the reading side of an upsert by appending."""
    rest = [c for c in rows.columns if c not in (key, created)]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(created, *rest), F.struct(F.col(created), F.hash(*(F.to_json(c) if t.startswith("map") else F.col(c) for c, t in rows.select(*rest).dtypes)))).alias("x"))
    return newest.select(key, "x.*").select(rows.columns)


def split_by_cache(jobs: DataFrame, cache: DataFrame, sound: Column, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(hits, todo): jobs with a sound cached row, with its columns, and the others. sound is a condition on the joined row."""
    joined = jobs.join(cache, key, "left").withColumn("_sound", F.coalesce(sound, F.lit(False)))
    return joined.where("_sound").drop("_sound"), joined.where("NOT _sound").select(jobs.columns)


def issue_runs(issues: DataFrame, doc: list[str], position: str = "pos") -> DataFrame:
    """Consecutive segments with one problem, merged: doc, first_pos, seg, last_seg, kind, detail. An issue without a segment stands alone.

    issues: doc columns, position, seg, kind, detail.
    """
    order = Window.partitionBy(*doc).orderBy(position)
    follows = (F.col("seg") == F.lag("seg").over(order) + 1) & F.col("kind").eqNullSafe(F.lag("kind").over(order)) & F.col("detail").eqNullSafe(F.lag("detail").over(order))
    marked = issues.withColumn("_new", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(order))
    out = marked.groupBy(*doc, "_run").agg(F.min(position).alias("first_pos"), F.min_by("seg", position).alias("seg"), F.max_by("seg", position).alias("last_seg"), F.min_by("kind", position).alias("kind"), F.min_by("detail", position).alias("detail"))
    return out.drop("_run")


def choose_chapters(spine: DataFrame, chapters: set[int] | None) -> DataFrame:
    """The spine rows (book, idx) at the positions chosen; a position that a book doesn't have is an error. None and an empty set choose all."""
    if not chapters:
        return spine
    last = spine.groupBy("book").agg(F.max("idx").alias("last"))
    missing = last.select("book", "last", F.explode(F.array(*map(F.lit, sorted(chapters)))).alias("idx")).where("idx > last OR idx < 1").orderBy("book", "idx").limit(20).collect()
    if missing:
        raise BookError("no such position: " + ", ".join(f"{r.idx} of {r.book}" for r in missing))
    return spine.where(F.col("idx").isin(sorted(chapters)))


def drop_documents(spine: DataFrame, manifest: DataFrame, links: DataFrame, packages: DataFrame, names: set[str], missing_ok: bool) -> DataFrame:
    """book, path of what leaves the books: the documents named by path or base name, and what only they pointed to.

    One hop: files that an orphan alone points to stay. A file's links to itself count as a use. Cover images stay.
    """
    listed = sorted(names)
    matched = spine.select("book", "path", F.explode(F.array_distinct(F.array("path", F.substring_index("path", "/", -1)))).alias("name")).where(F.col("name").isin(listed))
    if not missing_ok:
        found = matched.groupBy("book").agg(F.collect_set("name").alias("found"))  # at most the names given
        each = spine.select("book").distinct().join(found, "book", "left").withColumn("lacking", F.array_except(F.array(*map(F.lit, listed)), F.coalesce("found", F.array().cast("array<string>"))))
        lacking = each.where(F.size("lacking") > 0).orderBy("book").limit(20).collect()
        if lacking:
            raise BookError("not in the reading order: " + ", ".join(f"{', '.join(sorted(r.lacking))} of {r.book}" for r in lacking))
    return with_orphans(matched.select("book", "path").distinct(), manifest, links, packages)


def with_orphans(gone: DataFrame, manifest: DataFrame, links: DataFrame, packages: DataFrame) -> DataFrame:
    """book, path: the documents that go, and the files that nothing else needs.

    links: book, name, target, of the files that can hold links; packages: book, cover (an item's id).
    """
    kept = manifest.join(gone, ["book", "path"], "left_anti")
    readers = kept.where(F.col("is_content") | F.col("media_type").isin("text/css", "application/x-dtbncx+xml")).select("book", F.col("path").alias("name"))
    used = links.join(readers, ["book", "name"], "left_semi").select("book", F.col("target").alias("path"))
    covers = manifest.where(F.array_contains("properties", "cover-image")).select("book", "path").unionByName(manifest.join(packages.select("book", F.col("cover").alias("id")), ["book", "id"]).select("book", "path"))
    orphans = links.join(gone.select("book", F.col("path").alias("name")), ["book", "name"], "left_semi").select("book", F.col("target").alias("path"))
    for others in (gone, used, covers):
        orphans = orphans.join(others, ["book", "path"], "left_anti")
    orphans = orphans.join(kept.select("book", "path"), ["book", "path"], "left_semi")
    return gone.unionByName(orphans).distinct()


def run_counts(reports: DataFrame) -> DataFrame:
    """A row for each book: documents, done, cached, segments, requests, issues, ok. reports: book, idx, status, segments, requests, issues."""
    done = F.col("status").isin("translated", "cached") & (F.col("idx") != 0)
    bad = F.exists("issues", lambda x: x.kind != "untranslated")
    return reports.groupBy("book").agg(
        F.count_if(F.col("idx") != 0).alias("documents"), F.count_if(done).alias("done"), F.count_if(done & (F.col("status") == "cached")).alias("cached"), F.sum(F.when(F.col("idx") != 0, F.col("segments")).otherwise(0)).alias("segments"),
        F.sum("requests").alias("requests"), F.sum(F.size("issues")).alias("issues"), (~F.coalesce(F.bool_or(bad), F.lit(False))).alias("ok"),
    )
