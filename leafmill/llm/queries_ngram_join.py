"""op9: near duplicates of all documents by their sets of five-word runs."""

from pyspark.sql import functions as F

from .common import read
from .ngram_join import join


def op9_ngram_join(spark, sf_dir, docs=None):
    """doc_id, class_id, n_links: every document's group of connected texts and its number of links at a similarity of 0.8 or more."""
    docs = read(spark, sf_dir, "documents") if docs is None else docs
    return join(docs).select("doc_id", "class_id", F.col("n_links").cast("long").alias("n_links"))


QUERIES = {"op9_ngram_join": op9_ngram_join}
ORACLE = {
    # All pairs that share a run of words, by an exact join, and components by reachability.
    "op9_ngram_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
runs AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(len(w), 5) - 1), ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM runs GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM runs a JOIN runs b ON a.run = b.run AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 10 * shared.n >= 8 * (x.n + y.n - shared.n)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT w.doc_id, coalesce(least(w.doc_id, (SELECT min(b) FROM reach WHERE reach.a = w.doc_id)), w.doc_id) AS class_id, CAST((SELECT count(*) FROM links WHERE links.a = w.doc_id) AS BIGINT) AS n_links FROM w"""
}
