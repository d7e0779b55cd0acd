"""op4: the words of every document that lie inside a run of words of a benchmark item."""

from .common import read
from .decontaminate import digest, matches


def op4_decontamination(spark, sf_dir, docs=None, items=None):
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated. Null texts have no words; a null item_id counts as ''; items that share an id are one item."""
    docs = read(spark, sf_dir, "documents") if docs is None else docs
    items = read(spark, sf_dir, "benchmark") if items is None else items
    return digest(*matches(docs, items))


WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

QUERIES = {"op4_decontamination": op4_decontamination}
ORACLE = {
    "op4_decontamination": f"""
WITH b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
runs AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS run
         FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {WORDS} AS w FROM documents),
places AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM runs)),
hits AS (SELECT DISTINCT p.doc_id, p.i, p.k, r.item_id FROM (SELECT doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS run FROM places) p JOIN runs r USING (k, run)),
covered AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS x FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(named.n, 0) AS BIGINT) AS n_items,
       coalesce(named.s, sha256('')) AS items_sha256, covered.n IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)"""
}
