"""op3: the article text of every page."""

from pyspark.sql import functions as F

from .common import read
from .html import articles


def op3_html_extraction(spark, sf_dir, pages=None):
    """page_id, url, text, n_chars (code points). Null html has the empty text."""
    found = articles(read(spark, sf_dir, "pages") if pages is None else pages)
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES = {"op3_html_extraction": op3_html_extraction}
ORACLE = {}
