"""op8: judges every page's URL."""

from .common import read
from .urls import judge

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op8_url_filter(spark, sf_dir, pages=None):
    """page_id, host, path, rule, verdict, score. A null URL has empty host and path, no rule, and the trees' verdict."""
    return judge(read(spark, sf_dir, "pages") if pages is None else pages, RULES, "page_id")


QUERIES = {"op8_url_filter": op8_url_filter}
ORACLE = {}
