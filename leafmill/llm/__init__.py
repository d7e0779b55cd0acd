"""Operators of a training-data pipeline. Nothing outside this subpackage imports it."""

#: Modules that hold QUERIES and ORACLE.
QUERY_MODULES = ("queries_mixing", "queries_urls", "queries_toxicity", "queries_language", "queries_tokens", "queries_ngram_join", "queries_decontaminate", "queries_warc", "queries_media", "queries_html")
