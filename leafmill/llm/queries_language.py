"""op10: the language of every document, learnt from the rows that aren't held out."""

from .common import crc_mod, read
from .language import fit, predict


def op10_language_id(spark, sf_dir, docs=None):
    """doc_id, held_out, lang_pred, score. A null doc_id counts as the text ''; equal texts get equal predictions."""
    docs = read(spark, sf_dir, "documents") if docs is None else docs
    filters = fit(docs.where(crc_mod("doc_id", 3) != 1))
    return predict(docs.withColumn("held_out", crc_mod("doc_id", 3) == 1), filters, ["doc_id", "held_out"])


QUERIES = {"op10_language_id": op10_language_id}
ORACLE = {}
