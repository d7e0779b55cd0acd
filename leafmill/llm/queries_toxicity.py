"""op7: toxicity of every document, learnt from the labels of the rows that aren't held out."""

from pyspark.sql import functions as F

from .common import crc_mod, read
from .toxicity import fit, score


def op7_toxicity(spark, sf_dir, docs=None, labels=None):
    """doc_id, held_out, score, predicted, matches. Null and empty texts get the score of no evidence; a null doc_id counts as the text ''.

    Labels that name a document more than once count once for each, if they agree on `toxic`; else the larger counts.
    """
    docs = read(spark, sf_dir, "documents") if docs is None else docs
    labels = read(spark, sf_dir, "labels") if labels is None else labels
    told = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(crc_mod("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    held = (crc_mod("doc_id", 5) == 0).alias("held_out")
    lexicon = fit(docs, told, "doc_id")
    rows = docs.select("doc_id", "text", held)
    return score(rows, lexicon, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLE = {}
