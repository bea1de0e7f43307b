from pyspark.sql import functions as F

from aerolens.llm import common, toxicity
from aerolens.llm.queries import query, read

THRESHOLD = 0.7


@query("op7_toxicity")
def op7_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = toxicity.scored(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))
    return rows.select(
        F.col("row.doc_id").alias("doc_id"), common.held_out(F.col("row.doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans",
    )
