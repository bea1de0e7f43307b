from aerolens.llm import langid
from aerolens.llm.queries import query, read


@query("op10_language_id")
def op10_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return langid.predict(docs, langid.prototypes(docs))
