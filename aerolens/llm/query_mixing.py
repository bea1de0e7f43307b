from aerolens.llm import mixing
from aerolens.llm.queries import query, read


@query("op1_mix_sources")
def op1_mix_sources(spark, sf_dir):
    rows = mixing.mix(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")
