from aerolens.llm import simhash
from aerolens.llm.queries import query, read


@query("op6_simhash_near_dedup")
def op6_simhash_near_dedup(spark, sf_dir):
    return simhash.near_groups(read(spark, sf_dir, "documents"))
