from aerolens.llm import neighbours
from aerolens.llm.queries import query, read


@query("op8_nearest_vectors")
def op8_nearest_vectors(spark, sf_dir):
    return neighbours.search(read(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)
