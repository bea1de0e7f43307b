import public_tokenizers

from aerolens.llm import alignment
from aerolens.llm.queries import query, read


@query("op13_align_tokenizers")
def op13_align_tokenizers(spark, sf_dir):
    return alignment.align(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
