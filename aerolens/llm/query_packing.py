import public_tokenizers

from aerolens.llm import packing
from aerolens.llm.queries import query, read


@query("op9_pack_sequences")
def op9_pack_sequences(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
