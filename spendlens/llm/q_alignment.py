"""op11: tokens of a byte-level and a piece tokenizer aligned over all documents."""

from .alignment import align_tokenizers
from .common import table
from .q_token_files import tokenizer_path
from .registry import query


@query("op11_token_alignment")
def op11_token_alignment(spark, sf_dir):
    return align_tokenizers(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
