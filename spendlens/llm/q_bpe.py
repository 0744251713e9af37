"""op7: byte-level BPE of all documents and back."""

from .bpe_chunks import encode_by_chunks
from .common import table
from .q_token_files import tokenizer_path
from .registry import query


@query("op7_bpe_chunks")
def op7_bpe_chunks(spark, sf_dir):
    return encode_by_chunks(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), columns=["n_tokens", "ids_sha256", "decoded_sha256"])
