"""op3: token ids of all documents through the file format and back."""

from .common import table
from .registry import query
from .token_files import token_file_round_trip


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op3_token_files")
def op3_token_files(spark, sf_dir):
    read, _, _ = token_file_round_trip(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)
    return read.withColumnRenamed("value", "ids_crc32")
