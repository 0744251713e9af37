import hashlib

import numpy as np
import public_tokenizers
from llm_helpers import collected, documents, order, prose, texts
from tokenizers import Tokenizer

from spendlens.llm.bpe_chunks import chunk_bounds, decode_ids, encode_by_chunks

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_equal_the_library_and_decode_back(spark):
    tok = Tokenizer.from_file(PATH)
    shared = prose(400, 7)
    rows = texts() + [(200 + i, prose(30, 300 + i) + " " + shared + "  " + prose(20, 400 + i)) for i in range(6)]
    made = encode_by_chunks(documents(spark, rows), PATH, mean_bytes=128)
    want = [(i, tok.encode(t or "", add_special_tokens=False).ids) for i, t in rows]
    assert order(collected(made)) == order(want)
    back = [(i, tok.decode(x, skip_special_tokens=False)) for i, x in want]
    assert order(collected(decode_ids(made, PATH))) == order(back)


def test_digests(spark):
    tok = Tokenizer.from_file(PATH)
    rows = texts()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    got = encode_by_chunks(documents(spark, rows), PATH, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
    assert order(collected(got)) == order(want)


def test_chunks_follow_content():
    passage = prose(600, 1).encode()
    a, b = b"Some start. " + passage, prose(50, 2).encode() + passage
    data = np.frombuffer(a + b, np.uint8)
    offsets = np.array([0, len(a), len(a) + len(b)], np.int64)
    edges, first = chunk_bounds(data, offsets, 128)
    raw = data.tobytes()
    pieces = [raw[x:y] for x, y in zip(edges[:-1], edges[1:])]
    assert b"".join(pieces) == raw and edges[first].tolist() == offsets[:-1].tolist()
    cut = int(np.searchsorted(edges, len(a)))
    assert len(set(pieces[:cut]) & set(pieces[cut:])) >= 5  # the passage gives equal chunks in both


def test_empty_table(spark):
    assert collected(encode_by_chunks(documents(spark, []), PATH)) == []
