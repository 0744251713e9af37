import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import collected, documents, order, texts
from tokenizers import Tokenizer

from spendlens.llm.encoders import BlankSegments, SpaceSegments
from spendlens.llm.token_files import decode_ranks, encode_ranks, token_file_round_trip

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = ["", "  ", "a  b", "\n x", "a \n b\t c", "é  ñ", "<|endoftext|>x <|startoftext|> y", " don't 's", "x  y", "x\u0085 y \x1c z", "ΑΣ Σ. İx", "  lead", "trail  ", "日本 語", " 🙂 🙂", "'S 'LL I'm", "\x00a b", "a \x00b", " ͅa", "a, b. c.d e,, f., 's, .", "Q.", "<|ENDOFTEXT|> B", "a.\nb", "İ, x", "_a _ b"]


@pytest.mark.parametrize("path,kind", [(WORD, BlankSegments), (BYTE, SpaceSegments)])
def test_segments_equal_the_library(path, kind):
    table, tok = kind(path), Tokenizer.from_file(path)
    column = ODD + [t for _, t in texts()]
    ids, bounds = table.encode_column(pa.array(column, pa.string()))
    for k, t in enumerate(column):
        want = tok.encode(t or "", add_special_tokens=False).ids
        assert ids[bounds[k] : bounds[k + 1]].tolist() == want, t
        assert table.encode([t or ""])[0].tolist() == want


@pytest.mark.parametrize("path,kind", [(WORD, BlankSegments), (BYTE, SpaceSegments)])
def test_segments_equal_the_library_on_random_texts(path, kind):
    table, tok = kind(path), Tokenizer.from_file(path)

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.text(alphabet=st.sampled_from(list("abzAZé日 \n\t\r.,'!<|>09_́  🙂")), max_size=30), min_size=1, max_size=4))
    def check(column):
        ids, bounds = table.encode_column(pa.array(column, pa.string()))
        for k, t in enumerate(column):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids

    check()


def test_forgetting_keeps_ids_right(monkeypatch):
    monkeypatch.setattr(BlankSegments, "memo", 40)
    table, tok = BlankSegments(WORD), Tokenizer.from_file(WORD)
    for i, t in texts() * 2:
        ids, _ = table.encode_column(pa.array([t], pa.string()))
        assert ids.tolist() == tok.encode(t or "", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=13), max_size=6))
def test_variable_length_coding_round_trip(rows):
    n = np.array([len(r) for r in rows], np.int64)
    flat = np.array([x for r in rows for x in r], np.int64)
    control, data, c_at, d_at = encode_ranks(flat, np.concatenate([[0], np.cumsum(n)]))
    buf, start = [], []
    for i in range(len(rows)):
        start.append(sum(map(len, buf)))
        buf += [control[c_at[i] : c_at[i + 1]], data[d_at[i] : d_at[i + 1]]]
    whole = np.concatenate(buf) if buf else np.zeros(0, np.uint8)
    assert decode_ranks(whole, np.array(start, np.int64), n).tolist() == flat.tolist()


def test_files_hold_what_the_library_encodes(spark):
    read, manifest, ranked = token_file_round_trip(documents(spark), WORD, end_id=1)
    tok = Tokenizer.from_file(WORD)
    coded = []
    for i, t in texts():
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        coded.append((i is not None, i or 0, zlib.crc32(np.array(ids, "<u4").tobytes()), i, len(ids)))
    want, start = [], 0
    # null ids first; repeated ids by the checksum of their ids
    for *_, checksum, i, n in sorted(coded, key=lambda r: r[:3]):
        want.append((i, start, n, checksum))
        start += n
    assert order(collected(read)) == order(want)
    assert manifest.agg({"n_tokens": "sum"}).first()[0] == start
    assert len(set(ranked.tolist())) == len(ranked)


def test_empty_table(spark):
    read, manifest, _ = token_file_round_trip(documents(spark, []), WORD, end_id=1)
    assert collected(read) == [] and manifest.count() == 0
