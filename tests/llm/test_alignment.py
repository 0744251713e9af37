import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from llm_helpers import collected, documents, order, prose, texts
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from spendlens.llm.alignment import Aligner, align_tokenizers, segments, vocabularies
from spendlens.llm.encoders import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(rows):
    """All counts from whole-text encodings and pairs of byte ranges."""
    ta = Tokenizer.from_file(A)
    ta.encode_special_tokens = True
    tb = SentencePieceProcessor(model_file=B)
    back = {c: x for x, c in byte_letters().items()}
    docs, links = [], Counter()
    for i, t in rows:
        ids_a = ta.encode(" " + t, add_special_tokens=False).ids if t else []
        ids_b = tb.encode(t, num_threads=1) if t else []
        a = [bytes(back[c] for c in ta.id_to_token(x)) for x in ids_a]
        b = [bytes([int(tb.id_to_piece(x)[3:5], 16)]) if tb.is_byte(x) else tb.id_to_piece(x).replace("▁", " ").encode() for x in ids_b]
        if not t or b"".join(a) != (" " + t).encode() or b"".join(b) != (" " + t).encode():
            docs.append((i, [], [], [], []))
            continue

        def ends(parts):
            n = 0
            return [n := n + len(p) for p in parts]

        ea, eb = ends(a), ends(b)
        both = sorted(set(ea) & set(eb))
        groups, linked, x, y = [], [], 0, 0
        for e in both:
            k, m = ea.index(e, x) + 1, eb.index(e, y) + 1
            groups.append(",".join(map(str, ids_a[x:k])) + "|" + ",".join(map(str, ids_b[y:m])))
            linked.append((ids_a[k - 1], ids_b[m - 1]))
            x, y = k, m
        links.update(linked)
        docs.append((i, ids_a, ids_b, groups, linked))
    top = defaultdict(int)
    for (_, b), n in links.items():
        top[b] = max(top[b], n)
    out = []
    for i, ids_a, ids_b, groups, linked in docs:
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if ids_a else ""
        out.append((i, len(ids_a), len(ids_b), len(groups), len(linked), sum(links[p] == top[p[1]] for p in linked), sum(links[p] for p in linked), sha))
    return out


ODD = [
    (300, " starts with a space"),
    (301, "two  spaces   and\t tabs \n lines\r\n end "),
    (302, "literal ▁ mark"),
    (303, "<s> <unk> <0x41> <|endoftext|> [INST]"),
    (304, "ﬁ é 日本語\U0001f642   nbsp　wide"),
    (305, " "),
    (306, "12,345.67 don't they're A1b2"),
    (307, "nul \x00 and \x7f \x01"),
    (308, "word | word | été | ño"),
]


@pytest.mark.parametrize("hot", [1 << 18, 8, 0])
def test_equals_brute_force(spark, hot):
    rows = texts() + ODD + [(400 + i, prose(60, 50 + i % 4)) for i in range(12)]
    got = align_tokenizers(documents(spark, rows), A, B, hot_pairs=hot)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert order(collected(got)) == order(brute(rows))


def test_identity_map_and_segments():
    v = vocabularies(A, B)
    hits = [(a, b) for a, b in enumerate(v.same.tolist()) if b >= 0]
    assert len(hits) > 5000 and all(v.a_bytes[a] == v.b_bytes[b] for a, b in hits)
    assert segments("a b  c \nd") == ["a", "b  c \nd"] and segments(" x y") == [" x", "y"]
    # no piece joins a space to what stands before it: segments are independent
    assert not [p for p in v.b_bytes if b" " in p.lstrip(b" ")]


def test_bounded_table_forgets_without_changing_results():
    import pyarrow as pa

    small, large = Aligner(A, B), Aligner(A, B)
    small.memo = 20
    for k in range(6):
        column = pa.array([prose(40, k), prose(30, k // 2), None, ""])
        for table in (small, large):
            row, bounds = table.align(column)
            table.out = [b";".join(table.text[r] for r in row[i:j]) for i, j in zip(bounds[:-1], bounds[1:])]
        assert small.out == large.out
    assert len(small.rows) < len(large.rows)


def test_empty_table(spark):
    assert collected(align_tokenizers(documents(spark, []), A, B)) == []
