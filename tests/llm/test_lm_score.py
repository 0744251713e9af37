import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import collected, crc, documents, prose, texts
from pyspark.sql import functions as F

from spendlens.llm.lm_score import score_texts
from spendlens.llm.log_bloom import LogBloom, counted, level_of, pack_keys, unpack_keys

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def quantised(c, base=1.5):
    if not c:
        return 0.0
    return float(LogBloom("", 1, base, 5, [], 0, 0).estimates()[level_of(np.array([c]), base)[0]])


def brute(rows, order=2, mass=4.0):
    """{row number: (held_out, n_tokens, n_known, N, base, score)} from dictionaries of whole n-grams."""
    split = [WORD.findall((t or "").translate(LOWER)) for _, t in rows]
    held = [crc("" if i is None else str(i)) % 7 == 2 for i, _ in rows]
    grams = [Counter() for _ in range(order + 1)]
    for w, h in zip(split, held):
        if not h:
            seq = [None, *w, 0]
            for k in range(1, order + 1):
                grams[k].update(tuple(seq[i : i + k]) for i in range(len(seq) - k + 1))
    tokens = {g: c for g, c in grams[1].items() if g != (None,)}
    n, v = sum(tokens.values()), len(tokens)
    out = []
    for (i, _), w, h in zip(rows, split, held):
        seq = [None, *w, 0]
        base = sum(math.log10((tokens.get((x,), 0) + 1) / (n + v + 1)) for x in seq[1:])
        score = 0.0
        for j in range(1, len(seq)):
            p = (quantised(tokens.get((seq[j],), 0)) + 1) / (n + v + 1)
            for k in range(2, min(order, j + 1) + 1):
                c = quantised(grams[k - 1].get(tuple(seq[j - k + 1 : j]), 0))
                p = (min(quantised(grams[k].get(tuple(seq[j - k + 1 : j + 1]), 0)), c) + mass * p) / (c + mass)
            score += math.log10(p)
        out.append((i, h, len(w) + 1, sum((x,) in tokens for x in seq[1:]), n, base, score))
    return out


def rounded(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


ROWS = texts() + [(600 + i, prose(50 + i, i % 7) + " NUL\x00byte Été") for i in range(40)]


@pytest.mark.parametrize("order, hot, shard_text, round_bytes", [(2, 1 << 20, 1 << 14, 1 << 27), (3, 0, 1 << 18, 1)])
def test_equals_brute_force(spark, order, hot, shard_text, round_bytes):
    # 400 bits an entry: no false positives, so quantised counts are those of exact counting
    got = score_texts(documents(spark, ROWS), order=order, hot_words=hot, shard_text=shard_text, bits_per_entry=400, round_bytes=round_bytes)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert rounded(collected(got)) == rounded(brute(ROWS, order))


def test_default_filter_is_close_and_better_than_the_base(spark):
    rows = [(i, prose(120, i % 9)) for i in range(80)]
    got = score_texts(documents(spark, rows)).orderBy("doc_id").collect()
    want = sorted(brute(rows))
    assert max(abs(g["score"] - w[-1]) / -w[-1] for g, w in zip(got, want)) < 0.05
    held = [r for r in got if r["held_out"]]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_empty_and_untrained(spark):
    assert collected(score_texts(documents(spark, []))) == []
    got = collected(score_texts(documents(spark, [(1, "a b"), (2, None)]), train=F.lit(False)))
    assert sorted(r[2:] for r in got) == [(1, 0, 0, 0.0, 0.0), (3, 0, 0, 0.0, 0.0)]


def test_keys_and_counts():
    keys = np.array([5, 1 << 47, 5, 0], np.uint64)
    assert unpack_keys(pack_keys(keys)).tolist() == keys.tolist()
    k, n = counted(keys, np.array([1, 2, 3, 4]))
    assert (k.tolist(), n.tolist()) == ([0, 5, 1 << 47], [4, 4, 2])
    assert level_of(np.array([1, 2, 3, 4, 10**6]), 1.5).tolist() == [1, 2, 3, 4, 35]


def test_filter_never_counts_too_low_and_seldom_too_high():
    from spendlens.llm.log_bloom import Loaded, _build, parts

    draw = np.random.default_rng(3)
    keys = np.unique(draw.integers(0, 1 << 48, 40_000, dtype=np.uint64))
    counts = np.minimum(draw.zipf(1.7, len(keys)), 10_000)
    made = _build(1.5, 4, 12)(pa.Table.from_batches([parts(keys, counts, 1)]).slice(0, 1))
    table = Loaded.__new__(Loaded)
    table.bloom, table.lo, table.hi = LogBloom("", 1, 1.5, 4, [(0, 1)], 0, 0), 0, 1
    table.data = np.frombuffer(made["bits"][0].as_py(), "<u8")
    table.words, table.start = np.array([len(table.data), 0], np.uint64), np.zeros(2, np.int64)
    mine = keys < np.uint64(1 << 47)
    got, want = table.levels(keys[mine]).astype(int), level_of(counts[mine], 1.5)
    assert (got >= want).all() and (got > want).mean() < 0.03
    unseen = np.setdiff1d(draw.integers(0, 1 << 47, 40_000, dtype=np.uint64), keys)
    assert (table.levels(unseen) > 0).mean() < 0.03 and not table.levels(keys[~mine]).any()


def test_table_of_words_is_exact_for_repeated_words():
    from spendlens.llm.lm_score import Tokens, word_classes

    raw = b"A a\x00b  a\tEND" + b"" + b" "
    t = Tokens(np.frombuffer(raw, np.uint8), np.array([0, 12, 12, len(raw)]), word_classes(), 2)
    assert t.names.to_pylist() == [b"a ", b"a\xffb ", b"end "] and t.per_row.tolist() == [4, 0, 0]
    assert isinstance(t.names, pa.BinaryArray) and t.depth.tolist() == [0, 1, 2, 3, 4, 5, 0, 1, 0, 1]
