import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from llm_helpers import collected, documents, order, texts

from spendlens.llm.crc import joined, span_crcs
from spendlens.llm.importance import ngram_crcs, ngram_pattern, one_spaced, resample
from spendlens.llm.packing import pack_multisets, unpack_multisets

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(rows, target):
    """(doc_id, n_features, weight, score, rank) the plain way."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = [0] * 10000, [0] * 10000
    for _, x in rows:
        for f in features(x)[1]:
            s[bucket(f)] += 1
    for x in target:
        for f in features(x)[1]:
            t[bucket(f)] += 1
    S, T = float(sum(s)), float(sum(t))
    gain = [math.floor(1000 * math.log(((b + 1.0) * (S + 10000)) / ((a + 1.0) * (T + 10000)))) for a, b in zip(s, t)]
    made = []
    for i, x in rows:
        n, f = features(x)
        w = sum(gain[bucket(g)] for g in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        made.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in made if r[4] >= 20), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    rank = {id(r): k + 1 for k, r in enumerate(able[: 5 * len(able) // 100])}
    return [(*r[:4], rank.get(id(r))) for r in made]


def some_target(spark, rows):
    return spark.createDataFrame([(str(k), x) for k, x in enumerate(rows)], "item_id string, text string")


def test_equals_brute_force(spark):
    rows = texts() + [(500 + i, f"copy of rows {i % 3} " * (8 + i % 5)) for i in range(60)]
    target = ["The river of silver and copper", None, "", "paper engine window garden, alpha BETA gamma"]
    got = resample(documents(spark, rows), some_target(spark, target)).select("doc_id", "n_features", "weight", "score", "rank")
    assert order(collected(got)) == order(brute(rows, target))
    assert got.where("rank is not null").count() == 5 * sum(features(x)[0] >= 20 for _, x in rows) // 100


def test_empty_tables(spark):
    assert collected(resample(documents(spark, []), some_target(spark, ["a b"]))) == []
    got = collected(resample(documents(spark, [(1, "a b"), (2, None)]), some_target(spark, [])).select("doc_id", "n_features", "weight"))
    assert order(got) == order([(i, n, w) for i, n, w, _, _ in brute([(1, "a b"), (2, None)], [])])


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_spans_and_crcs(n):
    lines = b"".join(one_spaced(x) for x in (b"A-b  c,d e", b"", b"..", b"one", ("x" * 200 + " " + "é" * 90 + " y z").encode()))
    line, crcs, at = ngram_crcs(lines, ngram_pattern(n), n)
    got = [(int(line[w]), int(c)) for c_, w_ in zip(crcs, at) for c, w in zip(c_, w_)]
    want = []
    for k in range(1, n + 1):
        for i, words in enumerate(x.split() for x in lines.split(b"\n")[:-1]):
            want += [(i, zlib.crc32(b" ".join(words[j : j + k]))) for j in range(len(words) - k + 1)]
    assert sorted(got) == sorted(want)


def test_crc_of_joined_spans():
    r = np.random.default_rng(1)
    data = r.integers(0, 256, 5000, dtype=np.uint8)
    cut = [(0, 7, 20), (5, 5, 9), (100, 300, 1000), (10, 4000, 4000), (1, 65, 130)]
    a, b, c = (np.array(x) for x in zip(*cut))
    got = joined(span_crcs(data, a, b), span_crcs(data, b, c), c - b)
    assert got.tolist() == [zlib.crc32(data[i:k].tobytes()) for i, _, k in cut]


def test_multisets_round_trip():
    row, value = np.array([2, 0, 2, 2, 4]), np.array([9999, 255, 0, 9999, 600])
    packed = pack_multisets(row, value, 6, 10000)
    raw = b"".join(packed.to_pylist())
    offsets = np.cumsum([0, *map(len, packed.to_pylist())])
    values, bounds = unpack_multisets(np.frombuffer(raw, np.uint8), offsets)
    assert [values[i:j].tolist() for i, j in zip(bounds[:-1], bounds[1:])] == [[255], [], [0, 9999, 9999], [], [600], []]
