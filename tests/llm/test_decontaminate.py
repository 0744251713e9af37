import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import collected, documents, order, prose, texts

from spendlens.llm.decontaminate import WORD_BYTES, WuManber, drop_contaminated, find_contamination
from spendlens.llm.common import Words, text_buffer
import pyarrow as pa

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def brute(rows, items, k=10):
    windows = {}
    for i, t in items:
        w = words(t)
        for a in range(max(len(w) - k, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[a : a + k]), set()).add(i)
    sizes = {len(w) for w in windows}
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                got = windows.get(tuple(w[a : a + n]))
                if got is not None:
                    hit.update(range(a, a + n))
                    found |= got - {None}
        out.append((i, len(w), len(hit), sorted(found)))
    return out


def cases():
    passage = prose(30, 500)
    rows = texts() + [(300, "intro " + passage.upper().replace(" ", " - ") + " outro"), (301, passage + "\n" + passage), (302, " ".join(passage.split()[:9])), (303, "short words"), (304, "SHORT;words here short words")]
    items = [(1, passage), (2, passage + " more words follow here"), (3, "short words"), (4, None), (5, "!!!"), (None, prose(80, 2)), (6, prose(80, 3)), (1, "été")]
    return rows, items


@pytest.mark.parametrize("block_patterns", [250_000, 20])
def test_equals_brute_force(spark, block_patterns):
    rows, items = cases()
    bench = spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id long, text string, pattern string, doc_id string")
    got = find_contamination(documents(spark, rows), bench, block_patterns=block_patterns)
    assert got.columns == ["doc_id", "n_words", "n_hit", "spans", "items"]
    found = collected(got)
    assert order((i, n, h, list(x)) for i, n, h, _, x in found) == order(brute(rows, items))
    assert all(sum(b - a + 1 for a, b in spans) == h for _, _, h, spans, _ in found)
    clean = [i for i, _, h, _ in brute(rows, items) if not h]
    kept = drop_contaminated(documents(spark, rows), bench, block_patterns=block_patterns)
    assert order(r[0] for r in collected(kept)) == order(clean) and kept.columns == documents(spark).columns


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert all(r[2] == 0 and list(r[4]) == [] for r in collected(find_contamination(documents(spark), bench)))
    assert collected(find_contamination(documents(spark, []), spark.createDataFrame([(1, "a b")], "item_id long, text string"))) == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "ab", "abc", "zz"]), min_size=1, max_size=6), min_size=1, max_size=12), st.lists(st.lists(st.sampled_from(["a", "b", "ab", "abc", "zz"]), max_size=40), min_size=1, max_size=4))
def test_search_finds_all_occurrences(patterns, rows):
    texts_ = [" ".join(p) + " " for p in {tuple(p) for p in patterns}]
    data, offsets = text_buffer(pa.array([" ".join(r) for r in rows], pa.string()))
    w = Words(data, offsets, WORD_BYTES)
    first, which = WuManber([t.encode() for t in texts_]).find(w)
    want = set()
    for r, ws in enumerate(rows):
        for k, t in enumerate(texts_):
            n = t.count(" ")
            want |= {(int(w.first[r]) + a, k) for a in range(len(ws) - n + 1) if " ".join(ws[a : a + n]) + " " == t}
    got = list(zip(first.tolist(), which.tolist()))
    assert sorted(got) == sorted(want)
