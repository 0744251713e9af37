import itertools
import random
import re

import numpy as np
from llm_helpers import collected, documents, order, prose, texts

from spendlens.llm import jaccard_forest as J
from spendlens.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t):
    w = [x for x in re.split("[\x00\t\n\x0b\x0c\r ]+", (t or "").translate(LOWER)) if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def brute(rows):
    """(doc_id, class_id, n_links, n_copies) by comparing all different texts."""
    different = sorted({t or "" for _, t in rows})
    sets = {t: shingles(t) for t in different}
    links = {t: set() for t in different}
    for a, b in itertools.combinations(different, 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            links[a].add(b)
            links[b].add(a)
    home = {}
    for t in different:
        if t not in home:
            todo, seen = [t], {t}
            while todo:
                for x in links[todo.pop()] - seen:
                    seen.add(x)
                    todo.append(x)
            for x in seen:
                home[x] = t
    least = {}
    for i, t in rows:
        if i is not None:
            least[home[t or ""]] = min(i, least.get(home[t or ""], i))
    copies = {t: sum((u or "") == t for _, u in rows) for t in different}
    return [(i, least.get(home[t or ""]), len(links[t or ""]), copies[t or ""]) for i, t in rows]


def near_copies(n, seed, base, changes):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        w = base.split(" ")
        for _ in range(r.randint(0, changes)):
            w[r.randrange(len(w))] = r.choice(["new", "other", "third"])
        out.append(" ".join(w))
    return out


def test_equals_brute_force(spark):
    rows = texts() + [(500 + i, t) for i, t in enumerate(near_copies(80, 1, prose(150, 77), 6))] + [(800 + i, t) for i, t in enumerate(near_copies(30, 2, prose(25, 78), 2))]
    got = J.near_duplicate_classes(documents(spark, rows))
    assert order(collected(got)) == order(brute(rows))


def test_large_cells_are_dealt_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 7)
    rows = [(i, t) for i, t in enumerate(near_copies(60, 3, prose(120, 79), 4))]
    assert order(collected(J.near_duplicate_classes(documents(spark, rows)))) == order(brute(rows))


def test_one_of_each_class_stays(spark):
    rows = texts() + [(500 + i, t) for i, t in enumerate(near_copies(10, 4, prose(150, 77), 3))]
    docs = documents(spark, rows)
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns
    want = brute(rows)
    ids = [r[0] for r in collected(kept)]
    assert sorted(x for x in ids if x is not None) == sorted({c for _, c, _, _ in want if c is not None})


def test_a_hot_group_costs_no_marginal_links(spark):
    # of 3,000 such pairs the one that shares no prefix of 8 minima
    draw = random.Random(998)
    words = [f"w{draw.randrange(10**6)}" for _ in range(60)]
    pair = [" ".join(words), " ".join(["first", *words[1:30], "other", *words[31:]])]
    hot = prose(400, 11)
    rows = [(0, pair[0]), (1, pair[1])] + [(10 + i, f"{hot} end{i}") for i in range(60)]
    got = J.near_duplicate_classes(documents(spark, rows))
    assert order(collected(got)) == order(brute(rows))


def test_empty_table(spark):
    assert collected(J.near_duplicate_classes(documents(spark, []))) == []


def test_prefixes_are_shortened_until_recall_is_reached():
    counts = np.zeros((J.DEPTH + 1, J.TREES * J.DEPTH + 1), np.int64)
    minima = J.TREES * J.DEPTH
    counts[8, minima - 1] = 10_000  # nearly equal texts: the longest prefix finds them
    assert J.choose_depth(counts, 0.8, 0.999)[0] == 8
    counts[4, int(0.82 * minima)] = 3_000  # less similar ones only share short prefixes
    depth, recall = J.choose_depth(counts, 0.8, 0.999)
    assert depth == 4 and recall >= 0.999
    assert J.choose_depth(np.zeros_like(counts), 0.8, 0.999) == (8, 1.0)


def test_exact_links_both_ways():
    r = np.random.default_rng(0)
    sets = [np.unique(r.integers(0, 60, 50)).astype(np.uint64) for _ in range(30)]
    a, b = np.array(list(itertools.combinations(range(30), 2))).T
    want = [len(np.intersect1d(sets[i], sets[j])) >= 0.6 * len(np.union1d(sets[i], sets[j])) for i, j in zip(a, b)]
    assert J.exact_links(sets, a, b, 0.6).tolist() == want
    assert J.exact_links(sets, a[:40], b[:40], 0.6).tolist() == want[:40]


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 100 + i) for i in range(30)] + [(7, 7)]
    r = random.Random(5)
    r.shuffle(edges)
    got = dict(collected(components(spark.createDataFrame(edges, "u long, v long"))))
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {1000: 100}


def test_cells_are_bounded_by_bytes(spark, monkeypatch):
    rows = [(i, prose(60, 5) + f" tail{i} end{i % 7}") for i in range(40)] + [(100 + i, prose(3_000, 9) + f" {i}") for i in range(6)]
    want = order(collected(J.near_duplicate_classes(documents(spark, rows))))
    monkeypatch.setattr(J, "BLOCK_BYTES", 2_000)
    monkeypatch.setattr(J, "_SLICE", 1_000)
    assert order(collected(J.near_duplicate_classes(documents(spark, rows)))) == want
