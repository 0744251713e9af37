import re

from llm_helpers import collected, documents, order, prose, texts

from spendlens.llm.quality_rules import keep_good, quality_rules

WORD = r"[^\x20\x09-\x0D]+"


def brute(t):
    t = t or ""
    w = re.findall(WORD, t)
    lines = [x for x in t.split("\n") if re.search(WORD, x)]
    places = {}
    for i in range(len(w) - 4):
        places.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {p + j for at in places.values() if len(at) > 1 for p in at for j in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


ROWS = texts() + [(60, "a b c d e " * 3), (61, "a b c d e"), (62, "x y z x y z x y z x y z q r"), (63, "w $$ ## | <b> & 5%"), (64, prose(60, 1) + " " + prose(60, 1)), (65, "l1\nl1 \nl1\n\n\nl2")]


def test_base_counts_equal_brute_force(spark):
    got = collected(quality_rules(documents(spark, ROWS)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
    want = []
    for i, t in ROWS:
        n, c, s, d, r = brute(t)
        want.append((i, n, c, s, d, r, n < 10 or 100 * r > 20 * n))
    assert order(got) == order(want)


def test_divergent_texts_go_and_clean_ones_stay(spark):
    rows = [(i, prose(300, i)) for i in range(40)]
    rows += [(100 + i, prose(300, i).upper().replace(" ", "!! ")) for i in range(3)] + [(200, prose(30, 7).upper().replace(" ", "!! "))]
    docs = documents(spark, rows)
    kept = dict(collected(quality_rules(docs).select("doc_id", "kept")))
    assert all(kept[i] for i in range(40)) and not any(kept[100 + i] for i in range(3))
    assert kept[200]  # too short to judge
    good = keep_good(docs)
    assert good.columns == docs.columns and {r[0] for r in collected(good)} == {i for i, k in kept.items() if k}


def test_empty_table_and_no_language(spark):
    assert collected(quality_rules(documents(spark, []))) == []
    got = collected(quality_rules(documents(spark, ROWS), lang_col=None).select("base_failed", "kept"))
    assert all(k != f for f, k in got)  # nothing to diverge from
