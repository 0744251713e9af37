"""Small tables for the corpus operators: nulls, empty and long texts, repeats, clashing columns."""

import random

import numpy as np

WORDS = "the of and to a in is that it for was on alpha beta gamma delta river mountain paper engine window garden silver copper market yellow distance remember".split()
CLASH = ["KEY", "words", "size", "SHARD", "label", "part", "pos", "block"]


def prose(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = r.choice(WORDS) + (r.choice(WORDS) if r.random() < 0.4 else "")
        out.append(w.capitalize() if i % 11 == 0 else w)
        if i % 11 == 10:
            out[-1] += "."
    return " ".join(out)


def texts():
    """(doc_id, text) pairs with every odd case; ids 100 and None repeat."""
    base = [prose(80, i) for i in range(12)]
    near = base[0].split(" ")
    near[40] = "changed"
    rows = list(enumerate(base))
    rows += [(20, None), (21, ""), (22, "   \n\t "), (23, "one"), (24, "été Ünïcode 日本語 🙂 ́x"), (25, "a  b\n\n c \x00 d\r\n")]
    rows += [(30, base[0]), (31, base[0]), (32, " ".join(near)), (33, base[3] + "\n" + base[4])]
    rows += [(100, base[5]), (100, base[5]), (None, base[6]), (None, "lost ids have texts too")]
    rows += [(40, prose(30_000, 99)), (41, "x" * 50_000), (42, "same line\n" * 400), (43, "don't <|endoftext|> they're, 12,345!! ")]
    return rows


def documents(spark, rows=None, extra=True):
    rows = texts() if rows is None else rows
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {c} string" for c in (CLASH if extra else []))
    langs = ["en", None, "xx", "en"]
    made = [(i, t, langs[k % 4], "src0", None if t is None else len(t)) + ("z",) * (len(CLASH) if extra else 0) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(made, schema)


def collected(df):
    return [tuple(r) for r in df.collect()]


def crc(text):
    import zlib

    return zlib.crc32((text or "").encode())


def order(rows):
    return sorted(rows, key=repr)


def ids_array(*ids):
    return np.array(ids, np.int64)
