"""Quality classifier by positive-unlabelled learning (non-negative risk).

Trusted positives and unlabelled web text train a small network; no negative
label is used. With class prior ``p`` the risk is

    p * E_pos[loss(+)] + max(0, E_unl[loss(-)] - p * E_pos[loss(-)])

and where the bracket turns negative the step goes against it, so the network
cannot profit from overfitted positives. The prior is estimated from how often
trusted annotators mark a text good.

Features are shares and ratios of the text alone (character classes, word
lengths, repetition), computed on the bytes of every whole text in one pass;
the fit sees at most ``max_fit`` positives and as many unlabelled rows.

Defined results: null and empty texts have zero features and get a score like
any other; a label without id or quality is not used, one given twice counts
as good only if all say so; without positives every score is the prior; a null
id is held out; repeated rows keep a row each; an empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, ascii_classes, begin, keyed, new_owner, row_slices, span_hashes, stored, text_buffer

_SLICE = 2 << 20
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b".,;:", b"!?", b"'\"()[]-", b"#*$%&<>=+@/\\^~_", b"|"]
WORD_BYTES = ascii_classes(lambda b: b not in b"\x00\t\n\x0b\x0c\r ", lower=False)
N_FEATURES = len(_CLASSES) + 1 + 14


# -- features ----------------------------------------------------------------


def _by_row(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask)])
    return (total[bounds[1:]] - total[bounds[:-1]]).astype(np.float64)


def _variety(hashes: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, and the count of its most frequent one."""
    key = np.sort((row.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)))
    if not len(key):
        return np.zeros(n_rows), np.zeros(n_rows)
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    times = np.diff(np.append(at, len(key)))
    of = (key[at] >> np.uint64(44)).astype(np.int64)
    most = np.zeros(n_rows, np.int64)
    np.maximum.at(most, of, times)
    return np.bincount(of, minlength=n_rows).astype(float), most.astype(float)


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, N_FEATURES) of a slice of texts."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1).astype(float)
    number = np.full(256, len(_CLASSES) + 1, np.uint8)  # the rest
    for i, members in enumerate(_CLASSES):
        number[list(members)] = i
    number[0xC0:] = len(_CLASSES)  # first bytes of characters outside ASCII
    cls = number[data]
    out = [_by_row(cls == i, offsets) / size for i in range(len(_CLASSES) + 1)]
    letters = np.maximum(out[0] + out[1], 1e-9)
    words = Words(data, offsets, WORD_BYTES)
    n_words = np.diff(words.first).astype(float)
    some = np.maximum(n_words, 1)
    length = (words.end - words.start).astype(float)
    h = span_hashes(words.canon, words.start, words.end)
    same_row = words.row[1:] == words.row[:-1]
    types, most = _variety(h, words.row, n)
    pair = (h[1:] * np.uint64(3) + h[:-1])[same_row]
    pair_types, _ = _variety(pair, words.row[1:][same_row], n)
    again = np.bincount(words.row[1:][same_row & (h[1:] == h[:-1])], minlength=n) if len(h) else np.zeros(n)
    last = words.canon[words.end - 1] if len(h) else np.zeros(0, np.uint8)
    first = words.canon[words.start] if len(h) else np.zeros(0, np.uint8)
    share = lambda mask: np.bincount(words.row[mask], minlength=n) / some
    last_class = number[last]
    out += [
        out[0] / letters,
        np.log1p(n_words),
        np.bincount(words.row, weights=length, minlength=n) / some / 8,
        np.sqrt(np.maximum(np.bincount(words.row, weights=length**2, minlength=n) / some - (np.bincount(words.row, weights=length, minlength=n) / some) ** 2, 0)) / 8,
        types / some,
        np.log1p(types) / np.maximum(np.log1p(n_words), 1e-9),
        most / some,
        pair_types / np.maximum(n_words - 1, 1),
        again / some,
        share(length <= 3),
        share(length == 1),
        share((first >= 0x41) & (first <= 0x5A)),
        share((last_class == 6) | (last_class == 8)),
        _by_row(cls == 4, offsets) / some,
    ]
    return np.stack(out, axis=1).astype(np.float32)


def column_features(texts: pa.Array) -> np.ndarray:
    """(rows, N_FEATURES) of a string column, a few MB at a time."""
    data, offsets = text_buffer(texts)
    parts = [text_features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in row_slices(offsets, _SLICE)]
    return np.concatenate(parts) if parts else np.zeros((0, N_FEATURES), np.float32)


def features_of(owner: str):
    """Features of a text column, as a column function."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def features(texts: pa.Array) -> pa.Array:
        begin(owner)
        x = column_features(texts)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * N_FEATURES), pa.array(x.ravel()))

    return features


# -- model -------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    prior: float
    mean: np.ndarray
    scale: np.ndarray
    nets: list[tuple[np.ndarray, np.ndarray, np.ndarray, float]]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.nets:
            return np.full(len(x), self.prior)
        z = _standard(x, self.mean, self.scale)
        f = np.mean([np.tanh(z @ w1 + b1) @ w2 + b2 for w1, b1, w2, b2 in self.nets], axis=0)
        return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x.astype(np.float64) - mean) / scale, -6, 6)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 12, steps: int = 300, rate: float = 0.02, decay: float = 1e-4, seeds: int = 3) -> Model:
    """Minimise the non-negative risk by Adam on all rows; the mean of a few networks."""
    everything = np.concatenate([unlabelled, positive]) if len(positive) else unlabelled
    if not len(positive) or not len(unlabelled):
        return Model(prior, np.zeros(N_FEATURES), np.ones(N_FEATURES), [])
    mean, scale = everything.mean(axis=0, dtype=np.float64), np.maximum(everything.std(axis=0, dtype=np.float64), 1e-3)
    p, u = _standard(positive, mean, scale), _standard(unlabelled, mean, scale)
    x = np.concatenate([p, u])
    n_p, n_u = len(p), len(u)
    nets = []
    for seed in range(seeds):
        draw = np.random.default_rng(seed)
        w = [draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), draw.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        m1, m2 = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
        for step in range(1, steps + 1):
            a = np.tanh(x @ w[0] + w[1])
            f = a @ w[2] + w[3]
            s = 1 / (1 + np.exp(-np.clip(f, -30, 30)))  # d loss(-) / d f; that of loss(+) is s - 1
            minus = np.logaddexp(0, f)
            bracket = minus[n_p:].mean() - prior * minus[:n_p].mean()
            g = np.empty_like(f)
            if bracket >= 0:
                g[:n_p] = prior * (s[:n_p] - 1) / n_p - prior * s[:n_p] / n_p
                g[n_p:] = s[n_p:] / n_u
            else:
                g[:n_p] = prior * s[:n_p] / n_p
                g[n_p:] = -s[n_p:] / n_u
            back = np.outer(g, w[2]) * (1 - a * a)
            grads = [x.T @ back + decay * w[0], back.sum(axis=0), a.T @ g + decay * w[2], np.array([g.sum()])]
            for i, d in enumerate(grads):
                m1[i] = 0.9 * m1[i] + 0.1 * d
                m2[i] = 0.999 * m2[i] + 0.001 * d * d
                w[i] = w[i] - rate * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.999**step)) + 1e-8)
        nets.append((w[0], w[1], w[2], float(w[3][0])))
    return Model(prior, mean, scale, nets)


def held_out(doc_id: Column) -> Column:
    """Rows no label is learnt from: crc32 of the id as text divisible by 5."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def _first_ids(rows: DataFrame, n: int) -> DataFrame:
    """At most ``n`` distinct ids, chosen by hash."""
    return rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def train(docs: DataFrame, labels: DataFrame, max_fit: int = 5_000) -> Model:
    """Fit on (doc_id, text) rows; labels (doc_id, quality) count only where not held out.

    Ids are drawn first, so only the texts of the sample (``max_fit`` positives
    and as many unlabelled rows) are read into features and reach the driver.
    """
    learn = keyed(labels, doc_id="doc_id", quality="quality").where("doc_id IS NOT NULL AND quality IS NOT NULL")
    learn = learn.select(F.col("doc_id").cast("long"), "quality").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n, good = learn.agg(F.count("*"), F.coalesce(F.sum((F.col("quality") == 1).cast("long")), F.lit(0))).first()
    prior = (good + 1) / (n + 2)
    pool = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text")
    positive = _first_ids(pool.select("doc_id").join(learn.where("quality = 1"), "doc_id", "left_semi"), max_fit).withColumn("positive", F.lit(True))
    unlabelled = _first_ids(pool, max_fit).withColumn("positive", F.lit(False))
    drawn = stored(positive.unionByName(unlabelled), "quality-sample")  # at most 2 * max_fit ids
    got = pool.join(F.broadcast(drawn), "doc_id").dropDuplicates(["doc_id", "positive"]).select("doc_id", "positive", features_of(new_owner())("text").alias("x"))
    rows = got.orderBy("positive", "doc_id").toPandas()
    x = np.array(rows["x"].tolist(), np.float32).reshape(len(rows), N_FEATURES)
    mask = rows["positive"].to_numpy(bool)
    return fit(x[mask], x[~mask], prior)


def score_of(model: Model):
    """Score of a text column, as a column function."""
    owner = new_owner()

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        begin(owner)
        return pa.array(model.score(column_features(texts)))

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_fit: int = 5_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    rows = keyed(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    model = train(rows, labels, max_fit)
    scored = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_of(model)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
