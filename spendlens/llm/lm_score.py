"""Language-model scores of whole texts from a log-frequency Bloom filter of n-gram counts.

Tokens are the words of a text and one end. The n-grams (up to ``order``) of the
training texts are counted in tasks, merged by shard of their hash and stored as
quantised counts in a log-frequency Bloom filter, which every worker loads. The
probability of a token is smoothed from the longest context down: with h the
context and m a fixed prior mass,

    P(w | h) = (c(h w) + m P(w | shorter h)) / (c(h) + m),

ending at P(w) = (c(w) + 1) / (N + V + 1); c are the filter's counts, those of an
n-gram never above its context's. N, V and the base score are exact: words are
counted as bytes, the most frequent (at most ``hot_words``) go to every task, the
others are joined.

Filters larger than ``round_bytes`` are loaded in rounds; each round notes the
levels of the n-grams whose shards it holds and the last one turns them into
scores, so memory stays bounded and results are whole at any size.

Defined results: null and empty texts have the end as their only token; a null id
hashes as the empty text; rows that repeat an id are kept apart; an empty table
gives an empty result; without training rows counts, N and V are 0, and scores
follow the formulas. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, ascii_classes, keyed, mixed, new_folder, new_owner, owned, process_cache, row_slices, span_hashes, stored, text_buffer
from .files import resolve
from .frequent import frequent_from
from .log_bloom import KEY_BITS, PART_SCHEMA, LogBloom, build_filter, counted, loaded, parts

#: words sent to every task, each of at most HOT_LENGTH bytes
HOT_WORDS = 1 << 19
HOT_LENGTH = 48
#: training text (bytes) a shard of the filter stands for
SHARD_TEXT = 4 << 20
SLICE_BYTES = 1 << 20
#: n-gram keys a task holds before it hands their counts on
HELD_KEYS = 1 << 20

_BEGIN, _END = np.uint64(0x51ED270B9F652295), np.uint64(0xA24BAED4963EE407)
_SEPARATORS = {0x20, *range(0x09, 0x0E)}


def word_classes() -> np.ndarray:
    """Byte table: 0 for separators; A-Z lower-cased; NUL, a word byte, as 0xFF, which UTF-8 never holds."""
    lut = ascii_classes(lambda b: b not in _SEPARATORS)
    lut[0] = 0xFF
    return lut


def in_training(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds != fold


class Tokens:
    """Words of a slice of texts, distinct words, and the hashes of all n-grams up to ``order``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lut: np.ndarray, order: int):
        words = Words(data, offsets, lut)
        self.n_rows = n = len(offsets) - 1
        self.per_row = np.diff(words.first)
        bounds = np.append(words.start, len(words.canon)).astype(np.int32)
        listed = pa.BinaryArray.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(bounds), pa.py_buffer(words.canon)])
        coded = listed.dictionary_encode()  # each word with the space after it
        self.names, self.index = coded.dictionary, coded.indices.to_numpy()
        self.row = words.row
        first = np.zeros(len(self.names), np.int64)
        first[self.index[::-1]] = np.arange(len(words))[::-1]
        self.name_hash = name_hash = span_hashes(words.canon, words.start[first], words.end[first])
        # each text as begin, words, end
        size = self.per_row + 2
        last = np.cumsum(size) - 1
        self.start = last - size + 1
        h = np.empty(int(size.sum()), np.uint64)
        h[self.start], h[last] = _BEGIN, _END
        inner = np.ones(len(h), bool)
        inner[self.start] = inner[last] = False
        h[inner] = name_hash[self.index]
        self.inner = inner
        #: keys of the distinct words, then of the begin and the end
        self.word_keys = mixed(np.append(name_hash, [_BEGIN, _END])) >> np.uint64(64 - KEY_BITS)
        self.seq_row = np.repeat(np.arange(n), size)
        self.is_begin = np.zeros(len(h), bool)
        self.is_begin[self.start] = True
        self.grams = [mixed(h) >> np.uint64(64 - KEY_BITS)]
        run = h
        for k in range(2, order + 1):
            longer = np.zeros(len(h), np.uint64)
            longer[k - 1 :] = mixed(run[k - 2 : -1] * np.uint64(0x9E3779B97F4A7C15) + h[k - 1 :] + np.uint64(k))
            run = longer
            self.grams.append(longer >> np.uint64(64 - KEY_BITS))
        #: how many tokens stand before each one in its text
        self.depth = np.arange(len(h)) - self.start[self.seq_row] if n else np.zeros(0, np.int64)


def _count_words(lut: np.ndarray):
    def count(batches):
        held: list[pa.Table] = []

        def merged():
            t = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
            return t.rename_columns({"n_sum": "n"}).select(["word", "n"])

        for batch in batches:
            batch = batch.filter(batch.column("train"))
            data, offsets = text_buffer(batch.column("text"))
            for lo, hi in row_slices(offsets, SLICE_BYTES):
                t = Tokens(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lut, 1)
                held.append(pa.table({"word": t.names, "n": pa.array(np.bincount(t.index, minlength=len(t.names)), pa.int64())}))
            if len(held) > 8:
                held = [merged()]
                if held[0].num_rows > 1 << 20:
                    yield from held[0].to_batches()
                    held = []
        if held:
            yield from merged().to_batches()

    return count


def _count_grams(lut: np.ndarray, order: int, shard_bits: int):
    def count(batches):
        keys, n, fresh, n_fresh = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0
        for batch in batches:
            batch = batch.filter(batch.column("train"))
            data, offsets = text_buffer(batch.column("text"))
            for lo, hi in row_slices(offsets, SLICE_BYTES):
                t = Tokens(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lut, order)
                fresh += [g[t.depth >= k] for k, g in enumerate(t.grams)]
                n_fresh += sum(map(len, fresh[-order:]))
                if n_fresh > HELD_KEYS // 2:
                    keys, n = counted(np.concatenate([keys, *fresh]), np.concatenate([n, np.ones(n_fresh, np.int64)]))
                    fresh, n_fresh = [], 0
                    if len(keys) > HELD_KEYS:
                        yield parts(keys, n, shard_bits)
                        keys, n = keys[:0], n[:0]
        keys, n = counted(np.concatenate([keys, *fresh]), np.concatenate([n, np.ones(n_fresh, np.int64)]))
        yield parts(keys, n, shard_bits)

    return count


def train_filter(docs: DataFrame, owner: str, *, order: int = 2, shard_text: int = SHARD_TEXT, **options) -> LogBloom:
    """Filter of all n-grams up to ``order`` of the training rows of (text, train)."""
    size = docs.where("train").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    shard_bits = max(1, int(-(-size // shard_text)).bit_length())
    partial = docs.select("text", "train").mapInArrow(owned(owner, _count_grams(word_classes(), order, shard_bits)), PART_SCHEMA)
    return build_filter(partial, shard_bits, **options)


def _hot_words(path: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words with their space, counts, hashes) of the stored table of frequent words, by hash."""
    cache = process_cache("hot-words")
    if path not in cache:
        import pyarrow.dataset as ds

        fs, place = resolve(path)
        t = ds.dataset(place, filesystem=fs, format="parquet").to_table(columns=["word", "n"]).combine_chunks()
        data, at = text_buffer(t.column("word"))
        hashes = span_hashes(data, at[:-1], at[1:] - 1)
        by = np.argsort(hashes, kind="stable")
        cache.clear()
        cache[path] = t.column("word").combine_chunks().cast(pa.binary()).take(pa.array(by)), t.column("n").to_numpy()[by], hashes[by]
    return cache[path]


def hot_counts(t: "Tokens", path: str) -> np.ndarray:
    """Count of each distinct word of the slice that is a frequent one, else -1."""
    words, counts, hashes = _hot_words(path)
    out = np.full(len(t.names), -1, np.int64)
    if not len(words) or not len(out):
        return out
    at = np.minimum(np.searchsorted(hashes, t.name_hash), len(hashes) - 1)
    # words of equal hash stand side by side; bytes decide
    open_ = np.flatnonzero(hashes[at] == t.name_hash)
    at = at[open_]
    while len(open_):
        same = pc.equal(t.names.take(pa.array(open_)), words.take(pa.array(at))).to_numpy(zero_copy_only=False)
        out[open_[same]] = counts[at[same]]
        open_, at = open_[~same], at[~same] + 1
        more = (at < len(hashes)) & (hashes[np.minimum(at, len(hashes) - 1)] == t.name_hash[open_])
        open_, at = open_[more], at[more]
    return out


def gram_levels(t: Tokens, bloom: LogBloom, lo: int, hi: int) -> np.ndarray:
    """[order, tokens] levels of the n-grams in the round's shards (0 for all others); each distinct
    n-gram of the slice is probed once."""
    table = loaded(bloom, lo, hi)
    out = np.zeros((len(t.grams), len(t.depth)), np.uint8)
    word = table.levels(t.word_keys)
    out[0, t.inner] = word[:-2][t.index]
    out[0, ~t.inner] = np.where(t.is_begin[~t.inner], word[-2], word[-1])
    for k, g in enumerate(t.grams[1:], 1):
        at = np.flatnonzero(t.depth >= k)
        keys, place = np.unique(g[at], return_inverse=True)
        out[k, at] = table.levels(keys)[place]
    return out


def log_probabilities(levels: np.ndarray, t: Tokens, estimates: np.ndarray, n: float, v: float, mass: float) -> np.ndarray:
    """log10 probability of each text from the levels of its n-grams."""
    count = estimates[levels]
    p = (count[0] + 1) / (n + v + 1)
    context = np.concatenate([[0.0], count[0][:-1]])
    for k in range(1, len(levels)):
        deep = t.depth >= k
        seen = np.minimum(count[k], context)
        p = np.where(deep, (seen + mass * p) / (context + mass), p)
        context = np.concatenate([[0.0], count[k][:-1]])
    logs = np.where(t.is_begin, 0.0, np.log10(p))
    return np.bincount(t.seq_row, weights=logs, minlength=t.n_rows)


def _score(lut: np.ndarray, order: int, bloom: LogBloom, which: int, hot_path: str, n: int, v: int, ends: int, mass: float):
    lo, hi = bloom.rounds[which]
    last = which == len(bloom.rounds) - 1
    estimates = bloom.estimates()

    def score(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            before, before_at = text_buffer(batch.column("levels"))
            for a, b in row_slices(offsets, SLICE_BYTES):
                t = Tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lut, order)
                levels = gram_levels(t, bloom, lo, hi)
                if which:  # stored text by text, all tokens of one order after those of the next lower
                    old = before[before_at[a] : before_at[b]]
                    levels |= _by_order(old, t, order)
                if last:
                    yield _scored(batch.slice(a, b - a), t, levels)
                else:
                    yield _kept(batch.slice(a, b - a), t, levels)

    def _by_order(old: np.ndarray, t: Tokens, order: int) -> np.ndarray:
        return old.reshape(-1, order).T if len(old) else np.zeros((order, 0), np.uint8)

    def _kept(batch, t: Tokens, levels: np.ndarray) -> pa.RecordBatch:
        flat = np.ascontiguousarray(levels.T).reshape(-1)
        bounds = (np.append(t.start, len(t.depth)) * order).astype(np.int32)
        column = pa.BinaryArray.from_buffers(pa.binary(), t.n_rows, [None, pa.py_buffer(bounds), pa.py_buffer(flat)])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), batch.column("train"), column], ["doc_id", "text", "train", "levels"])

    def _scored(batch, t: Tokens, levels: np.ndarray) -> pa.RecordBatch:
        scores = log_probabilities(levels, t, estimates, n, v, mass)
        count = hot_counts(t, hot_path)
        hot = count >= 0
        logs = np.log10(np.maximum(count, 0) + 1.0)
        base = np.bincount(t.row, weights=logs[t.index], minlength=t.n_rows) + np.log10(ends + 1)
        known = np.bincount(t.row, weights=hot[t.index], minlength=t.n_rows).astype(np.int64) + (ends > 0)
        rare = ~hot[t.index]
        pair, times = np.unique(t.row[rare].astype(np.int64) << 32 | t.index[rare], return_counts=True)
        first = np.searchsorted(pair >> 32, np.arange(t.n_rows + 1)).astype(np.int32)
        asked = pa.StructArray.from_arrays([t.names.take(pa.array(pair & 0xFFFFFFFF)), pa.array(times, pa.int32())], ["word", "times"])
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pc.invert(batch.column("train")),
                pa.array(t.per_row + 1, pa.int64()),
                pa.array(known, pa.int64()),
                pa.array(base - (t.per_row + 1) * np.log10(n + (v + 1.0))),
                pa.array(scores),
                pa.ListArray.from_arrays(pa.array(first), asked),
            ],
            ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"],
        )

    return score


def score_texts(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    train: Column | None = None,
    order: int = 2,
    mass: float = 4.0,
    hot_words: int = HOT_WORDS,
    shard_text: int = SHARD_TEXT,
    bits_per_entry: int = 10,
    round_bytes: int = 128 << 20,
) -> DataFrame:
    """Every text with its token counts, exact unigram base score and model score.

    ``train`` (over a column ``doc_id``) chooses the rows learnt from.
    """
    spark, owner = docs.sparkSession, new_owner()
    rows = keyed(docs, doc_id=doc_id, text=text).withColumn("train", in_training(F.col("doc_id")) if train is None else train)
    kind = rows.schema["doc_id"].dataType.simpleString()
    words = stored(rows.select("text", "train").mapInArrow(owned(owner, _count_words(word_classes())), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends = rows.where("train").count()
    n, v = total["n"] + ends, total["v"] + (1 if ends else 0)
    short = F.octet_length("word") <= HOT_LENGTH
    least = frequent_from(words.where(short), "n", hot_words)
    hot_path = new_folder(spark, "hot-words")
    words.where(short & (F.col("n") >= least)).write.parquet(hot_path)
    bloom = train_filter(rows, owner, order=order, shard_text=shard_text, bits_per_entry=bits_per_entry, round_bytes=round_bytes)
    made = rows.withColumn("levels", F.lit(None).cast("binary"))
    lut = word_classes()
    for which in range(len(bloom.rounds) - 1):
        step = _score(lut, order, bloom, which, hot_path, n, v, ends, mass)
        made = stored(made.mapInArrow(owned(owner, step), f"doc_id {kind}, text string, train boolean, levels binary"), "levels")
    step = _score(lut, order, bloom, len(bloom.rounds) - 1, hot_path, n, v, ends, mass)
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<struct<word: binary, times: int>>"
    made = stored(made.mapInArrow(owned(owner, step), schema).withColumn("_row", F.monotonically_increasing_id()), "scored")
    others = words.where(~short | (F.col("n") < least))
    asked = made.select("_row", F.explode("rare").alias("r")).select("_row", "r.word", "r.times")
    found = asked.join(others, "word").groupBy("_row").agg(F.sum("times").alias("_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("_logs"))
    out = made.join(found, "_row", "left")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("_logs", F.lit(0.0))).alias("base_score"),
        "score",
    )
