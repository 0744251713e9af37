"""Target-distribution importance resampling over hashed n-grams.

Words of a text are put on one line with single spaces between them; an
overlapped regular expression then emits, at every word, the span of the widest
n-gram starting there. Shorter n-grams are the parts of that span up to the
spaces in it. The CRC-32 of each span picks its bucket. Buckets of all documents
and of all target texts are counted; a document's weight is the sum of its
buckets' gains, and a seeded Gumbel term turns the top of the scores into a draw
without replacement.

The text is scanned once: each document's buckets are stored as a few bytes an
n-gram and read again for counts and weights. Counts are vectors with one entry
a bucket, in tasks and on the driver.

Defined results: null and empty texts have no features and weight 0; a null id
takes part in the draw with the hash of the seed alone and ranks as the smallest
id; rows that repeat an id are ranked one by one (equal ones in stored order);
an empty table gives an empty result; without target texts T is 0. Other columns
are ignored.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rank import with_rank
from .common import keyed, new_folder, release_memory, row_slices, text_buffer
from .crc import append_byte, joined, span_crcs
from .packing import pack_multisets, unpack_multisets

BUCKETS = 10_000
#: text scanned at once in a task
SLICE_BYTES = 1 << 20


def _is_word(b: int) -> bool:
    return 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80


#: separators become spaces, A-Z is lower-cased
WORD_BYTES = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if _is_word(b) else 0x20 for b in range(256))


def one_spaced(text: bytes) -> bytes:
    """The words of a text on a line: one space before each, a line feed after the last."""
    words = text.translate(WORD_BYTES).split()
    return b" " + b" ".join(words) + b"\n" if words else b"\n"


def ngram_pattern(n: int):
    """Widest run of up to ``n`` words after a space, ending where a word ends."""
    import regex

    return regex.compile(rb" [^ \n]+(?: [^ \n]+){0,%d}(?=[ \n])" % (n - 1))


def ngram_crcs(lines: bytes, pattern, n: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(line of each word, CRC-32 of the k-gram at each word that has one, those words) for k = 1..n."""
    spans = np.fromiter(chain.from_iterable(m.span() for m in pattern.finditer(lines, overlapped=True)), np.int64).reshape(-1, 2)
    data = np.frombuffer(lines, np.uint8)
    line_end = np.flatnonzero(data == 0x0A)
    start, widest = spans[:, 0] + 1, spans[:, 1]
    line = np.searchsorted(line_end, start)
    # a word ends before the space at which the next one's span starts
    end = widest.copy()
    follows = np.flatnonzero(line[1:] == line[:-1])
    end[follows] = start[follows + 1] - 1
    word = span_crcs(data, start, end)
    length = end - start
    crcs, at = [word], [np.arange(len(start))]
    for k in range(2, n + 1):
        # spans wide enough for k words: the k-th lies on the same line and inside the span
        here = at[-1][at[-1] + k - 1 < len(start)]
        keep = (line[here + k - 1] == line[here]) & (end[here + k - 1] <= widest[here])
        left = crcs[-1][: len(here)][keep]
        here = here[keep]
        last = here + k - 1
        crcs.append(joined(append_byte(left, 0x20), word[last], length[last]))
        at.append(here)
    return line, crcs, at


def _scan(n: int, buckets: int):
    def scan(batches):
        pattern = ngram_pattern(n)
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            raw = data.tobytes()
            for lo, hi in row_slices(offsets, SLICE_BYTES):
                at = offsets[lo : hi + 1].tolist()
                lines = b"".join([one_spaced(raw[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)])
                line, crcs, where = ngram_crcs(lines, pattern, n)
                row = np.concatenate([line[w] for w in where])
                bucket = np.concatenate(crcs).astype(np.int64) % buckets
                n_rows = hi - lo
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, n_rows),
                        pa.array(np.bincount(line, minlength=n_rows), pa.int64()),
                        pa.array(np.bincount(row, minlength=n_rows), pa.int64()),
                        pack_multisets(row, bucket, n_rows, buckets),
                    ],
                    ["doc_id", "n_words", "n_features", "buckets"],
                )
        release_memory()

    return scan


def hashed_ngrams(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = 3, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features and the packed buckets of every text."""
    rows = keyed(docs, doc_id=doc_id, text=text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_scan(n, buckets), f"doc_id {kind}, n_words long, n_features long, buckets binary")


def bucket_counts(hashed: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features lie in each bucket: one row a bucket and task, summed, one vector on the driver."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            values, _ = unpack_multisets(*text_buffer(batch.column("buckets")))
            total += np.bincount(values, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in hashed.select("buckets").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket in thousandths of a nat (add-one shares of target over source)."""
    k = len(source)
    s, t, all_s, all_t = source.astype(float), target.astype(float), float(source.sum()), float(target.sum())
    return np.floor(1000.0 * np.log(((t + 1.0) * (all_s + k)) / ((s + 1.0) * (all_t + k)))).astype(np.int64)


def _weigh(gain: np.ndarray):
    def weigh(batches):
        for batch in batches:
            values, bounds = unpack_multisets(*text_buffer(batch.column("buckets")))
            sums = np.concatenate([[0], np.cumsum(gain[values])])
            weight = pa.array(sums[bounds[1:]] - sums[bounds[:-1]], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), batch.column("n_features"), weight], ["doc_id", "n_words", "n_features", "weight"])

    return weigh


def resample(
    docs: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", n: int = 3, buckets: int = BUCKETS, min_words: int = 20, per_hundred: int = 5, seed: int = 42
) -> DataFrame:
    """Every document with its weight and score; ``rank`` numbers those drawn, others have none."""
    spark = docs.sparkSession
    path = new_folder(spark, "ngrams")
    hashed_ngrams(docs, doc_id=doc_id, text=text, n=n, buckets=buckets).write.option("compression", "zstd").parquet(path)
    hashed = spark.read.parquet(path)
    target_rows = keyed(target, text=target_text).withColumn("doc_id", F.lit(0))
    wanted = bucket_counts(hashed_ngrams(target_rows, n=n, buckets=buckets), buckets)
    gain = gains(bucket_counts(hashed, buckets), wanted)
    kind = hashed.schema["doc_id"].dataType.simpleString()
    weighed = hashed.mapInArrow(_weigh(gain), f"doc_id {kind}, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    path = new_folder(spark, "weights")
    weighed.withColumns({"score": F.col("weight") + noise, "_row": F.monotonically_increasing_id(), "_out": F.col("n_words") < min_words}).write.parquet(path)
    scored = spark.read.parquet(path)
    eligible = scored.where(~F.col("_out")).count()
    drawn = per_hundred * eligible // 100
    ranked = with_rank(scored, [F.col("_out"), F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("_row")])
    rank = F.when(~F.col("_out") & (F.col("rank") <= drawn), F.col("rank"))
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))
