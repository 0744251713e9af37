"""Quality rules: base counts, then distribution divergence from language references.

Every document has two histograms: characters by class, and its common words
(fixed lists of four languages, one bin a word, one for all other words). The
references are the summed histograms of all documents of a language that pass
the base rules. A document long enough to judge is rejected when its
Jensen-Shannon distance to the nearest reference exceeds a limit.

DataFrame functions only; a document's counts are made in its own row, so no
text is shuffled. The references are at most one row per listed language.

Defined results: a null text has no words (it fails the base rules); a null or
unlisted ``lang`` only keeps a document out of the references; without any
reference nothing diverges; repeated rows keep a row each; an empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed, stored

#: fixed values: frequent words of each language
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "sich", "mit", "des", "auf"],
    "fr": ["de", "la", "le", "et", "les", "en", "des", "un", "du", "une", "que", "pour"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "las", "se", "del", "un", "por"],
}
BINS = sorted({w for ws in COMMON_WORDS.values() for w in ws})
#: counted classes; lower-case letters and all else are the remainder
CLASSES = {"upper": "[A-ZÀ-ÖØ-Þ]", "digit": "[0-9]", "stop": "[.,;:]", "call": "[!?]", "quote": "['\"()\\[\\]-]", "symbol": "[#*$%&|<>]"}
_WORD = r"[^\x20\x09-\x0D]+"
#: limits of the nearest distance, and the words a text needs to be judged by it
CLASS_LIMIT, CLASS_MIN_WORDS = 0.3, 50
WORD_LIMIT, WORD_MIN_WORDS = 0.27, 200


def _code(i: int) -> str:
    return chr(0x100 + i)


def _hash(word: str) -> int:
    """xxhash64(word) as Spark computes it (signed)."""
    h = xxhash.xxh64(word.encode(), seed=42).intdigest()
    return h - (1 << 64) if h >> 63 else h


#: the least number of slots that gives every common word its own
_SLOTS = next(n for n in range(len(BINS), 1 << 16) if len({_hash(w) % n for w in BINS}) == len(BINS))


def _tables() -> tuple[Column, Column]:
    """Slot of a word's hash -> the common word there, and its one-character code."""
    words, codes = [""] * _SLOTS, [""] * _SLOTS
    for i, w in enumerate(BINS):
        words[_hash(w) % _SLOTS], codes[_hash(w) % _SLOTS] = w, _code(i)
    return F.array(*map(F.lit, words)), F.array(*map(F.lit, codes))


def base_counts(docs: DataFrame, carry: Column, text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """(carried, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes, bins) of whole texts.

    ``carry`` is any column of the input to keep (an id, or a struct of all).
    """
    lang = F.col(f"`{lang_col}`") if lang_col else F.lit(None)
    rows = docs.select(carry.alias("carried"), lang.cast("string").alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(f"({_WORD})"), F.lit(1)))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    words_at, codes_at = _tables()
    slot = lambda w: F.pmod(F.xxhash64(w), F.lit(_SLOTS)).cast("int")
    known = F.transform(F.transform("words", F.lower), lambda w: F.when(F.get(words_at, slot(w)) == w, F.get(codes_at, slot(w))).otherwise(F.lit("")))
    rows = rows.select(
        "carried",
        "lang",
        F.size("words").alias("n_words"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        F.length("text").alias("n_chars"),
        lines.alias("lines"),
        *[F.regexp_count("text", F.lit(c)).alias(f"c_{n}") for n, c in CLASSES.items()],
        F.array_join(known, "").alias("known"),
        F.when(F.size("words") > 5, F.transform(F.sequence(F.lit(1), F.size("words") - 4), lambda i: F.xxhash64(F.slice("words", i, 5)))).alias("windows"),
    )
    rows = rows.withColumn("windows", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.col("windows")))
    rows = rows.withColumn("placed", F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    last = F.size("placed") - 1
    twin = lambda i: ((i > 0) & (F.get("placed", i - 1)["h"] == F.get("placed", i)["h"])) | ((i < last) & (F.get("placed", i + 1)["h"] == F.get("placed", i)["h"]))
    rows = rows.withColumn("found", F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), last), twin), lambda i: F.get("placed", i)["i"])))
    steps = F.sequence(F.lit(0), F.size("found") - 2)  # windows found come in twos at least
    covered = F.aggregate(steps, F.lit(5), lambda n, i: n + F.least(F.lit(5), F.get("found", i + 1) - F.get("found", i)))
    counted = [F.col(f"c_{n}").cast("long") for n in CLASSES]
    in_words = reduce(lambda a, b: a + b, counted)
    per_bin = [(F.length("known") - F.length(F.replace("known", F.lit(_code(i))))).cast("long") for i in range(len(BINS))]
    return rows.select(
        "carried",
        "lang",
        F.col("n_words").cast("long"),
        F.col("word_chars").cast("long"),
        F.col("c_symbol").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("found").isNull(), F.lit(0)).otherwise(covered).cast("long").alias("n_repeat_words"),
        F.array(*counted, (F.col("n_chars") - F.col("word_chars")).cast("long"), F.col("word_chars") - in_words).alias("classes"),
        F.array(*per_bin, F.col("n_words") - F.length("known").cast("long")).alias("bins"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def language_references(counts: DataFrame) -> dict[str, dict[str, list[float]]]:
    """Histograms (as shares) by listed language, summed over all documents passing the base rules."""
    sizes = {"classes": len(CLASSES) + 2, "bins": len(BINS) + 1}
    sums = [F.sum(F.get(h, F.lit(i))).alias(f"{h}_{i}") for h, n in sizes.items() for i in range(n)]
    good = counts.where(F.col("lang").isin(*COMMON_WORDS) & ~base_failed())
    out = {}
    for r in good.groupBy("lang").agg(*sums).collect():  # one row per listed language
        out[r["lang"]] = {}
        for h, n in sizes.items():
            total = sum(r[f"{h}_{i}"] for i in range(n))
            out[r["lang"]][h] = [r[f"{h}_{i}"] / total for i in range(n)]
    return out


def distance(counts: Column, share: list[float]) -> Column:
    """Jensen-Shannon distance (0 to 1) between a count array and reference shares."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(F.transform(counts, lambda x: x / total), F.array(*map(F.lit, share)), lambda p, q: part(p, (p + q) / 2) + part(q, (p + q) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2))


def with_verdict(counts: DataFrame, refs: dict[str, dict[str, list[float]]], class_limit: float = CLASS_LIMIT, word_limit: float = WORD_LIMIT, class_min_words: int = CLASS_MIN_WORDS, word_min_words: int = WORD_MIN_WORDS) -> DataFrame:
    """Counts with ``base_failed``, the distances to the nearest reference, and ``kept``."""
    nearest = {}
    for h, least in (("classes", class_min_words), ("bins", word_min_words)):
        ds = [distance(F.col(h), r[h]) for _, r in sorted(refs.items())]
        value = (F.least(*ds) if len(ds) > 1 else ds[0]) if ds else F.lit(None).cast("double")
        nearest[h] = F.when(F.col("n_words") >= max(least, 1), value)
    judged = counts.withColumn("base_failed", base_failed()).withColumn("class_distance", nearest["classes"]).withColumn("word_distance", nearest["bins"])
    diverges = F.coalesce(F.col("class_distance") > class_limit, F.lit(False)) | F.coalesce(F.col("word_distance") > word_limit, F.lit(False))
    return judged.withColumn("kept", ~F.col("base_failed") & ~diverges)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", **limits: float) -> DataFrame:
    """(doc_id, base counts, base_failed, class_distance, word_distance, kept) of every document."""
    docs = keyed(docs, doc_id=id_col, text=text_col, **({"lang": lang_col} if lang_col else {}))
    counts = stored(base_counts(docs, F.col("doc_id"), "text", lang_col and "lang"), "quality-counts")
    judged = with_verdict(counts, language_references(counts), **limits)
    return judged.withColumnRenamed("carried", "doc_id").drop("classes", "bins", "lang")


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang", **limits: float) -> DataFrame:
    """The rows that pass, with all their columns; rows are stored beside their counts, so texts are read once."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    counts = stored(base_counts(docs, row, text_col, lang_col), "quality-rows")
    return with_verdict(counts, language_references(counts), **limits).where("kept").select("carried.*")
