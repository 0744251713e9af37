"""op4: quality rules over every whole text."""

from .common import table
from .quality_rules import BINS, CLASS_LIMIT, CLASS_MIN_WORDS, CLASSES, COMMON_WORDS, WORD_LIMIT, WORD_MIN_WORDS, quality_rules
from .registry import query


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_WORD = r"[^\x20\x09-\x0D]+"
_CLASS_COUNTS = [f"len(regexp_extract_all(t, {_sql_list([c])[1:-1]}))" for c in CLASSES.values()]
_JS = "sqrt(greatest(0, list_sum(list_transform(range(1, len(r.{h}) + 1), lambda i: {a} + {b})) / 2))"


def _distance(h: str) -> str:
    p, q = f"(c.{h}[i] / list_sum(c.{h}))", f"(r.{h}[i] / list_sum(r.{h}))"
    part = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({p} + {q}) / 2)) ELSE 0 END"
    return _JS.format(h=h, a=part(p), b=part(q))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
win AS (SELECT rid, i, array_to_string(ws[i : i + 4], ' ') AS w FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)),
twice AS (SELECT rid, w FROM win GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, unnest(range(i, i + 5)) AS p FROM win JOIN twice USING (rid, w)) GROUP BY 1),
c AS (SELECT rid, doc_id, lang, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
             length(t) AS n_chars, [{", ".join(_CLASS_COUNTS)}] AS cls,
             list_transform({_sql_list(BINS)}, lambda b: len(list_filter(ws, lambda x: lower(x) = b))) AS known
      FROM d),
f AS (SELECT c.rid, doc_id, lang, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
             list_concat(cls, [n_chars - word_chars, word_chars - list_sum(cls)]) AS classes, list_append(known, n_words - list_sum(known)) AS bins
      FROM c LEFT JOIN rep USING (rid)),
g AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
sums AS (SELECT lang, 'classes' AS h, i, sum(classes[i]) AS s FROM (SELECT *, unnest(range(1, len(classes) + 1)) AS i FROM g WHERE NOT base_failed AND lang IN {tuple(COMMON_WORDS)!r}) GROUP BY ALL
         UNION ALL
         SELECT lang, 'bins', i, sum(bins[i]) FROM (SELECT *, unnest(range(1, len(bins) + 1)) AS i FROM g WHERE NOT base_failed AND lang IN {tuple(COMMON_WORDS)!r}) GROUP BY ALL),
r AS (SELECT lang, list(s ORDER BY i) FILTER (h = 'classes') AS classes, list(s ORDER BY i) FILTER (h = 'bins') AS bins FROM sums GROUP BY 1),
near AS (SELECT c.rid, c.n_words, min({_distance("classes")}) AS cd, min({_distance("bins")}) AS wd FROM g c CROSS JOIN r WHERE c.n_words >= {min(CLASS_MIN_WORDS, WORD_MIN_WORDS)} GROUP BY ALL)
SELECT doc_id, g.n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(cd > {CLASS_LIMIT} AND g.n_words >= {CLASS_MIN_WORDS}, false) AND NOT coalesce(wd > {WORD_LIMIT} AND g.n_words >= {WORD_MIN_WORDS}, false) AS kept
FROM g LEFT JOIN near USING (rid)
"""


@query("op4_quality_rules", ORACLE)
def op4_quality_rules(spark, sf_dir):
    judged = quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
