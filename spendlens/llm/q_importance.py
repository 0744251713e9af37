"""op12: documents drawn towards the benchmark's distribution."""

from .common import table
from .importance import resample
from .registry import query

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# CRC-32 by its byte table, once for every distinct feature
ORACLE = f"""
WITH byte_table AS (SELECT list(v ORDER BY i) AS tab FROM (
  SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) r(i))),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM documents),
b AS (SELECT regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM benchmark),
df AS (SELECT rid, array_to_string(w[i : i + k - 1], ' ') AS f FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN range(1, 4) n(k))),
bf AS (SELECT array_to_string(w[i : i + k - 1], ' ') AS f FROM (SELECT w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b CROSS JOIN range(1, 4) n(k))),
fb AS (SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda x: ('0x' || x)::BIGINT)),
              lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]))) % 10000 AS bucket
       FROM (SELECT f FROM df UNION SELECT f FROM bf) CROSS JOIN byte_table),
s AS (SELECT bucket, count(*) AS n FROM df JOIN fb USING (f) GROUP BY 1),
t AS (SELECT bucket, count(*) AS n FROM bf JOIN fb USING (f) GROUP BY 1),
g AS (SELECT bucket, CAST(floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE)
             / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket)),
w AS (SELECT rid, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM df JOIN fb USING (f) JOIN g USING (bucket) GROUP BY 1),
sc AS (SELECT rid, doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
              coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
       FROM d LEFT JOIN w USING (rid)),
r AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id) AS k, count(*) OVER () AS n FROM sc WHERE n_words >= 20)
SELECT doc_id, n_words, n_features, weight, score, CASE WHEN k <= 5 * n // 100 THEN k END AS rank FROM sc LEFT JOIN r USING (rid)
"""


@query("op12_importance_resampling", ORACLE)
def op12_importance_resampling(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
