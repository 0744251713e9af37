"""op1: every page's url against host rules and a list of canonical URLs."""

from pyspark.sql import functions as F

from .common import table
from .registry import query
from .url_filter import canonical, filter_urls, host_of, path_of

#: fixed rules of the query: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: hosts with such a label feed the list of blocked URLs
LISTED_LABELS = ["ads-track", "casino-win", "cheap-pills"]

_REST = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
ORACLE = f"""
WITH u AS (SELECT page_id, {_REST} AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\\.|:(80|443)$', '', 'g') || regexp_replace(path, '/(index\\.html?)?$', '') END AS canonical FROM h),
listed AS (SELECT DISTINCT canonical FROM c WHERE list_has_any(string_split(host, '.'), {LISTED_LABELS!r})),
j AS (SELECT c.*, l.canonical IS NOT NULL AS listed,
      CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
           WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
           WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
           WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
      FROM c LEFT JOIN listed l USING (canonical))
SELECT page_id, host, path, rule,
       CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow'
                 ELSE CASE WHEN listed THEN 'block' ELSE 'allow' END END AS verdict,
       canonical, listed
FROM j
"""


@query("op1_url_filter", ORACLE)
def op1_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    host = host_of(F.col("url"))
    feed = pages.where(F.arrays_overlap(F.split(host, r"\."), F.array(*map(F.lit, LISTED_LABELS))))
    return filter_urls(pages, feed.select(canonical(host, path_of(F.col("url"))).alias("url")), RULES)
