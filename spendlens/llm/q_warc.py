"""op6: all pages through WARC archives and their capture index."""

from .common import table
from .registry import query
from .warc import archive_round_trip

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_GROUP = "CAST('0x' || substr(h, {at}, 5) AS INTEGER)"
_BASE32 = " || ".join(f"substr('{_ALPHABET}', 1 + ({_GROUP.format(at=1 + 5 * g)} >> {shift}) % 32, 1)" for g in range(8) for shift in (15, 10, 5, 0))

ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS first_id FROM p)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM g
"""


@query("op6_warc_capture_index", ORACLE)
def op6_warc_capture_index(spark, sf_dir):
    read = archive_round_trip(table(spark, sf_dir, "pages"), revisit_from=0)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
