"""Deterministic identities: canonical JSON, fingerprint, finding id, action id.

Canonical JSON = keys sorted, no whitespace, UTF-8, NULL -> "". Spark's
``to_json`` over a ``named_struct`` whose fields are listed alphabetically gives
exactly that for strings (quotes, backslash, non-ASCII pass through as Python's
``json.dumps(ensure_ascii=False)``); only control-character escapes differ in
hex case, which ``_fix_hex`` fixes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCOPE_KEYS = (
    "account_id",
    "billing_account_id",
    "cloud",
    "region",
    "resource_arn",
    "resource_id",
    "resource_type",
    "service",
)
# Keys that keep their case (provider ids); all others are lower-cased.
CASE_KEEP = {"resource_id", "resource_arn"}


# Characters Python's str.strip() removes (str.isspace), built from that rule.
PY_WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def py_strip(c: Column) -> Column:
    """Trim exactly the characters Python's ``str.strip()`` trims (not only ASCII spaces).

    A trim by a set of characters walks and copies the whole text; text that begins and ends
    with a visible ASCII character has nothing to trim and is kept as it is.
    """
    last = F.substring(c, -1, 1)
    bare = (c >= "!") & (c < "\x7f") & (last >= "!") & (last < "\x7f")
    return F.when(bare, c).otherwise(F.btrim(c, F.lit(PY_WHITESPACE)))


def norm_str(c: Column | str, lower: bool = True) -> Column:
    """Trim (Python whitespace), optional lower, NULL -> ''."""
    c = F.col(c) if isinstance(c, str) else c
    out = py_strip(F.coalesce(c.cast("string"), F.lit("")))
    return F.lower(out) if lower else out


def canonical_scope(scope: Column) -> Column:
    """Scope key struct (alphabetical fields, canonicalized)."""
    return F.struct(*[norm_str(scope.getField(k), lower=k not in CASE_KEEP).alias(k) for k in SCOPE_KEYS])


def canonical_issue(issue: Column | None) -> Column:
    """Issue key map: keys lower/trim, values trim, entries sorted by key."""
    if issue is None:
        return F.create_map().cast("map<string,string>")
    m = F.coalesce(issue, F.create_map().cast("map<string,string>"))
    normalized = F.transform(
        F.map_entries(m),
        lambda e: F.struct(norm_str(e["key"]).alias("key"), norm_str(e["value"], lower=False).alias("value")),
    )
    return F.map_from_entries(F.array_sort(normalized))


def _fix_hex(js: Column) -> Column:
    # Python writes \u001f, Jackson writes \u001F; only control chars are escaped.
    # A linear chain: the JSON text is referenced once (no duplicated subtree).
    out = js
    for up in "ABCDEF":
        out = F.regexp_replace(out, r"\\u00([01])" + up, r"\\u00$1" + up.lower())
    return out


def canonical_json(struct_col: Column) -> Column:
    """JSON text of a struct whose fields are already in key order."""
    return _fix_hex(F.to_json(struct_col))


def fingerprint_col(tenant_id: Column, check_id: Column, scope: Column, issue: Column | None = None) -> Column:
    """sha256 hex of canonical {check_id, issue, scope, tenant_id}."""
    payload = F.struct(
        norm_str(check_id).alias("check_id"),
        canonical_issue(issue).alias("issue"),
        canonical_scope(scope).alias("scope"),
        norm_str(tenant_id).alias("tenant_id"),
    )
    return F.sha2(canonical_json(payload), 256)


def id_salt_col(mode: str, run_id: Column | None = None, run_ts: Column | None = None) -> Column:
    """X10 salt: stable -> '', per_run -> run_id, per_day -> yyyy-MM-dd of run_ts."""
    if mode == "stable":
        return F.lit("")
    if mode == "per_run":
        return norm_str(run_id, lower=False)
    if mode == "per_day":
        return F.coalesce(F.date_format(run_ts, "yyyy-MM-dd"), F.lit(""))
    raise ValueError(f"unknown id salt mode {mode!r}")


def finding_id_col(tenant_id: Column, fingerprint: Column, salt: Column) -> Column:
    """sha256 hex of canonical {fingerprint, salt, tenant_id}."""
    payload = F.struct(
        norm_str(fingerprint).alias("fingerprint"),
        norm_str(salt, lower=False).alias("salt"),
        norm_str(tenant_id).alias("tenant_id"),
    )
    return F.sha2(canonical_json(payload), 256)


def action_id_col(seed: Column) -> Column:
    """M1: 'act_' + first 24 hex chars of sha256(seed)."""
    return F.concat(F.lit("act_"), F.substring(F.sha2(seed, 256), 1, 24))
