"""Registered vault detectors: lock with storage cost (D50, A22) and access policy."""

from __future__ import annotations

from ..operators.vaults import vault_locks, vault_policies
from ..sources.bind import bound, binding_cte
from .q_detect import _sel
from .registry import query

EXPECTED = dict(expected_min_days=7, expected_max_days=400)
ALLOWED_ACCOUNTS = ("210000000007",)
# the other class has no price row and takes the fixed one
PRICES = [("eu-west-1", "backup_gb_month", "warm", 0.055, "pricing_api")]

_LOCKS = """
v AS (SELECT *, COALESCE(min_days, 0) AS lo, COALESCE(max_days, 0) AS hi FROM vaults),
r AS (SELECT *, CASE WHEN locked IS NULL AND min_days IS NULL AND max_days IS NULL THEN 'missing'
                     WHEN locked = false AND lo = 0 AND hi = 0 THEN 'missing'
                     WHEN hi <= 0 THEN 'no_max' WHEN lo < 7 OR hi > 400 THEN 'out_of_standard' END AS rule FROM v)
"""
_KEYS = "tenant_id, account_id, region, vault_name"


@query(
    "d50_vault_locks",
    oracle=binding_cte("vaults", "recovery_points")
    + ","
    + _LOCKS
    + f""",
held AS (SELECT {_KEYS}, COALESCE(sum(size_gb) FILTER (storage_class <> 'COLD' AND size_gb > 0), 0) AS warm, COALESCE(sum(size_gb) FILTER (storage_class = 'COLD' AND size_gb > 0), 0) AS cold
         FROM recovery_points GROUP BY ALL),
c AS (SELECT r.*, CASE WHEN rule = 'no_max' THEN CAST(COALESCE(warm, 0) * CAST('0.055' AS DECIMAL(12,6)) + COALESCE(cold, 0) * CAST('0.01' AS DECIMAL(12,6)) AS DECIMAL(18,6)) END AS cost,
             CASE WHEN rule = 'no_max' THEN CASE WHEN COALESCE(warm, 0) + COALESCE(cold, 0) = 0 THEN 20 ELSE 70 END END AS conf
      FROM r LEFT JOIN held USING ({_KEYS}))
SELECT """
    + _sel(service="AWSBackup", rtype="backup_vault", rid="vault_name", check="aws.backup.vaults.no.lifecycle", lvl="CASE WHEN rule = 'out_of_standard' THEN 'low' ELSE 'medium' END",
           score="CASE WHEN rule = 'out_of_standard' THEN 40 ELSE 70 END", cost="cost", conf="conf", detail="concat_ws('|', rule, CAST(lo AS VARCHAR), CAST(hi AS VARCHAR))")
    + " FROM c WHERE rule IS NOT NULL",
)
def d50(spark, sf):
    prices = spark.createDataFrame(PRICES, "region string, kind string, key string, unit_price double, source string")
    return vault_locks(bound(spark, sf, "vaults"), bound(spark, sf, "recovery_points"), prices, **EXPECTED)


def _list(json: str) -> str:
    """JSON list of a value that may be a list or single (NULL and JSON null: empty)."""
    return f"CASE json_type({json}) WHEN 'ARRAY' THEN json_extract({json}, '$[*]') WHEN 'NULL' THEN [] ELSE CASE WHEN {json} IS NULL THEN [] ELSE [{json}] END END"


def _text_list(json: str) -> str:
    return f"list_transform(list_filter({_list(json)}, lambda x: json_type(x) <> 'NULL'), lambda x: x->>'$')"


_ORGS = " || ".join(_text_list(f"json_extract(f, '/Condition/{op}/aws:PrincipalOrgID')") for op in ("StringEquals", "StringLike", "ForAnyValue:StringEquals", "ForAnyValue:StringLike"))


@query(
    "d51_vault_policies",
    oracle=binding_cte("vaults")
    + ","
    + _LOCKS
    + f""",
p AS (SELECT *, CASE WHEN policy IS NULL THEN 'no_access_policy' WHEN trim(policy) = '' THEN 'empty_access_policy' WHEN NOT json_valid(policy) THEN 'invalid_policy_json' END AS whole FROM r WHERE rule IS NULL),
docs AS (SELECT {_KEYS}, vault_arn, CAST(policy AS JSON) AS doc FROM p WHERE whole IS NULL),
lists AS (SELECT *, {_list("json_extract(doc, '$.Statement')")} AS sts FROM docs WHERE json_type(doc) = 'OBJECT'),
st AS (SELECT {_KEYS}, vault_arn, unnest(sts) AS f, generate_subscripts(sts, 1) AS pos FROM lists),
a AS (SELECT *, json_extract(f, '$.Principal') AS pr, json_extract(f, '$.Resource') AS rs FROM st
      WHERE json_type(f) = 'OBJECT' AND lower(trim(COALESCE(f->>'$.Effect', ''))) = 'allow'),
b AS (SELECT *, COALESCE(f->>'$.Sid', '') AS sid,
             CASE WHEN json_type(pr) = 'OBJECT' THEN {_text_list("json_extract(pr, '$.AWS')")} ELSE {_text_list("pr")} END AS named,
             list_sort(list_distinct(list_transform({_text_list("json_extract(f, '$.Action')")}, lambda x: lower(trim(x))))) AS acts,
             list_transform({_text_list("rs")}, lambda x: trim(x)) AS res,
             list_filter(list_transform({_ORGS}, lambda x: trim(x)), lambda x: x <> '') AS orgs0 FROM a),
c AS (SELECT *, list_filter(orgs0, lambda x, i: list_position(orgs0, x) = i) AS orgs,
             (json_type(pr) = 'OBJECT' AND list_contains(named, '*')) OR (json_type(pr) = 'VARCHAR' AND pr->>'$' = '*') AS wild,
             list_sort(list_distinct(list_filter(list_transform(named, lambda x: CASE WHEN trim(x) SIMILAR TO '[0-9]{{12}}' THEN trim(x)
                 WHEN starts_with(trim(x), 'arn:') AND len(string_split(trim(x), ':')) >= 6 AND string_split(trim(x), ':')[5] SIMILAR TO '[0-9]{{12}}' THEN string_split(trim(x), ':')[5] END),
                 lambda x: x IS NOT NULL AND x <> account_id AND x <> '210000000007'))) AS accts FROM b),
d AS (SELECT *, len(orgs) > 0 AS org, rs IS NOT NULL AND len(list_filter(res, lambda x: x = '*' OR (x <> '' AND contains(x, vault_arn)))) = 0 AS far,
             CASE WHEN json_type(json_extract(f, '$.NotPrincipal')) <> 'NULL' THEN 'uses_notprincipal' WHEN wild THEN 'wildcard_principal' WHEN len(accts) > 0 THEN 'cross_account_access'
                  WHEN len(acts) > 0 AND len(named) > 0 THEN 'broad_sensitive_actions' END AS fault FROM c),
e AS (SELECT *, CASE fault WHEN 'uses_notprincipal' THEN 20 WHEN 'wildcard_principal' THEN CASE WHEN far AND org THEN 45 WHEN far THEN 65 WHEN org THEN 85 ELSE 95 END
                     WHEN 'cross_account_access' THEN CASE WHEN len(acts) > 0 THEN 80 ELSE 70 END ELSE 65 END AS score FROM d WHERE fault IS NOT NULL),
g AS (SELECT *, row_number() OVER (PARTITION BY {_KEYS} ORDER BY score DESC, CASE fault WHEN 'wildcard_principal' THEN 0 ELSE 1 END, pos) AS n FROM e),
found AS (
  SELECT {_KEYS}, whole AS fault, CASE whole WHEN 'invalid_policy_json' THEN 65 ELSE 40 END AS score, whole || '||||' AS detail FROM p WHERE whole IS NOT NULL
  UNION ALL
  SELECT {_KEYS}, fault, score, fault || '|' || sid || '|' || array_to_string(acts, ',') || '|' || CASE fault WHEN 'cross_account_access' THEN array_to_string(accts, ',') ELSE '' END
         || '|' || CASE fault WHEN 'wildcard_principal' THEN array_to_string(orgs, ',') ELSE '' END FROM g WHERE n = 1)
SELECT """
    + _sel(service="AWSBackup", rtype="backup_vault", rid="vault_name", check="aws.backup.vaults.access.policy.misconfig", status="CASE fault WHEN 'uses_notprincipal' THEN 'info' ELSE 'fail' END",
           lvl="CASE score WHEN 95 THEN 'high' WHEN 85 THEN 'medium' WHEN 80 THEN 'high' WHEN 70 THEN 'medium' WHEN 65 THEN 'medium' ELSE 'low' END", score="score", conf="0", detail="detail")
    + " FROM found",
)
def d51(spark, sf):
    return vault_policies(bound(spark, sf, "vaults"), allowed_accounts=ALLOWED_ACCOUNTS, **EXPECTED)
