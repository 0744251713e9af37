"""Backup vaults: retention lock (D50), storage cost (A22) and access policy (D51, W8), the
anchor signals of the vault risk rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arn import account_of
from ..functions.coerce import MONEY
from ..sources.prices import price_lookup
from .detect import _draft

VAULT = ["tenant_id", "account_id", "region", "vault_name"]

# Prices used without a price row, and the confidence of a looked-up price.
BACKUP_FALLBACK_USD = {"warm": 0.05, "cold": 0.01}
BACKUP_PRICE_CONFIDENCE = 70

# Actions that matter when granted; `*` at the end stands for any rest.
SENSITIVE_ACTIONS = (
    "backup:deletebackupvault",
    "backup:deletebackupvaultaccesspolicy",
    "backup:putbackupvaultaccesspolicy",
    "backup:deletebackupvaultlockconfiguration",
    "backup:putbackupvaultlockconfiguration",
    "backup:deletebackupplan",
    "backup:deletebackupselection",
    "backup:deleterecoverypoint",
    "backup:startrestorejob",
    "backup:copyfrombackupvault",
    "backup:copyintobackupvault",
    "backup:*",
    "*",
)
# Condition operators under which an organisation id restricts a statement.
ORG_OPERATORS = ("StringEquals", "StringLike", "ForAnyValue:StringEquals", "ForAnyValue:StringLike")
ORG_KEY = "aws:PrincipalOrgID"


def lock_rule(expected_min_days: int = 0, expected_max_days: int = 0) -> Column:
    """What is wrong with a vault's retention lock (NULL: nothing); an expectation of 0 is none."""
    low, high = F.coalesce("min_days", F.lit(0)), F.coalesce("max_days", F.lit(0))
    unset = F.col("locked").isNull() & F.col("min_days").isNull() & F.col("max_days").isNull()
    idle = ~F.coalesce("locked", F.lit(True)) & (low == 0) & (high == 0)
    outside = F.lit(False)
    if expected_min_days > 0:
        outside = outside | (low < expected_min_days)
    if expected_max_days > 0:
        outside = outside | (high > expected_max_days)
    return F.when(unset | idle, "missing").when(high <= 0, "no_max").when(outside, "out_of_standard")


def vault_storage_cost(vaults: DataFrame, recovery_points: DataFrame, prices: DataFrame) -> DataFrame:
    """``vaults`` with the monthly ``storage_cost`` of the recovery points they hold and its
    ``storage_confidence``.

    ``recovery_points``: the vault's four keys, storage_class, size_gb. Every class but COLD is
    warm; sizes that are not positive do not count. Points are summed per vault before the join,
    and each class is priced by region (``prices``: region, kind ``backup_gb_month``, key ``warm``
    or ``cold``, unit_price, source). A vault without points costs nothing.
    """
    size = F.when(F.col("size_gb") > 0, F.col("size_gb").cast("decimal(18,2)"))
    cold = F.upper(F.coalesce("storage_class", F.lit(""))) == "COLD"
    held = recovery_points.groupBy(*VAULT).agg(F.sum(F.when(~cold, size)).alias("_warm_gb"), F.sum(F.when(cold, size)).alias("_cold_gb"))
    out = vaults.join(held, VAULT, "left")
    for key in ("warm", "cold"):
        out = price_lookup(out, prices, region=F.col("region"), kind="backup_gb_month", key=F.lit(key), fallback=BACKUP_FALLBACK_USD)
        out = out.withColumnsRenamed({"unit_price": f"_{key}_usd", "price_confidence": f"_{key}_conf"})
    known = lambda key: F.when(F.col(f"_{key}_conf") >= 80, BACKUP_PRICE_CONFIDENCE).otherwise(0)
    part = lambda key: F.coalesce(f"_{key}_gb", F.lit(0)) * F.col(f"_{key}_usd").cast("decimal(12,6)")
    empty = F.coalesce("_warm_gb", F.lit(0)) + F.coalesce("_cold_gb", F.lit(0)) == 0
    return out.withColumns(
        {"storage_cost": (part("warm") + part("cold")).cast(MONEY), "storage_confidence": F.when(empty, 20).otherwise(F.greatest(known("warm"), known("cold")))}
    ).drop("_warm_gb", "_cold_gb", "_warm_usd", "_cold_usd", "_warm_conf", "_cold_conf")


def vault_locks(vaults: DataFrame, recovery_points: DataFrame, prices: DataFrame, *, expected_min_days: int = 0, expected_max_days: int = 0) -> DataFrame:
    """Vaults whose lock is missing or without effect, has no longest retention (with what
    their points cost a month), or lies outside the expected retention.

    ``vaults``: tenant_id, account_id, region, vault_name, locked, min_days, max_days (NULL:
    not set).
    """
    v = vaults.withColumn("rule", lock_rule(expected_min_days, expected_max_days)).where(F.col("rule").isNotNull())
    v = vault_storage_cost(v, recovery_points, prices)
    mild, endless = F.col("rule") == "out_of_standard", F.col("rule") == "no_max"
    days = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    return _draft(
        v, service=F.lit("AWSBackup"), resource_type=F.lit("backup_vault"), resource_id=F.col("vault_name"), check_id=F.lit("aws.backup.vaults.no.lifecycle"),
        severity_level=F.when(mild, "low").otherwise("medium"), severity_score=F.when(mild, 40).otherwise(70),
        monthly_cost=F.when(endless, F.col("storage_cost")), confidence=F.when(endless, F.col("storage_confidence")).cast("int"),
        detail=F.concat_ws("|", "rule", days("min_days"), days("max_days")),
    )


def strip(c: Column) -> Column:
    """Text without white space (any kind) at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


# -- access policies ------------------------------------------------------------


def _field(fields: Column, name: str) -> Column:
    """A member of an object (map of VARIANT); JSON null counts as absent."""
    v = F.try_element_at(fields, F.lit(name))
    return F.when(~F.is_variant_null(v), v)


def _fields(v: Column) -> Column:
    """The members of a VARIANT object; NULL if it is none."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def _items(v: Column) -> Column:
    """The elements of a VARIANT list; a scalar or object is a list of itself; nulls are dropped."""
    listed = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))
    return F.filter(listed, lambda x: x.isNotNull() & ~F.is_variant_null(x))


def _texts(v: Column) -> Column:
    return F.transform(_items(v), lambda x: F.try_variant_get(x, "$", "string"))


def _granted(actions: Column, patterns: Sequence[str]) -> Column:
    """Whether any action equals a pattern or starts with one that ends in ``*``."""
    whole = [p for p in patterns if not p.endswith("*")]
    return F.exists(actions, lambda a: a.isin(*whole) | F.array_contains(F.array(*[a.startswith(p[:-1]) for p in patterns if p.endswith("*")] or [F.lit(False)]), True))


def policy_statements(vaults: DataFrame) -> DataFrame:
    """The Allow statements of all parsable policies: one row each, its parts as columns.

    ``vaults``: the four keys, vault_arn, policy (JSON text). Statement, Principal, Action and
    Resource may each be a list or one value. Adds position, sid, not_principal, wildcard,
    principals, actions, resources (NULL: absent), org_ids.
    """
    doc = vaults.withColumn("_doc", _fields(F.try_parse_json("policy")))
    st = doc.select(*vaults.columns, F.posexplode(_items(_field(F.col("_doc"), "Statement"))).alias("position", "_st")).withColumn("_f", _fields(F.col("_st")))
    get = lambda name: _field(F.col("_f"), name)
    allow = F.lower(strip(F.coalesce(F.try_variant_get(get("Effect"), "$", "string"), F.lit("")))) == "allow"
    st = st.where(F.col("_f").isNotNull() & allow).withColumns({"_p": get("Principal"), "_c": _fields(get("Condition"))})
    st = st.withColumn("_named", _fields(F.col("_p")))
    aws = _texts(_field(F.col("_named"), "AWS"))
    orgs = F.flatten(F.array(*[_texts(_field(_fields(_field(F.col("_c"), op)), ORG_KEY)) for op in ORG_OPERATORS]))
    orgs = F.array_distinct(F.filter(F.transform(orgs, strip), lambda x: x != ""))
    return st.select(
        *vaults.columns,
        "position",
        F.coalesce(F.try_variant_get(get("Sid"), "$", "string"), F.lit("")).alias("sid"),
        get("NotPrincipal").isNotNull().alias("not_principal"),
        F.coalesce(F.when(F.col("_named").isNotNull(), F.array_contains(aws, "*")).otherwise(F.try_variant_get("_p", "$", "string") == "*"), F.lit(False)).alias("wildcard"),
        F.when(F.col("_named").isNotNull(), aws).otherwise(_texts(F.col("_p"))).alias("principals"),
        F.array_sort(F.array_distinct(F.transform(_texts(get("Action")), lambda a: F.lower(strip(a))))).alias("actions"),
        F.when(get("Resource").isNotNull(), F.transform(_texts(get("Resource")), strip)).alias("resources"),
        F.coalesce(orgs, F.array().cast("array<string>")).alias("org_ids"),
    )


def vault_policies(
    vaults: DataFrame, *, allowed_accounts: Sequence[str] = (), sensitive: Sequence[str] = SENSITIVE_ACTIONS, expected_min_days: int = 0, expected_max_days: int = 0
) -> DataFrame:
    """The worst fault of each vault's access policy (W8), for vaults whose lock passes D50.

    No policy, an empty one and one that is no JSON are faults of the whole document. Else
    every Allow statement is judged: NotPrincipal (not interpreted, information only); any
    principal (milder with an organisation id, or when its resources leave the vault out);
    principals of accounts that are neither the vault's nor allowed; sensitive actions. The
    highest score wins, then any principal, then the first statement. With the default
    patterns, which end in ``*``, every action is sensitive.
    """
    v = vaults.where(lock_rule(expected_min_days, expected_max_days).isNull()).select(*VAULT, "vault_arn", "policy")
    blank = strip(F.col("policy")) == ""
    whole = F.when(F.col("policy").isNull(), "no_access_policy").when(blank, "empty_access_policy").when(F.try_parse_json("policy").isNull(), "invalid_policy_json")
    none = F.lit("")
    documents = v.withColumn("rule", whole).where(F.col("rule").isNotNull()).select(
        *VAULT, "rule", F.when(F.col("rule") == "invalid_policy_json", 65).otherwise(40).alias("score"), none.alias("sid"), none.alias("actions"), none.alias("accounts"), none.alias("org_ids")
    )
    st = policy_statements(v)
    accounts = F.filter(F.transform("principals", account_of), lambda a: a.isNotNull() & (a != F.col("account_id")) & ~a.isin(*(allowed_accounts or [""])))
    st = st.withColumns({"accounts": F.array_sort(F.array_distinct(accounts)), "sensitive": _granted(F.col("actions"), sensitive)})
    arn = F.col("vault_arn")
    named = F.exists("resources", lambda r: (r == "*") | ((r != "") & (arn != "") & r.contains(arn)))
    elsewhere = F.col("resources").isNotNull() & ~F.coalesce(named, F.lit(False))
    org = F.size("org_ids") > 0
    rule = (
        F.when(F.col("not_principal"), "uses_notprincipal")
        .when(F.col("wildcard"), "wildcard_principal")
        .when(F.size("accounts") > 0, "cross_account_access")
        .when(F.col("sensitive") & (F.size("principals") > 0), "broad_sensitive_actions")
    )
    score = (
        F.when(F.col("rule") == "uses_notprincipal", 20)
        .when(F.col("rule") == "wildcard_principal", F.when(elsewhere & org, 45).when(elsewhere, 65).when(org, 85).otherwise(95))
        .when(F.col("rule") == "cross_account_access", F.when(F.col("sensitive"), 80).otherwise(70))
        .otherwise(65)
    )
    st = st.withColumn("rule", rule).where(F.col("rule").isNotNull()).withColumn("score", score)
    worst = Window.partitionBy(*VAULT).orderBy(F.col("score").desc(), (F.col("rule") == "wildcard_principal").desc(), "position")
    judged = st.withColumn("_n", F.row_number().over(worst)).where(F.col("_n") == 1).select(
        *VAULT, "rule", "score", "sid", F.array_join("actions", ",").alias("actions"),
        F.when(F.col("rule") == "cross_account_access", F.array_join("accounts", ",")).otherwise("").alias("accounts"),
        F.when(F.col("rule") == "wildcard_principal", F.array_join("org_ids", ",")).otherwise("").alias("org_ids"),
    )
    f = documents.unionByName(judged)
    level = F.when((F.col("rule") == "wildcard_principal") & (F.col("score") == 85), "medium").when(F.col("score") >= 80, "high").when(F.col("score") >= 65, "medium").otherwise("low")
    return _draft(
        f, service=F.lit("AWSBackup"), resource_type=F.lit("backup_vault"), resource_id=F.col("vault_name"), check_id=F.lit("aws.backup.vaults.access.policy.misconfig"),
        status=F.when(F.col("rule") == "uses_notprincipal", "info").otherwise("fail"), severity_level=level, severity_score=F.col("score"),
        confidence=F.lit(0), detail=F.concat_ws("|", "rule", "sid", "actions", "accounts", "org_ids"),
    )
