"""Parts of resource names (F16)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Places of the parts of ``arn:partition:service:region:account:resource``.
PARTS = {"partition": 1, "service": 2, "region": 3, "account": 4}


def arn_part(arn: Column, name: str) -> Column:
    """A part of an ARN; NULL if the text is no ARN of six parts or the part is blank."""
    text = F.trim(arn)
    parts = F.split(text, ":", 6)
    found = F.when(text.startswith("arn:") & (F.size(parts) == 6), F.try_element_at(parts, F.lit(PARTS[name] + 1)))
    return F.nullif(found, F.lit(""))


def account_of(name: Column) -> Column:
    """The account a principal or resource names: twelve digits alone or in an ARN; NULL if none."""
    text = F.trim(name)
    account = F.when(text.startswith("arn:"), arn_part(text, "account")).otherwise(text)
    return F.when(account.rlike("^[0-9]{12}$"), account)
