"""Access control. Every predicate is applied before statistics or scores are computed, so those depend on the principal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLE = r"^[A-Za-z0-9_.:-]{1,64}$"
DOCUMENT_ID = r"^[A-Za-z0-9_.:-]{1,128}$"


def may_read(principal: list[str], tenant: str | None = None, owner: str = "tenant_id") -> Column:
    """Active, a role in common, and the tenant; no roles: nothing."""
    if not principal:
        return F.lit(False)
    ok = (F.col("status") == "active") & F.arrays_overlap("allowed_roles", F.array(*[F.lit(r) for r in principal]))
    return ok if tenant is None else ok & (F.col(owner) == tenant)


def authorized(docs: DataFrame, principal: list[str], tenant: str | None = None) -> DataFrame:
    for r in principal:
        check_role(r)
    return docs.where(may_read(principal, tenant))


def check_role(role: str) -> None:
    import re

    if not re.fullmatch(ROLE, role):
        raise ValueError(f"not a role: {role!r}")


def restricted_ids(docs: DataFrame, principal: list[str]) -> DataFrame:
    """Ids of all documents the principal may not read."""
    return docs.select("document_id").join(authorized(docs, principal).select("document_id"), "document_id", "left_anti")


def encoded_roles(roles: Column) -> Column:
    """|a|b| with sorted roles."""
    return F.concat(F.lit("|"), F.array_join(F.array_sort(roles), "|"), F.lit("|"))


def encoded_keys(roles: Column) -> Column:
    """The same with each role in hexadecimal, so no character of a role has a meaning in a pattern."""
    return F.concat(F.lit("|"), F.array_join(F.transform(F.array_sort(roles), lambda r: F.lower(F.hex(F.encode(r, "utf-8")))), "|"), F.lit("|"))


def among(rows: DataFrame, allowed: DataFrame, key: str = "document_id") -> DataFrame:
    """Candidate allow-list: a semi-join, so an empty list leaves nothing."""
    return rows.join(allowed.select(key).distinct(), key, "left_semi")
