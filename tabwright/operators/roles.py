"""Column roles: metadata that decides which statistics apply, independent of storage type."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tabwright.errors import TableError
from tabwright.functions.names import is_identifier_name
from tabwright.functions.numbers import is_numeric, is_temporal

ROLES = ("numeric", "category", "text", "datetime", "id", "ignore")
CATEGORY_LIMIT = 30
CATEGORY_SHARE = 0.05


def check_roles(columns: Iterable[str], roles: Mapping[str, str] | None) -> None:
    roles = roles or {}
    absent = sorted(set(roles) - set(columns))
    if absent:
        raise TableError(f"roles name columns that do not exist: {absent}")
    wrong = sorted(str(role) for role in roles.values() if role not in ROLES)
    if wrong:
        raise TableError(f"unknown roles: {wrong}")


def role_by_type(name: str, dtype: T.DataType) -> str | None:
    """Role the name or the type settles; None when only the number of distinct values can tell."""
    if is_identifier_name(name):
        return "id"
    if isinstance(dtype, T.BooleanType):
        return "category"
    if is_numeric(dtype):
        return "numeric"
    if is_temporal(dtype):
        return "datetime"
    return None


def role_by_distinct(distinct: int, rows: int) -> str:
    return "category" if distinct <= CATEGORY_LIMIT or distinct / max(rows, 1) < CATEGORY_SHARE else "text"


def roles_after(roles: Mapping[str, str], columns: Iterable[str], steps: Iterable[Mapping]) -> dict[str, str]:
    """Roles on the cleaned table: a cast renews the role unless it is id or ignore."""
    # The role a cast gives.
    by_cast = {"numeric": "numeric", "datetime": "datetime", "string": "text"}
    columns = set(columns)
    result = {name: role for name, role in roles.items() if name in columns}
    for step in steps:
        if step["op"] != "cast":
            continue
        for name in step["columns"]:
            if name in result and result[name] not in ("id", "ignore"):
                result[name] = by_cast.get(step.get("dtype", "numeric"), "text")
    return result
