"""Everything a before/after report shows, as tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tabwright.operators.charts import comparison_table, report_tables
from tabwright.operators.profile import Profile, compare_profiles
from tabwright.operators.roles import roles_after
from tabwright.plans.pipeline import CleaningResult


@dataclass
class Report:
    before: Profile
    after: Profile
    tables: dict[str, dict[str, DataFrame]]
    log: list[dict]

    @property
    def comparison(self) -> list[dict]:
        return compare_profiles(self.before, self.after)


def report(original: DataFrame, result: CleaningResult) -> Report:
    """Profiles of both versions, their chart tables, and shared-edge histograms of numeric columns."""
    before = Profile(original, result.config.get("roles"))
    later_roles = roles_after(before.roles, result.df.columns, result.config.get("steps", []))
    after = Profile(result.df, later_roles)
    tables = {"before": report_tables(before), "after": report_tables(after), "comparison": {}}
    shared = comparison_table(before, after)
    if shared is not None:
        tables["comparison"]["numeric"] = shared
    return Report(before, after, tables, result.log)
