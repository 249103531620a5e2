"""Physical plans as text, for tests of what is shuffled and where."""

from __future__ import annotations

import re


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def partitionings(df) -> list[str]:
    """What the shuffles of a plan partition by, column ids left out."""
    return [re.sub(r"#\d+L?", "", found) for found in re.findall(r"Exchange (\S+\(.*?\))", plan(df))]
