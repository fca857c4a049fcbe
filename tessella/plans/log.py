"""What queries did: interceptors around them, and a log of plans and times."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from tessella.plans.query import Select

#: Takes a query's name, its DataFrame and what runs it; returns the result.
Interceptor = Callable[[str, DataFrame, Callable[[DataFrame], Any]], Any]


@dataclass
class Entry:
    name: str
    plan: str
    seconds: float
    error: str | None = None


@dataclass
class QueryRunner:
    """Runs queries through interceptors, the first outermost, and keeps a log."""

    interceptors: list[Interceptor] = field(default_factory=list)
    log: list[Entry] = field(default_factory=list)

    def run(self, name: str, query: Select | DataFrame, action: Callable[[DataFrame], Any] = DataFrame.collect) -> Any:
        frame = query.to_df() if isinstance(query, Select) else query
        step = action
        for i in reversed(self.interceptors):
            step = (lambda f, after, own: lambda df: f(own, df, after))(i, step, name)
        began = time.perf_counter()
        try:
            out = step(frame)
        except Exception as e:
            self.log.append(Entry(name, explained(frame), time.perf_counter() - began, str(e)))
            raise
        self.log.append(Entry(name, explained(frame), time.perf_counter() - began))
        return out


def explained(query: Select | DataFrame) -> str:
    """The physical plan as text."""
    frame = query.to_df() if isinstance(query, Select) else query
    return frame._jdf.queryExecution().executedPlan().toString()
