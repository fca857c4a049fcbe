"""Results kept by key, with tags and a time to live. What is kept is a persisted DataFrame, its registry on the driver.

A cache that is bound to a catalog drops what is tagged with a table's name when that table is written.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from tessella.sources.catalog import Catalog

#: Seconds of each unit.
UNITS = {"ms": 0.001, "s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def duration(text: str | float) -> float:
    """Seconds of ``90``, ``"30s"``, ``"5m"``, ``"2h"``, ``"1d"`` or ``"1w"``."""
    if not isinstance(text, str):
        return float(text)
    m = re.fullmatch(r"(\d+(?:\.\d+)?)\s*(ms|s|m|h|d|w)", text.strip())
    if not m:
        raise ValueError(f"not a duration: {text!r}")
    return float(m[1]) * UNITS[m[2]]


class QueryCache:
    def __init__(self, clock: Callable[[], float] = time.time, tenant: str | None = None, ttl: str | float = "1h") -> None:
        self.clock, self.tenant, self.ttl = clock, tenant, ttl
        self._kept: dict[str, tuple[float, frozenset[str], DataFrame]] = {}

    def bind(self, catalog: Catalog) -> QueryCache:
        """Drop what is tagged with a table's name, each time the catalog is given another snapshot of it."""
        catalog.listeners.append(lambda name: self.invalidate_tags(name))
        return self

    def _key(self, key: str) -> str:
        return f"{self.tenant}:{key}" if self.tenant else key

    def get(self, key: str, make: Callable[[], DataFrame], ttl: str | float | None = None, tags: tuple[str, ...] = ()) -> DataFrame:
        """What is kept under the key, unless it is too old; else what ``make`` gives, kept from now on."""
        k = self._key(key)
        if k in self._kept and self._kept[k][0] > self.clock():
            return self._kept[k][2]
        self.invalidate(key)
        frame = make().persist()
        self._kept[k] = (self.clock() + duration(self.ttl if ttl is None else ttl), frozenset(tags), frame)
        return frame

    def invalidate(self, key: str) -> None:
        if found := self._kept.pop(self._key(key), None):
            found[2].unpersist()

    def invalidate_tags(self, *tags: str) -> int:
        """Also called, with a table's name, when a table of a bound catalog is written."""
        return self._drop([k for k, (_, own, _) in self._kept.items() if own & set(tags)])

    def invalidate_prefix(self, prefix: str) -> int:
        return self._drop([k for k in self._kept if k.startswith(self._key(prefix))])

    def _drop(self, keys: list[str]) -> int:
        for k in keys:
            self._kept.pop(k)[2].unpersist()
        return len(keys)
