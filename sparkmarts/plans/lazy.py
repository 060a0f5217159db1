"""A read-only mapping whose DataFrames are defined on first access.

Defining a DataFrame costs driver-side analysis (every projection is resolved against the
catalog), so a query that needs two raw tables should not pay for eleven.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame


class LazyFrames(Mapping[str, DataFrame]):
    """Mapping name -> DataFrame, each built once by its factory when first read."""

    def __init__(self, factories: Mapping[str, Callable[[], DataFrame]]):
        self._factories = dict(factories)
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._factories[name]()
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._factories)

    def __len__(self) -> int:
        return len(self._factories)
