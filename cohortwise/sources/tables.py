"""The eight input tables, handed out column by column."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

TABLES = [
    "courses", "groups", "students", "grades",
    "attendance", "concepts", "engagement", "submissions",
]

Provider = Callable[[tuple[str, ...]], DataFrame]


class CohortTables:
    """Named tables; a report asks for a table together with the columns it reads.

    A provider that assembles a table from several files can then leave out the
    joins whose columns nobody asked for.
    """

    def __init__(self, providers: Mapping[str, Provider]):
        self._providers = dict(providers)

    @classmethod
    def from_frames(cls, frames: Mapping[str, DataFrame]) -> CohortTables:
        def provider(df: DataFrame) -> Provider:
            return lambda columns: df.select(*columns) if columns else df

        return cls({name: provider(df) for name, df in frames.items()})

    def get(self, name: str, *columns: str) -> DataFrame:
        """The named columns of a table, or all of them when none are named."""
        df = self._providers[name](columns)
        return df.select(*columns) if columns else df

    def has(self, name: str) -> bool:
        return name in self._providers

    def with_providers(self, more: Mapping[str, Provider]) -> CohortTables:
        """The same tables and more, or some replaced, each assembled when it is asked for."""
        return CohortTables(self._providers | dict(more))

    def with_table(self, name: str, df: DataFrame) -> CohortTables:
        """The same tables and one more, or one replaced."""
        more = CohortTables.from_frames({name: df})
        return CohortTables(self._providers | more._providers)
