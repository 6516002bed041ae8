"""A case: the evidence tables and the views over them.

Each view is a method that gives a DataFrame; a view that is used by several others is planned once. What the
reference's users know as consolidated tables (groups, facts, attribution, timeline) is written to the shared folder,
so plans stay short and a lost executor costs a re-read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vestige.operators.staging import dropped, table_in_shared_folder


class Views:
    """Evidence tables by name: of(name) gives each."""

    def __init__(self, of: Callable[[str], DataFrame]):
        self._of = of
        self._made: dict[str, DataFrame] = {}
        self._written: list[str] = []

    def close(self) -> None:
        """Delete the consolidated tables; what was planned on them can't run any more."""
        for df in self._made.values():
            for path in self._written:
                dropped(df.sparkSession, path)
            break
        self._made, self._written = {}, []

    def table(self, name: str) -> DataFrame:
        if (key := f"table {name}") not in self._made:
            self._made[key] = self._of(name)
        return self._made[key]


def view(make: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    @wraps(make)
    def once(self: Views) -> DataFrame:
        if make.__name__ not in self._made:
            self._made[make.__name__] = make(self)
        return self._made[make.__name__]

    return once


def consolidated(make: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    """A view that is written out."""

    @view
    @wraps(make)
    def written(self: Views) -> DataFrame:
        return table_in_shared_folder(make(self), self._written)

    return written


def with_source(df: DataFrame, source: DataFrame, **columns: str) -> DataFrame:
    """df with columns of its source, by new name: source_path='path', source_sha256='sha256'."""
    s = source.select(F.col("id").alias("source_id"), *[F.col(c).alias(name) for name, c in columns.items()])
    return df.join(s, "source_id", "left")


def listed(value: Column | str, separator: str) -> Column:
    """The distinct values in order, null for none."""
    values = F.array_sort(F.collect_set(value))
    return F.when(F.size(values) > 0, F.array_join(values, separator))


def listed_by(value: Column, separator: str, *order: Column) -> Column:
    """All values, in this order."""
    rows = F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)], value.alias("v"))))
    return F.when(F.size(rows) > 0, F.array_join(F.transform(rows, lambda r: r.v), separator))


def said(column: Column | str) -> Column:
    """Null where the text is empty."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c != "", c)
