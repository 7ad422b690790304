"""Names of datasets, tables and their columns."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class TableSpec:
    """A table of files: one column names the content, the ordered key columns name the row."""

    name: str
    keys: tuple[str, ...]
    file_column: str = "file_key"

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.file_column, *self.keys)


@dataclass(frozen=True)
class DatasetSpec:
    name: str
    tables: tuple[TableSpec, ...] = field(default=())

    def table(self, name: str) -> TableSpec:
        return next(t for t in self.tables if t.name == name)


#: Tables of crawled data.
CRAWL = DatasetSpec("crawl", (TableSpec("submissions", ("source", "id", "updated", "part")), TableSpec("metadata", ("source", "id", "updated")), TableSpec("posts", ("source", "id", "updated"))))
