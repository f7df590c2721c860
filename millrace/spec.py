"""Descriptions of keyed tables: which columns make up a key, and how it is ordered."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class KeySpec:
    """A key's columns; the first ``group`` of them select a group, the rest order the rows within it."""

    columns: tuple[str, ...]
    group: int = 0
    descending: frozenset[str] = frozenset()

    @property
    def group_columns(self) -> tuple[str, ...]:
        return self.columns[: self.group]

    @property
    def order_columns(self) -> tuple[str, ...]:
        return self.columns[self.group :]


@dataclass(frozen=True)
class TableSpec:
    """A keyed table; key 0 is the primary key and never changes, ``mutable`` columns may."""

    name: str
    keys: tuple[KeySpec, ...]
    mutable: tuple[str, ...] = ()
    defaults: dict[str, object] = field(default_factory=dict)

    @property
    def primary(self) -> tuple[str, ...]:
        return self.keys[0].columns
