"""A relational database as DataFrames: declared keys, column roles and event times."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame


class Role(str, Enum):
    NUMERICAL = "Numerical"
    CATEGORICAL = "Categorical"
    TIMESTAMP = "Timestamp"
    PRIMARY_KEY = "PrimaryKey"
    FOREIGN_KEY = "ForeignKey"
    LABEL = "Label"
    IGNORE = "Ignore"


class TaskType(str, Enum):
    BINARY = "binary"
    MULTICLASS = "multiclass"
    REGRESSION = "regression"
    RANKING = "ranking"

    @classmethod
    def parse(cls, name: str) -> TaskType:
        """By name, whatever its case, hyphens and underscores."""
        plain = name.lower().replace("-", "").replace("_", "")
        for t in cls:
            if plain in (t.value, f"{t.value}classification"):
                return t
        raise ValueError(f"unknown task type: {name}")


@dataclass(frozen=True)
class ForeignKey:
    """``table.column`` holds keys of ``target``."""

    table: str
    column: str
    target: str


@dataclass
class TableSpec:
    name: str
    roles: dict[str, Role] = field(default_factory=dict)
    targets: dict[str, str] = field(default_factory=dict)
    time_column: str | None = None
    file: str | None = None

    @property
    def primary_key(self) -> str | None:
        return next((c for c, r in self.roles.items() if r is Role.PRIMARY_KEY), None)

    def columns(self, role: Role) -> list[str]:
        return [c for c, r in self.roles.items() if r is role]


@dataclass
class DatabaseSpec:
    tables: list[TableSpec]
    seed_table: str

    @classmethod
    def from_json(cls, text: str) -> DatabaseSpec:
        raw = json.loads(text)
        tables = []
        for t in raw["tables"]:
            spec = TableSpec(t["name"], time_column=t.get("time_column"), file=t.get("file"))
            for c in t["columns"]:
                role = c["role"]
                if isinstance(role, dict):
                    spec.targets[c["name"]] = role["ForeignKey"]
                    role = "ForeignKey"
                spec.roles[c["name"]] = Role(role)
            tables.append(spec)
        return cls(tables, raw["seed_table"])

    def to_json(self) -> str:
        role = lambda t, c, r: {"ForeignKey": t.targets[c]} if r is Role.FOREIGN_KEY else r.value
        tables = [{"name": t.name, "file": t.file, "time_column": t.time_column, "columns": [{"name": c, "role": role(t, c, r)} for c, r in t.roles.items()]} for t in self.tables]
        return json.dumps({"tables": tables, "seed_table": self.seed_table}, indent=2)


@dataclass
class RelationalDB:
    """Tables in a fixed order, which also orders their nodes; keys maps a table to its primary key and
    times a table to its event-time column, in seconds."""

    name: str
    tables: dict[str, DataFrame]
    foreign_keys: list[ForeignKey]
    keys: dict[str, str]
    times: dict[str, str] = field(default_factory=dict)

    def check(self) -> None:
        """Raises on a foreign key whose table, column or target is missing, or a target without a key."""
        for fk in self.foreign_keys:
            if fk.table not in self.tables or fk.target not in self.tables:
                raise ValueError(f"foreign key {fk} names a table that is missing")
            if fk.column not in self.tables[fk.table].columns:
                raise ValueError(f"foreign key {fk}: no such column")
            if fk.target not in self.keys:
                raise ValueError(f"foreign key {fk}: {fk.target} has no primary key")

    def upto(self, at: float) -> RelationalDB:
        """Rows known at a time; tables without event times stay whole."""
        cut = {n: d.where(d[self.times[n]] <= at) if n in self.times else d for n, d in self.tables.items()}
        return RelationalDB(self.name, cut, self.foreign_keys, self.keys, self.times)

    def since(self, at: float) -> RelationalDB:
        cut = {n: d.where(d[self.times[n]] >= at) if n in self.times else d for n, d in self.tables.items()}
        return RelationalDB(self.name, cut, self.foreign_keys, self.keys, self.times)
