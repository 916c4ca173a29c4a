"""Task definitions: which entity is predicted, from which tables, up to which time."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

from hindcast.fixed_values import FALLBACK_TABLES, MAX_EVIDENCE_TABLES
from hindcast.functions.columns import kind_of


@dataclass(frozen=True)
class IdRule:
    """Which columns are ids, and the name two tables must share to be related."""

    suffix: str = "_id"
    strip_prefix: bool = False

    def logical(self, column: str) -> str:
        return column.split("_", 1)[1] if self.strip_prefix and "_" in column else column

    def is_id(self, column: str) -> bool:
        return self.logical(column).endswith(self.suffix)


STAR_RULE = IdRule(suffix="key", strip_prefix=True)


@dataclass(frozen=True)
class Task:
    dataset: str
    name: str
    tables: tuple[str, ...]
    entity_table: str
    lookup_column: str
    target_column: str
    task_type: str
    candidate_tables: tuple[str, ...]
    expected_evidence: tuple[str, ...]
    question_template: str | None = None
    label_column: str = "status"
    priority_tables: tuple[str, ...] = ("payments",)
    id_rule: IdRule = IdRule()
    time_columns: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.question_template and "{" + self.target_column + "}" in self.question_template:
            raise ValueError(f"the question template of {self.name} shows its target {self.target_column}")


def expected_evidence_of(task_name: str, entity_table: str, entity_column: str) -> tuple[str, ...]:
    """The words of the task name, then table and column; only the first mention of each counts."""
    named: list[str] = []
    for item in (*re.split("[-_]", task_name), entity_table, entity_column):
        if item not in named:
            named.append(item)
    return tuple(named)


def candidate_tables_of(
    entity_table: str,
    entity_column: str,
    schemas: dict[str, T.StructType],
    foreign_keys: dict[str, dict[str, str]] | None = None,
    id_rule: IdRule = IdRule(),
) -> tuple[str, ...]:
    """The entity table, then the tables with the entity column or a foreign key to the entity table."""
    related = [
        name
        for name, schema in schemas.items()
        if name != entity_table
        and (
            entity_column in {id_rule.logical(c) for c in schema.names}
            or entity_table in (foreign_keys or {}).get(name, {}).values()
        )
    ]
    return (entity_table, *related)


@dataclass(frozen=True)
class TableRole:
    """How one table serves a task: its position, cutoff column and entity column (either may be absent)."""

    table: str
    ordinal: int
    time_column: str | None
    key_column: str | None


def table_role(task: Task, table: str, ordinal: int, schema: T.StructType) -> TableRole:
    temporal = [f.name for f in schema.fields if kind_of(f.dataType) == "temporal"]
    keys = [
        f.name
        for f in schema.fields
        if task.id_rule.is_id(f.name) and task.id_rule.logical(f.name) == task.lookup_column
    ]
    time_column = task.time_columns.get(table, temporal[0] if temporal else None)
    return TableRole(table, ordinal, time_column, keys[0] if keys else None)


def relevant_tables(task: Task, schemas: dict[str, T.StructType]) -> list[TableRole]:
    """Candidate tables in name order, at most five; without any, the first three tables of the dataset."""
    names = sorted(n for n in schemas if n in task.tables)
    chosen = [n for n in names if n in task.candidate_tables] or names[:FALLBACK_TABLES]
    return [table_role(task, n, i, schemas[n]) for i, n in enumerate(chosen[:MAX_EVIDENCE_TABLES])]
