"""Statements that bring a live table outside to a schema version: steps of a plan by dialect."""

from __future__ import annotations

from tidemark.operators.schema import Step, Version

DIALECTS = ("spark", "postgres", "mysql")
NOTE = "deprecated, to be dropped"


def quoted(name: str, dialect: str) -> str:
    mark = '"' if dialect == "postgres" else "`"
    return ".".join(mark + part.replace(mark, 2 * mark) + mark for part in name.split("."))


def create_table(table: str, version: Version, dialect: str = "spark") -> str:
    """The table with its columns, what must hold a value, and its key where the dialect has keys."""
    _known(dialect)
    q = lambda n: quoted(n, dialect)
    parts = [f"{q(c.name)} {c.type}{'' if c.nullable else ' NOT NULL'}" for c in version.columns]
    if dialect != "spark" and version.pk:
        parts.append(f"PRIMARY KEY ({', '.join(q(version.column(i).name) for i in version.pk)})")
    return f"CREATE TABLE {q(table)} ({', '.join(parts)})"


def _known(dialect: str) -> None:
    if dialect not in DIALECTS:
        raise ValueError(f"dialect {dialect}")


def statements(table: str, step: Step, dialect: str = "spark") -> list[str]:
    """One step as statements. MySQL restates a column to alter it; a check that fails raises, where a dialect can."""
    _known(dialect)
    t, c = quoted(table, dialect), quoted(step.column.name, dialect)
    alter, kind = f"ALTER TABLE {t}", step.column.type
    restated = f"{alter} MODIFY COLUMN {c} {kind}"
    if step.kind == "add_column":
        return [f"{alter} ADD COLUMN {c} {kind}"]
    if step.kind == "drop_column":
        return [f"{alter} DROP COLUMN {c}"]
    if step.kind == "rename_column":
        return [f"{alter} RENAME COLUMN {c} TO {quoted(step.new_name, dialect)}"]
    if step.kind == "preflight_not_null":
        empty = f"SELECT count(*) FROM {t} WHERE {c} IS NULL"
        return [f"SELECT assert_true(({empty}) = 0)" if dialect == "spark" else f"SELECT 1 / CASE WHEN ({empty}) = 0 THEN 1 ELSE 0 END" if dialect == "postgres" else empty]
    if step.kind == "deprecate_column":
        return {"spark": [f"{alter} ALTER COLUMN {c} COMMENT '{NOTE}'"], "postgres": [f"COMMENT ON COLUMN {t}.{c} IS '{NOTE}'"], "mysql": [f"{restated} COMMENT '{NOTE}'"]}[dialect]
    if step.kind == "alter_type":
        return [restated if dialect == "mysql" else f"{alter} ALTER COLUMN {c} TYPE {kind}"]
    if step.kind in ("set_not_null", "drop_not_null"):
        word = step.kind.split("_")[0].upper()
        return [f"{restated}{' NOT NULL' if word == 'SET' else ' NULL'}" if dialect == "mysql" else f"{alter} ALTER COLUMN {c} {word} NOT NULL"]
    raise ValueError(step.kind)
