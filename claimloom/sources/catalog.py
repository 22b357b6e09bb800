"""Schemas as Markdown, and whether a written description is still true."""

from __future__ import annotations

from pyspark.sql.types import StructType


def describe(tables: dict[str, StructType]) -> str:
    parts = []
    for name in sorted(tables):
        rows = [f"| {f.name} | {f.dataType.simpleString()} | {'yes' if f.nullable else 'no'} |" for f in tables[name].fields]
        parts.append("\n".join([f"## {name}", "", "| column | type | null |", "| --- | --- | --- |", *rows, ""]))
    return "\n".join(parts)


def drifted(tables: dict[str, StructType], written: str) -> list[str]:
    """Names of tables whose description is missing or old."""
    return [name for name in sorted(tables) if describe({name: tables[name]}).strip() not in written]
