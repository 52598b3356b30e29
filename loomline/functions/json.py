"""Paths into JSON texts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_get(doc: Column, path: str) -> Column:
    """Text at a path such as a.b[2].c; null on a miss."""
    return F.get_json_object(doc, "$." + path)


def path_map(doc: Column, array_path: str, key: str) -> Column:
    """A key asked of a list maps over the list's elements."""
    items = F.from_json(F.get_json_object(doc, "$." + array_path), "array<string>")
    return F.transform(items, lambda x: F.get_json_object(x, "$." + key))


def path_parts(path: str) -> list[str | int]:
    return [int(x[1:-1]) if x[0] == "[" else x for x in re.findall(r"\[\d+\]|[^.\[\]]+", path)]


def section(doc: Column, name: str) -> Column:
    """doc[name] if there is one, else the whole document."""
    return F.coalesce(F.get_json_object(doc, "$." + name), doc)
