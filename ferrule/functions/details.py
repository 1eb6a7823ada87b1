"""Details of findings: a column of variants with typed access.

A finding's details are an object of texts, whole numbers and truth values
whose names depend on its kind.  A number is read as a number and a text as a
text: no value is converted to the type that was asked for.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parsed(text) -> Column:
    """JSON text to a variant; null for what isn't JSON.  Names have to be unique: container.read() keeps the last of equal ones."""
    return F.try_parse_json(_col(text))


def _path(name: str) -> str:
    """A path has no escapes, so a name can hold one kind of quotes."""
    quote = "'" if "'" not in name else '"'
    if quote in name:
        raise ValueError(f"no path for {name!r}")
    return f"$[{quote}{name}{quote}]"


def kind(details, name: str) -> Column:
    """text, number, flag or null (also for what is missing)."""
    shape = F.schema_of_variant(F.try_variant_get(_col(details), _path(name), "variant"))
    return F.when(shape == "STRING", "text").when(shape == "BIGINT", "number").when(shape == "BOOLEAN", "flag")


def _typed(details, name: str, wanted: str, as_type: str) -> Column:
    return F.when(kind(details, name) == wanted, F.try_variant_get(_col(details), _path(name), as_type))


def text(details, name: str) -> Column:
    return _typed(details, name, "text", "string")


def number(details, name: str) -> Column:
    return _typed(details, name, "number", "bigint")


def flag(details, name: str) -> Column:
    return _typed(details, name, "flag", "boolean")


def names(details) -> Column:
    """The names that are there, in order."""
    return F.array_sort(F.map_keys(F.try_variant_get(_col(details), "$", "map<string,variant>")))


def shown(details) -> Column:
    """As JSON text, for lists and views."""
    return F.to_json(_col(details))
