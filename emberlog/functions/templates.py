"""Templates with ``${name}`` parts, compiled to one concatenation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_PART = re.compile(r"\$\{([^}]*)\}")


def template_names(template: str) -> list[str]:
    return _PART.findall(template)


def fill(template: str, values: dict[str, Column]) -> Column:
    """The template as a string column; null values leave nothing."""
    if not template:
        raise ValueError("a template is needed")
    parts, at = [], 0
    for m in _PART.finditer(template):
        if m.start() > at:
            parts.append(F.lit(template[at : m.start()]))
        if m[1] not in values:
            raise ValueError(f"nothing is named {m[1]!r}")
        parts.append(F.coalesce(values[m[1]].cast("string"), F.lit("")))
        at = m.end()
    if at < len(template):
        parts.append(F.lit(template[at:]))
    return F.concat(*parts)
