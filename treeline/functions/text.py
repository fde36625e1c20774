"""Render a fixed message template (``{name}`` placeholders) as a Column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SLOT = re.compile(r"\{(\w+)\}")


def fmt(template: str, **values) -> Column:
    """``concat`` of the template's literal pieces and the given Columns.

    Values may be Columns or plain strings; a null Column makes the result null.
    """
    parts: list[Column] = []
    pos = 0
    for m in _SLOT.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        v = values[m.group(1)]
        parts.append(v if isinstance(v, Column) else F.lit(v))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def render(template: str, **values) -> str:
    """The same template rendered in Python (for the replay steps)."""
    return template.format(**values)
