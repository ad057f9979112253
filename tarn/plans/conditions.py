"""Conditions of alerts and query builders as SQL.

A condition is ``{"column", "operator", "value"}``; ``{"and": [...]}`` and
``{"or": [...]}`` nest. Values of comparisons are numbers where they look like
one and quoted texts elsewhere; no condition at all is true.
"""

from __future__ import annotations

from tarn.plans.sqltext import quoted

_COMPARE = {"=": "=", "==": "=", "<>": "<>", "!=": "<>", ">=": ">=", "<=": "<=", ">": ">", "<": "<"}
_LIKE = {"contains": ("LIKE", "%{}%"), "notcontains": ("NOT LIKE", "%{}%"), "startswith": ("LIKE", "{}%"), "endswith": ("LIKE", "%{}")}


def _name(column: str) -> str:
    return ".".join(f"`{part.replace('`', '``')}`" for part in column.split("."))


def _value(value: object) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return repr(value)
    return quoted(str(value))


def where(condition: dict | list | None) -> str:
    """The condition as the text of a WHERE clause."""
    if not condition:
        return "true"
    if isinstance(condition, list):
        condition = {"and": condition}
    for word in ("and", "or"):
        if word in condition:
            parts = [where(c) for c in condition[word]]
            return f"({f' {word.upper()} '.join(parts)})" if parts else "true"
    if "not" in condition:
        return f"(NOT {where(condition['not'])})"
    column, value = _name(condition["column"]), condition.get("value")
    operator = str(condition["operator"]).strip().lower().replace(" ", "").replace("_", "")
    if operator in ("isnull", "isnotnull"):
        return f"{column} IS {'NOT ' if operator == 'isnotnull' else ''}NULL"
    if operator in ("in", "notin"):
        values = ", ".join(_value(v) for v in value) if value else "NULL"
        return f"{column} {'NOT IN' if operator == 'notin' else 'IN'} ({values})"
    if operator in _LIKE:
        word, pattern = _LIKE[operator]
        text = str(value).replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
        return f"{column} {word} {quoted(pattern.format(text))}"
    if operator not in _COMPARE:
        raise ValueError(f"unknown operator {condition['operator']!r}")
    return f"{column} {_COMPARE[operator]} {_value(value)}"
