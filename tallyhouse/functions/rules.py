"""Data type rules: name -> (column -> true where the value breaks the rule).

NULL never breaks a rule. New rules are added with ``register_rule``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from tallyhouse.functions.columns import strip, to_number, to_timestamp_any

Rule = Callable[[Column], Column]

_RULES: dict[str, Rule] = {}


def register_rule(name: str, rule: Rule) -> None:
    _RULES[name] = rule


def has_rule(name: str) -> bool:
    return name in _RULES


def violates(rule: str, c: Column) -> Column:
    return _RULES[rule](c.cast("string"))


def _fails(test) -> Rule:
    """NULL passes; a value fails when the test is false or unknown."""
    return lambda c: c.isNotNull() & ~F.coalesce(test(c), F.lit(False))


register_rule("numeric", _fails(lambda c: to_number(c).isNotNull()))
register_rule("positive_numeric", _fails(lambda c: to_number(c) > 0))
register_rule("datetime", _fails(lambda c: to_timestamp_any(strip(c)).isNotNull()))
