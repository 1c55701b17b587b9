"""Naming an intermediate value inside one expression.

A chain of ``withColumn`` calls that use each other several times is inlined when a filter or a generator
is pushed through it, and the expression then grows with every step.  A lambda variable is evaluated
once and never inlined, so rules built from these helpers stay linear in size wherever Catalyst moves them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def let_all(values: dict[str, Column], body: Callable[[Callable[[str], Column]], Column]) -> Column:
    """``body(get)`` where ``get(name)`` gives one of the named values."""
    packed = F.struct(*[v.alias(k) for k, v in values.items()])
    return let(packed, lambda s: body(lambda name: s[name]))
