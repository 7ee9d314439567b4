"""Helpers for expression builders."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def named(builder: Callable[..., Column]) -> Callable[..., Column]:
    """Add ``builder.udf``: the same expression over column names.

    Call sites read as with a registered function, but the plan holds native expressions only.
    """

    def by_name(*columns: str | Column, **options) -> Column:
        return builder(*(F.col(c) if isinstance(c, str) else c for c in columns), **options)

    builder.udf = functools.wraps(builder)(by_name)
    return builder


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body (or a lambda in it) uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)
