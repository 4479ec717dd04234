"""Row-wise statements over streams.

A stream has no row numbers, so only WHERE and projections apply: what orders, groups or numbers rows
is refused. The result is a streaming frame for ``writeStream``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans import ast as A
from ..plans.binder import Binder, Scope, quoted
from ..plans.parser import parse
from ..plans.planner import aggregates_in, named
from ..types import TaqlError


def _positions(e: object) -> bool:
    if isinstance(e, A.Call) and e.name in ("ROWID", "ROWNUMBER", "ROWNR"):
        return True
    if isinstance(e, A.Subquery):
        return True
    if isinstance(e, list):
        return any(map(_positions, e))
    return any(_positions(x) for x in vars(e).values()) if hasattr(e, "__dataclass_fields__") else False


def taql_stream(df: DataFrame, text: str) -> DataFrame:
    """Apply ``SELECT ... FROM $1 [WHERE ...]`` to a streaming (or any) frame."""
    stmt = parse(text)
    if not isinstance(stmt, A.Select) or stmt.order or stmt.group or stmt.unique or stmt.limit is not None or stmt.offset or stmt.into:
        raise TaqlError("a stream takes SELECT with WHERE only")
    items = stmt.items if stmt.items is not None else [A.Item(A.Name(c)) for c in df.columns]
    if any(aggregates_in(i.expr) or _positions(i.expr) for i in items) or _positions(stmt.where):
        raise TaqlError("a stream has no groups, row numbers or row lookups")
    binder = Binder(Scope(df.schema))
    if stmt.where is not None:
        df = df.where(binder.predicate(stmt.where))
    out = [(quoted(i.expr.name) if isinstance(i.expr, A.Name) else binder.bind(i.expr).col).alias(n) for i, n in zip(items, named(items), strict=True)]
    return df.select(*out)
