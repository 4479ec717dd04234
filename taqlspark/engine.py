"""Run a statement."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators.rows import ROWID, number
from .plans import ast as A
from .plans import dml
from .plans.parser import parse
from .plans.planner import Result, Source, plan_calc, plan_count, plan_select
from .sources import store
from .types import TaqlError


def source_of(spark: SparkSession, table: Any) -> tuple[Source, str | None]:
    """A table handle, a frame or a path as a source, and the path that writes go to."""
    if isinstance(table, str):
        path = store.clean(table)
        return Source(store.load(spark, path), store.load_meta(spark, path).get("keywords", {})), path
    if isinstance(table, DataFrame):
        return Source(table if ROWID in table.columns else number(table)), None
    return table.source(), table.path if not table.is_view else None


def taql(spark: SparkSession, text: str, tables: list[Any] | None = None, ordered: bool = True) -> DataFrame:
    """Run one statement and return its rows.

    tables: what ``$1``, ``$2`` ... stand for: table handles, frames or paths. A frame that has no row
    numbers gets them from its own order. With ``ordered`` the rows come in the language's order; without
    it a sort that only that order asks for is left out. Statements that write return a frame of the
    paths they wrote.
    """
    stmt = parse(text)
    known: dict[int, tuple[Source, str | None]] = {}
    paths: dict[int, str] = {}

    def resolve(ref: A.TableRef) -> Source:
        if ref.path is not None:
            return source_of(spark, ref.path)[0]
        i = ref.position or 0
        if not 1 <= i <= len(tables or []):
            raise TaqlError(f"${i} is not in the list of tables")
        if i not in known:
            known[i] = source_of(spark, (tables or [])[i - 1])
            if known[i][1]:
                paths[i] = known[i][1]  # type: ignore[assignment]
        return known[i][0]

    if isinstance(stmt, A.Select):
        result = plan_select(stmt, resolve)
        if stmt.into:
            frame = result.frame()
            store.save_new(spark, stmt.into, frame)
            return _written(spark, [store.clean(stmt.into)])
        return result.frame(ordered)
    if isinstance(stmt, A.Count):
        return plan_count(stmt, resolve)
    if isinstance(stmt, A.Calc):
        return plan_calc(stmt, resolve)
    if isinstance(stmt, A.Show):
        return dml.show(spark, stmt)
    if isinstance(stmt, A.Create):
        return _written(spark, [dml.create(spark, stmt)])
    if isinstance(stmt, A.Drop):
        return _written(spark, dml.drop(spark, stmt))
    if getattr(stmt, "table", None) is not None and stmt.table.position is not None:
        resolve(stmt.table)
    if isinstance(stmt, A.Alter):
        return _written(spark, [dml.alter(spark, stmt, paths)])
    run = {A.Update: dml.update, A.Delete: dml.delete, A.Insert: dml.insert}[type(stmt)]
    return _written(spark, [run(spark, stmt, resolve, paths)])


def select_result(spark: SparkSession, text: str, source: Source) -> Result:
    """A SELECT over one table, with its hidden columns."""
    stmt = parse(text)
    if not isinstance(stmt, A.Select):
        raise TaqlError("a SELECT is needed")
    return plan_select(stmt, lambda ref: source if ref.position == 1 else _no(ref))


def _no(ref: A.TableRef) -> Source:
    raise TaqlError(f"${ref.position} is not in the list of tables")


def _written(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.createDataFrame([(p,) for p in paths], T.StructType([T.StructField("touched", T.StringType())]))


__all__ = ["taql", "source_of", "select_result", "F"]
