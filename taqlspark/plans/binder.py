"""From expression trees to typed columns."""

from __future__ import annotations

import copy
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import call
from ..functions import aggregates as G
from ..functions.coerce import NAN, common, number, real, text, truth, whole
from ..functions.mathematics import divided, euclid
from ..functions.patterns import from_regex, from_sql, valid
from ..operators.rows import ROWID
from ..types import ARR, BOOL, CPLX, FLOAT, INT, REGEX, STR, TaqlError, Val, promoted, zero
from . import ast as A


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


class Scope:
    """Names that an expression can use: the columns of a table, as held in a DataFrame."""

    def __init__(self, schema: T.StructType, keywords: dict[str, Any] | None = None) -> None:
        self.fields = {f.name: f.dataType for f in schema if not f.name.startswith("__")}
        self.keywords = keywords or {}

    def column(self, name: str) -> Val:
        if name not in self.fields:
            raise TaqlError(f"unknown column or function {name}")
        return promoted(quoted(name), self.fields[name])


class Binder:
    """Binds expressions of one statement.

    safe: errors of the data become null (for WHERE and HAVING, where they count as false).
    lookup: turns a row-lookup subquery into a value, by adding a join to the plan.
    """

    def __init__(self, scope: Scope, safe: bool = False, lookup: Callable[[A.Select, Val], Val] | None = None) -> None:
        self.scope, self.safe, self.lookup = scope, safe, lookup

    def bind(self, e: Any) -> Val:
        return getattr(self, "_" + type(e).__name__.lower())(e)

    def predicate(self, e: Any) -> Column:
        """True where the expression is; data errors are false."""
        own = copy.copy(self)
        own.safe = True
        return F.coalesce(truth(own.bind(e)), F.lit(False))

    def _lit(self, e: A.Lit) -> Val:
        v = e.value
        if isinstance(v, bool):
            return Val(F.lit(v), BOOL, const=v)
        if isinstance(v, int):
            return Val(F.lit(v).cast("bigint"), INT, const=v)
        if isinstance(v, float):
            return Val(F.lit(v), FLOAT, const=v)
        return Val(F.lit(v), STR, const=v)

    def _name(self, e: A.Name) -> Val:
        return self.scope.column(e.name)

    def _unary(self, e: A.Unary) -> Val:
        v = self.bind(e.arg)
        if e.op == "not":
            return Val(~truth(v), BOOL, const=None if v.const is None else not v.const)
        v = number(v)
        return Val(-v.col, v.kind, const=None if v.const is None else -v.const)

    def _binary(self, e: A.Binary) -> Val:
        a, b = self.bind(e.left), self.bind(e.right)
        if e.op == "and":
            return Val(truth(a) & truth(b), BOOL)
        if e.op == "or":
            return Val(truth(a) | truth(b), BOOL)
        if e.op in ("~", "!~"):
            return self._match(a, b, e.op == "!~")
        if e.op in ("=", "!=", "<", "<=", ">", ">="):
            return compare(e.op, a, b)
        return self._arithmetic(e.op, a, b)

    def _arithmetic(self, op: str, a: Val, b: Val) -> Val:
        a, b = number(a), number(b)
        if FLOAT in (a.kind, b.kind):
            x, y = real(a), real(b)
            if op == "/":
                out = divided(x, y)
            elif op == "%":
                out = F.when(y == 0, NAN).otherwise(x % F.when(y == 0, 1.0).otherwise(y))
            else:
                out = {"+": x + y, "-": x - y, "*": x * y}[op]
            return Val(out, FLOAT)
        x, y = a.col, b.col
        if op == "/":
            out = euclid(x, y, self.safe)
        elif op == "%":
            out = x % (F.when(y == 0, None).otherwise(y) if self.safe else y)
        elif self.safe:
            out = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y)
        else:
            out = {"+": x + y, "-": x - y, "*": x * y}[op]
        return Val(out, INT)

    def _match(self, a: Val, b: Val, negated: bool) -> Val:
        if b.kind == REGEX:
            pattern = b.const
        elif b.const is not None:
            pattern = from_regex(str(b.const))
        else:
            raise TaqlError("a pattern must be a constant")
        out = text(a).rlike(pattern) if valid(pattern) else F.lit(False)
        return Val(~out if negated else out, BOOL)

    def _between(self, e: A.Between) -> Val:
        v = self.bind(e.arg)
        return Val(compare(">=", v, self.bind(e.low)).col & compare("<=", v, self.bind(e.high)).col, BOOL)

    def _in(self, e: A.In) -> Val:
        v, items = self.bind(e.arg), [self.bind(x) for x in e.items]
        if not items:
            return Val(F.lit(False), BOOL)
        if v.kind != ARR and all(i.kind == v.kind and i.const is not None for i in items):
            return Val(v.col.isin(*[i.const for i in items]), BOOL)
        out = F.lit(False)
        for i in items:
            out = out | compare("=", v, i).col
        return Val(out, BOOL)

    def _like(self, e: A.Like) -> Val:
        v, p = self.bind(e.arg), self.bind(e.pattern)
        if p.const is None:
            raise TaqlError("a pattern must be a constant")
        pattern = str(p.const)
        s = text(v)
        if e.fold:
            return Val(F.lower(s).rlike(from_sql(pattern.lower())), BOOL)
        body = pattern.strip("%")
        if not set(body) & set("%_\\"):  # plain text between marks: the scan can use it
            lead, trail = pattern.startswith("%"), pattern.endswith("%") and len(pattern) > 0
            if body and lead and trail:
                return Val(s.contains(body), BOOL)
            if body and trail:
                return Val(s.startswith(body), BOOL)
            if body and lead:
                return Val(s.endswith(body), BOOL)
            if not lead and not trail:
                return Val(s == body, BOOL)
        return Val(s.rlike(from_sql(pattern)), BOOL)

    def _index(self, e: A.Index) -> Val:
        at = whole(self.bind(e.at))
        if isinstance(e.base, A.Subquery):
            if self.lookup is None:
                raise TaqlError("a row lookup can't be used here")
            return self.lookup(e.base.select, Val(at, INT))
        v = self.bind(e.base)
        if v.kind == CPLX:
            return Val(F.when(at == 0, v.col["re"]).when(at == 1, v.col["im"]).otherwise(0.0), FLOAT)
        if v.kind != ARR:
            raise TaqlError("only arrays and subqueries can be indexed")
        kind = v.elem or FLOAT
        if v.pick is not None:
            return Val(F.coalesce(v.pick(at), zero(kind)), kind)
        place = F.when(at < 0, at + F.size(v.col)).otherwise(at).cast("int")
        return Val(F.coalesce(F.get(v.col, place), zero(kind)), kind)

    def _subquery(self, e: A.Subquery) -> Val:
        raise TaqlError("a subquery needs a row number after it, as in [SELECT ...][i]")

    def _call(self, e: A.Call) -> Val:
        if e.name in ("ROWID", "ROWNUMBER", "ROWNR"):
            return Val(F.col(ROWID), INT)
        if e.name in ("ISCOLUMN", "ISKEYWORD"):
            [arg] = e.args
            name = arg.name if isinstance(arg, A.Name) else str(arg.value)
            found = name in (self.scope.fields if e.name == "ISCOLUMN" else self.scope.keywords)
            return Val(F.lit(found), BOOL, const=found)
        if e.name in G.NAMES:
            return self.aggregate(e)
        return call(e.name, [self.bind(a) for a in e.args], self.safe)

    def aggregate(self, e: A.Call) -> Val:
        raise TaqlError(f"{e.name} needs GROUPBY")


def compare(op: str, a: Val, b: Val) -> Val:
    """Numbers across kinds, strings by code point, arrays by elements; a string is less than any number."""
    numeric = {BOOL, INT, FLOAT}
    if {a.kind, b.kind} <= numeric or a.kind == b.kind:
        if a.kind == BOOL and b.kind in (INT, FLOAT) or b.kind == BOOL and a.kind in (INT, FLOAT):
            x, y = truth(a), truth(b)
        elif a.kind == CPLX:
            if op not in ("=", "!="):
                raise TaqlError("complex numbers have no order")
            same = (a.col["re"] == b.col["re"]) & (a.col["im"] == b.col["im"])
            return Val(same if op == "=" else ~same, BOOL)
        else:
            a, b = common(a, b)
            x, y = a.col, b.col
    elif ARR in (a.kind, b.kind):
        if op not in ("=", "!="):
            raise TaqlError("an array and a scalar have no order")
        same = F.lit(False)
        return Val(same if op == "=" else ~same, BOOL)
    else:
        less = a.kind == STR and b.kind in numeric
        if not less and not (b.kind == STR and a.kind in numeric):
            raise TaqlError(f"values of kinds {a.kind} and {b.kind} can't be compared")
        found = {"=": False, "!=": True, "<": less, "<=": less, ">": not less, ">=": not less}[op]
        return Val(F.lit(found), BOOL, const=found)
    return Val({"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], BOOL)


class GroupBinder(Binder):
    """Binds expressions over groups: aggregates are computed once each and named, and the rest is over them.

    A bare column is that of the group's first row.
    """

    def __init__(self, scope: Scope, safe: bool = False, lookup: Callable[[A.Select, Val], Val] | None = None) -> None:
        super().__init__(scope, safe, lookup)
        self.found: dict[str, tuple[Column, str, str | None]] = {}
        self.first: dict[str, str] = {}

    def _add(self, key: str, v: Val) -> Val:
        if key not in self.found:
            self.found[key] = (v.col, v.kind, v.elem)
        _, kind, elem = self.found[key]
        return Val(F.col(f"`__agg_{list(self.found).index(key)}`"), kind, elem)

    def columns(self) -> list[Column]:
        return [c.alias(f"__agg_{i}") for i, (c, _, _) in enumerate(self.found.values())]

    def _name(self, e: A.Name) -> Val:
        v = self.scope.column(e.name)
        return self._add(f"first {e.name}", Val(F.min_by(v.col, F.col(ROWID)), v.kind, v.elem))

    def _call(self, e: A.Call) -> Val:
        if e.name in ("ROWID", "ROWNUMBER", "ROWNR"):
            return self._add("first rowid", Val(F.min(F.col(ROWID)), INT))
        return super()._call(e)

    def aggregate(self, e: A.Call) -> Val:
        rid = F.col(ROWID)
        if e.name == "GCOUNT":
            return self._add("GCOUNT", G.count())
        if e.name == "GROWID":
            return self._add("GROWID", G.rows(rid))
        if not e.args:
            raise TaqlError(f"{e.name} needs a column")
        rows = Binder(self.scope, self.safe, self.lookup)
        value, fraction = rows.bind(e.args[0]), 0.5
        if len(e.args) > 1:
            f = rows.bind(e.args[1])
            if f.const is None:
                raise TaqlError("a fractile's fraction must be a constant")
            fraction = float(f.const)
        return self._add(f"{e.name} {e.args!r}", G.AGGREGATES[e.name](value, rid, fraction))
