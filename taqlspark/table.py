"""Table handles: lazy selections and sorts, cells and slices, keywords, and buffered writes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .engine import select_result, source_of, taql
from .operators import slices
from .operators.rows import BASE_ROWID, ROWID, number, ordered_number
from .plans import ast as A
from .plans import dml
from .plans.binder import quoted
from .plans.parser import parse
from .plans.planner import Source
from .sources import store
from .sources.files import Files
from .types import TaqlError, default_value, promoted


def open_table(spark: SparkSession, name: str) -> Table:
    """A table directory, a Parquet file or folder, or a subtable as ``path::NAME``."""
    return Table(spark, store.clean(name))


def create_table(spark: SparkSession, name: str, desc: T.StructType | dict[str, dict[str, Any]], nrow: int = 0, dminfo: Any = None) -> Table:
    """A new table of nrow default rows. dminfo is accepted and has no effect: all columns are Parquet."""
    schema = desc if isinstance(desc, T.StructType) else schema_of(desc)
    meta = {"keywords": {}, "column_keywords": {}, "columns": {f.name: f.metadata for f in schema}, "info": {}}
    if isinstance(desc, dict):
        meta["column_keywords"] = {c: d["keywords"] for c, d in desc.items() if not c.startswith("_") and d.get("keywords")}
        meta["keywords"] = dict(desc.get("_keywords_", {}))
    store.save(spark, name, store.empty_rows(spark, schema, nrow), meta)
    return Table(spark, store.clean(name))


def schema_of(desc: dict[str, dict[str, Any]]) -> T.StructType:
    """A description as a schema."""
    fields = []
    for name, d in desc.items():
        if name.startswith("_"):
            continue
        spec = A.ColumnSpec(name, str(d.get("valueType", "double")), d.get("ndim"), d.get("shape"), int(d.get("option", 0)), int(d.get("maxlen", 0)), str(d.get("comment", "")))
        fields.append(dml.field_of(spec))
    return T.StructType(fields)


def make_scalar_column(name: str, value: Any = None, comment: str = "", value_type: str | None = None, options: int = 0, maxlen: int = 0, keywords: dict[str, Any] | None = None) -> dict[str, Any]:
    """Description of a scalar column; the type is named or that of a sample value."""
    return {"name": name, "desc": {"valueType": value_type or _type_of(value), "ndim": -1, "option": options, "maxlen": maxlen, "comment": comment, "keywords": keywords or {}}}


def make_array_column(name: str, value: Any = None, ndim: int = 0, shape: Sequence[int] | None = None, comment: str = "", value_type: str | None = None, options: int = 0, keywords: dict[str, Any] | None = None) -> dict[str, Any]:
    """Description of an array column, of a fixed shape or of any."""
    d: dict[str, Any] = {"valueType": value_type or _type_of(value), "ndim": len(shape) if shape else ndim, "option": options, "maxlen": 0, "comment": comment, "keywords": keywords or {}}
    if shape:
        d |= {"shape": list(shape), "option": options | 4}
    return {"name": name, "desc": d}


def make_table(columns: Sequence[dict[str, Any]]) -> dict[str, dict[str, Any]]:
    """Description of a table from those of its columns; a name used twice is an error."""
    out: dict[str, dict[str, Any]] = {}
    for c in columns:
        if c["name"] in out:
            raise ValueError(f"column {c['name']} is described twice")
        out[c["name"]] = c["desc"]
    return out


def _type_of(value: Any) -> str:
    if isinstance(value, (list, tuple, np.ndarray)) and len(value):
        return _type_of(np.asarray(value).ravel()[0].item())
    return {bool: "bool", int: "int", float: "double", complex: "dcomplex", str: "string"}.get(type(value), "double")


class Table:
    """A table or a view of one.

    Views (query, sort, select, selectrows) are lazy frames that keep the base table's row numbers; they
    can't be written. Written cells are held until ``flush`` (or the end of a ``with`` block) and reads
    see them.
    """

    def __init__(self, spark: SparkSession, path: str | None, df: DataFrame | None = None, base: Table | None = None) -> None:
        self.spark, self.path, self._df, self.base = spark, path, df, base
        self._pending: DataFrame | None = None

    # sources
    @property
    def is_view(self) -> bool:
        return self._df is not None

    def df(self) -> DataFrame:
        """Rows with ROWID; of a view also BASE_ROWID."""
        if self._df is not None:
            return self._df
        return self._pending if self._pending is not None else store.load(self.spark, self.path or "")

    def source(self) -> Source:
        return Source(self.df().drop(BASE_ROWID), self.meta().get("keywords", {}))

    def meta(self) -> dict[str, Any]:
        path = self.path or (self.base.path if self.base else None)
        return store.load_meta(self.spark, path) if path else {"keywords": {}, "column_keywords": {}, "columns": {}, "info": {}}

    def __enter__(self) -> Table:
        return self

    def __exit__(self, *error: Any) -> None:
        if error[0] is None:
            self.flush()

    def close(self) -> None:
        self.flush()

    # reading
    def nrows(self) -> int:
        return self.df().count()

    __len__ = nrows

    def colnames(self) -> list[str]:
        return [c for c in self.df().columns if not c.startswith("__")]

    def ncols(self) -> int:
        return len(self.colnames())

    def frame(self) -> DataFrame:
        """Visible columns, in row order."""
        return self.df().orderBy(ROWID).select(*[quoted(c) for c in self.colnames()])

    def _range(self, startrow: int, nrow: int) -> tuple[int, int | None]:
        if startrow < 0:
            startrow += self.nrows()
        return startrow, None if nrow < 0 else startrow + nrow

    def column(self, name: str, startrow: int = 0, nrow: int = -1) -> DataFrame:
        """One column of a range of rows, in order, as a frame of ROWID and value."""
        self._need(name)
        lo, hi = self._range(startrow, nrow)
        df = self.df().where(F.col(ROWID) >= lo)
        if hi is not None:
            df = df.where(F.col(ROWID) < hi)
        return df.orderBy(ROWID).select(ROWID, quoted(name).alias("value"))

    def _need(self, name: str) -> T.DataType:
        for f in self.df().schema:
            if f.name == name and not name.startswith("__"):
                return f.dataType
        raise TaqlError(f"no column {name}")

    def _cell(self, name: str, value: Any) -> Any:
        """A cell as the caller sees it: complex numbers and shaped arrays."""
        t = self.df().schema[name].dataType
        return host_value(value, t, self.df().schema[name].metadata.get("shape") if self.df().schema[name].metadata else None)

    def getcol(self, name: str, startrow: int = 0, nrow: int = -1, rowincr: int = 1) -> Any:
        """Values as a NumPy array (strings as a list). Cells of different shapes can't be stacked; an undefined cell is an error."""
        field = self.df().schema[name] if self._need(name) is not None else None
        rows = [(r[ROWID], r["value"]) for r in self.column(name, startrow, nrow).collect()]
        for rid, v in rows:
            if v is None and isinstance(field.dataType, (T.ArrayType, T.StructType)):
                raise ValueError(f"no array in row {rid}")
        values = [self._cell(name, v) for _, v in rows]
        if isinstance(field.dataType, T.StringType):
            return values
        if len({np.shape(v) for v in values}) > 1:
            raise ValueError("cells have different shapes; use getvarcol")
        return np.array(values)

    def getcolnp(self, name: str, out: np.ndarray, startrow: int = 0, nrow: int = -1) -> None:
        out[...] = self.getcol(name, startrow, nrow)

    def getvarcol(self, name: str, startrow: int = 0, nrow: int = -1) -> dict[str, Any]:
        """Cells by ``r`` and row number counted from 1; False where undefined."""
        rows = self.column(name, startrow, nrow).collect()
        return {f"r{r[ROWID] + 1}": False if r["value"] is None else self._cell(name, r["value"]) for r in rows}

    def getcell(self, name: str, row: int) -> Any:
        self._need(name)
        found = self.df().where(F.col(ROWID) == row).select(quoted(name)).first()
        if found is None:
            raise ValueError(f"no row {row}")
        if found[0] is None and isinstance(self.df().schema[name].dataType, (T.ArrayType, T.StructType)):
            raise ValueError(f"no array in row {row}")
        return self._cell(name, found[0])

    def iscelldefined(self, name: str, row: int) -> bool:
        self._need(name)
        found = self.df().where(F.col(ROWID) == row).select(quoted(name).isNotNull()).first()
        if found is None:
            raise ValueError(f"no row {row}")
        return bool(found[0])

    def __getitem__(self, key: str | int) -> Any:
        if isinstance(key, str):
            return self.getcol(key)
        n = self.nrows()
        row = key + n if key < 0 else key
        found = self.df().where(F.col(ROWID) == row).first()
        if found is None:
            raise IndexError(key)
        return {c: self._cell(c, found[c]) for c in self.colnames()}

    def __iter__(self) -> Iterator[dict[str, Any]]:
        for r in self.df().orderBy(ROWID).toLocalIterator():
            yield {c: self._cell(c, r[c]) for c in self.colnames()}

    def getcolslice(self, name: str, blc: list[int], trc: list[int], inc: list[int] | None = None, startrow: int = 0, nrow: int = -1) -> np.ndarray:
        """Slices of array cells, from blc to trc with both included."""
        return np.array([r for _, r in self._slices(name, blc, trc, inc, startrow, nrow)])

    def getcellslice(self, name: str, row: int, blc: list[int], trc: list[int], inc: list[int] | None = None) -> np.ndarray:
        found = self._slices(name, blc, trc, inc, row, 1)
        if not found:
            raise ValueError(f"no row {row}")
        return found[0][1]

    def slice_frame(self, name: str, blc: list[int], trc: list[int], inc: list[int] | None = None) -> tuple[DataFrame, list[int]]:
        """(ROWID, value) of slices computed inside the JVM, and a slice's shape."""
        t = self._need(name)
        if isinstance(t, T.ArrayType):
            shape = (self.df().schema[name].metadata or {}).get("shape") or [self._length(name)]
            places, out = slices.flat_indices([int(s) for s in shape], blc, trc, inc)
            return self.df().select(ROWID, slices.take(quoted(name), places).alias("value")), out
        steps = inc or [1] * len(blc)
        out = [len(range(b, e + 1, s)) for b, e, s in zip(blc, trc, steps, strict=True)]
        return self.df().select(ROWID, slices.take_shaped(quoted(name), blc, trc, inc)["data"].alias("value")), out

    def _length(self, name: str) -> int:
        found = self.df().agg(F.min(F.size(quoted(name)))).first()
        return int(found[0] or 0)

    def _slices(self, name: str, blc: list[int], trc: list[int], inc: list[int] | None, startrow: int, nrow: int) -> list[tuple[int, np.ndarray]]:
        lo, hi = self._range(startrow, nrow)
        df, shape = self.slice_frame(name, blc, trc, inc)
        df = df.where(F.col(ROWID) >= lo)
        if hi is not None:
            df = df.where(F.col(ROWID) < hi)
        out = []
        element = df.schema["value"].dataType.elementType
        for r in df.orderBy(ROWID).collect():
            if r["value"] is None:
                raise ValueError(f"no array in row {r[ROWID]}")
            out.append((r[ROWID], np.array([host_value(x, element) for x in r["value"]]).reshape(shape)))
        return out

    # views
    def _view(self, rows: DataFrame, ordered: bool) -> Table:
        """rows: those of this table's columns with ROWID as the position here."""
        base = BASE_ROWID if self.is_view else ROWID
        if base == ROWID:
            rows = rows.withColumn(BASE_ROWID, F.col(ROWID))
        keep = [quoted(c) for c in self.colnames()] + [F.col(BASE_ROWID)]
        order = [F.col("__position__")] if ordered else [F.col(ROWID)]
        view = ordered_number(rows.select(*keep, *(["__position__"] if ordered else [ROWID])), order)
        return Table(self.spark, None, view.drop("__position__"), self.base if self.is_view else self)

    def query(self, where: str = "", sort: str = "", columns: str = "", limit: int | None = None) -> Table:
        """A view of the rows that an expression chooses, sorted; or of some columns. The text may go on with clauses."""
        text = f"SELECT {columns or '*'} FROM $1" + (f" WHERE {where}" if where else "") + (f" ORDERBY {sort}" if sort else "") + (f" LIMIT {limit}" if limit is not None else "")
        stmt = parse(text)
        plain = isinstance(stmt, A.Select) and not (stmt.group or stmt.unique or stmt.having) and (stmt.items is None or all(isinstance(i.expr, A.Name) and not i.alias for i in stmt.items))
        if not plain:
            return Table(self.spark, None, number(taql(self.spark, text, [self])), None)
        result = select_result(self.spark, text, self.source())
        names = result.names
        rows = result.df
        mine = self.df().select(ROWID, BASE_ROWID) if self.is_view else None
        if result.order:
            placed = ordered_number(rows, result.order, "__position__")
        else:
            placed = rows
        if mine is not None:
            placed = placed.join(mine, ROWID)
        else:
            placed = placed.withColumn(BASE_ROWID, F.col(ROWID))
        key = "__position__" if result.order else ROWID
        view = ordered_number(placed.select(*[quoted(n) for n in names], BASE_ROWID, key), [F.col(key)])
        return Table(self.spark, None, view.drop("__position__"), self.base if self.is_view else self)

    def sort(self, keys: str) -> Table:
        return self.query(sort=keys)

    def select(self, columns: str) -> Table:
        return self.query(columns=columns)

    def selectrows(self, rows: Sequence[int]) -> Table:
        """A view of the given rows in the given order; a row that isn't there is an error."""
        wanted = self.spark.createDataFrame(list(enumerate(map(int, rows))), "__position__ bigint, __want__ bigint")
        found = self.df().join(wanted, F.col(ROWID) == F.col("__want__"))
        if found.count() != len(rows):
            raise ValueError("a row is not in the table")
        return self._view(found, True)

    def rownumbers(self, other: Table | None = None) -> np.ndarray:
        """The base table's row of each row of a view; or its row in another view of the same table, -1 if absent."""
        own = BASE_ROWID if self.is_view else ROWID
        mine = self.df().select(F.col(ROWID).alias("i"), F.col(own).alias("b"))
        if other is None:
            return np.array([r["b"] for r in mine.orderBy("i").collect()], dtype=np.int64)
        if (self.base or self).path != (other.base or other).path:
            raise ValueError("views of different tables")
        theirs = other.df().select(F.col(ROWID).alias("j"), F.col(BASE_ROWID if other.is_view else ROWID).alias("b"))
        joined = mine.join(theirs.groupBy("b").agg(F.min("j").alias("j")), "b", "left").orderBy("i")
        return np.array([r["x"] for r in joined.select(F.coalesce("j", F.lit(-1)).alias("x")).collect()], dtype=np.int64)

    def taql(self, text: str) -> DataFrame:
        """A statement in which $1 is this table."""
        return taql(self.spark, text, [self])

    # descriptions
    def getkeywords(self) -> dict[str, Any]:
        return self.meta().get("keywords", {})

    def getkeyword(self, name: str) -> Any:
        return _walk(self.getkeywords(), name)

    def getcolkeywords(self, column: str) -> dict[str, Any]:
        self._need(column)
        return self.meta().get("column_keywords", {}).get(column, {})

    def getcolkeyword(self, column: str, name: str) -> Any:
        return _walk(self.getcolkeywords(column), name)

    def putkeyword(self, name: str, value: Any) -> None:
        self._edit(lambda m: _put(m["keywords"], name, value))

    def putcolkeyword(self, column: str, name: str, value: Any) -> None:
        self._need(column)
        self._edit(lambda m: _put(m["column_keywords"].setdefault(column, {}), name, value))

    def removekeyword(self, name: str) -> None:
        self._edit(lambda m: _drop(m["keywords"], name))

    def removecolkeyword(self, column: str, name: str) -> None:
        self._need(column)
        self._edit(lambda m: _drop(m["column_keywords"].get(column, {}), name))

    def info(self) -> dict[str, str]:
        return {"type": "", "subType": "", "readme": ""} | self.meta().get("info", {})

    def putinfo(self, info: dict[str, str]) -> None:
        self._edit(lambda m: m["info"].update(info))

    def addreadmeline(self, line: str) -> None:
        self._edit(lambda m: m["info"].update(readme=m["info"].get("readme", "") + line + "\n"))

    def _edit(self, change: Any) -> None:
        if self.path is None:
            raise TaqlError("a view can't be written")
        meta = self.meta()
        for part in ("keywords", "column_keywords", "columns", "info"):
            meta.setdefault(part, {})
        change(meta)
        store.save_meta(self.spark, self.path, meta)

    def getcoldesc(self, name: str) -> dict[str, Any]:
        t = self._need(name)
        own = dict(self.meta().get("columns", {}).get(name, {}))
        own.setdefault("valueType", dml.type_name(t))
        own.setdefault("ndim", 1 if isinstance(t, T.ArrayType) else -1)
        return own | {"keywords": self.getcolkeywords(name)}

    def getdesc(self) -> dict[str, Any]:
        return {c: self.getcoldesc(c) for c in self.colnames()} | {"_keywords_": self.getkeywords()}

    def getdminfo(self) -> dict[str, Any]:
        """All columns are of one manager."""
        return {"*1": {"TYPE": "Parquet", "NAME": "Parquet", "SEQNR": 0, "COLUMNS": self.colnames()}}

    def coldatatype(self, name: str) -> str:
        return self.getcoldesc(name)["valueType"]

    def isscalarcol(self, name: str) -> bool:
        t = self._need(name)
        return not isinstance(t, (T.ArrayType, T.StructType)) or isinstance(t, T.StructType) and t.fieldNames() == ["re", "im"]

    def getsubtables(self) -> list[str]:
        """Paths of all keywords that name tables."""
        out: list[str] = []

        def walk(v: Any) -> None:
            if isinstance(v, dict):
                for x in v.values():
                    walk(x)
            elif isinstance(v, str) and v.startswith("Table: "):
                p = v[7:]
                out.append(p if p.startswith("/") or "://" in p else f"{self.path}/{p}")

        walk(self.getkeywords())
        return out

    def subtable(self, name: str) -> Table:
        value = self.getkeywords().get(name)
        path = value[7:] if isinstance(value, str) and value.startswith("Table: ") else name
        return Table(self.spark, path if path.startswith("/") or "://" in path else f"{self.path}/{path}")

    # locks: writers replace a table at once, so there is nothing to hold
    def lock(self, write: bool = True, nattempts: int = 0) -> None:
        """Has no effect."""

    def unlock(self) -> None:
        """Has no effect."""

    def haslock(self, write: bool = True) -> bool:
        return True

    def ismultiused(self) -> bool:
        return False

    def iswritable(self) -> bool:
        return self.path is not None and store.is_table(self.spark, self.path)

    # writing
    def _writable(self) -> None:
        if not self.iswritable():
            raise TaqlError("a view or a plain Parquet file can't be written")

    def putcol(self, name: str, values: Any, startrow: int = 0, nrow: int = -1) -> None:
        """Values of a range of rows, from a sequence or an array."""
        self._writable()
        cells = list(values)
        lo, hi = self._range(startrow, nrow if nrow >= 0 else len(cells))
        if lo < 0 or (hi or 0) > self.nrows() or len(cells) < (hi or 0) - lo:
            raise ValueError("rows and values don't agree")
        self._put(name, {lo + i: v for i, v in enumerate(cells[: (hi or 0) - lo])})

    def putcell(self, name: str, row: int | Sequence[int], value: Any) -> None:
        self._writable()
        rows = [row] if isinstance(row, (int, np.integer)) else list(row)
        if any(not 0 <= r < self.nrows() for r in rows):
            raise ValueError("no such row")
        self._put(name, dict.fromkeys(rows, value))

    def putvarcol(self, name: str, values: dict[str, Any]) -> None:
        """Cells by ``r`` and row number counted from 1."""
        self._writable()
        self._put(name, {int(k[1:]) - 1: v for k, v in values.items()})

    def putcellslice(self, name: str, row: int, value: Any, blc: list[int], trc: list[int], inc: list[int] | None = None) -> None:
        """Overlay a slice of an array cell."""
        self._writable()
        cell = np.array(self.getcell(name, row))
        steps = inc or [1] * len(blc)
        slices.flat_indices(list(cell.shape), blc, trc, inc)
        cell[tuple(slice(b, t + 1, s) for b, t, s in zip(blc, trc, steps, strict=True))] = value
        self.putcell(name, row, cell)

    def putcolslice(self, name: str, values: Any, blc: list[int], trc: list[int], inc: list[int] | None = None, startrow: int = 0, nrow: int = -1) -> None:
        """Overlay slices of a range of rows, inside the JVM for a fixed shape."""
        self._writable()
        t = self._need(name)
        lo, hi = self._range(startrow, nrow if nrow >= 0 else len(values))
        shape = (self.df().schema[name].metadata or {}).get("shape")
        if not isinstance(t, T.ArrayType) or not shape:
            for i, v in enumerate(values):
                self.putcellslice(name, lo + i, v, blc, trc, inc)
            return
        places, _ = slices.flat_indices([int(s) for s in shape], blc, trc, inc)
        rows = [(lo + i, [spark_value(x, t.elementType) for x in np.asarray(v).ravel()]) for i, v in enumerate(list(values)[: (hi or 0) - lo])]
        staged = self.spark.createDataFrame(rows, T.StructType([T.StructField("__r", T.LongType()), T.StructField("__v", t)]))
        own = self.df().join(staged, F.col(ROWID) == F.col("__r"), "left")
        new = F.when(F.col("__v").isNull(), quoted(name)).otherwise(slices.overlay(quoted(name), places, F.col("__v")))
        meta = self.df().schema[name].metadata or {}
        self._pending = own.withColumn(name, new.cast(t)).withMetadata(name, meta).select(*self.df().columns)

    def _put(self, name: str, cells: dict[int, Any]) -> None:
        t = self._need(name)
        meta = self.df().schema[name].metadata or {}
        if meta.get("shape"):
            size = int(np.prod(meta["shape"]))
            for v in cells.values():
                if np.size(v) != size:
                    raise ValueError(f"{name} has shape {meta['shape']}")
        rows = [(r, spark_value(v, t)) for r, v in cells.items()]
        staged = self.spark.createDataFrame(rows, T.StructType([T.StructField("__r", T.LongType()), T.StructField("__v", t)]))
        own = self.df().join(staged, F.col(ROWID) == F.col("__r"), "left")
        fields = {f.name: f.metadata for f in self.df().schema}
        new = F.when(F.col("__r").isNotNull(), F.col("__v")).otherwise(quoted(name)).alias(name, metadata=fields[name])
        self._pending = own.select(*[new if c == name else quoted(c) for c in self.df().columns])

    def addrows(self, n: int = 1) -> None:
        """Rows of default values at the end."""
        self._writable()
        df, start = self.df(), self.nrows()
        more = store.empty_rows(self.spark, T.StructType([f for f in df.schema if f.name != ROWID]), n)
        self._pending = df.unionByName(more.withColumn(ROWID, F.col(ROWID) + start))

    def removerows(self, rows: int | Sequence[int]) -> None:
        self._writable()
        gone = [rows] if isinstance(rows, (int, np.integer)) else [int(r) for r in rows]
        if any(not 0 <= r < self.nrows() for r in gone):
            raise ValueError("no such row")
        left = self.df().where(~F.col(ROWID).isin(gone))
        self._pending = ordered_number(left, [F.col(ROWID)])

    def addcols(self, desc: dict[str, Any], dminfo: Any = None) -> None:
        """Columns from a description (of a table, or of one column)."""
        self._writable()
        table = {desc["name"]: desc["desc"]} if set(desc) >= {"name", "desc"} else desc
        schema = schema_of(table)
        df = self.df()
        for f in schema:
            if f.name in df.columns:
                raise TaqlError(f"column {f.name} exists")
            df = df.withColumn(f.name, (dml.default_cell(f) if isinstance(f.dataType, T.ArrayType) else default_value(f.dataType)).cast(f.dataType).alias(f.name, metadata=f.metadata))
            df = df.withMetadata(f.name, f.metadata)
        self._edit(lambda m: m["columns"].update({f.name: f.metadata for f in schema}))
        self._edit(lambda m: m["column_keywords"].update({c: d["keywords"] for c, d in table.items() if isinstance(d, dict) and d.get("keywords")}))
        self._pending = df

    def removecols(self, names: str | Sequence[str]) -> None:
        self._writable()
        gone = [names] if isinstance(names, str) else list(names)
        for n in gone:
            self._need(n)
        self._pending = self.df().drop(*gone)
        self._edit(lambda m: [m[p].pop(n, None) for n in gone for p in ("columns", "column_keywords")])

    def renamecol(self, old: str, new: str) -> None:
        self.flush()
        taql(self.spark, f"ALTER TABLE $1 RENAME COLUMN {old} TO {new}", [self])

    def flush(self) -> None:
        """Store what was written."""
        if self._pending is not None and self.path is not None:
            store.save(self.spark, self.path, self._pending)
            self._pending = None

    # copies
    def copy(self, name: str, deep: bool = False, valuecopy: bool = True) -> Table:
        """A table of this table's or view's rows in order; deep: its subtables too."""
        meta = {k: v for k, v in self.meta().items() if k not in ("data", "schema")}
        target = store.clean(name)
        df = self.df().drop(BASE_ROWID)
        store.save(self.spark, target, df, meta)
        if deep and (root := (self.path or (self.base.path if self.base else None))):
            for p in [p for p in Table(self.spark, root).getsubtables() if store.is_table(self.spark, p)]:
                last = p.rstrip("/").rpartition("/")[2]
                Table(self.spark, p).copy(f"{target}/{last}", True)
        return Table(self.spark, target)

    def toascii(self, path: str, columns: Sequence[str] | None = None, sep: str = " ") -> None:
        from .sources.ascii import write_ascii

        write_ascii(self, path, list(columns or self.colnames()), sep)


def host_value(v: Any, t: T.DataType, shape: Any = None) -> Any:
    if v is None:
        return None
    if isinstance(t, T.StructType) and t.fieldNames() == ["re", "im"]:
        return complex(v[0], v[1])
    if isinstance(t, T.StructType) and t.fieldNames() == ["shape", "data"]:
        return np.array([host_value(x, t["data"].dataType.elementType) for x in v[1]]).reshape(v[0])
    if isinstance(t, T.ArrayType):
        out = np.array([host_value(x, t.elementType) for x in v])
        return out.reshape([int(s) for s in shape]) if shape else out
    return v


def spark_value(v: Any, t: T.DataType) -> Any:
    if v is None:
        return None
    if isinstance(t, T.StructType) and t.fieldNames() == ["re", "im"]:
        return (float(np.real(v)), float(np.imag(v)))
    if isinstance(t, T.StructType) and t.fieldNames() == ["shape", "data"]:
        a = np.asarray(v)
        return (list(a.shape), [spark_value(x, t["data"].dataType.elementType) for x in a.ravel()])
    if isinstance(t, T.ArrayType):
        return [spark_value(x, t.elementType) for x in np.asarray(v).ravel()]
    if isinstance(t, T.BooleanType):
        return bool(v)
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return float(v)
    if isinstance(t, T.StringType):
        return str(v)
    return int(v)


def _walk(record: dict[str, Any], name: str) -> Any:
    for part in name.split("."):
        if not isinstance(record, dict) or part not in record:
            raise TaqlError(f"no keyword {name}")
        record = record[part]
    return record


def _put(record: dict[str, Any], name: str, value: Any) -> None:
    *path, last = name.split(".")
    for p in path:
        record = record.setdefault(p, {})
    record[last] = value


def _drop(record: dict[str, Any], name: str) -> None:
    *path, last = name.split(".")
    for p in path:
        record = record.get(p, {})
    if last not in record:
        raise TaqlError(f"no keyword {name}")
    del record[last]


def table_exists(spark: SparkSession, name: str) -> bool:
    return store.is_table(spark, name)


def delete_table(spark: SparkSession, name: str) -> None:
    if not store.is_table(spark, name):
        raise TaqlError(f"no table at {name}")
    Files(spark).delete(store.clean(name))


__all__ = ["Table", "open_table", "create_table", "promoted", "source_of"]
