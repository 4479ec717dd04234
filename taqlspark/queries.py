"""Registered queries: statements over the test tables, and SQL that says what they return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import taql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def statement(name: str, text: str, tables: str, sql: str | None, digits: int | None = None) -> None:
    """Register a statement over tables ($1, $2 ...). digits: decimals to which reals are rounded on both sides."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = taql(spark, text, [f"{sf_dir}/{t}.parquet" for t in tables.split()], ordered=False)
        if digits is not None:
            df = df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])
        return df

    QUERIES[name] = run
    if sql is not None:
        ORACLE_SQL[name] = sql


def rows(table: str) -> str:
    """The table with its row numbers, for SQL."""
    return f"(SELECT *, row_number() OVER () - 1 AS rid FROM {table})"


# The first query end to end.
statement(
    "group_slice",
    "SELECT l_returnflag, GCOUNT() AS n, GSUM(l_quantity) AS q FROM $1 WHERE l_discount > 0.05 GROUPBY l_returnflag ORDERBY l_returnflag",
    "lineitem",
    "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem WHERE l_discount > 0.05 GROUP BY 1",
    2,
)

# Projections, filters, predicates.
_ALL_REGION = "SELECT r_regionkey, r_name FROM region"
statement("select_star", "SELECT * FROM $1", "region", _ALL_REGION)
statement("select_from", "SELECT FROM $1", "region", _ALL_REGION)
statement("select_alias", "SELECT p_size*2 AS twice, p_name, p_retailprice-1. FROM $1", "part", "SELECT p_size*2 AS twice, p_name, round(p_retailprice-1, 4) AS col0 FROM part", 4)
_WHERE = {
    "where_cmp": ("l_quantity > 45 AND l_discount <= 0.02", None),
    "where_not_or": ("NOT (l_returnflag = 'A') || l_tax = 0", "NOT (l_returnflag = 'A') OR l_tax = 0"),
    "where_ops": ("l_quantity >= 30 && l_quantity < 31 & l_tax != 0.01 AND l_tax <> 0.02 AND l_linenumber == 1", "l_quantity >= 30 AND l_quantity < 31 AND l_tax <> 0.01 AND l_tax <> 0.02 AND l_linenumber = 1"),
    "where_truthy": ("l_linenumber - 1 AND !(l_tax)", "l_linenumber - 1 <> 0 AND NOT (l_tax <> 0)"),
    "where_error_false": ("10 / (l_linenumber - 1) > 3", "l_linenumber IN (2, 3, 4) AND l_linenumber <> 1 AND 10 // (l_linenumber - 1) > 3"),
    "where_mixed_types": ("l_returnflag < 5 AND l_returnflag != 3 AND l_quantity = 7", "l_quantity = 7"),
    "where_between": ("l_quantity BETWEEN 10 AND 11", None),
    "where_not_between": ("l_quantity NOT BETWEEN 2 AND 49", None),
    "where_in": ("l_linenumber IN (6, 7) AND l_returnflag IN ['R', 'A']", "l_linenumber IN (6, 7) AND l_returnflag IN ('R', 'A')"),
    "where_not_in": ("l_returnflag NOT IN ('A', 'N') AND l_linenumber NOT IN (1, 2, 3)", None),
    "where_in_exprs": ("l_linenumber IN (l_quantity / 10, 7)", "CAST(l_linenumber AS DOUBLE) IN (l_quantity / 10, 7)"),
}
for _name, (_w, _sql) in _WHERE.items():
    _cols = "l_orderkey, l_linenumber, l_quantity, l_returnflag"
    statement(_name, f"SELECT {_cols} FROM $1 WHERE {_w}", "lineitem", f"SELECT {_cols} FROM lineitem WHERE {_sql or _w}")
_TEXT = {
    "like": ("p_name LIKE '%1%'", None),
    "like_prefix": ("p_name LIKE 'part 1%' OR p_name LIKE 'p%' AND p_size < 5", None),
    "like_underscore": ("p_name LIKE '%_1_'", None),
    "like_escape": ("p_type LIKE '%\\A%' OR p_name LIKE '\\p%7'", "p_type LIKE '%A%' OR p_name LIKE 'p%7'"),
    "ilike": ("p_name ILIKE '%P%9'", None),
    "not_like": ("p_name NOT LIKE '%1%'", None),
    "regex": ("p_name ~ regex('[0-4]$')", "regexp_matches(p_name, '[0-4]$')"),
    "not_regex": ("p_name !~ '[0-4]$'", "NOT regexp_matches(p_name, '[0-4]$')"),
    "pattern": ("p_name ~ pattern('*[1-3]')", "regexp_matches(p_name, '[1-3]$')"),
    "sqlpattern": ("p_type ~ sqlpattern('%E%')", "p_type LIKE '%E%'"),
}
for _name, (_w, _sql) in _TEXT.items():
    statement(_name, f"SELECT p_partkey, p_name, p_type FROM $1 WHERE {_w}", "part", f"SELECT p_partkey, p_name, p_type FROM part WHERE {_sql or _w}")

_EUCLID = "CASE WHEN ({a}) % ({b}) < 0 THEN ({a}) // ({b}) - sign({b}) ELSE ({a}) // ({b}) END"
statement(
    "arith",
    "SELECT l_orderkey/7 AS d, l_orderkey%7 AS m, -l_quantity AS n, l_quantity*l_tax+1 AS f, (3-l_linenumber)/2 AS e, (3-l_linenumber)/-2 AS g, (3-l_linenumber)%2 AS h FROM $1",
    "lineitem",
    f"""SELECT l_orderkey // 7 AS d, l_orderkey % 7 AS m, -l_quantity AS n, round(l_quantity*l_tax+1, 6) AS f,
    CAST({_EUCLID.format(a="3-l_linenumber", b="2")} AS BIGINT) AS e, CAST({_EUCLID.format(a="3-l_linenumber", b="-2")} AS BIGINT) AS g,
    CAST((3-l_linenumber) % 2 AS BIGINT) AS h FROM lineitem""",
    6,
)
statement("float_div_zero", "SELECT l_orderkey, ISINF(l_quantity/l_tax) AS inf, l_quantity/2. AS half, ISNAN(l_tax % 0.) AS nan FROM $1", "lineitem", "SELECT l_orderkey, l_tax = 0 AS inf, l_quantity/2 AS half, true AS nan FROM lineitem", 6)
statement("iif", "SELECT l_orderkey, IIF(l_quantity > 25, 'big', 'small') AS size, IIF(l_tax, 1, 0.5) AS w FROM $1", "lineitem", "SELECT l_orderkey, CASE WHEN l_quantity > 25 THEN 'big' ELSE 'small' END AS size, CASE WHEN l_tax <> 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS w FROM lineitem")
statement("index", "SELECT vec_id, embedding[0] AS a, embedding[-1] AS z, embedding[999] AS none FROM $1", "embeddings", "SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS a, round(embedding[64]::DOUBLE, 6) AS z, 0.0::DOUBLE AS none FROM embeddings", 6)

# Sorting, limits, distinct rows.
_LI = "rid, l_orderkey, l_quantity, l_tax"
_LQ = "ROWID() AS rid, l_orderkey, l_quantity, l_tax"
statement("orderby_limit_offset", f"SELECT {_LQ} FROM $1 ORDERBY l_returnflag, l_quantity LIMIT 50 OFFSET 10", "lineitem", f"SELECT {_LI} FROM {rows('lineitem')} ORDER BY l_returnflag, l_quantity, rid LIMIT 50 OFFSET 10")
statement("orderby_desc_tie", f"SELECT {_LQ} FROM $1 ORDERBY DESC l_quantity, l_tax LIMIT 40", "lineitem", f"SELECT {_LI} FROM {rows('lineitem')} ORDER BY l_quantity DESC, rid DESC LIMIT 40")
statement("order_by_words", f"SELECT {_LQ} FROM $1 ORDER BY l_tax ASC, l_orderkey DESC, l_quantity LIMIT 60", "lineitem", f"SELECT {_LI} FROM {rows('lineitem')} ORDER BY l_tax, l_orderkey DESC, rid DESC LIMIT 60")
statement("limit_only", f"SELECT {_LQ} FROM $1 OFFSET 100 LIMIT 30", "lineitem", f"SELECT {_LI} FROM {rows('lineitem')} ORDER BY rid LIMIT 30 OFFSET 100")
statement("orderby_expr", f"SELECT {_LQ} FROM $1 ORDERBY l_quantity*-1, l_orderkey%10 LIMIT 25", "lineitem", f"SELECT {_LI} FROM {rows('lineitem')} ORDER BY l_quantity*-1, l_orderkey%10, rid LIMIT 25")
statement("orderby_all", "SELECT ROWID() AS rid, o_orderkey, o_totalprice FROM $1 ORDERBY o_totalprice", "orders", f"SELECT rid, o_orderkey, o_totalprice FROM {rows('orders')}")
statement("unique", "SELECT UNIQUE l_returnflag, l_linestatus FROM $1", "lineitem", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
statement("unique_after_limit", "SELECT UNIQUE l_linenumber FROM $1 LIMIT 5", "lineitem", f"SELECT DISTINCT l_linenumber FROM (SELECT * FROM {rows('lineitem')} ORDER BY rid LIMIT 5)")
statement("unique_ordered", "SELECT UNIQUE o_orderstatus, o_orderpriority FROM $1 ORDERBY o_totalprice DESC", "orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
statement("rowid", "SELECT ROWID() AS r, ROWNUMBER() AS s, rowid AS t FROM $1 WHERE l_quantity = 1", "lineitem", f"SELECT rid AS r, rid AS s, rid AS t FROM {rows('lineitem')} WHERE l_quantity = 1")

# Groups. One query per aggregate.
_GROUPS = {
    "gcount": ("GCOUNT()", "count(*)"),
    "gmin": ("GMIN(l_quantity)", "min(l_quantity)"),
    "gmax": ("GMAX(l_linenumber)", "CAST(max(l_linenumber) AS BIGINT)"),
    "gsum": ("GSUM(l_linenumber)", "CAST(sum(l_linenumber) AS BIGINT)"),
    "gsumsqr": ("GSUMSQR(l_linenumber)", "CAST(sum(l_linenumber*l_linenumber) AS BIGINT)"),
    "gproduct": ("GPRODUCT(l_tax+1)", "product(l_tax+1)"),
    "gmean": ("GMEAN(l_quantity)", "avg(l_quantity)"),
    "gavg": ("GAVG(l_linenumber)", "avg(l_linenumber)"),
    "gvariance": ("GVARIANCE(l_quantity)", "var_pop(l_quantity)"),
    "gstddev": ("GSTDDEV(l_quantity)", "stddev_pop(l_quantity)"),
    "grms": ("GRMS(l_quantity)", "sqrt(avg(l_quantity*l_quantity))"),
    "gmedian": ("GMEDIAN(l_extendedprice)", "quantile_cont(l_extendedprice, 0.5)"),
    "gfractile": ("GFRACTILE(l_extendedprice, 0.9)", "quantile_cont(l_extendedprice, 0.9)"),
    "gfirst": ("GFIRST(l_orderkey)", "arg_min(l_orderkey, rid)"),
    "glast": ("GLAST(l_extendedprice)", "arg_max(l_extendedprice, rid)"),
    "gany": ("GANY(l_tax > 0.07)", "bool_or(l_tax > 0.07)"),
    "gall": ("GALL(l_quantity)", "bool_and(l_quantity <> 0)"),
    "gntrue": ("GNTRUE(l_tax)", "count(*) FILTER (WHERE l_tax <> 0)"),
    "gnfalse": ("GNFALSE(l_tax)", "count(*) FILTER (WHERE l_tax = 0)"),
    "first_of_column": ("l_extendedprice", "arg_min(l_extendedprice, rid)"),
    "nelements_gaggr": ("NELEMENTS(GAGGR(l_tax))", "count(*)"),
    "growid_first": ("GROWID()[0]", "min(rid)"),
    "growid_last": ("GROWID()[-1]", "max(rid)"),
    "gaggr_third": ("GAGGR(l_orderkey)[2]", "list(l_orderkey ORDER BY rid)[3]"),
    "over_aggregates": ("GSUM(l_quantity)/GCOUNT()*2", "sum(l_quantity)/count(*)*2"),
}
for _name, (_t, _s) in _GROUPS.items():
    _digits = 4 if _name not in ("gsum", "gsumsqr") else 2  # medians and means may end in a 5 at the third place
    _as = f"round({_s}, {_digits})" if _name not in ("gany", "gall") else _s
    if _name == "gproduct":  # of a few rows, as a product of thousands leaves the reals
        statement("group_gproduct", "SELECT l_orderkey AS k, GPRODUCT(l_tax+1) AS v FROM $1 GROUPBY l_orderkey", "lineitem", "SELECT l_orderkey AS k, round(product(l_tax+1), 6) AS v FROM lineitem GROUP BY 1", 6)
        continue
    statement(f"group_{_name}", f"SELECT l_returnflag AS k, {_t} AS v FROM $1 GROUPBY l_returnflag", "lineitem", f"SELECT l_returnflag AS k, {_as} AS v FROM {rows('lineitem')} GROUP BY 1", _digits)
statement("group_gaggr", "SELECT l_orderkey, GAGGR(l_linenumber) AS a, GROWID() AS r FROM $1 GROUPBY l_orderkey", "lineitem", f"SELECT l_orderkey, list(l_linenumber::BIGINT ORDER BY rid) AS a, list(rid ORDER BY rid) AS r FROM {rows('lineitem')} GROUP BY 1")
statement("group_having_order", "SELECT o_custkey, GCOUNT() AS n FROM $1 GROUPBY o_custkey HAVING GCOUNT()>3 ORDERBY o_custkey LIMIT 20", "orders", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*)>3 ORDER BY 1 LIMIT 20")
statement("group_first_appearance", "SELECT l_linenumber, GCOUNT() AS n FROM $1 GROUPBY l_linenumber LIMIT 3", "lineitem", f"SELECT l_linenumber, count(*) AS n FROM {rows('lineitem')} GROUP BY 1 ORDER BY min(rid) LIMIT 3")
statement("group_expr", "SELECT l_orderkey % 10 AS k, GSUM(l_quantity) AS q, GMAX(l_tax) AS t FROM $1 GROUPBY l_orderkey % 10", "lineitem", "SELECT l_orderkey % 10 AS k, round(sum(l_quantity), 2) AS q, max(l_tax) AS t FROM lineitem GROUP BY 1", 2)
statement("group_many_keys", "SELECT l_returnflag, l_linestatus, GSUM(l_extendedprice*(1.-l_discount)) AS revenue, GMEAN(l_quantity) AS q FROM $1 GROUPBY l_returnflag, l_linestatus", "lineitem", "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice*(1-l_discount)), 4) AS revenue, round(avg(l_quantity), 4) AS q FROM lineitem GROUP BY 1, 2", 4)
statement("group_having_only", "SELECT o_orderpriority FROM $1 GROUPBY o_orderpriority HAVING GMEAN(o_totalprice) > 10 AND GMIN(o_orderkey) < 100", "orders", "SELECT o_orderpriority FROM orders GROUP BY 1 HAVING avg(o_totalprice) > 10 AND min(o_orderkey) < 100")
statement("aggregate_all", "SELECT GCOUNT() AS n, GMAX(o_totalprice) AS m FROM $1", "orders", "SELECT count(*) AS n, max(o_totalprice) AS m FROM orders")
statement("count_cmd", "COUNT * FROM $1 WHERE l_quantity < 10", "lineitem", "SELECT count(*) AS count FROM lineitem WHERE l_quantity < 10")

# Mathematical, string, date, complex and array functions.
_X, _I = "l_extendedprice", "l_linenumber"
_MATH = {
    "pi_e_c": ("PI()+E()+C()", "pi()+exp(1)+299792458.0"),
    "abs": ("ABS(l_tax-0.05)", "abs(l_tax-0.05)"),
    "norm": ("NORM(COMPLEX(l_tax,l_discount))", "sqrt(l_tax*l_tax+l_discount*l_discount)"),
    "sign": ("SIGN(l_tax-0.04)", "CAST(sign(l_tax-0.04) AS BIGINT)"),
    "square": ("SQUARE(l_quantity)+SQR(3)", "l_quantity*l_quantity+9"),
    "cube": ("CUBE(l_linenumber)", "CAST(l_linenumber*l_linenumber*l_linenumber AS BIGINT)"),
    "int": ("INT(l_extendedprice)", "CAST(trunc(l_extendedprice) AS BIGINT)"),
    "floor_ceil": ("FLOOR(l_extendedprice)*2+CEIL(-l_extendedprice)", "floor(l_extendedprice)*2+ceil(-l_extendedprice)"),
    "round": ("ROUND(l_extendedprice*0.01)", "round(l_extendedprice*0.01)"),
    "roots": ("SQRT(l_quantity)+CBRT(l_quantity)", "sqrt(l_quantity)+cbrt(l_quantity)"),
    "exp_log": ("EXP(l_tax)+LN(l_quantity)+LOG(l_quantity)+LOG10(l_quantity)", "exp(l_tax)+2*ln(l_quantity)+log10(l_quantity)"),
    "log_edges": ("IIF(ISINF(LN(l_tax)),1,0)+IIF(ISNAN(LN(-l_quantity)),10,0)", "CAST(CASE WHEN l_tax=0 THEN 1 ELSE 0 END+10 AS BIGINT)"),
    "trig": ("SIN(l_tax)+COS(l_tax)+TAN(l_tax)", "sin(l_tax)+cos(l_tax)+tan(l_tax)"),
    "arc": ("ASIN(l_tax)+ACOS(l_tax)+ATAN(l_tax)+ATAN2(l_tax,l_quantity)", "asin(l_tax)+acos(l_tax)+atan(l_tax)+atan2(l_tax,l_quantity)"),
    "hyperbolic": ("SINH(l_tax)+COSH(l_tax)+TANH(l_tax)", "sinh(l_tax)+cosh(l_tax)+tanh(l_tax)"),
    "pow_fmod": ("POW(l_quantity,1.5)+FMOD(-l_extendedprice,7)", "pow(l_quantity,1.5)+(-l_extendedprice) % 7"),
    "tests": ("IIF(ISFINITE(l_tax) AND NOT ISNAN(l_tax) AND NOT ISINF(l_tax),1,0)", "CAST(1 AS BIGINT)"),
    "null_tests": ("IIF(ISNULL(l_tax),1,0)+IIF(ISDEFINED(l_tax),2,0)+IIF(ISCOLUMN(l_tax),4,0)+IIF(ISCOLUMN(nope),8,0)+IIF(ISKEYWORD(k),16,0)", "CAST(6 AS BIGINT)"),
    "complex": ("REAL(COMPLEX(l_tax,l_quantity))+IMAG(CONJ(COMPLEX(l_tax,l_quantity)))+AMPL(COMPLEX(l_tax,1))+PHASE(COMPLEX(l_tax,1))", "l_tax-l_quantity+sqrt(l_tax*l_tax+1)+atan2(1,l_tax)"),
}
for _name, (_t, _s) in _MATH.items():
    statement(f"math_{_name}", f"SELECT l_orderkey, l_linenumber, {_t} AS v FROM $1", "lineitem", f"SELECT l_orderkey, l_linenumber, round({_s}, 5) AS v FROM lineitem" if "BIGINT" not in _s else f"SELECT l_orderkey, l_linenumber, {_s} AS v FROM lineitem", 5)

_STRINGS = {
    "length": ("STRLENGTH(p_name)", "CAST(length(p_name) AS BIGINT)"),
    "upper_lower": ("UPCASE(p_name)", "upper(p_name)"),
    "lower": ("TOLOWER(p_brand)", "lower(p_brand)"),
    "capitalize": ("CAPITALIZE(p_type)", "upper(p_type[1]) || lower(p_type[2:])"),
    "reverse": ("SREVERSE(p_name)", "reverse(p_name)"),
    "trim": ("TRIM(REPLACE(p_name, 'part', '  '))", "trim(replace(p_name, 'part', '  '))"),
    "ltrim": ("LTRIM(p_brand, 'Brand#')", "ltrim(p_brand, 'Brand#')"),
    "rtrim": ("RTRIM(p_name, '0123456789')", "rtrim(p_name, '0123456789')"),
    "substr": ("SUBSTR(p_name, 1, 3)", "substr(p_name, 2, 3)"),
    "substr_end": ("SUBSTR(p_name, -3)", "right(p_name, 3)"),
    "replace": ("REPLACE(p_name, 'a', 'oo')", "replace(p_name, 'a', 'oo')"),
    "str_int": ("STR(p_size)", "CAST(p_size AS VARCHAR)"),
    "str_float": ("STR(p_size/4.)", "CASE WHEN p_size % 4 = 0 THEN CAST(p_size // 4 AS VARCHAR) ELSE CAST(p_size/4 AS VARCHAR) END"),
    "hms": ("HMS(p_size*PI()/60)", "lpad(CAST(p_size*12//60 AS VARCHAR), 2, '0') || 'h' || lpad(CAST(p_size*12 % 60 AS VARCHAR), 2, '0') || 'm00.000'"),
}
for _name, (_t, _s) in _STRINGS.items():
    if _name != "hms":
        statement(f"string_{_name}", f"SELECT p_partkey, {_t} AS v FROM $1", "part", f"SELECT p_partkey, {_s} AS v FROM part")
statement("string_dms", "SELECT UNIQUE DMS(0), HMS(PI()/2), DMS(-PI()/2) AS d FROM $1", "region", "SELECT '+000d00m00.000' AS col0, '06h00m00.000' AS col1, '-090d00m00.000' AS d")

_MJD = "(date_diff('day', DATE '1858-11-17', CAST(o_orderdate AS DATE)) + (hour(o_orderdate)*3600+minute(o_orderdate)*60+second(o_orderdate))/86400.0)"
_DAY = "CAST(o_orderdate AS DATE)"
_DATES = {
    "mjd": ("MJD(o_orderdate)", f"round({_MJD}, 5)"),
    "date": ("DATE(o_orderdate)", f"floor({_MJD})"),
    "time": ("TIME(o_orderdate+0.25)", f"round((({_MJD}+0.25)-floor({_MJD}+0.25))*2*pi(), 5)"),
    "year": ("YEAR(o_orderdate)", f"year({_DAY})"),
    "month": ("MONTH(o_orderdate)", f"month({_DAY})"),
    "day": ("DAY(o_orderdate)", f"day({_DAY})"),
    "weekday": ("WEEKDAY(o_orderdate)", f"isodow({_DAY})"),
    "cmonth": ("CMONTH(o_orderdate)", f"strftime({_DAY}, '%b')"),
    "cweekday": ("CDOW(o_orderdate)", f"strftime({_DAY}, '%a')"),
    "week": ("WEEK(o_orderdate)", f"(dayofyear({_DAY}) - isodow({_DAY}) + 10) // 7"),
    "cdate": ("CDATE(o_orderdate)", f"strftime({_DAY}, '%d-%b-%Y')"),
    "ctime": ("CTIME(o_orderdate)", "strftime(o_orderdate, '%H:%M:%S.%g')"),
    "ctod": ("CTOD(o_orderdate)", "strftime(o_orderdate, '%Y/%m/%d/%H:%M:%S.%g')"),
    "parse": ("MJD('2000-01-01T12:00:00')+MJD('1999/12/31')+o_orderkey", "CAST(51544.5+51543+o_orderkey AS DOUBLE)"),
}
for _name, (_t, _s) in _DATES.items():
    statement(f"date_{_name}", f"SELECT o_orderkey, {_t} AS v FROM $1", "orders", f"SELECT o_orderkey, {_s} AS v FROM orders", 5)

_E = "CAST(embedding AS DOUBLE[])"
_ARRAYS = {
    "shape_ndim": ("SHAPE(embedding)[0]+NDIM(embedding)+NELEMENTS(embedding)", "CAST(2*len(embedding)+1 AS BIGINT)"),
    "sum": ("SUM(embedding)", f"list_sum({_E})"),
    "product": ("PRODUCT(ARRAY(vec_id%7,2,3))", "CAST((vec_id%7)*6 AS BIGINT)"),
    "sumsqr": ("SUMSQR(embedding)", f"list_sum(list_transform({_E}, lambda x: x*x))"),
    "min": ("MIN(embedding)", f"list_min({_E})"),
    "max": ("MAX(embedding)", f"list_max({_E})"),
    "mean": ("MEAN(embedding)", f"list_avg({_E})"),
    "variance": ("VARIANCE(embedding)", f"list_var_pop({_E})"),
    "stddev": ("STDDEV(embedding)", f"list_stddev_pop({_E})"),
    "samplevariance": ("SAMPLEVARIANCE(embedding)", f"list_var_samp({_E})"),
    "samplestddev": ("SAMPLESTDDEV(embedding)", f"list_stddev_samp({_E})"),
    "avdev": ("AVDEV(embedding)", f"list_avg(list_transform({_E}, lambda x: abs(x - list_avg({_E}))))"),
    "rms": ("RMS(embedding)", f"sqrt(list_avg(list_transform({_E}, lambda x: x*x)))"),
    "median": ("MEDIAN(embedding)", f"list_median({_E})"),
    "fractile": ("FRACTILE(embedding,0.25)", f"list_aggregate({_E}, 'quantile_cont', 0.25)"),
    "any_all": ("IIF(ANY(embedding),1,0)+IIF(ALL(embedding),2,0)", f"CAST(CASE WHEN list_bool_or(list_transform({_E}, lambda x: x <> 0)) THEN 1 ELSE 0 END + CASE WHEN list_bool_and(list_transform({_E}, lambda x: x <> 0)) THEN 2 ELSE 0 END AS BIGINT)"),
    "ntrue": ("NTRUE(embedding)*100+NFALSE(embedding)", f"CAST(len(list_filter({_E}, lambda x: x <> 0))*100+len(list_filter({_E}, lambda x: x = 0)) AS BIGINT)"),
    "reverse": ("AREVERSE(embedding)[0]+TRANSPOSE(embedding)[1]", f"{_E}[64]+{_E}[2]"),
    "flatten": ("NELEMENTS(FLATTEN(embedding,ARRAY(1,2)))", "CAST(len(embedding)+2 AS BIGINT)"),
    "sums": ("SUM(SUMS(embedding,embedding,1))", f"2*list_sum({_E})+64"),
    "means": ("MEANS(embedding,AREVERSE(embedding))[3]", f"({_E}[4]+{_E}[61])/2"),
    "maxs": ("SUM(MAXS(embedding,0))", f"list_sum(list_transform({_E}, lambda x: greatest(x, 0)))"),
    "fractiles": ("FRACTILES(embedding,0,1,0.5)[0]", f"list_median([{_E}[1],0,1])"),
    "runningsum": ("RUNNINGSUM(embedding)[9]", f"list_sum({_E}[1:10])"),
    "boxedmean": ("BOXEDMEAN(embedding)[4]", f"list_avg({_E}[1:5])"),
    "runningmax": ("RUNNINGMAX(embedding)[63]", f"list_max({_E})"),
}
for _name, (_t, _s) in _ARRAYS.items():
    statement(f"array_{_name}", f"SELECT vec_id, {_t} AS v FROM $1", "embeddings", f"SELECT vec_id, {_s if 'BIGINT' in _s else f'round({_s}, 5)'} AS v FROM embeddings", 5)

# Each statistic across arrays (with a scalar among them), and of prefixes under both names.
_SQL_STATISTICS = {
    "SUM": "list_sum({l})",
    "PRODUCT": "list_product({l})",
    "SUMSQR": "list_sum(list_transform({l}, lambda x: x*x))",
    "MIN": "list_min({l})",
    "MAX": "list_max({l})",
    "MEAN": "list_avg({l})",
    "AVG": "list_avg({l})",
    "VARIANCE": "list_var_pop({l})",
    "SAMPLEVARIANCE": "list_var_samp({l})",
    "STDDEV": "list_stddev_pop({l})",
    "SAMPLESTDDEV": "list_stddev_samp({l})",
    "AVDEV": "list_avg(list_transform({l}, lambda x: abs(x - list_avg({l}))))",
    "RMS": "sqrt(list_avg(list_transform({l}, lambda x: x*x)))",
    "MEDIAN": "list_median({l})",
    "ANY": "list_bool_or(list_transform({l}, lambda x: x <> 0))",
    "ALL": "list_bool_and(list_transform({l}, lambda x: x <> 0))",
    "NTRUE": "CAST(len(list_filter({l}, lambda x: x <> 0)) AS BIGINT)",
    "NFALSE": "CAST(len(list_filter({l}, lambda x: x = 0)) AS BIGINT)",
}
_THREE, _PREFIX = f"[{_E}[4], {_E}[61], 2.0::DOUBLE]", f"{_E}[1:6]"
for _name, _s in _SQL_STATISTICS.items():
    _whole = _name in ("ANY", "ALL", "NTRUE", "NFALSE")
    for _query, _t, _list in (
        (f"array_plural_{_name.lower()}", f"{_name}S(embedding, AREVERSE(embedding), 2)[3]", _THREE),
        (f"array_running_{_name.lower()}", f"RUNNING{_name}(embedding)[5]", _PREFIX),
        (f"array_boxed_{_name.lower()}", f"BOXED{_name}(embedding)[5]", _PREFIX),
    ):
        _sql = _s.format(l=_list)
        statement(_query, f"SELECT vec_id, {_t} AS v FROM $1", "embeddings", f"SELECT vec_id, {_sql if _whole else f'round({_sql}, 5)'} AS v FROM embeddings", 5)
statement("array_hdms", "SELECT vec_id, HDMS(ARRAY(0, PI()/2, -PI()/2))[1] AS v, NELEMENTS(HDMS(embedding)) AS n FROM $1", "embeddings", "SELECT vec_id, '+090d00m00.000' AS v, CAST(64 AS BIGINT) AS n FROM embeddings")
statement("complex_parts", "SELECT l_orderkey, l_linenumber, ARG(CONJ(COMPLEX(l_tax, l_quantity))) AS a, AMPLITUDE(FORMCOMPLEX(l_tax, l_quantity)) AS m, COMPLEX(l_tax, 1)[1] AS i, COMPLEX(l_tax, 0.) = COMPLEX(0.05, 0.) AS same FROM $1", "lineitem", "SELECT l_orderkey, l_linenumber, round(atan2(-l_quantity, l_tax), 6) AS a, round(sqrt(l_tax*l_tax+l_quantity*l_quantity), 6) AS m, 1.0::DOUBLE AS i, l_tax = 0.05 AS same FROM lineitem", 6)
statement("precedence", "SELECT l_orderkey, l_linenumber, l_linenumber + 2 * 3 - -l_linenumber % 2 AS v, l_linenumber > 2 OR l_linenumber = 1 AND l_tax > 0.05 AS w, NOT l_linenumber = 3 AS x FROM $1", "lineitem", "SELECT l_orderkey, l_linenumber, CAST(l_linenumber + 6 - ((-l_linenumber) % 2) AS BIGINT) AS v, l_linenumber > 2 OR (l_linenumber = 1 AND l_tax > 0.05) AS w, l_linenumber <> 3 AS x FROM lineitem")
statement("literals", "SELECT UNIQUE 1. AS a, 1e3 AS b, 'it''s' AS c, TRUE AS d, .5 AS e, 42 AS f FROM $1", "region", "SELECT 1.0::DOUBLE AS a, 1000.0::DOUBLE AS b, 'it''s' AS c, true AS d, 0.5::DOUBLE AS e, CAST(42 AS BIGINT) AS f")
statement("event_times", "SELECT event_id, MJD(ts) AS m, CDATE(ts) AS t, value FROM $1 WHERE event_type = 'click' ORDERBY ts DESC LIMIT 100", "events", f"SELECT event_id, round(date_diff('day', DATE '1858-11-17', CAST(ts AS DATE)) + (hour(ts)*3600+minute(ts)*60+second(ts)+(microsecond(ts)%1000000)/1e6)/86400.0, 6) AS m, strftime(ts, '%d-%b-%Y') AS t, round(value, 6) AS value FROM {rows('events')} WHERE event_type = 'click' ORDER BY ts DESC, rid DESC LIMIT 100", 6)

# Row lookups, the only operator over two tables.
statement("lookup_subquery", "SELECT c_custkey, [SELECT n_name FROM $2][c_nationkey] AS nation FROM $1", "customer nation", f"SELECT c_custkey, n_name AS nation FROM customer JOIN {rows('nation')} ON rid = c_nationkey")
statement("lookup_where", "SELECT c_custkey FROM $1 WHERE [SELECT n_regionkey FROM $2][c_nationkey] = 2", "customer nation", f"SELECT c_custkey FROM customer JOIN {rows('nation')} ON rid = c_nationkey WHERE n_regionkey = 2")
statement("lookup_missing", "SELECT c_custkey, [SELECT n_regionkey FROM $2 LIMIT 5][c_nationkey] AS r FROM $1", "customer nation", "SELECT c_custkey, CAST(CASE WHEN c_nationkey < 5 THEN n_regionkey ELSE 0 END AS BIGINT) AS r FROM customer JOIN nation ON n_nationkey = c_nationkey")
statement("lookup_nested", "SELECT c_custkey, [SELECT r_name FROM $3][[SELECT n_regionkey FROM $2][c_nationkey]] AS region FROM $1", "customer nation region", "SELECT c_custkey, r_name AS region FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
statement("lookup_group", "SELECT [SELECT n_name FROM $2][c_nationkey] AS nation, GCOUNT() AS n, GMEAN(c_acctbal) AS b FROM $1 GROUPBY c_nationkey", "customer nation", "SELECT n_name AS nation, count(*) AS n, round(avg(c_acctbal), 6) AS b FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1", 6)
statement("calc", "CALC l_quantity*2, STR(l_linenumber) FROM $1", "lineitem", f"SELECT l_quantity*2 AS col0, CAST(l_linenumber AS VARCHAR) AS col1 FROM {rows('lineitem')} WHERE rid = 0")
