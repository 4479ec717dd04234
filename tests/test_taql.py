"""The query language on a five-row table."""

import math

import pytest

from taqlspark.engine import taql
from taqlspark.plans.parser import parse
from taqlspark.streaming import taql_stream
from taqlspark.types import TaqlError


def run(spark, text, *tables):
    return [tuple(r) for r in taql(spark, text, list(tables)).collect()]


ROWS = {
    "ORDERBY ANT": [2, 0, 4, 1, 3],
    "ORDERBY ANT, VAL": [2, 4, 0, 1, 3],
    "ORDERBY VAL DESC": [2, 0, 3, 1, 4],
    "ORDERBY DESC VAL, ANT ASC": [2, 0, 3, 1, 4],
    "ORDER BY VAL": [4, 1, 3, 0, 2],
    "WHERE VAL > 2.0": [0, 2],
    "WHERE ANT = 2 AND VAL <= 2.0": [1, 3],
    "WHERE NAME != 'c' ORDERBY WHAT DESC": [4, 3, 1, 0],
    "WHERE VAL BETWEEN 1 AND 2": [1, 3, 4],
    "WHERE VAL NOT BETWEEN 1 AND 2": [0, 2],
    "ORDERBY ANT LIMIT 2 OFFSET 1": [0, 4],
    "WHERE NAME LIKE '%c%'": [2],
    "WHERE NAME ~ regex('[b-d]')": [1, 2, 3],
    "WHERE NAME ~ pattern('*e')": [4],
    "WHERE 10/ANT > 5": [0, 4],  # a zero divisor is no match
    "WHERE NAME < 3": [0, 1, 2, 3, 4],
    "WHERE NAME ILIKE 'C'": [2],
    "WHERE ANT IN (0, 2)": [1, 2, 3],
    "WHERE NOT ANT": [2],
    "WHERE NAME ~ regex('(')": [],
    "WHERE ROWID() % 2 = 1": [1, 3],
}


@pytest.mark.parametrize("clauses", ROWS)
def test_rows(spark, probe, clauses):
    assert [r[0] for r in run(spark, f"SELECT ROWID() FROM $1 {clauses}", probe)] == ROWS[clauses]


VALUES = {
    "SUBSTR('abcdef',1,3)": "bcd", "SUBSTR('abcdef',2)": "cdef", "SUBSTR('abcdef',-3)": "def", "SUBSTR('',0)": "", "SUBSTR('abc',2,1)": "",
    "WEEK(51544)": 0, "WEEK(58849)": 1, "DOW(0)": 3, "CDATE(51544)": "01-Jan-2000", "CTOD(51544.5)": "2000/01/01/12:00:00.000",
    "HMS(PI()/2)": "06h00m00.000", "DMS(PI()/2)": "+090d00m00.000", "MJD('2000-01-01 12:00:00')": 51544.5, "TIME(51544.25)": math.pi / 2,
    "RUNNINGMIN(ARRAY(3,1,2))": [3, 1, 1], "BOXEDMEAN(ARRAY(1.,2.,3.,4.))": [1.0, 1.5, 2.0, 2.5], "SUMS(ARRAY(1,2,3),ARRAY(10,20,30))": [11, 22, 33],
    "-7/2": -4, "-7/-2": 4, "7/-2": -3, "-7%2": -1, "7/2": 3, "7./0": math.inf, "STR(2.0)": "2", "STR(1e20)": "100000000000000000000", "STR(0.1)": "0.1",
    "CAPITALIZE('hELLO wORLD')": "Hello world", "ROUND(-2.5)": -3.0, "ROUND(2.5)": 3.0, "TRIM('  x ')": "x", "LTRIM('xxyx','x')": "yx", "UPCASE('aé')": "Aé",
    "MEDIAN(ARRAY(3,1,2,4))": 2.5, "AMPL(COMPLEX(3,4))": 5.0, "ISCOLUMN(ANT)": True, "ARRAY(1,2,3)[-1]": 3, "ARRAY(1,2,3)[7]": 0, "MIN(ARRAY(3,1),2)": 1,
    "CUBE(3000000)": 2**63 - 1, "INT(-2.7)": -2, "FLOOR(-2.5)": -3.0, "SIGN(-3)": -1, "FMOD(-7,3)": -1.0, "LN(0)": -math.inf, "STRLENGTH('é')": 1,
    "IIF(1 > 2, 1, 2.5)": 2.5, "NELEMENTS('abc')": 3, "SHAPE(ARRAY(1,2))": [2], "VARIANCE(ARRAY(1,3))": 1.0, "SAMPLEVARIANCE(ARRAY(5))": 0.0,
    "ALL(ARRAY(1,0))": False, "NTRUE(ARRAY(1,0,2))": 2, "FRACTILE(ARRAY(1,2,3,4,5),0.25)": 2.0, "'it''s'": "it's", "TRUE": True,
}


def test_values(spark, probe):
    got = run(spark, f"CALC {', '.join(VALUES)} FROM $1", probe)[0]
    assert dict(zip(VALUES, got, strict=True)) == VALUES


def test_groups(spark, probe):
    assert run(spark, "SELECT ANT, GCOUNT() AS n, GROWID()[0] AS f, GAGGR(WHAT) AS w FROM $1 GROUPBY ANT", probe) == [(1, 2, 0, [10, 50]), (2, 2, 1, [20, 40]), (0, 1, 2, [30])]
    assert run(spark, "SELECT GMIN(WHAT),GMAX(WHAT),GSUM(WHAT),GMEAN(WHAT),GMEDIAN(WHAT),GSUMSQR(WHAT) FROM $1 GROUPBY ANT", probe) == [
        (10, 50, 60, 30.0, 30.0, 2600), (20, 40, 60, 30.0, 30.0, 2000), (30, 30, 30, 30.0, 30.0, 900)]
    assert run(spark, "SELECT GFRACTILE(VAL,0.5) FROM $1 WHERE ANT=1 GROUPBY ANT", probe) == [(3.25,)]
    assert run(spark, "SELECT ANT FROM $1 GROUPBY ANT HAVING GCOUNT() > 1", probe) == [(1,), (2,)]
    assert run(spark, "SELECT NAME FROM $1 GROUPBY ANT ORDERBY GSUM(WHAT) DESC, ANT", probe) == [("b",), ("a",), ("c",)]
    assert run(spark, "SELECT GCOUNT() FROM $1 WHERE ANT > 7", probe) == []


def test_unique_and_lookup(spark, probe):
    assert run(spark, "SELECT UNIQUE ANT FROM $1", probe) == [(1,), (2,), (0,)]
    assert run(spark, "SELECT UNIQUE ANT FROM $1 LIMIT 2", probe) == [(1,), (2,)]
    assert run(spark, "SELECT UNIQUE ANT FROM $1 ORDERBY WHAT DESC", probe) == [(1,), (2,), (0,)]
    assert run(spark, "SELECT [SELECT NAME FROM $2][ANT] FROM $1", probe, probe) == [("b",), ("c",), ("a",), ("c",), ("b",)]
    assert run(spark, "SELECT [SELECT NAME FROM $2 ORDERBY WHAT DESC][ANT+3] FROM $1", probe, probe) == [("a",), ("",), ("b",), ("",), ("a",)]
    assert run(spark, "COUNT * FROM $1 WHERE ANT=1", probe) == [(2,)]
    assert taql(spark, "SELECT ANT+1, NAME, VAL*2 FROM $1", [probe]).columns == ["col0", "NAME", "col1"]


def test_writes(spark, probe, tmp_path):
    t = f"{tmp_path}/t"
    taql(spark, f"SELECT * INTO {t} FROM $1", [probe])
    taql(spark, f"UPDATE {t} SET WHAT=WHAT*10 WHERE ANT=2")
    assert run(spark, "SELECT WHAT FROM $1", t) == [(10,), (200,), (30,), (400,), (50,)]
    taql(spark, "UPDATE $1 SET WHAT=VAL, VAL=WHAT LIMIT 1", [t])
    assert run(spark, "SELECT WHAT,VAL FROM $1 LIMIT 1", t) == [(5, 10.0)]
    taql(spark, "DELETE FROM $1 WHERE ANT=1", [t])
    assert run(spark, "SELECT ROWID(),ANT FROM $1", t) == [(0, 2), (1, 0), (2, 2)]
    taql(spark, "INSERT INTO $1 (ANT,NAME) SELECT WHAT,NAME FROM $2 WHERE WHAT<30", [t, probe])
    assert run(spark, "SELECT ROWID(),ANT,WHAT,NAME FROM $1 OFFSET 3", t) == [(3, 10, 0, "a"), (4, 20, 0, "b")]
    taql(spark, f"ALTER TABLE {t} ADD COLUMN X R8 COMMENT='hi', DROP COLUMN VAL, RENAME COLUMN NAME TO N, SET kw=3")
    assert [r[0] for r in run(spark, f"SHOW TABLE {t}")] == ["ANT", "WHAT", "N", "X"]
    taql(spark, f"CREATE TABLE {t}2 [A I4, B R4 SHAPE=[2,3], S S, V R4 NDIM=1] KEYWORDS q='z' LIMIT 3")
    assert run(spark, f"SELECT * FROM {t}2") == [(0, [0.0] * 6, "", None)] * 3
    taql(spark, f"DROPTABLE {t}2")
    with pytest.raises(TaqlError):
        taql(spark, f"SELECT * FROM {t}2").collect()


@pytest.mark.parametrize(
    "text",
    ["SELECT", "SELECT a FROM", "SELECT a b FROM $1", "SELECT nope FROM $1", "SELECT FOO(1) FROM $1", "SELECT ANT FROM $1 HAVING ANT", "SELECT ANT FROM $2",
     "SELECT NAME+1 FROM $1", "SELECT ANT FROM $1 WHERE NAME ~ NAME", "COUNT * FROM $1 trailing", "SELECT ANT FROM $1 ORDERBY alias", "UPDATE $1 SET ANT=1"],
)
def test_refused(spark, probe, text):
    with pytest.raises(TaqlError):
        taql(spark, text, [probe])


def test_terminator_and_case(spark, probe):
    assert run(spark, "select ANT from $1 where upcase(NAME) = 'A';", probe) == [(1,)]
    assert parse("SELECT a FROM $1 WHERE b ORDER BY c DESC LIMIT 3 OFFSET 1").limit == 3


def test_stream(spark, probe, tmp_path):
    probe.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(probe.schema).parquet(f"{tmp_path}/in")
    out = taql_stream(stream, "SELECT WHAT*2 AS w FROM $1 WHERE ANT = 2")
    q = out.writeStream.format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r[0] for r in spark.sql("SELECT * FROM w").collect()) == [40, 80]
    with pytest.raises(TaqlError):
        taql_stream(stream, "SELECT ROWID() FROM $1")
