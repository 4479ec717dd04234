"""Table handles, text tables and measurement sets."""

import numpy as np
import pytest

from taqlspark.engine import taql
from taqlspark.operators.rows import ROWID
from taqlspark.sources.ascii import read_ascii
from taqlspark.sources.ms import LINKED, add_imaging_columns, complete_schema, default_ms, remove_imaging_columns, required_schema
from taqlspark.table import Table, create_table, delete_table, make_array_column, make_scalar_column, make_table, open_table, table_exists
from taqlspark.types import TaqlError


@pytest.fixture()
def small(spark, tmp_path):
    rows = spark.createDataFrame([(0.0, 3), (1.0, 1), (2.0, 2), (3.0, 3), (4.0, 1), (5.0, 2)], "TIME double, ANT int").coalesce(1)
    taql(spark, f"SELECT * INTO {tmp_path}/tq FROM $1", [rows])
    return open_table(spark, f"{tmp_path}/tq")


def test_views(small):
    v = small.query("ANT==3")
    assert list(v.rownumbers()) == [0, 3]
    assert list(v.rownumbers(small)) == [0, 3]
    assert list(small.rownumbers(v)) == [0, -1, -1, 1, -1, -1]
    s = small.sort("ANT DESC")
    assert list(s.getcol("TIME")) == [3.0, 0.0, 5.0, 2.0, 4.0, 1.0]
    chained = s.query("TIME > 1").sort("TIME")
    assert list(chained.rownumbers()) == [2, 3, 4, 5]
    assert list(small.selectrows([4, 0]).getcol("TIME")) == [4.0, 0.0]
    assert small.select("ANT").colnames() == ["ANT"]
    assert chained.taql("SELECT ROWID() AS r, TIME FROM $1").collect()[0] == (0, 2.0)
    with pytest.raises(TaqlError):
        v.putcell("ANT", 0, 1)


def test_reads(small):
    assert list(small.getcol("ANT", 1, 2)) == [1, 2]
    assert list(small.getcol("ANT", -2)) == [1, 2]
    assert small.getcell("TIME", 4) == 4.0
    assert small[2] == {"TIME": 2.0, "ANT": 2}
    assert len(small) == 6
    assert small.getvarcol("ANT", 0, 2) == {"r1": 3, "r2": 1}
    with pytest.raises(ValueError):
        small.getcell("TIME", 6)
    with pytest.raises(TaqlError):
        small.getcol("NOPE")


def test_writes(spark, small):
    with small:
        small.putcol("ANT", [9, 8], 1, 2)
        small.putcell("TIME", 0, 7.5)
        assert small.getcell("ANT", 1) == 9
    again = open_table(spark, small.path)
    assert list(again.getcol("ANT")) == [3, 9, 8, 3, 1, 2]
    again.addrows(2)
    again.removerows([0, 1])
    again.flush()
    assert list(open_table(spark, small.path).getcol("ANT")) == [8, 3, 1, 2, 0, 0]
    with pytest.raises(ValueError):
        again.putcell("ANT", 99, 1)


def test_columns_and_keywords(spark, tmp_path):
    desc = make_table([make_scalar_column("I", 0, comment="count"), make_scalar_column("C", 1j), make_array_column("F", 0.0, shape=[2, 3]), make_array_column("V", 0.0, ndim=1)])
    t = create_table(spark, f"{tmp_path}/t", desc, 3)
    assert t.getcell("F", 0).shape == (2, 3)
    assert not t.iscelldefined("V", 1)
    with pytest.raises(ValueError):
        t.getcell("V", 1)
    t.putcell("V", 1, [1.0, 2.0])
    t.putcol("C", [1 + 2j, 3j, 4])
    t.putcell("F", 2, np.arange(6).reshape(2, 3))
    t.flush()
    t = open_table(spark, f"{tmp_path}/t")
    assert list(t.getcol("C")) == [1 + 2j, 3j, 4]
    assert t.iscelldefined("V", 1) and list(t.getcell("V", 1)) == [1.0, 2.0]
    assert t.getcellslice("F", 2, [0, 1], [1, 2]).tolist() == [[1, 2], [4, 5]]
    assert t.getcolslice("F", [1, 0], [1, 2], [1, 2]).tolist() == [[[0, 0]], [[0, 0]], [[3, 5]]]
    t.putcellslice("F", 0, [[7.0]], [1, 1], [1, 1])
    t.putcolslice("F", [[[1.0]], [[2.0]], [[3.0]]], [0, 0], [0, 0])
    assert t.getcell("F", 0).tolist() == [[1, 0, 0], [0, 7, 0]]
    with pytest.raises(TaqlError):
        t.getcellslice("F", 0, [0, 0], [2, 2])
    t.putkeyword("NEST.HH.II", 5)
    t.putcolkeyword("I", "UNITS", "Jy")
    assert t.getkeyword("NEST.HH.II") == 5 and t.getcolkeyword("I", "UNITS") == "Jy"
    t.removekeyword("NEST.HH.II")
    assert t.getkeyword("NEST.HH") == {}
    assert t.getcoldesc("I")["comment"] == "count" and t.coldatatype("F") == "double"
    t.addcols(make_scalar_column("N", "x"))
    t.removecols("V")
    t.flush()
    assert open_table(spark, t.path).colnames() == ["I", "C", "F", "N"]
    with pytest.raises(ValueError):
        make_table([make_scalar_column("A", 1), make_scalar_column("A", 2)])
    c = t.copy(f"{tmp_path}/copy")
    assert table_exists(spark, c.path)
    delete_table(spark, c.path)
    assert not table_exists(spark, c.path)


def test_ascii(spark, tmp_path):
    (tmp_path / "in.txt").write_text("A B  C D\nI D X S\n1 2.5 3 4 x\n7 oops 5 6 y\n")
    t = read_ascii(spark, f"{tmp_path}/in.txt", f"{tmp_path}/t")
    assert [t[i] for i in range(2)] == [{"A": 1, "B": 2.5, "C": 3 + 4j, "D": "x"}, {"A": 7, "B": 0.0, "C": 5 + 6j, "D": "y"}]
    t.toascii(f"{tmp_path}/out.txt", ["A", "B", "D"])
    assert (tmp_path / "out.txt").read_text() == "A B D\n1 2.5 x\n7 0 y\n"


def test_measurement_set(spark, tmp_path):
    ms = default_ms(spark, f"{tmp_path}/a.ms", make_table([make_array_column("DATA", 1j, shape=[4, 2])]))
    assert len(ms.colnames()) == 22 and len(ms) == 0
    assert len(ms.getsubtables()) == len(LINKED)
    assert open_table(spark, f"{tmp_path}/a.ms::ANTENNA").colnames() == required_schema("ANTENNA").names
    assert ms.getcolkeyword("TIME", "MEASINFO.Ref") == "UTC" and ms.getcolkeywords("ANTENNA1") == {}
    assert [len(complete_schema(t)) for t in ("MAIN", "ANTENNA", "SYSCAL", "WEATHER", "SOURCE")] == [39, 11, 25, 19, 16]
    ms.addrows(2)
    ms.flush()
    add_imaging_columns(ms)
    ms = Table(spark, ms.path)
    assert ms.getcell("MODEL_DATA", 0).shape == (4, 2) and ms.getcell("IMAGING_WEIGHT", 1).tolist() == [0.0] * 4
    remove_imaging_columns(ms)
    assert "MODEL_DATA" not in Table(spark, ms.path).colnames()


def test_many_files(spark, tmp_path):
    """Rows are numbered through all files of a folder, in the order of their names."""
    spark.range(1000).repartitionByRange(7, "id").sortWithinPartitions("id").write.parquet(f"{tmp_path}/p")
    df = open_table(spark, f"{tmp_path}/p").df()
    assert df.where(f"id <> {ROWID}").count() == 0 and df.count() == 1000
